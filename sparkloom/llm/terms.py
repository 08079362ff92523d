"""Words of many texts at once, as numbers of a vocabulary.

A word is a maximal run of digits, letters a to z in either case, and characters beyond ASCII; only A-Z are lower-cased. In
UTF-8 these are the bytes of the runs, so texts are cut as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0 for b in range(256))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where each text's words begin and the last ones end. Null has none."""
    each = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = b"\0".join(each).translate(_KEPT)
    codes = np.frombuffer(data, np.uint8)
    inside = codes != 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum(np.concatenate([[0], ends - starts]), dtype=np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])])
    text_starts = np.cumsum([0, *(len(t) + 1 for t in each)], dtype=np.int64)
    return words, np.searchsorted(starts, text_starts)


def numbered(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word its place in the vocabulary (-1 for others), and where each text's words begin and the last ones end."""
    words, bounds = cut(texts)
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False), bounds


def item_blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple]]:
    """The distinct (key, text) of a query set, in blocks of about `most` code points that the driver can hold and broadcast."""
    wanted = items.select(key, F.coalesce(text, F.lit("")).alias(text)).distinct()
    size = wanted.agg(F.sum(F.length(text))).first()[0] or 0  # one row
    parts = max(1, -(-size // most))
    for p in range(parts):
        part = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64(key, text), F.lit(parts)) == p)
        if rows := [tuple(r) for r in part.collect()]:
            yield rows
