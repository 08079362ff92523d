"""Byte-level BPE with the tokenizers library, and its inverse.

A rank file (token bytes and rank a line) becomes a BPE model of the library: each token is a string of the byte table's
characters, and every split of a token into two tokens is a merge, in the order of the ranks. The library's model merges
one match of the split pattern at a time; tables of what was seen before, kept for the life of a Python worker and emptied
at CACHE entries, save most calls. Texts arrive in Arrow batches. Ids map back to bytes by the inverse byte
table, so a character whose bytes lie in two tokens is put together again before UTF-8 is decoded.

Defined results: null counts as an empty text, which has no ids. Repeated rows each get a row; an empty table gives none.
A column of the input that has the name of the new one is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches
from sparkloom.llm.runs import RunEncoder



def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: What keeps a text from being cut at every space: blanks other than space and line end, and a space next to a blank.
_UNEVEN = re.compile(r"[^\S\x20\n]")


class Codec(RunEncoder):
    """Runs are what lies between spaces, a space put before all but a text's first.

    A match of the split pattern holds a space only as its first character, if the space has no blank beside it; so
    such a text is cut at its spaces, and each run is split by the pattern and merged by the library's model.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import models

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        characters = byte_characters()
        shown = {token: "".join(characters[b] for b in token) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = models.BPE({shown[t]: r for t, r in ranks.items()}, merges, cache_capacity=0)
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(characters)})
        self.split = regex.compile(pattern)
        self.by_space = pattern.endswith(r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # what is said above about spaces holds for this pattern
        self.shown = {r: shown[t] for t, r in ranks.items()}
        self.sizes = np.zeros(max(self.shown, default=-1) + 1, np.int64)
        for t, r in ranks.items():
            self.sizes[r] = len(t)
        self.bytes_of = np.zeros(512, np.uint8)  # the byte table's inverse
        for b, c in enumerate(characters):
            self.bytes_of[ord(c)] = b

    def merged(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def run_ids(self, run: str) -> bytes:
        return self.encode_whole(run[1:] if run[:1] == "\0" else " " + run)

    def runs(self, texts: list[str]) -> pa.ListArray:
        return pc.split_pattern(pa.array(["\0" + t for t in texts]), " ")  # the mark of a first run

    def cuttable(self, text: str) -> bool:
        return self.by_space and not ("\0" in text or "  " in text or " \n" in text or "\n " in text or _UNEVEN.search(text))

    def encode_whole(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The ids' characters, put together, and each mapped back to its byte."""
        characters = "".join(map(self.shown.__getitem__, memoryview(ids).cast("I")))
        return self.bytes_of[np.frombuffer(characters.encode("utf-16-le"), np.uint16)].tobytes()

    def offsets(self, data: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the code points of the text, given as UTF-8, that each id's bytes touch, end exclusive; two ids that share a character both have it."""
        sizes = self.sizes[np.frombuffer(ids, np.uint32)]
        ends = np.cumsum(sizes)
        character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        return (character[ends - sizes], character[ends - 1] + 1) if len(ids) else (ends, ends)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with a column out: {ids, starts, ends}, the code points that each id touches. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def column(texts: pa.Array) -> pa.Array:
        own, rows = codec(path, pattern), []
        for t in texts.to_pylist():
            ids = own.encode(t or "")
            starts, ends = own.offsets((t or "").encode(), ids)
            rows.append({"ids": list(memoryview(ids).cast("I")), "starts": starts.tolist(), "ends": ends.tolist()})
        return pa.array(rows, type=kind)

    return docs.withColumn(out, F.arrow_udf(column, "struct<ids:array<int>,starts:array<int>,ends:array<int>>")(F.col(text)))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with a binary column out: the bytes of its ids. Null ids give null."""
    bounded_batches(tokens.sparkSession)

    def column(rows: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if r is None else own.decode(array("I", r).tobytes()) for r in rows.to_pylist()], type=pa.binary())

    return tokens.withColumn(out, F.arrow_udf(column, "binary")(F.col(ids)))


def round_trip_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids and of the bytes decoded from them, and n_split: ids that begin inside a character, by their offsets."""
    bounded_batches(docs.sparkSession, 4096)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64())])

    def column(texts: pa.Array) -> pa.Array:
        own, rows = codec(path, pattern), []
        for ids in own.encode_batch([t or "" for t in texts.to_pylist()]):
            data = own.decode(ids)
            starts, ends = own.offsets(data, ids)
            rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(data).hexdigest(), "n_split": int((starts[1:] < ends[:-1]).sum())})
        return pa.array(rows, type=kind)

    report = F.arrow_udf(column, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,n_split:bigint>")
    return docs.select("doc_id", report("text").alias("r")).select("doc_id", "r.*")
