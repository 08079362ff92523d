"""Best-fit packing of tokenized documents into sequences of a fixed length, by minimum bin slack.

Documents are tokenized in Arrow batches, only longer ones are cut, and just the lengths of the pieces are counted over
the whole corpus: a histogram of at most `length` rows. Minimum bin slack runs on the histogram. The longest remaining
length seeds a bin; a bitset subset-sum dynamic program over the remaining lengths (a length as often as it is left)
finds the combination that fills the bin most; that combination is removed as often as the counts allow, which gives the
same bins as removing it once at a time. Each step uses up a length or leaves fewer of it than one bin would take, so there
are at most length * (1 + ln length) steps. Pieces of one length are numbered across partitions (by buckets, so that a
common length doesn't meet in one task), and a piece's number tells its bin and place.

Defined results: null counts as an empty text, whose only id is the end id. A repeated row is packed as a row of its own.
An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import bounded_batches, checkpointed
from sparkloom.llm.runs import RunEncoder

LENGTH, END_ID = 4096, 1
#: Pieces of a numbering bucket, about.
BUCKET_ROWS = 20_000

# Code points below U+0180 whose normal form, lower case and class are the same for Python and the library; U+0130 has a longer lower case.
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ňŊ-ž"
_PIECE = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s{_LETTERS}0-9\xb2\xb3\xb9\xbc-\xbe]+")


class WordTokenizer(RunEncoder):
    """Runs are what lies between blanks, in lower case; they are split into pieces, and those are merged by the library's model.

    Texts with characters beyond _SIMPLE, or with an added token's content, go through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # an added token that is matched in the normal form can stand in either case
        added = [("(?i:%s)" if t.normalized else "%s") % re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        simple = [chr(c) for c in range(0x21, 0x180) if _SIMPLE.fullmatch(chr(c)) and not chr(c).isspace()]
        self.characters = str.maketrans({c: shown.pre_tokenize_str(c)[0][0] for c in simple})

    def merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.characters))]).tobytes()

    def run_ids(self, run: str) -> bytes:
        return b"".join(map(self.piece_ids, _PIECE.findall(run)))

    def runs(self, texts: list[str]) -> pa.ListArray:
        return pc.ascii_split_whitespace(pa.array([t.lower() for t in texts]))

    def cuttable(self, text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and self.added.search(text) is None

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids of each piece of each document."""
    bounded_batches(docs.sparkSession, 1024, "2m")
    fields = [("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"), ("length", pa.int64(), "bigint"), ("ids_crc32", pa.int64(), "bigint")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids
    kind, sql = pa.list_(pa.struct([f[:2] for f in fields])), f"array<struct<{','.join(f'{n}:{s}' for n, _, s in fields)}>>"

    def column(texts: pa.Array) -> pa.Array:
        own, rows = tokenizer(path), []
        end = array("I", [END_ID]).tobytes()
        for body in own.encode_batch([t or "" for t in texts.to_pylist()]):
            ids, row = body + end, []
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                row.append({"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} | ({"ids": list(memoryview(part).cast("I"))} if with_ids else {}))
            rows.append(row)
        return pa.array(rows, type=kind)

    return docs.select("doc_id", F.explode(F.arrow_udf(column, sql)("text")).alias("p")).select("doc_id", "p.*")


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How often to take each length so that the sum is as large as it can be within room; counts limit the lengths.

    A bit of reach tells that its sum can be made. Lengths are added from the long to the short, each up to its count by
    powers of two; the states before each addition lead back to the choice. Once room itself can be made, the rest isn't tried.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, block = min(counts[size], room // size), 1
        while left:
            many = min(block, left)
            steps.append((size, many, reach))
            reach |= (reach << (size * many)) & mask
            left -= many
            block *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for size, many, before in reversed(steps):
        if not before >> at & 1:
            at -= size * many
            taken[size] = taken.get(size, 0) + many
    return taken


def bins(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """(how often each length is in the bin, how many such bins), by minimum bin slack."""
    left, out = dict(histogram), []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(length - seed, left)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[size] // n for size, n in chosen.items())
        for size, n in chosen.items():
            left[size] -= times * n
            if not left[size]:
                del left[size]
        out.append((chosen, times))
    return out


def _places(found: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, times a bin holds it, first bin, offset), by the first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for chosen, times in found:
        offset = 0
        for size, n in sorted(chosen.items(), reverse=True):
            out.setdefault(size, []).append((used.get(size, 0), n, first, offset))
            used[size] = used.get(size, 0) + n * times
            offset += size * n
        first += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in out.items()}


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts (rows with a length of at most `length`, checkpointed) with sequence_id and offset."""
    total = parts.count()
    buckets = max(64, total // BUCKET_ROWS)
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = checkpointed(sizes.withColumn("before", F.coalesce(before, F.lit(0))))
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    places = _places(bins(histogram, length))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("number", within - 1).join(firsts.drop("n"), ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before"))

    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        sizes, number = lengths.to_numpy(), numbers.to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            rows, own = places[int(size)], np.flatnonzero(sizes == size)
            row = rows[np.searchsorted(rows[:, 0], number[own], side="right") - 1]
            at = number[own] - row[:, 0]
            sequence[own], offset[own] = row[:, 2] + at // row[:, 1], row[:, 3] + at % row[:, 1] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    out = numbered.withColumn("place", F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")("length", "number"))
    return out.select(*parts.columns, "place.*")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids, if wanted), sequence_id, offset. Texts are tokenized once."""
    return pack(checkpointed(pieces(docs.select("doc_id", "text"), path, length, with_ids)), length)
