"""Suffix-array dedup: removes every byte that a WIDTH-byte string covers which also starts earlier.

Two windows of WIDTH bytes are equal only if they hold the same anchor: the GRAM bytes of least hash in the window (a
minimizer). So the text falls into segments, runs of windows with one anchor, about every 40 bytes:

1. Each chunk of a partition lists its segments (anchor, hash of the segment's bytes, place); copies inside the chunk are
   settled at once, and so are later copies in the partition of what a chunk has twice, so that a common passage gives
   some rows a partition. The rest are dealt by anchor. Segments equal to an earlier one are repeats in all their windows.
   Different segments can share a window only if they agree in half of its other bytes, on one side of the anchor; segments that
   agree with none go, and that's most of the text.
2. Different segments with one anchor may share some windows. Their bytes are fetched, dealt by anchor, and the
   suffixes of these texts are sorted by the difference-cover algorithm: triples of symbols at positions 1 and 2 modulo 3
   are sorted and named, the names are sorted by recursion, the remaining suffixes are sorted by their first symbol
   and the next rank, and both are merged. Recursion ends when all names differ. Neighbours in this
   order whose first WIDTH bytes agree are one class, and all but its first place are repeats.
   Anchors with more than MOST_SEGMENTS segments are dealt by window instead (hash of its bytes), so no group is one task's.
3. Repeated windows are gathered by document, and their bytes are cut out.

Order of places: doc_id (null first), then start; rows that share a doc_id are ordered by a checksum of the text, those without
one by a hash of it, and rows that are equal in both count as one document, each with its result. Defined results: null
counts as an empty text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.storage import written
from sparkloom.llm.common import bounded_batches, checkpointed

WIDTH, GRAM = 100, 16
#: Bytes that are looked at together, and sorted together.
CHUNK, SORT_CHUNK = 1_000_000, 400_000
MOST_SEGMENTS, MOST_HELD = 2_000, 500_000
#: Copied segments that a task remembers, to settle copies early; copies of those it forgets are settled after the shuffle.
REMEMBERED = 200_000
#: Anchors are broadcast up to this count, else shuffled.
MAX_BROADCAST = 500_000

_RNG = np.random.Generator(np.random.PCG64(17))
_BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_FACTORS = [np.uint64(0x9E3779B97F4A7C15)]
with np.errstate(over="ignore"):
    while len(_FACTORS) < 4:
        _FACTORS.append(_FACTORS[-1] * _FACTORS[-1])


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place, by doubling."""
    h, size = _BYTES[codes], 1
    with np.errstate(over="ignore"):
        for f in _FACTORS:
            h = h[:-size] * f + h[size:]
            size *= 2
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from minima up to and from the borders of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """_BASE to the powers 0 to n - 1, and its inverse."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (_BASE, _BACK)]
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def segments(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, body, sides) of each segment of data.

    body is a hash of the segment's bytes, never REPEAT. A window has half of what it holds beside the anchor on the left or on
    the right of it; sides are 16-bit hashes of that many bytes on either side (left in the high half), 0 where no window
    of the segment reaches that far. Segments that share a window share a side.
    """
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 5
    h = _gram_hashes(np.frombuffer(data, np.uint8))
    low = np.uint64(0xFFFFFFFF)
    least = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    many = np.diff(first, append=len(at))
    place, last = at[first], first + many - 1
    with np.errstate(over="ignore"):
        up, down = _power(max(len(h), CHUNK + width))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
        body = _mixed((sums[last + width - GRAM + 1] - sums[first]) * down[first] + many.astype(np.uint64)) | np.uint64(1)
        side = -(-(width - GRAM) // 2)
        if side < GRAM:
            return h[place].view(np.int64), first, many, body.view(np.int64), np.full(len(first), 0x10001, np.int64)
        parts = [*range(0, side - GRAM, GRAM), side - GRAM]

        def of(start: np.ndarray, able: np.ndarray) -> np.ndarray:
            start = np.where(able, start, 0)
            x = sum((h[start + k] * up[k + 1] for k in parts), np.zeros(len(start), np.uint64))
            return np.where(able, np.maximum(_mixed(x) >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.int64)

        left, right = of(place - side, place - first >= side), of(place + GRAM, last + width - (place + GRAM) >= side)
    return h[place].view(np.int64), first, many, body.view(np.int64), left << 16 | right


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """(doc, sum) tell documents apart: the id and 24 bits of the text's CRC-32. Without an id, doc is among the 2^40 least longs, by 40 bits of another hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    nameless = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(t), 24)
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("doc"), F.crc32(F.encode(t, "UTF-8")).bitwiseAND(0xFFFFFF).alias("sum"))


# A place is one long: checksum (24 bits), start (32 bits), windows (8 bits); within a document it orders by start.
def _place(check: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (check << 40) | (start << 8) | windows


def _start(place):
    return (place >> 8) & 0xFFFFFFFF


ROW = "anchor long, body long, doc long, place long, sides int"
REPEAT = 0


class _Remembered:
    """Segments that a chunk had more than once, each with a place of it that was passed on; one body an anchor."""

    def __init__(self) -> None:
        self.rows = [np.zeros(0, np.int64)] * 4

    def settle(self, anchor: np.ndarray, body: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which segments are copies that start later than the place known, and which are at that place."""
        known, bodies, docs, places = self.rows
        if not len(known):
            return (np.zeros(len(anchor), bool),) * 2
        at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        found = (known[at] == anchor) & (bodies[at] == body)
        same = found & (docs[at] == doc)
        return found & (doc > docs[at]) | same & (place > places[at]), same & (place == places[at])

    def add(self, *rows: np.ndarray) -> None:
        """Rows (anchor, body, doc, place) that were passed on; the newest are kept."""
        both = [np.concatenate(x) for x in zip(rows, self.rows, strict=True)] if len(self.rows[0]) + len(rows[0]) <= REMEMBERED else list(rows)
        _, first = np.unique(both[0], return_index=True)
        self.rows = [x[first[:REMEMBERED]] for x in both]


def _listed(width: int):
    """Of batches (doc, sum, text): the chunk's segments, and as body REPEAT those that repeat one of the same chunk or one remembered, dealt at random."""

    def emit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], remembered: _Remembered) -> pa.RecordBatch:
        anchor, body, place, sides = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3, 4))
        doc = np.concatenate([np.full(len(r[1]), r[0], np.int64) for r in rows])
        order = np.lexsort((place, doc, body, anchor))
        anchor, body, doc, place, sides = anchor[order], body[order], doc[order], place[order], sides[order]
        other = np.ones(len(order), bool)
        other[1:] = (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        anchor, body, doc, place, sides = anchor[other], body[other], doc[other], place[other], sides[other]  # without those of a document that is there twice
        again = np.zeros(len(anchor), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (body[1:] == body[:-1])
        later, there = remembered.settle(anchor, body, doc, place)
        copied = np.zeros(len(anchor), bool)
        copied[:-1] = again[1:]
        first = copied & ~again & ~later & ~there
        remembered.add(anchor[first], body[first], doc[first], place[first])
        again |= later
        anchor, body, doc, place, sides, again = (x[~there] for x in (anchor, body, doc, place, sides, again))
        place_of = doc * 31 + place
        anchor[again], body[again], sides[again] = place_of[again], REPEAT, 0
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (anchor, body, doc, place)), pa.array(sides.astype(np.uint32).view(np.int32))], ["anchor", "body", "doc", "place", "sides"])

    def run(batches):
        rows, size, remembered = [], 0, _Remembered()
        for batch in batches:
            for doc, check, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                for at in range(0, max(0, len(data) - width + 1), CHUNK):
                    part = data[at : at + CHUNK + width - 1]
                    anchor, first, many, body, sides = segments(part, width)
                    rows.append((doc, anchor, body, _place(np.int64(check), first + at, many), sides))
                    size += len(part)
                    if size >= CHUNK:
                        yield emit(rows, remembered)
                        rows, size = [], 0
        if rows:
            yield emit(rows, remembered)

    return run


def _settled(batches):
    """Of rows sorted by anchor, body, doc, place: repeats (kind 0), and the first of each different segment of an anchor that has a side in common with another (kind 1).

    Whole anchors are looked at together; of one with more than MOST_HELD different segments, which isn't held whole, all count.
    """
    last, held, open_anchor = None, [], None

    def again(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = _mixed(anchor.view(np.uint64) + side.astype(np.uint64) * _BASE)
        _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
        return (side > 0) & (counts[place] > 1)

    def out(gone: list[np.ndarray], whole: list[np.ndarray]) -> pa.RecordBatch:
        anchor, doc, place, sides = whole
        if len(anchor):
            keep = again(anchor, sides >> 16 & 0xFFFF) | again(anchor, (sides & 0xFFFF) | np.where(sides & 0xFFFF, 0x10000, 0))
            if open_anchor is not None:
                keep |= anchor == open_anchor
            anchor, doc, place = anchor[keep], doc[keep], place[keep]
            start = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]) != 0)
            number = np.arange(len(anchor)) - np.repeat(start, np.diff(start, append=len(anchor))) + 1 if len(anchor) else anchor
        else:
            anchor, doc, place, number = (np.zeros(0, np.int64),) * 4
        n, m = len(gone[0]), len(anchor)
        columns = [np.repeat([0, 1], [n, m]), *(np.concatenate(x) for x in ((np.zeros(n, np.int64), anchor), (gone[0], doc), (gone[1], place), (np.zeros(n, np.int64), number)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "anchor", "doc", "place", "others"])

    none = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        anchor, body, doc, place, sides = (batch.column(k).to_numpy() for k in range(5))
        if not len(anchor):
            continue
        same_anchor = np.zeros(len(anchor), bool)
        same_body = np.zeros(len(anchor), bool)
        same_anchor[1:] = anchor[1:] == anchor[:-1]
        same_body[1:] = same_anchor[1:] & (body[1:] == body[:-1])
        same_place = np.zeros(len(anchor), bool)
        same_place[1:] = same_body[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        if last:
            same_anchor[0] = anchor[0] == last[0]
            same_body[0] = same_anchor[0] and body[0] == last[1]
            same_place[0] = same_body[0] and doc[0] == last[2] and place[0] == last[3]
        last = (anchor[-1], body[-1], doc[-1], place[-1])
        # a segment at the same place is of a document that is there twice
        gone = (body == REPEAT) | same_body & ~same_place
        new = (body != REPEAT) & ~same_body
        held.append([anchor[new], doc[new], place[new], sides[new].view(np.uint32).astype(np.int64)])
        size = sum(len(x[0]) for x in held)
        if size < 100_000:
            yield out([doc[gone], place[gone]], none)
            continue
        every = [np.concatenate(x) for x in zip(*held, strict=True)]
        # the last anchor may go on
        cut = int(np.flatnonzero(every[0] != every[0][-1])[-1]) + 1 if every[0][0] != every[0][-1] else 0
        if not cut and size > MOST_HELD:
            cut, open_anchor = size, every[0][0]
        yield out([doc[gone], place[gone]], [x[:cut] for x in every])
        held = [[x[cut:] for x in every]]
    if held:
        yield out([np.zeros(0, np.int64)] * 2, [np.concatenate(x) for x in zip(*held, strict=True)])


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The places of symbols (small positive integers) in the order of their suffixes, by difference cover modulo 3."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    one = np.arange(1, n + 1, 3) if n % 3 == 1 else np.arange(1, n, 3)  # a place past the end keeps the two halves apart
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(s.max()) + 1
    if top < 2**20:
        keys = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        differs = sorted_keys[1:] != sorted_keys[:-1]
    else:
        order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
        t = np.stack([s[sample + k] for k in range(3)])[:, order]
        differs = (t[:, 1:] != t[:, :-1]).any(0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(differs)])
    if names.max() < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    size = np.int64(n + 4)
    zero_key = s[zero] * size + rank[zero + 1]
    zero = zero[np.argsort(zero_key, kind="stable")]
    # Merge: how many of the sample come before each remaining suffix, by residue.
    is_one = sorted_sample % 3 == 1
    ones, twos = sorted_sample[is_one], sorted_sample[~is_one]
    ahead = np.searchsorted(s[ones] * size + rank[ones + 1], s[zero] * size + rank[zero + 1])
    pair = lambda i: (s[i] * top + s[i + 1]) * size + rank[i + 2]
    if top * top < 2**62 // int(size):
        ahead = ahead + np.searchsorted(pair(twos), pair(zero))
    else:
        both = np.concatenate([twos, zero])
        by = np.lexsort((np.concatenate([np.zeros(len(twos)), np.ones(len(zero))]), rank[both + 2], s[both + 1], s[both]))
        of_two = by < len(twos)
        ahead = ahead + np.cumsum(of_two)[~of_two]
    out = np.empty(n, np.int64)
    at = ahead + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sorted_sample
    return out


def repeated_windows(texts: list[bytes], keys: list[tuple], width: int = WIDTH) -> list[tuple[int, int]]:
    """(text, window) of all windows that equal one with a smaller key, then smaller start; sorted suffixes, neighbours compared."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(b"\0".join(texts) + b"\0" + b"\0" * width, np.uint8)
    symbols = data[: starts[-1]].astype(np.int64) + 2
    symbols[starts[1:] - 1] = 1  # the end of a text
    order = suffix_order(symbols)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    whole = np.flatnonzero(starts[owner[order] + 1] - 1 - order >= width)
    order = order[whole]
    equal = np.ones(max(0, len(order) - 1), bool)
    for k in range(0, width, 4):  # neighbours that still agree
        left = np.flatnonzero(equal)
        if not len(left):
            break
        for j in range(k, min(k + 4, width)):
            equal[left] &= data[order[left] + j] == data[order[left + 1] + j]
    group = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else np.zeros(0, int)
    rank = np.empty(len(texts), np.int64)
    rank[sorted(range(len(texts)), key=lambda i: keys[i])] = np.arange(len(texts))
    text = owner[order]
    by = np.lexsort((order, rank[text], group))
    again = np.zeros(len(order), bool)
    again[1:] = group[by][1:] == group[by][:-1]
    hit = order[by[again]]
    return list(zip(owner[hit].tolist(), (hit - starts[owner[hit]]).tolist(), strict=True))


def _sorted_out(width: int):
    """Of rows (anchor, doc, place, bytes) sorted so: repeats, by sorting the suffixes of whole anchors together."""

    def solve(rows: list[tuple[int, int, int, bytes]]):
        found = repeated_windows([r[3] for r in rows], [(r[1], r[2]) for r in rows], width)
        docs, places = [rows[i][1] for i, _ in found], [(((rows[i][2] >> 8) + w) << 8) | 1 for i, w in found]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], ["doc", "place"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rows and row[:3] == rows[-1][:3]:
                    continue  # of a document that is there twice
                if size >= SORT_CHUNK and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield solve(rows)

    return run


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, place of all repeated runs of windows; docs: doc_id, text. width: up to 270 bytes, as a place holds 255 windows of an anchor."""
    if width > 255 + GRAM - 1:
        raise ValueError(f"width {width} is above {255 + GRAM - 1}")
    bounded_batches(docs.sparkSession, 1024, "2m")
    listed = docs.select(document_key().alias("k"), "text").select("k.*", "text").mapInArrow(_listed(width), ROW)
    dealt = listed.repartition("anchor").sortWithinPartitions("anchor", "body", "doc", "place")
    settled = checkpointed(dealt.mapInArrow(_settled, "kind long, anchor long, doc long, place long, others long"))
    several = settled.filter("kind = 1")
    crowded = checkpointed(several.groupBy("anchor").agg(F.max("others").alias("most")).filter(F.col("most") > MOST_SEGMENTS).select("anchor"))
    any_crowded = crowded.count()
    if 0 < any_crowded <= MAX_BROADCAST:
        crowded = F.broadcast(crowded)
    fetched = _fetched(docs, several, width)  # shuffles all texts, so once
    if any_crowded:
        fetched = written(fetched)
    calm = (fetched.join(crowded, "anchor", "left_anti") if any_crowded else fetched).repartition("anchor").sortWithinPartitions("anchor", "doc", "place")
    found = [settled.filter("kind = 0").select("doc", "place"), checkpointed(calm.mapInArrow(_sorted_out(width), "doc long, place long"))]
    if any_crowded:
        pieces = fetched.join(crowded, "anchor", "left_semi")
        windows = pieces.select("doc", "place", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - width)).alias("w"))
        window = F.substring("bytes", F.col("w") + 1, F.lit(width))
        windows = checkpointed(windows.select("doc", (F.shiftleft(F.shiftright("place", 8) + F.col("w"), 8) + 1).alias("place"), F.xxhash64(F.lit(1), window).alias("h1"), F.xxhash64(F.lit(2), window).alias("h2")))
        least = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("h1", "h2", "first")
        found.append(checkpointed(windows.join(least, ["h1", "h2"]).filter(F.struct("doc", "place") > F.col("first")).select("doc", "place")))
    return reduce(DataFrame.unionByName, found)


def _fetched(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """anchor, doc, place, bytes of the segments in wanted (anchor, doc, place)."""
    by_doc = wanted.select("anchor", "doc", "place", F.shiftright("place", 40).bitwiseAND(0xFFFFFF).alias("sum")).groupBy("doc", "sum").agg(F.collect_list(F.struct("anchor", "place")).alias("of"))
    keyed = docs.select(document_key().alias("k"), "text").select("k.*", "text")

    def cut(texts: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for text, rows in zip(texts.to_pylist(), of.to_pylist(), strict=True):
            data = (text or "").encode()
            out.append([data[_start(r["place"]) : _start(r["place"]) + (r["place"] & 0xFF) + width - 1] for r in rows])
        return pa.array(out, pa.list_(pa.binary()))

    fetched = keyed.join(by_doc.hint("shuffle_hash"), ["doc", "sum"]).select("doc", "of", F.arrow_udf(cut, "array<binary>")("text", "of").alias("bytes"))
    return fetched.select("doc", F.explode(F.arrays_zip("of", "bytes")).alias("p")).select(F.col("p.of.anchor").alias("anchor"), "doc", F.col("p.of.place").alias("place"), F.col("p.bytes").alias("bytes"))


def _runs(places: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[list[int]] = []
    for a, b in sorted((_start(p), _start(p) + (p & 0xFF) + width - 1) for p in places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_repeats(docs: DataFrame, width: int = WIDTH, out: str = "repeats", columns: list[str] | None = None) -> DataFrame:
    """docs with a column out: {n_bytes, runs: [{start, end}] of repeated bytes, kept: the other bytes}."""
    found = repeats(docs.select("doc_id", "text"), width)
    by_doc = found.select("doc", F.shiftright("place", 40).bitwiseAND(0xFFFFFF).alias("sum"), "place").groupBy("doc", "sum").agg(F.collect_list("place").alias("places"))
    keyed = docs.select(F.struct(*(columns or docs.columns)).alias("row"), "text", document_key().alias("k")).select("row", "text", "k.*")
    kind = pa.struct([("n_bytes", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def column(texts: pa.Array, places: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            data = (text or "").encode()
            runs, kept, last = _runs(own or [], width), [], 0
            for a, b in runs:
                kept.append(data[last:a])
                last = b
            rows.append({"n_bytes": len(data), "runs": [{"start": a, "end": b} for a, b in runs], "kept": b"".join([*kept, data[last:]])})
        return pa.array(rows, type=kind)

    udf = F.arrow_udf(column, "struct<n_bytes:bigint,runs:array<struct<start:bigint,end:bigint>>,kept:binary>")
    return keyed.join(by_doc.hint("shuffle_hash"), ["doc", "sum"], "left").select("row", udf("text", "places").alias(out)).select("row.*", out)


def repeat_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    r = F.col("repeats")
    cut = F.aggregate(r["runs"], F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    own = with_repeats(docs.select("doc_id", "text"), width, columns=["doc_id"])
    return own.select("doc_id", r["n_bytes"].alias("n_bytes"), cut.alias("n_removed"), F.size(r["runs"]).cast("long").alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated bytes cut out of text (a character that loses a byte goes), and n_chars, if there is one, counted anew."""
    def column(kept: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    out = with_repeats(docs, width, "repeats_of_text")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.arrow_udf(column, "string")(F.col("repeats_of_text.kept")))).drop("repeats_of_text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
