"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix, without all pairs of a group.

Documents with equal sets form a class, and classes are what is joined. Columns (n-grams) are ordered, those of few classes
first, those of more than HEAVY_SHARE of the documents last.

- Columns of one class give no pair. To find them, the matrix is dealt by ranges of columns: chunks of rows send each range the
  columns they have there, packed as binary arrays; a range tells each chunk which of them other classes have too, and how
  many. What is left of a class's set bounds its overlap with any other, so classes that keep less than the similarity asks
  for have no links and go; near copies with edits of their own go here, whatever the size of their group.
- First block of the product: the head of each class's set, the rarest n' - ceil(t * n) + 1 of the n' columns left. Linked classes
  share a column there. To begin with, every class is paired only with one other: each column has a centre, the class with the
  least of its own, and of its columns' centres a class takes the one it shares most columns with; in a group of near copies that
  is what they were made from, and links found so make components. Then overlap counts of pairs from different
  components are accumulated over the columns of the heads, for pairs that meet early enough in the order, by their sizes, to
  reach the similarity, and a pair goes if its count and the rest of the sets can't reach the bound.
- Other blocks: overlap counts of the remaining pairs are accumulated over ranges of columns, and a pair is dropped as soon
  as its overlap so far and what is left can't reach the bound.

What is rare or heavy only orders the columns: any order gives the same links. Columns are 64-bit hashes of n-grams.

Defined results: a text is lower-cased in A-Z; null and blank texts have an empty set and no links; fewer than n words are
one n-gram; rows that share a doc_id but not a set are different documents; a null doc_id has no component and no links;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import bounded_batches, checkpointed
from sparkloom.llm.components import connected_components
from sparkloom.llm.shingles import sets

HEAVY_SHARE, BLOCKS = 0.001, 8
#: Entries of the matrix that a chunk of rows has, and that a range of columns has at most, about; classes of a chunk.
CHUNK, RANGE, MOST_CLASSES = 2_000_000, 4_000_000, 60_000
#: Ids are broadcast up to this count (16 bytes each or so), else shuffled.
MAX_BROADCAST = 500_000


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _described(docs: DataFrame, n: int) -> DataFrame:
    """docs without text, with n (set size) and class (hash of the set)."""
    kind = pa.struct([("n", pa.int64()), ("class", pa.int64())])

    def column(texts: pa.Array) -> pa.Array:
        own = sets(texts.to_pylist(), n)
        return pa.StructArray.from_arrays([pa.array([len(s) for s in own], pa.int64()), pa.array(map(_class_of, own), pa.int64())], fields=list(kind))

    own = [c for c in docs.columns if c != "text"]
    return docs.select(*own, F.arrow_udf(column, "struct<n:bigint,class:bigint>")("text").alias("s")).select(*own, "s.*")


def _surveyed(docs: DataFrame, n: int) -> DataFrame:
    """One reading of the texts: the rows of _described, and rows (g, c) of n-grams that c documents of a million entries or so hold.

    Told are n-grams that three documents, and half of HEAVY_SHARE of those at hand, hold; more precision isn't needed for an order.
    """
    own = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"{c} {t}" for c, t in docs.select(*own).dtypes), "n long", "class long", "g long", "c long"])

    def often(all_of: list[np.ndarray], like: pa.RecordBatch) -> pa.RecordBatch:
        g, c = np.unique(np.concatenate(all_of), return_counts=True)
        keep = c >= max(3, HEAVY_SHARE / 2 * len(all_of))
        g, c = g[keep], c[keep]
        empty = [pa.nulls(len(g), t) for t in [*(like.schema.field(x).type for x in own), pa.int64(), pa.int64()]]
        return pa.RecordBatch.from_arrays([*empty, pa.array(g), pa.array(c)], [*own, "n", "class", "g", "c"])

    def run(batches):
        held, size, batch = [], 0, None
        for batch in batches:
            found = sets(batch.column("text").to_pylist(), n)
            counts = [pa.array([len(s) for s in found], pa.int64()), pa.array(map(_class_of, found), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *counts, pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], [*own, "n", "class", "g", "c"])
            held += found
            size += sum(map(len, found))
            if size > 1_000_000:
                yield often(held, batch)
                held, size = [], 0
        if held:
            yield often(held, batch)

    return checkpointed(docs.select(*own, "text").mapInArrow(run, schema))


def _heavy(surveyed: DataFrame, total: int) -> np.ndarray:
    """N-grams that more than HEAVY_SHARE of the documents hold, rarest first; at most (mean set size) / HEAVY_SHARE."""
    found = surveyed.filter("g is not null").groupBy("g").agg(F.sum("c").alias("c"))
    rows = found.filter(F.col("c") > max(2.0, HEAVY_SHARE * total)).collect()
    return np.array([r["g"] for r in sorted(rows, key=lambda r: (r["c"], r["g"]))], np.int64)


def _planes(g: np.ndarray) -> bytes:
    """Ascending longs by bytes of equal weight: the high ones hardly change, so Spark's compression takes them away."""
    return np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


PACKED = "target int, chunk long, kind int, a binary, b binary, c binary, many long"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
ENTRIES, TABLE, HEAVIES = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def _dealt(n: int, heavy: np.ndarray, ranges: int):
    """Of batches (text): for each chunk of rows its table of classes, its heavy columns, and for each range the chunk's other columns there.

    A chunk is named by a hash of its classes, partition and number there.
    """
    order = np.argsort(heavy)
    known = heavy[order]
    borders = np.array([2**64 * k // ranges - 2**63 for k in range(1, ranges)], np.int64)

    def emit(chunk: dict[int, np.ndarray], number: int):
        classes, own = np.array(list(chunk), np.int64), list(chunk.values())
        name = xxhash.xxh3_64_intdigest(classes.tobytes() + f"{TaskContext.get().partitionId()}.{number}".encode()) - 2**63
        g, row = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.uint16), [len(s) for s in own])
        by = np.argsort(g)
        g, row = g[by], row[by]
        at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
        is_heavy = known[at] == g if len(known) else np.zeros(len(g), bool)
        sizes = np.array([len(s) for s in own], np.int64)
        home = int(name % ranges)
        out = [(home, name, TABLE, classes.tobytes(), sizes.tobytes(), None, int((~is_heavy).sum()))]
        if is_heavy.any():
            out.append((home, name, HEAVIES, order[at[is_heavy]].astype(np.int64).tobytes(), row[is_heavy].tobytes(), None, 0))
        g, row = g[~is_heavy], row[~is_heavy]
        cuts = [0, *np.searchsorted(g, borders).tolist(), len(g)]
        size = 0
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                out.append((k, name, ENTRIES, _planes(g[a:b]), row[a:b].tobytes(), None, b - a))
                size += b - a
            if size > 200_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def run(batches):
        chunk, size, number = {}, 0, 0
        for batch in batches:
            for s in sets(batch.column(0).to_pylist(), n):
                if len(s) and (c := _class_of(s)) not in chunk:
                    chunk[c] = s
                    size += len(s)
                    if size >= CHUNK or len(chunk) >= MOST_CLASSES:
                        yield from emit(chunk, number)
                        chunk, size, number = {}, 0, number + 1
        if chunk:
            yield from emit(chunk, number)

    return run


def _shared(batches):
    """Of one range: to each chunk those of its columns that more than one class has, with the number of classes. Other rows pass."""
    rows, gs = [], []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 6)), strict=True):
            if r[1] == ENTRIES:
                rows.append((r[0], r[3]))
                gs.append(_unplaned(r[2]))
            else:
                yield _rows([(0, r[0], r[1], r[2], r[3], None, r[4])])
    if not rows:
        return
    g = np.concatenate(gs)
    cuts = np.cumsum([0, *map(len, gs)])
    del gs
    by = np.argsort(g)
    new = np.flatnonzero(np.diff(g[by], prepend=~g[by[0]]) != 0)
    runs = np.diff(new, append=len(g)).astype(np.uint32)
    many = np.empty(len(g), np.uint32)
    many[by] = np.repeat(runs, runs)
    del by
    out, size = [], 0
    for (chunk, row), a, b in zip(rows, cuts.tolist(), cuts[1:].tolist(), strict=False):
        keep = many[a:b] > 1
        out.append((0, chunk, ENTRIES, _planes(g[a:b][keep]), np.frombuffer(row, np.uint16)[keep].tobytes(), many[a:b][keep].tobytes(), b - a))
        size += int(keep.sum())
        if size > 100_000:
            yield _rows(out)
            out, size = [], 0
    if out:
        yield _rows(out)


def _alive(percent: int, heavy: np.ndarray):
    """Of rows sorted by chunk: class, n, left (columns others have too), the set of those, ascending, and its head, rarest first, of each class that can have links."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        table = next(r for r in rows if r[1] == TABLE)
        classes, sizes = np.frombuffer(table[2], np.int64), np.frombuffer(table[3], np.int64)
        light = [r for r in rows if r[1] == ENTRIES]
        if sum(r[5] for r in light) != table[5]:
            raise RuntimeError("a chunk's columns came back in part: its texts were read in another order")
        none = [np.zeros(0, np.int64)]
        late = [np.frombuffer(r[2], np.int64) for r in rows if r[1] == HEAVIES] or none
        g = np.concatenate([*none, *(_unplaned(r[2]) for r in light), *(heavy[x] for x in late)])
        row = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r[3], np.uint16) for r in (*light, *(r for r in rows if r[1] == HEAVIES)))]).astype(np.int64)
        rank = np.concatenate([*none, *(np.frombuffer(r[4], np.uint32).astype(np.int64) for r in light), *(x + 2**32 for x in late)])
        left = np.bincount(row, minlength=len(classes))
        least = -(-percent * sizes // 100)
        able = (left >= least) & (left > 0)
        keep = able[row]
        g, row, rank = g[keep], row[keep], rank[keep]
        by = np.lexsort((g, row))
        ends = np.cumsum(np.where(able, left, 0))
        rare = g[np.lexsort((g, rank, row))]
        g = g[by]
        out = []
        for k in np.flatnonzero(able).tolist():
            a, b = int(ends[k] - left[k]), int(ends[k])
            out.append((int(classes[k]), int(sizes[k]), b - a, g[a:b].tobytes(), rare[a : a + int(left[k] - least[k]) + 1].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["class", "n", "left", "columns", "head"])

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                if rows and r[0] != last:
                    yield solve(rows)
                    rows = []
                last = r[0]
                rows.append(r)
        if rows:
            yield solve(rows)

    return run


def _heads(batches):
    """g, class, n, left, place (from 0) of each column of the heads."""
    for batch in batches:
        own = [np.frombuffer(h, np.int64) for h in batch.column("head").to_pylist()]
        sizes = [len(s) for s in own]
        if sum(sizes):
            place = np.concatenate([np.arange(k) for k in sizes])
            wide = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("class", "n", "left")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(own), *wide, place)], ["g", "class", "n", "left", "place"])


def _overlap(percent: int):
    """A column function of two sets (what is left of them, ascending longs as bytes) and their whole sizes: the size of the intersection, or -1 once it can't link them.

    100 * i >= percent * (na + nb - i), so i >= percent * (na + nb) / (100 + percent). Counts are accumulated over BLOCKS ranges of columns.
    """
    edges = np.array([-(2**63) + 2**64 * k // BLOCKS for k in range(1, BLOCKS)], np.int64)

    def column(left: pa.Array, right: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for a, b, x, y in zip(left.to_pylist(), right.to_pylist(), na.to_pylist(), nb.to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            need, got = -(-percent * (x + y) // (100 + percent)), 0
            i, j = [0, *np.searchsorted(a, edges).tolist(), len(a)], [0, *np.searchsorted(b, edges).tolist(), len(b)]
            for k in range(BLOCKS):
                got += len(np.intersect1d(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], assume_unique=True))
                if got + min(len(a) - i[k + 1], len(b) - j[k + 1]) < need:
                    got = -1
                    break
            out.append(got)
        return pa.array(out, pa.int64())

    return F.arrow_udf(column, "bigint")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its count is within the bound."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _linked(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. The last blocks of the product."""
    own = alive.select("class", "n", "columns")
    first = pairs.select("a", "b").join(own.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("columns").alias("ca")), "a")
    full = first.join(own.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("columns").alias("cb")), "b")
    return checkpointed(full.filter(_overlap(percent)("ca", "cb", "na", "nb") >= 0).select("a", "b"))


def _rooted(own: DataFrame, surveyed: DataFrame, n: int, percent: int) -> DataFrame:
    """class, doc_id (the least), root (a class of its component) of every class. own: doc_id (never null), text; surveyed: of at least those."""
    spark = own.sparkSession
    described = surveyed.filter("g is null")
    size = described.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).first()
    heavy = _heavy(surveyed, size["rows"])
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["entries"] // RANGE))
    classes = checkpointed(described.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    firsts = classes.select("doc_id").distinct()
    near = firsts.count() <= MAX_BROADCAST
    texts = own.join(F.broadcast(firsts) if near else firsts, "doc_id", "left_semi")
    if not near:  # rows of a shuffle may come in another order when a lost task is run again; its chunks must be the same ones
        texts = texts.sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt = texts.select("text").mapInArrow(_dealt(n, heavy, ranges), PACKED).repartitionById(ranges, F.col("target"))
    told = dealt.mapInArrow(_shared, PACKED).repartition(ranges, "chunk").sortWithinPartitions("chunk")
    alive = checkpointed(told.mapInArrow(_alive(percent, heavy), "class long, n long, left long, columns binary, head binary"))
    if not alive.groupBy("class").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():  # of repeated rows
        alive = checkpointed(alive.dropDuplicates(["class"]))
    heads = checkpointed(alive.select("class", "n", "left", "head").mapInArrow(_heads, "g long, class long, n long, left long, place long"))

    typical = F.max(F.struct((F.col("left") / F.col("n")).alias("share"), "class", "n")).alias("t")
    centres = heads.groupBy("g").agg(typical, F.count("*").alias("many")).filter("many > 1").select("g", F.col("t.class").alias("centre"), F.col("t.n").alias("size"))
    near = heads.join(centres, "g").filter((F.col("class") != F.col("centre")) & (100 * F.least("n", "size") >= percent * F.greatest("n", "size")))
    stars = near.groupBy("class", "centre").agg(F.count("*").alias("shared")).groupBy("class").agg(F.max(F.struct("shared", "centre")).alias("best"))
    links = _linked(stars.select(F.col("class").alias("a"), F.col("best.centre").alias("b")), alive, percent)

    roots = connected_components(links)
    placed = heads.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("g").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("g")
    placed = checkpointed(placed.join(mixed, "g", "left_semi"))
    side = lambda x: placed.select("g", F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "left", "place")))
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    # A linked pair's shared columns before this one are at most the smaller place, those from here on at most the smaller rest.
    most = F.least("place_a", "place_b") + F.least(F.col("left_a") - F.col("place_a"), F.col("left_b") - F.col("place_b"))
    able = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (most >= need)
    # Common columns that aren't in both heads lie behind the head that ends first, in a tail of n' less its length, ceil(t * n) - 1. So a
    # linked pair shares at least `least` columns of the heads, and the first of them has least - 1 more behind it in either head.
    tail = lambda n: F.expr(f"({percent} * {n} + 99) div 100 - 1")
    least = need - tail("greatest(n_a, n_b)")
    early = lambda x: F.col(f"place_{x}") + least <= F.col(f"left_{x}") - tail(f"n_{x}")
    met = side("a").join(side("b"), "g").filter((F.col("root_a") < F.col("root_b")) & able & early("a") & early("b"))
    pairs = checkpointed(met.select("a", "b", least.alias("least")).distinct())
    own = heads.select("g", "class")
    shared = pairs.join(own.withColumnRenamed("class", "a"), "a").join(own.withColumnRenamed("class", "b"), ["b", "g"])
    across = shared.groupBy("a", "b", "least").agg(F.count("*").alias("got")).filter("got >= least")
    roots = connected_components(links.unionByName(_linked(checkpointed(across.select("a", "b")), alive, percent)))
    return classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. Links: 100 * intersection >= percent * union of word n-gram sets."""
    bounded_batches(docs.sparkSession, 1024, "2m")
    own = docs.select("doc_id", "text")
    surveyed = _surveyed(own, n)
    described = surveyed.filter("g is null")
    labelled = _rooted(own.filter("doc_id is not null"), surveyed, n, percent)
    names = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = labelled.join(names, "root").select("class", "component_id")
    out = described.select("doc_id", "n", "class").join(by_class, "class", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group linked directly or not: that of smallest doc_id (null last), then class, then text. Empty sets link to nothing, so those rows stay.

    A row without doc_id goes by a hash of its text here. Ids whose rows all go, and ids of one row, are settled by the id;
    where rows share an id and some stay, the set tells which.
    """
    bounded_batches(docs.sparkSession, 1024, "2m")
    key = {"absent": F.col("doc_id").isNull(), "doc_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))}
    own = docs.select(*(c.alias(k) for k, c in key.items()), "text")
    surveyed = _surveyed(own, n)
    described = surveyed.filter("g is null")
    labelled = _rooted(own.drop("absent"), surveyed, n, percent).select("class", "root")
    rooted = described.filter("n > 0").groupBy("class").agg(F.min(F.struct("absent", "doc_id")).alias("least")).join(labelled, "class")
    best = rooted.groupBy("root").agg(F.min(F.struct("least", "class")).alias("b")).select("b.class", "b.least.*")
    stay = checkpointed(best.select("class", F.col("absent").alias("absent_of"), F.col("doc_id").alias("id_of")))
    fate = described.select("absent", "doc_id", "n", "class").join(stay, "class", "left")
    fate = fate.withColumn("stays", (F.col("n") == 0) | F.coalesce((F.col("absent") == F.col("absent_of")) & (F.col("doc_id") == F.col("id_of")), F.lit(False)))
    by_id = fate.groupBy("absent", "doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("c"))
    by_id = checkpointed(by_id.filter("not stays or c > 1"))
    gone, mixed = by_id.filter("not stays").select("absent", "doc_id"), by_id.filter("stays").select("absent", "doc_id")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", *(c.alias(k) for k, c in key.items()))
    if not mixed.count():
        return keyed.drop("text").join(_few(gone), ["absent", "doc_id"], "left_anti").select("row.*")
    plain = keyed.drop("text").join(_few(by_id.select("absent", "doc_id")), ["absent", "doc_id"], "left_anti").select("row.*")
    told = _described(keyed.join(_few(mixed), ["absent", "doc_id"], "left_semi").select("row", "text", "absent", "doc_id"), n)
    staying = stay.select("class", F.col("absent_of").alias("absent"), F.col("id_of").alias("doc_id"))
    first = F.row_number().over(Window.partitionBy("absent", "doc_id", "class").orderBy("row.text"))
    one = told.filter("n > 0").join(staying, ["class", "absent", "doc_id"], "left_semi").withColumn("r", first).filter("r = 1")
    return plain.unionByName(told.filter("n = 0").select("row.*")).unionByName(one.select("row.*"))
