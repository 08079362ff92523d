"""The prefix trie of conversations and the totals of its subtrees, by parallel tree contraction.

1. Turns become a digest and a length, and their texts are dropped before anything is shuffled. A prefix is named by two sums
   of digest * BASE ** place modulo the prime 2 ** 61 - 1. Such sums can be put together from parts, so turns are dealt by ranges of
   (conv_id, turn), summed in their range, and the few conversations that go over a range's end are carried on. A
   conversation of any length is many tasks' work.
2. Rebuilt conversations need their base's first five sums and their own sums only: prefix names are computed from both.
   Nodes are the distinct names.
3. Tree contraction: a round rakes all leaves into their parents and compresses chains: of the nodes with one child, those whose hash is
   larger than their parent's and child's are taken out, and the child is hung on their parent with what they hold as an offset.
   Every join of a round is by unique ids, children are summed before they are shuffled, and rounds grow with the logarithm of the nodes.
4. Contracted nodes are re-expanded: their links, each to the next node that was left below, are shortened by doubling until
   they end at raked nodes, whose totals are known.
5. The ids of the conversations that end at a node are written as runs of at most RUN bytes in sorted ranges; a node's runs,
   in order, go through one hash.

Defined results: turns of one conversation are ordered by turn, null first; equal ones by the SHA-256 hex of role, a line
feed, the length of the role in code points, a line feed and the text. Rows without a conv_id belong to no conversation. An empty table has
no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import written
from sparkloom.llm.common import checkpointed

PRIME = 2**61 - 1
BASES = (0x1B8F3D5C7A9E2461 % PRIME, 0x0D4C9B7E5F3A1826 % PRIME)
#: Turns that are taken from the base of a conversation, and how many conversations share a base.
HEADS, FAMILY = 6, 100
#: Bytes of a run of ids.
RUN = 1_000_000
ROOT = bytes(16)


def _key(sums: tuple[int, int]) -> bytes:
    return sums[0].to_bytes(8) + sums[1].to_bytes(8)


def _sums(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8]), int.from_bytes(key[8:])


def _shifted(key: bytes, places: int) -> tuple[int, int]:
    """The sums of a stretch moved by so many places (left, if negative)."""
    a, b = _sums(key)
    return a * pow(BASES[0], places, PRIME) % PRIME, b * pow(BASES[1], places, PRIME) % PRIME


def _joined(key: bytes, places: int, more: bytes) -> bytes:
    """The name of a prefix of so many places followed by a stretch."""
    (a, b), (c, d) = _sums(key), _shifted(more, places)
    return _key(((a + c) % PRIME, (b + d) % PRIME))


def _minus(key: bytes, places: int, whole: bytes) -> bytes:
    """The name of what follows a prefix (key, of so many places) in a whole."""
    (a, b), (c, d) = _sums(key), _sums(whole)
    return _key(_shifted(_key(((c - a) % PRIME, (d - b) % PRIME)), -places))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: place and name of the prefix inside this range."""
    conv, place, a, b, pa_, pb = None, 0, 0, 0, 1, 1
    for batch in batches:
        places, keys = [], []
        for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if c != conv:
                conv, place, a, b, pa_, pb = c, 0, 0, 0, 1, 1
            a = (a + int(digest[:16], 16) * pa_) % PRIME
            b = (b + int(digest[16:32], 16) * pb) % PRIME
            pa_, pb = pa_ * BASES[0] % PRIME, pb * BASES[1] % PRIME
            place += 1
            places.append(place)
            keys.append(_key((a, b)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(places, pa.int64()), pa.array(keys, pa.binary()), batch.column("chars")], ["conv_id", "part", "place", "key", "chars"])


def _carried(carry: dict[tuple[int, int], tuple[int, bytes]]):
    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = list(zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist(), strict=True))
            places, keys = batch.column("place").to_pylist(), batch.column("key").to_pylist()
            for i, owner in enumerate(owners):
                if owner in carry:
                    n, before = carry[owner]
                    places[i], keys[i] = places[i] + n, _joined(before, n, keys[i])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(keys, pa.binary()), batch.column("chars")], ["conv_id", "place", "key", "chars"])

    return carried


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key (the name of the turns up to it), chars (code points of its text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(role, F.lit("\n"), F.length(role).cast("string"), F.lit("\n"), text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    ranged = turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    own = checkpointed(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_summed, "conv_id long, part int, place long, key binary, chars long"))
    # One row a range for the conversation that it begins with, and one for each that goes on in the next: at most two a range.
    ends = own.groupBy("conv_id", "part").agg(F.max_by(F.struct("place", "key"), "place").alias("e"))
    several = ends.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).filter("n > 1").orderBy("conv_id", "part")
    carry, last = {}, (None, 0, ROOT)
    for conv, part, (n, key), _ in several.collect():
        places, before = last[1:] if last[0] == conv else (0, ROOT)
        carry[part, conv] = places, before
        last = conv, places + n, _joined(before, places, key)
    return own.mapInArrow(_carried(carry), "conv_id long, place long, key binary, chars long")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of own turns after the first h, behind the base's first ones."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("place", "key", "before", "h", "skipped", "heads", "head")), strict=True)
        keys, parents, depths = [], [], []
        for place, key, before, h, skipped, heads, head in rows:
            keys.append(_joined(head, heads, _minus(skipped, h, key)))
            parents.append(head if place == h + 1 else _joined(head, heads, _minus(skipped, h, before)))
            depths.append(place - h + heads)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column("chars")], ["conv_id", "depth", "key", "parent", "chars"])


def members(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, key, parent, chars of every prefix of every rebuilt conversation but the root; and conv_id, key of where each ends."""
    turns = checkpointed(_with_before(prefixes(conversations)))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    takes = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", "n", base.alias("base"), takes.alias("h"))
    early = turns.filter(F.col("place") < HEADS)
    bases = early.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "key", F.col("before").alias("parent"), "chars")
    # The base's first h turns: at most five rows a conversation.
    heads = checkpointed(convs.join(bases, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "key", "parent", "chars"))
    head = heads.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("e")).select("conv_id", F.col("e.depth").alias("heads"), F.col("e.key").alias("head"))
    skipped = early.select("conv_id", F.col("place").alias("h"), F.col("key").alias("skipped"))
    facts = convs.join(skipped, ["conv_id", "h"], "left").join(head, "conv_id", "left")
    root = F.lit(ROOT)
    facts = checkpointed(facts.select("conv_id", "h", "n", F.coalesce("skipped", root).alias("skipped"), F.coalesce("heads", F.lit(0)).alias("heads"), F.coalesce("head", root).alias("head")))
    own = turns.join(facts, "conv_id").filter(F.col("place") > F.col("h"))
    tail = own.mapInArrow(_rebuilt, "conv_id long, depth long, key binary, parent binary, chars long")
    every = checkpointed(heads.unionByName(tail))
    ends = every.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    nowhere = facts.filter("heads = 0 and n <= h").select("conv_id", root.alias("key"))
    return every, ends.unionByName(nowhere)


def _with_before(turns: DataFrame) -> DataFrame:
    """Adds before, the name of the turns before each."""
    after = turns.select("conv_id", (F.col("place") + 1).alias("place"), F.col("key").alias("before"))
    return turns.join(after, ["conv_id", "place"], "left").withColumn("before", F.coalesce("before", F.lit(ROOT)))


def subtree_totals(nodes: DataFrame, figures: list[str]) -> DataFrame:
    """key and the totals of figures (longs) over the subtree of each node of nodes(key, parent, figures); the roots' parent is null."""
    return _expanded(*_contracted(nodes, figures), figures)


def _contracted(nodes: DataFrame, figures: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rounds: raked nodes with their totals; contracted ones with where they lead to (to) and what they have beside its total."""
    own, delivered, offsets = [f"own_{f}" for f in figures], [f"in_{f}" for f in figures], [f"off_{f}" for f in figures]
    zero = F.lit(0).cast("long")
    live = nodes.select("key", "parent", *(F.col(f).alias(o) for f, o in zip(figures, own, strict=True)), *(zero.alias(o) for o in offsets))
    raked, contracted, turn = [], [], 0
    while True:
        kids = live.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"), F.min("key").alias("child")).withColumnRenamed("parent", "key")
        marked = written(live.join(kids, "key", "left"))
        leaf = marked.filter("kids is null")
        raked.append(leaf.select("key", *(F.col(o).alias(f) for f, o in zip(figures, own, strict=True))))
        rest = marked.filter("kids is not null")
        if rest.isEmpty():
            break
        sent = leaf.filter("parent is not null").groupBy("parent").agg(*(F.sum(F.col(o) + F.col(off)).alias(d) for o, off, d in zip(own, offsets, delivered, strict=True)))
        rest = rest.join(sent.withColumnRenamed("parent", "key"), "key", "left")
        # A chain's node that gets nothing this round: its child stays. Of neighbours, only the one of the largest hash goes.
        coin = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), c)  # noqa: E731, B023
        goes = (F.col("kids") == 1) & F.col(delivered[0]).isNull() & F.col("parent").isNotNull() & (coin(F.col("key")) > coin(F.col("parent"))) & (coin(F.col("key")) > coin(F.col("child")))
        rest = rest.withColumn("goes", F.coalesce(goes, F.lit(False)))
        rest = written(rest.withColumns({o: F.col(o) + F.coalesce(d, zero) for o, d in zip(own, delivered, strict=True)}).drop(*delivered))
        gone = rest.filter("goes").select(F.col("child").alias("key"), F.col("key").alias("above"), F.col("parent").alias("next"), *(F.col(o).alias(f"a_{o}") for o in own), *(F.col(o).alias(f"a_{o}") for o in offsets))
        moved = written(rest.filter("not goes").drop("kids", "child", "goes").join(gone, "key", "left"))
        hung = moved.filter("above is not null")
        # What a contracted node has beside the total of the child that was left: its own figures and the child's offset.
        contracted.append(hung.select(F.col("above").alias("key"), F.col("key").alias("to"), *((F.col(f"a_{o}") + F.col(off)).alias(f) for f, o, off in zip(figures, own, offsets, strict=True))))
        up = {off: F.col(off) + F.coalesce(F.col(f"a_{o}") + F.col(f"a_{off}"), zero) for o, off in zip(own, offsets, strict=True)}
        live = moved.withColumns(up).select("key", F.coalesce("next", "parent").alias("parent"), *own, *offsets)
        turn += 1
    return raked, contracted


def _expanded(raked: list[DataFrame], contracted: list[DataFrame], figures: list[str]) -> DataFrame:
    """Totals of raked and of contracted nodes; a contracted one has figures beside those of the node that it leads to."""
    known = reduce(DataFrame.unionByName, raked)
    if not contracted:
        return known
    links = written(reduce(DataFrame.unionByName, contracted).repartition("key"))  # dealt anew: each round left partitions
    while True:
        onward = links.select(F.col("key").alias("to"), F.col("to").alias("beyond"), *(F.col(f).alias(f"b_{f}") for f in figures))
        step = written(links.join(onward, "to", "left"))
        if step.filter("beyond is not null").isEmpty():
            break
        # A link that doesn't end at a raked node yet takes two steps in one.
        links = step.select("key", F.coalesce("beyond", "to").alias("to"), *((F.col(f) + F.coalesce(f"b_{f}", F.lit(0))).alias(f) for f in figures))
    totals = known.select(F.col("key").alias("to"), *(F.col(f).alias(f"t_{f}") for f in figures))
    ended = links.join(totals, "to").select("key", *((F.col(f) + F.col(f"t_{f}")).alias(f) for f in figures))
    return checkpointed(known.unionByName(ended).repartition("key"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation: comma-joined ids in runs of at most about RUN bytes, with the first id of each."""
    key, first, ids, size = None, 0, [], 0
    done: list[tuple[bytes, int, str]] = []

    def batch_of(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        keys, firsts, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or size > RUN:
                if ids:
                    done.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if done:
            yield batch_of(done)
            done = []
    if ids:
        yield batch_of([(key, first, ",".join(ids))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by node and first id: the SHA-256 of each node's runs, joined by commas."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state:
                keys.append(key)
                hashes.append(state.hexdigest())
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end."""
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    every, ends = members(conversations)
    ends = checkpointed(ends)
    inner = every.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    top = root.select(F.lit(ROOT).alias("key"), "conv_id", zero.alias("depth"), "n_convs", none.cast("binary").alias("parent"), zero.alias("chars"))
    nodes = checkpointed(inner.unionByName(top))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    own = nodes.select("key", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(totals, "key").join(end_digests(ends), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _crc32(value: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string of ASCII characters."""
    byte = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({value}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda s, b: {byte}), 4294967295)"


ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || length(role) || chr(10) || text)) AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, c - c % {FAMILY} AS b, {_crc32("CAST(c AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT c.c, least(h, (SELECT count(*) FROM t WHERE t.c = b)) AS k FROM c),
r AS (SELECT c.c, i AS d, role, text FROM c JOIN t ON t.c = c.b AND i <= h UNION ALL SELECT c.c, i - h + k, role, text FROM c JOIN k ON c.c = k.c JOIN t ON t.c = c.c AND i > h),
p AS (SELECT c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS p, length(text) AS n FROM r UNION ALL SELECT c, 0, '', 0 FROM c),
q AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT p, min(c) AS c, min(d) AS d, count(*) AS m, min(up) AS up, (count(*) - 1) * min(n) AS saved, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (ends), '')) AS h FROM q GROUP BY p),
kids AS (SELECT up AS p, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT q.p, sum(saved) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM n JOIN q ON q.c = n.c AND q.d <= n.d LEFT JOIN kids ON kids.p = n.p GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, x.c AS parent_conv_id, n.m AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.h AS ends_sha256
FROM n JOIN s USING (p) LEFT JOIN kids USING (p) LEFT JOIN n x ON n.up = x.p
"""
