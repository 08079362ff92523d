"""Taxonomy, dependencies and import order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sparkloom.functions.storage import shared_folder, written
from sparkloom.plans.schemas import GENERIC, OTHER

#: Registries and blocklists up to this count are broadcast, larger ones shuffled.
MAX_BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its count is within MAX_BROADCAST."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def assign_taxonomy(packages: DataFrame, taxonomy: DataFrame, keys: list[str], generic: str = GENERIC) -> DataFrame:
    """packages with the taxonomy's columns, known, severity and suggestion: an unknown category warns and suggests Other below the generic root, else fails. A null root or category is unknown."""
    joined = packages.join(small(taxonomy.withColumn("known", F.lit(True))), keys, "left")
    joined = joined.withColumn("known", F.coalesce("known", F.lit(False)))
    bad = ~F.col("known")
    under = F.col(keys[0]).cast("string") == generic
    return joined.withColumns({"severity": F.when(bad & under, "warn").when(bad, "fail"), "suggestion": F.when(bad & under, OTHER)})


def missing_platform_deps(bindings: DataFrame, registry: DataFrame, on: list[str]) -> DataFrame:
    """Bindings that aren't custom and that the environment's registry lacks. A null name is in no registry; null in custom counts as not custom."""
    if "custom" in bindings.columns:
        bindings = bindings.filter(~F.coalesce("custom", F.lit(False)))
    return bindings.join(small(registry.select(*on).distinct()), on, "left_anti")


#: Rows whose keys one task combines at once.
COMBINED = 2_000_000


def _spread(df: DataFrame, on: list[str]) -> DataFrame:
    """df, dealt by on if a task of it has more than COMBINED rows: the keys that a task combines before a shuffle are held in memory. Rows of one key still go to as many tasks as they come from, up to 64."""
    most, rows = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()  # one row
    if (most or 0) <= COMBINED:
        return df
    return df.repartition(-(-2 * rows // COMBINED), *on, F.pmod(F.spark_partition_id(), F.lit(64)))


def reconcile_bundles(bound: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """on, status: ok (bound and bundled), not_bundled, unused (bundled, not bound). Nulls are equal here. Rows are combined before they are shuffled, COMBINED a task or so."""
    rows = lambda df, b: _spread(df.select(*on), on).select(*on, F.lit(b).alias("b"), F.lit(not b).alias("p"))
    both = rows(bound, True).unionByName(rows(present, False))
    found = both.groupBy(*on).agg(F.max("b").alias("b"), F.max("p").alias("p"))
    return found.select(*on, F.when(~F.col("b"), "unused").when(~F.col("p"), "not_bundled").otherwise("ok").alias("status"))


def match_submission(submissions: DataFrame, agents: DataFrame, name: str = "name") -> DataFrame:
    """submissions (with display_name) and matched: whether an agent has that name."""
    names = agents.select(F.col(name).alias("display_name")).distinct().withColumn("matched", F.lit(True))
    return submissions.join(names, "display_name", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def import_plan(bindings: DataFrame, target: str = "agent_key", item: str = "name") -> DataFrame:
    """target, stage, item, position: each dependency once a target (stage 1), then the target itself (stage 2). A null name is no dependency."""
    deps = bindings.filter(F.col(item).isNotNull()).select(target, F.lit(1).alias("stage"), F.col(item).cast("string").alias("item")).distinct()
    own = bindings.select(target, F.lit(2).alias("stage"), F.col(target).cast("string").alias("item")).distinct()
    return deps.unionByName(own).withColumn("position", F.row_number().over(Window.partitionBy(target).orderBy("stage", "item")))


def _staged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, stage of the nodes that don't wait for a cycle in the end. edges: a waits for b.

    A round looks up who waits for those that the last one made ready. Beside the rounds themselves only nodes are stored that have some of what they wait for, but not all.
    """
    spark, top = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/rounds"
    waits = written(edges.join(edges.groupBy("a").agg(F.count("*").alias("n")), "a"))
    now = nodes.join(edges.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("n"))
    stage, shape = 1, now.schema
    while True:
        now.write.parquet(f"{top}/stage={stage}")
        now = spark.read.schema(shape).parquet(f"{top}/stage={stage}")
        ready, some = now.filter("got = n").select(F.col("node").alias("b")), now.filter("got < n")
        if ready.isEmpty():
            return spark.read.schema(StructType([*shape.fields, StructField("stage", IntegerType())])).parquet(top).filter("got = n").select("node", "stage")
        met = waits.join(ready, "b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("got"), F.first("n").alias("n"))
        now = some.unionByName(met).groupBy("node").agg(F.sum("got").alias("got"), F.first("n").alias("n"))
        stage += 1


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that start where none ends or end where none starts, again and again while a tenth of them goes."""
    count = edges.count()
    while count:
        starts, ends = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = written(edges.join(ends, "a", "left_semi").join(starts, "b", "left_semi").select("a", "b"))
        before, count = count, edges.count()
        if 10 * count > 9 * before:
            break
    return edges


def _colours(edges: DataFrame, turn: int) -> DataFrame:
    """node, rank, colour: the largest rank among those from which each node can be reached, itself included. Ranks are in random order."""
    rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), F.col("node").alias("of"))
    now = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", rank.alias("rank"), rank.alias("colour"), F.lit(True).alias("grew"))
    while True:
        now = written(now)
        told = now.filter("grew").select(F.col("node").alias("a"), "colour")
        if told.isEmpty():
            return now.drop("grew")
        sent = edges.join(told, "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("sent"))
        now = now.join(sent, "node", "left").select("node", "rank", F.greatest("colour", "sent").alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("grew"))


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle (its smallest node): the strongly connected components of edges(a, b) that have a cycle.

    Each node gets the largest rank that reaches it as a colour, and the nodes of a colour that reach the node of this rank
    back are one component; it goes, and so do edges between colours. Ranks are drawn anew in each round, so components that lie behind each other take
    rounds by the logarithm of their number. Edges that lead from nowhere or to nowhere go first.
    """
    found = edges.select(F.col("a").alias("node"), F.col("a").alias("cycle")).limit(0)
    turn = 0
    while True:
        edges = _trimmed(edges)
        if edges.isEmpty():
            return found
        colour = _colours(edges, turn)
        side = lambda x: colour.select(F.col("node").alias(x), F.col("colour").alias(f"colour_{x}"))  # noqa: E731, B023
        inside = written(edges.join(side("a"), "a").join(side("b"), "b").filter("colour_a = colour_b").select("a", "b"))
        whole = frontier = written(colour.filter("rank = colour").select("node", F.col("node").alias("root")))
        while not frontier.isEmpty():
            before = inside.join(frontier.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root").distinct()
            frontier = written(before.join(whole, "node", "left_anti"))
            whole = written(whole.unionByName(frontier))
        least = whole.groupBy("root").agg(F.min("node").alias("cycle"), F.count("*").alias("size"))
        own = inside.filter("a = b").select(F.col("a").alias("node"), F.lit(True).alias("own"))
        new = whole.join(least, "root").join(own, "node", "left").filter("size > 1 or own").select("node", "cycle")
        found = written(found.unionByName(new))
        gone = whole.select("node")
        edges = written(inside.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
        turn += 1


def import_order(bindings: DataFrame, target: str = "agent_key", item: str = "name") -> DataFrame:
    """item, stage, status, cycle of everything that depends on something or is depended on; target and item are names of one kind.

    stage is one more than the largest stage among what an item depends on (1 if on nothing), so a stage can be imported
    once all before it are. status: ok; cycle (it depends on itself in the end; cycle is the smallest item of its cycle, a finding); blocked
    (it depends on a cycle). The latter two have no stage. Null names and repeated bindings don't count. There are as many rounds as stages.
    """
    edges = written(bindings.select(F.col(target).alias("a"), F.col(item).alias("b")).dropna().distinct())
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    staged = _staged(edges, nodes)
    left = written(edges.join(staged.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    out = nodes.join(staged, "node", "left").join(cycles(left), "node", "left")
    status = F.when(F.col("stage").isNotNull(), "ok").when(F.col("cycle").isNotNull(), "cycle").otherwise("blocked")
    return out.select(F.col("node").alias("item"), "stage", status.alias("status"), "cycle")


def closure(edges: DataFrame) -> DataFrame:
    """item, needs, far: everything that each item of edges(item, needs) needs in the end, and over how many steps at least.

    Steps double: pairs at exactly k steps meet those within k, which gives all within 2 * k. The sums of what is read and written stay in proportion to the result.
    """
    near, k = written(edges.select("item", "needs", F.lit(1).alias("far"))), 1
    while True:
        last = near.filter(F.col("far") == k).select("item", F.col("needs").alias("via"))
        further = last.join(near.withColumnRenamed("item", "via"), "via").select("item", "needs", (F.col("far") + k).alias("far"))
        near = written(near.unionByName(further).groupBy("item", "needs").agg(F.min("far").alias("far")))
        if near.filter(F.col("far") > k).isEmpty():
            return near
        k *= 2


#: Items in one row of what an item needs.
LIST = 1_000
#: Pairs of target and item that are sorted in one task.
PAIRS = 4_000_000


def _lists(edges: DataFrame) -> DataFrame:
    """item, needs, codes: what each item of edges(item, needs) needs in the end and itself, up to LIST a row. Codes: the stage, -1 for status cycle, -2 for blocked."""
    order = import_order(edges, "item", "needs")
    code = order.select(F.col("item").alias("needs"), F.when(F.col("status") == "ok", F.col("stage")).when(F.col("status") == "cycle", -1).otherwise(-2).alias("code"))
    pairs = closure(edges).filter("item <> needs").select("item", "needs").join(code, "needs").select("item", "needs", "code")
    every = pairs.unionByName(code.select(F.col("needs").alias("item"), "needs", "code"))
    part = F.floor((F.row_number().over(Window.partitionBy("item").orderBy("item")) - 1) / LIST)
    return every.withColumn("part", part).groupBy("item", "part").agg(F.collect_list(F.struct("needs", "code")).alias("all")).select("item", F.col("all.needs").alias("needs"), F.col("all.code").alias("codes"))


def transitive_plan(bindings: DataFrame, requires: DataFrame, target: str = "agent_key", item: str = "name", needs: str = "needs") -> DataFrame:
    """target, item, stage, status, position: everything that each target of bindings(target, item) needs in the end, once, in an order in which it can be imported.

    requires(item, needs) says what items depend on. Items of a cycle, and those that depend on one, come last, with their
    status. What an item needs is found once an item, not once a target: lists of it travel to the targets, and are taken apart and put in order there, after the only shuffle of the result.
    """
    edges = written(requires.select(F.col(item).alias("item"), F.col(needs).alias("needs")).dropna().distinct())
    lists = written(_lists(edges))
    bound = bindings.select(F.col(target).alias("target"), F.col(item).alias("item")).dropna()
    sizes = lists.groupBy("item").agg(F.sum(F.size("needs")).alias("size"))
    pairs = bound.groupBy("item").agg(F.count("*").alias("n")).join(sizes, "item", "left").agg(F.sum(F.col("n") * F.coalesce("size", F.lit(1)))).first()[0] or 0
    tasks = max(int(bindings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    sent = bound.join(lists, "item", "left").select("target", F.coalesce("needs", F.array("item")).alias("needs"), F.coalesce("codes", F.array(F.lit(1))).alias("codes"))
    flat = sent.repartition(tasks, "target").select("target", F.inline(F.arrays_zip("needs", "codes")).alias("item", "code"))
    place = Window.partitionBy("target").orderBy(F.when(F.col("code") > 0, F.col("code")).asc_nulls_last(), "item")
    placed = flat.withColumns({"position": F.dense_rank().over(place), "last": F.lag("item").over(place)}).filter("last is null or last <> item")
    status = F.when(F.col("code") > 0, "ok").when(F.col("code") == -1, "cycle").otherwise("blocked")
    return placed.select(F.col("target").alias(target), "item", F.when(F.col("code") > 0, F.col("code")).alias("stage"), status.alias("status"), "position")
