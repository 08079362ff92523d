"""Groups of linked rows, and groups of near copies without all their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.storage import checkpointed, written
from sparkloom.operators.search import fits, ngram_sets, prefixes


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node of edges(a, b), which may be of any type with an order. Self-edges and nulls don't count.

    Rounds of large stars (all larger neighbours of a node go to the least one) and small stars (all smaller ones do) until
    nothing changes; a round is joins with one row a node, and sums that are combined before they are shuffled.
    """
    pair = lambda df, x, y: df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = written(pair(edges.filter(F.col(a) != F.col(b)), a, b).distinct())
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(new):
            break
        state = tuple(new)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        met = large.join(least, "u")
        small = pair(met, "v", "least").unionByName(pair(met, "u", "least"))
        now = written(small.filter("u <> v").distinct())
    root = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)


def _similar(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """a, b: the pairs whose sets have a Jaccard similarity of at least t."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("g").alias(f"g_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    common, all_of = F.size(F.array_intersect("g_a", "g_b")), F.size("g_a") + F.size("g_b")
    return full.filter(common >= t * (all_of - common) - 1e-9).select("a", "b")


def _star_links(head: DataFrame, sets: DataFrame, t: float, turn: int) -> DataFrame:
    """Links between each set and one pivot of each n-gram by which it can meet others."""
    chosen = head.groupBy("h").agg(F.min_by(F.struct("id", "n", "rest"), F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("p"), F.count("*").alias("rows")).filter("rows > 1")
    met = head.join(chosen, "h").filter((F.col("id") != F.col("p.id")) & fits(t, "n", "p.n", "rest", "p.rest"))
    pairs = met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
    return _similar(checkpointed(pairs), sets, t)


def _links_across(head: DataFrame, sets: DataFrame, found: DataFrame, t: float) -> DataFrame:
    """Links between sets of different components. Where an n-gram's rows are of one component, nothing meets; else the rows of all but its largest one meet the others."""
    of = found.select(F.col("node").alias("id"), "component")
    rows = checkpointed(head.join(of, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = rows.groupBy("h", "component").agg(F.count("*").alias("rows"))
    largest = parts.groupBy("h").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    mixed = checkpointed(rows.join(largest, "h"))
    few = mixed.filter("component <> largest").select("h", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("component").alias("c_b"))
    met = mixed.join(few, "h").filter((F.col("component") != F.col("c_b")) & ((F.col("component") == F.col("largest")) | (F.col("id") < F.col("b"))) & fits(t, "n", "n_b", "rest", "rest_b"))
    return _similar(checkpointed(met.select(F.col("id").alias("a"), "b").distinct()), sets, t)


def duplicate_groups(df: DataFrame, key: str, text: str, n: int = 5, t: float = 0.8, mode: str = "word", stars: int = 2) -> DataFrame:
    """key, representative, component, group_size of every row: exact groups of texts linked by a Jaccard similarity of word n-grams of at least t.

    Equal n-gram sets are one representative (their smallest key); representatives meet by the n-grams of the exact prefix filter
    (n-grams as 64-bit hashes). First each meets one pivot an n-gram, `stars` times, which joins groups of near copies with one
    link a member; then only sets of different components meet. No link between components is lost, and the pairs inside a group
    are never listed. Texts without an n-gram (null, empty, or fewer than n words) are groups of their own; rows that share a key are one.
    """
    every = ngram_sets(df, key, text, n, mode, t)
    of = every.groupBy("h1", "h2").agg(F.min("id").alias("representative"))
    owned = checkpointed(every.join(of, ["h1", "h2"]).select("id", "representative").distinct())
    sets = checkpointed(every.join(of.select(F.col("representative").alias("id")), "id", "left_semi").dropDuplicates(["id", "h1", "h2"]).select("id", "n", "g"))
    head = checkpointed(prefixes(sets, t))
    # A key whose rows differ is one node.
    links = owned.select(F.col("id").alias("a"), F.col("representative").alias("b")).filter("a <> b")
    for turn in range(stars):
        links = checkpointed(links.unionByName(_star_links(head, sets, t, turn)).distinct())
    links = checkpointed(links.unionByName(_links_across(head, sets, connected_components(links), t)))
    found = connected_components(links)
    ids = df.select(F.col(key).alias("id")).distinct()
    first = owned.groupBy("id").agg(F.min("representative").alias("representative"))
    out = ids.join(first, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    out = checkpointed(out.select("id", F.coalesce("representative", "id").alias("representative"), F.coalesce("component", "id").alias("component")))
    sizes = out.groupBy("component").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "component").select(F.col("id").alias(key), "representative", "component", "group_size")
