"""Chat formatting: logged snapshots of a growing conversation are collapsed to the longest before rendering (DataFrame functions only).

A conversation is its turns by turn number. The rolling hash of a prefix is the number of its rows and two sums of 64-bit
hashes of (turn, role, text); sums grow turn by turn and can be put together from blocks of BLOCK turn numbers, so a long
conversation is not one task's work. Of conversations with equal full hashes the smallest conv_id stays; one whose full
hash is a proper prefix of another conversation is a snapshot of it and goes (anti-join).

Defined results: a null role or text is rendered as an empty string but differs from an empty one when compared; rows
without conv_id are one conversation; rows with one turn number belong to the same prefix and are rendered by role, then
text; repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import checkpointed

BLOCK = 512
KEY = ["n", "s1", "s2"]


def _hash(salt: int) -> Column:
    parts = [F.lit(salt), F.coalesce(F.col("turn"), F.lit(-1)), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, the rolling hash up to each turn (n, s1, s2), and whether it is the whole conversation (whole)."""
    rows = turns.select("conv_id", "turn", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"), F.lit(1).cast("long").alias("n"), _hash(1).alias("s1"), _hash(2).alias("s2"))
    by_turn = rows.groupBy("conv_id", "block", "turn").agg(*(F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in KEY))
    blocks = by_turn.groupBy("conv_id", "block").agg(*(F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in KEY))
    order = Window.partitionBy("conv_id").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("conv_id")
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_before") for k in KEY), F.sum("n").over(all_of).alias("total"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    rolling = by_turn.select("conv_id", "block", *(F.sum(k).over(inside).alias(k) for k in KEY))
    joined = rolling.join(starts, rolling["conv_id"].eqNullSafe(starts["c"]) & (rolling["block"] == starts["b"]))
    sums = [(F.col(k) + F.col(f"{k}_before")).cast("long" if k == "n" else "decimal(38,0)").alias(k) for k in KEY]
    return joined.select("conv_id", "total", *sums).withColumn("whole", F.col("n") == F.col("total")).drop("total")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n (its rows) of the conversations that stay."""
    every = checkpointed(prefixes(turns))
    wholes = every.filter("whole").groupBy(*KEY).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("c"))
    shorter = every.filter("not whole").groupBy(*KEY).agg(F.lit(1).alias("x"))
    return wholes.join(shorter, KEY, "left_anti").select("c.conv_id", "n")


def render(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of the conversations in ids."""
    kept = turns.join(ids.select(F.col("conv_id").alias("c")), turns["conv_id"].eqNullSafe(F.col("c")), "left_semi")
    rows = kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    part = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("t", part), "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of each maximal conversation."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    return render(turns, maximal(turns))


ORACLE = """
WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT min(conv_id) AS conv_id, l, n FROM c GROUP BY l, n),
p AS (SELECT DISTINCT l[1:k] AS l FROM c, range(1, 10000) AS t(k) WHERE k < n)
SELECT conv_id, n AS n_turns, list_aggregate(list_transform(l, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), 'string_agg', '') AS text
FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = r.l)
"""
