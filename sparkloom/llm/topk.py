"""Exact top-k search by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are dealt into blocks by row number, whatever their ids, and every block of queries meets every block of
candidates in one task; no single task sees more than a block of each. There the candidates lie dimension by dimension.
For each query the partial products grow by DIMENSIONS dimensions at a time; a candidate's remaining part is at most the
product of the remaining norms, so candidates whose upper bound is below the k-th best lower bound are dropped and the
survivors are compacted. A window ranks the blocks' bests.

Components x count as floor(scale * x). Products are exact: in double precision while every sum stays below 2^53, else in
Python's integers, limited to the range of a long. Vectors that are null or empty or hold a null or non-finite component
take no part, nor do rows without vec_id; vectors of different lengths aren't compared. A row is no candidate of its own
query; another row with the same vec_id is. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import checkpointed

DIMENSIONS = 16
#: Rows of a block: candidates are dealt to about TASKS blocks within these limits.
TASKS, FEWEST, MOST_CANDIDATES, MOST_QUERIES = 24, 2_000, 100_000, 20_000
EXACT = float(2**53)
#: Products of queries and candidates that are held at once.
PRODUCT = 8_000_000


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table["v"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _bests(q: np.ndarray, own: np.ndarray, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query's place, candidate's place, score) of each query's k best in this block."""
    d = v.shape[1]
    order = np.argsort(-np.square(q).sum(0) * np.square(v).sum(0), kind="stable")  # heavy dimensions first
    q, vertical = q[:, order], np.ascontiguousarray(v[:, order].T)
    cuts = [*range(0, d, DIMENSIONS), d]
    rest_v = [np.sqrt(np.square(vertical[c:]).sum(0)) for c in cuts[1:]]
    rest_q = [np.sqrt(np.square(q[:, c:]).sum(1)) for c in cuts[1:]]
    step = max(1, PRODUCT // max(1, len(ids)))
    at = {int(r): i for i, r in enumerate(rows)}
    for i in range(len(q)):
        if i % step == 0:
            first = q[i : i + step, : cuts[1]] @ vertical[: cuts[1]]
        alive, part = np.arange(len(ids)), first[i % step]
        if int(own[i]) in at:
            alive = np.delete(alive, at[int(own[i])])
            part = part[alive]
        for b in range(len(cuts) - 1):
            if b:
                part = part + q[i, cuts[b] : cuts[b + 1]] @ vertical[cuts[b] : cuts[b + 1]][:, alive]
            slack = rest_q[b][i] * rest_v[b][alive]
            slack += 1e-9 * slack
            if len(alive) > k:
                floor = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                stay = part + slack >= floor - 1e-9 * abs(floor)
                alive, part = alive[stay], part[stay]
        for j in np.lexsort((ids[alive], -part))[:k]:
            yield i, int(alive[j]), int(part[j])


def _bests_of_integers(q, own, v, rows, ids, k):
    """The same for numbers beyond exact doubles."""
    integers = lambda m: np.array([list(map(int, r)) for r in m.tolist()], object).reshape(m.shape)
    whole, asked = integers(v), integers(q)
    for i in range(len(q)):
        scores = whole @ asked[i]
        ranked = sorted((-int(s), int(ids[j]), j) for j, s in enumerate(scores) if rows[j] != own[i])
        for s, _, j in ranked[:k]:
            yield i, j, max(min(-s, 2**63 - 1), -(2**63))


def search(vectors: DataFrame, queries: str, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates for each row that the condition `queries` on vec_id picks."""
    placed = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = checkpointed(placed.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite))  # so that row has one meaning on both sides
    asked = good.filter(F.expr(queries.replace(vec_id, "id")))
    n, m = good.count(), asked.count()
    blocks = max(1, -(-n // min(MOST_CANDIDATES, max(FEWEST, n // TASKS))))
    groups = max(1, -(-m // MOST_QUERIES))
    part = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = good.withColumns({"block": part(blocks)}).withColumn("group", each(groups))
    asking = asked.withColumns({"group": part(groups)}).withColumn("block", each(blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        sizes_q, sizes_v = pa.compute.list_value_length(left["v"]).to_numpy(), pa.compute.list_value_length(right["v"]).to_numpy()
        for size in np.intersect1d(sizes_q, sizes_v):
            a, b = left.filter(sizes_q == size), right.filter(sizes_v == size)
            q, v = np.floor(scale * _matrix(a)), np.floor(scale * _matrix(b))
            ids, rows, own, asked_ids = b["id"].to_numpy(), b["row"].to_numpy(), a["row"].to_numpy(), a["id"].to_numpy()
            largest = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * size
            found = (_bests if largest < EXACT else _bests_of_integers)(q, own, v, rows, ids, k)
            out += [(own[i], asked_ids[i], ids[j], s) for i, j, s in found]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["row", "query_id", "vec_id", "score"])

    bests = asking.groupBy("group", "block").cogroup(candidates.groupBy("group", "block")).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    ranked = bests.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
