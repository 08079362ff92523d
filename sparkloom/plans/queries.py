"""The catalogue operators over the fixture tables, and the same in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.storage import shared_folder
from sparkloom.functions.text import tokens
from sparkloom.operators import aggregates, deps, groups, hashtree, index, manifest, passages, phrases, prep, review, search, sketches, vectors, versions
from sparkloom.plans.schemas import CODE_RULES, LICENCE_RULES, PROMPT_RULES, SENSITIVE_RULES
from sparkloom.sources import layout, packages, variants
from sparkloom.streaming import review as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Sources and sinks


def _hub(spark: SparkSession, documents: DataFrame) -> str:
    """A hub whose agents are languages (without one: none); the texts are the files of a skill, a null one an empty line. Languages are a few."""
    hub = f"{shared_folder(spark)}/hub"
    named = documents.select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for lang in sorted(r[0] for r in named.select("lang").distinct().collect()):
        named.filter(F.col("lang") == lang).select("text").write.text(f"{hub}/generic/texts/{lang}/skills")
    return hub


@_query("SELECT 'generic' AS root, 'texts' AS category, coalesce(lang, 'none') AS agent, 'skill' AS kind, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY ALL")
def scan_packages(spark, table):
    files = packages.scan_packages(spark, _hub(spark, table("documents")))
    return files.groupBy("root", "category", "agent", "kind").agg(F.sum("size").alias("n_bytes"))


@_query(
    "SELECT lang AS root, source AS category, CASE doc_id % 5 WHEN 0 THEN 'manifest' WHEN 1 THEN 'readme' WHEN 2 THEN 'skill' WHEN 3 THEN 'mcp' ELSE 'changelog' END AS kind,"
    " count(*) AS n FROM documents GROUP BY ALL"
)
def classify_paths(spark, table):
    names = F.array(*map(F.lit, ("agent.json", "README.md", "skills/a.md", "mcps/b.py", "CHANGELOG.md")))
    paths = table("documents").select(F.concat_ws("/", F.lit("hub"), "lang", "source", "doc_id", F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("path"))
    return packages.classify_paths(paths).groupBy("root", "category", "kind").agg(F.count("*").alias("n"))


def _manifests(conversations: DataFrame) -> DataFrame:
    turns = F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "role", "text"))), lambda t: t)
    return conversations.groupBy("conv_id").agg(turns.alias("examples")).withColumn("name", F.concat(F.lit("agent "), "conv_id"))


@_query(
    "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"
    " SELECT CASE WHEN conv_id % 10 = 0 THEN 'corrupt' ELSE 'ok' END AS status, count(*) AS n_agents, CAST(sum(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE n END) AS BIGINT) AS n_examples FROM c GROUP BY 1"
)
def parse_manifests(spark, table):
    text = F.to_json(F.struct("name", "examples"))
    files = _manifests(table("conversations")).select("conv_id", F.when(F.col("conv_id") % 10 == 0, F.substring(text, 1, 20)).otherwise(text).alias("content"))
    sizes = F.coalesce(F.sum(F.when(F.col("status") == "ok", F.size("examples"))), F.lit(0)).cast("long")
    return packages.parse_manifests(files).groupBy("status").agg(F.count("*").alias("n_agents"), sizes.alias("n_examples"))


@_query("SELECT c_custkey, c_name, r_name AS root, n_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def catalog_round_trip(spark, table):
    rows = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = shared_folder(spark)
    packages.write_catalog(rows.select("c_custkey", "c_name", F.col("r_name").alias("root"), F.col("n_name").alias("category")), folder)
    return packages.read_catalog(spark, folder, root=table("region").agg(F.min("r_name")).first()[0])


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority FROM orders")
def convert_format(spark, table):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string, o_orderpriority string"
    top = shared_folder(spark)
    rows = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    rows.write.option("header", "true").csv(f"{top}/csv")
    packages.convert_format(spark, f"{top}/csv", "csv", f"{top}/json", "json", schema)
    return packages.convert_format(spark, f"{top}/json", "json", f"{top}/orc", "orc", schema)


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 20 AND 60 AND value > 50")
def variant_facet(spark, table):
    """Manifests with keys that no schema declares, stored shredded and filtered by these keys."""
    content = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","name":"'), F.col("event_type"), F.lit('","limits":{"quota":'), F.to_json(F.struct("value")), F.lit('},"props":'), F.col("props"), F.lit("}"))
    path = f"{shared_folder(spark)}/variants"
    variants.write_variants(variants.parse_variants(table("events").select(content.alias("content"))).filter("status = 'ok'").select("manifest"), path)
    found = variants.variant_facet(spark.read.parquet(path), {"$.props.k": (20, 60)})
    found = found.filter(variants.at("manifest", "$.limits.quota.value", "double") > 50)
    return found.select(*(F.try_variant_get("manifest", f"$.{c}", "string").alias(c) for c in ("id", "name")), F.try_variant_get("manifest", "$.props.k", "long").alias("k"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 100 AND 140 OR (l_suppkey BETWEEN 5 AND 8 AND l_extendedprice < 20000)")
def clustered_scan(spark, table):
    path = f"{shared_folder(spark)}/clustered"
    layout.write_clustered(table("lineitem"), path, ["l_partkey", "l_suppkey", "l_extendedprice"], bloom=["l_orderkey"])
    return spark.read.parquet(path).filter("l_partkey between 100 and 140 or (l_suppkey between 5 and 8 and l_extendedprice < 20000)").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Projections and filters


def _orders_as_agents(lineitem: DataFrame) -> DataFrame:
    bound = lambda odd: F.collect_set(F.when(F.col("l_linenumber") % 2 == int(odd), F.struct(F.col("l_partkey").cast("string").alias("name"), (F.col("l_linenumber") > 4).alias("custom"))))
    return lineitem.groupBy(F.col("l_orderkey").alias("agent_key")).agg(bound(True).alias("skills"), bound(False).alias("mcps"))


@_query("SELECT DISTINCT l_orderkey AS agent_key, CASE WHEN l_linenumber % 2 = 1 THEN 'skill' ELSE 'mcp' END AS kind, CAST(l_partkey AS VARCHAR) AS name, l_linenumber > 4 AS custom FROM lineitem")
def flatten_bindings(spark, table):
    return manifest.flatten_bindings(_orders_as_agents(table("lineitem")))


@_query("SELECT conv_id AS agent_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS position, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
def flatten_examples(spark, table):
    return manifest.flatten_examples(_manifests(table("conversations")).withColumnRenamed("conv_id", "agent_key"))


@_query("SELECT event_id AS agent_key, 'k' AS param, json_extract_string(props, '$.k') AS value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS typed FROM events")
def flatten_params(spark, table):
    agents = table("events").select(F.col("event_id").alias("agent_key"), F.from_json("props", "map<string,string>").alias("params"))
    return manifest.flatten_params(agents, {"k": "double"})


@_query("SELECT DISTINCT lang AS agent_key, source AS kb_ref FROM documents")
def flatten_kb_refs(spark, table):
    return manifest.flatten_kb_refs(table("documents").groupBy(F.col("lang").alias("agent_key")).agg(F.collect_set("source").alias("kb_refs")))


@_query("SELECT p_partkey, p_name FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 3) AND p_size BETWEEN 5 AND 30")
def facet_filter(spark, table):
    brands = [r[0] for r in table("part").select("p_brand").dropna().distinct().orderBy("p_brand").limit(3).collect()]
    return manifest.facet_filter(table("part"), p_brand=brands, p_size=(5, 30)).select("p_partkey", "p_name")


@_query("SELECT event_id, user_id FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY event_type LIMIT 2) AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 60")
def facet_params(spark, table):
    kinds = [r[0] for r in table("events").select("event_type").dropna().distinct().orderBy("event_type").limit(2).collect()]
    agents = table("events").withColumn("params", F.from_json("props", "map<string,string>"))
    return manifest.facet_filter(agents, {"k": (10, 60)}, event_type=kinds).select("event_id", "user_id")


def _titles(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "[new agent] ").otherwise("update "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("nobody")).alias("title"))


@_query("SELECT c_custkey, c_custkey % 3 = 0 AS is_new_agent, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'nobody' END END AS display_name FROM customer")
def parse_pr_title(spark, table):
    return manifest.parse_pr_title(_titles(table("customer"))).drop("title")


# Joins


@_query(
    "SELECT c_custkey, n_nationkey IS NOT NULL AS known, CASE WHEN n_nationkey IS NULL AND c_mktsegment = 'BUILDING' THEN 'warn' WHEN n_nationkey IS NULL THEN 'fail' END AS severity,"
    " CASE WHEN n_nationkey IS NULL AND c_mktsegment = 'BUILDING' THEN '其他' END AS suggestion FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey AND c_mktsegment IS NOT NULL"
)
def assign_taxonomy(spark, table):
    segments = [r[0] for r in table("customer").select("c_mktsegment").distinct().collect()]  # a few
    known = table("nation").filter("n_regionkey < 3").select(F.explode(F.array(*map(F.lit, segments))).alias("root"), F.col("n_nationkey").alias("category"))
    placed = table("customer").select("c_custkey", F.col("c_mktsegment").alias("root"), F.col("c_nationkey").alias("category"))
    return deps.assign_taxonomy(placed, known, ["root", "category"], generic="BUILDING").select("c_custkey", "known", "severity", "suggestion")


@_query("SELECT l_orderkey AS agent_key, l_partkey AS name FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 10 AND p_partkey = l_partkey)")
def missing_platform_deps(spark, table):
    bindings = table("lineitem").select(F.col("l_orderkey").alias("agent_key"), F.col("l_partkey").alias("name"))
    return deps.missing_platform_deps(bindings, table("part").filter("p_size > 10").select(F.col("p_partkey").alias("name")), ["name"])


@_query(
    "WITH b AS (SELECT DISTINCT l_partkey AS name, l_suppkey % 10 AS agent, true AS bound FROM lineitem), p AS (SELECT DISTINCT *, true AS present FROM (SELECT p_partkey AS name, unnest(range(0, 10)) AS agent FROM part))"
    " SELECT coalesce(b.name, p.name) AS name, coalesce(b.agent, p.agent) AS agent, CASE WHEN b.bound IS NULL THEN 'unused' WHEN p.present IS NULL THEN 'not_bundled' ELSE 'ok' END AS status FROM b FULL JOIN p ON b.name IS NOT DISTINCT FROM p.name AND b.agent IS NOT DISTINCT FROM p.agent"
)
def reconcile_bundles(spark, table):
    bound = table("lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_suppkey") % 10).alias("agent"))
    present = table("part").select(F.col("p_partkey").alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("agent"))
    return deps.reconcile_bundles(bound, present, ["name", "agent"])


@_query("SELECT c_custkey, c_name AS display_name, true AS matched FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'nobody', false FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def match_submission(spark, table):
    submitted = manifest.parse_pr_title(_titles(table("customer"))).filter("is_new_agent").select("c_custkey", "display_name")
    return deps.match_submission(submitted, table("customer"), "c_name")


@_query(
    "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents)"
    " SELECT doc_id AS agent_key, count(*) AS n_hits, count(DISTINCT t) AS n_terms FROM w WHERE t IN ('token', 'password', 'akia', 'licensed') GROUP BY 1"
)
def blocked_terms(spark, table):
    terms = spark.createDataFrame([("token",), ("Password",), ("akia",), ("licensed",)], "term string")
    return review.blocked_terms(table("documents").select(F.col("doc_id").alias("agent_key"), "text"), terms)


# Aggregations


@_query("SELECT n_regionkey AS root, c_nationkey AS category, CAST(grouping(n_regionkey) * 2 + grouping(c_nationkey) AS INTEGER) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def catalog_counts(spark, table):
    joined = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.catalog_counts(joined.select(F.col("n_regionkey").alias("root"), F.col("c_nationkey").alias("category")))


@_query("SELECT l_partkey AS name, count(DISTINCT l_orderkey) AS n_agents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def dependency_reuse(spark, table):
    return aggregates.dependency_reuse(table("lineitem").select(F.col("l_orderkey").alias("agent_key"), F.col("l_partkey").alias("name")), 20)


@_query(
    "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, year(o_orderdate))"
)
def extract_aggregate(spark, table):
    dims, revenue = _sales(table)
    return aggregates.extract_aggregate(table("lineitem"), dims, [F.col("n_name"), F.col("year")], [revenue, F.count("*").alias("n")], "cube")


@_query(
    "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (year(o_orderdate)))"
)
def extract_aggregate_sets(spark, table):
    dims, revenue = _sales(table)
    keys = [F.col("n_name"), F.col("year")]
    return aggregates.extract_aggregate(table("lineitem"), dims, keys, [revenue], "sets", [[k] for k in keys])


def _sales(table):
    dims = [(table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), "l_orderkey", "o_orderkey"), (table("customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"), (table("nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")]
    return dims, F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, {f'round(avg({c}), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS mean FROM orders"
        for c, number in (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False))
    )
)
def profile_columns(spark, table):
    return aggregates.profile_columns(table("orders")).withColumn("mean", F.round("mean", 4))


@_query(
    "SELECT 'o_custkey' AS \"column\", count(*) AS n_rows, count(*) - count(o_custkey) AS n_nulls, true AS distinct_within, true AS median_within FROM orders"
    " UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), true, true FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), true, NULL FROM orders"
)
def sketch_profile(spark, table):
    """Batches by year as sketches, united; distinct counts and medians against the exact ones: within four standard errors."""
    orders, path = table("orders").select("o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year")), f"{shared_folder(spark)}/sketches"
    for year in [r[0] for r in orders.select("year").distinct().collect()]:
        sketches.store([sketches.sketch_columns(orders.filter(F.col("year").eqNullSafe(F.lit(year))).drop("year"), F.lit(year).cast("int"))], path)
    found = sketches.profile_sketches(spark.read.parquet(path), (0.5,))
    count = lambda c: F.count_distinct(c).alias("exact")
    middle = {r["column"]: r["q1"] for r in found.select("column", "q1").collect()}  # one row a column
    below = lambda c: F.lit(None).cast("double") if middle[c] is None else F.avg((F.col(c) <= middle[c]).cast("double"))
    exact = [orders.agg(F.lit(c).alias("column"), count(c), below(c).alias("rank")) for c in middle]
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * 1.04 / 2 ** (sketches.LG_K / 2) * F.col("exact") + 0.5
    out = found.join(functools.reduce(DataFrame.unionByName, exact), "column")
    return out.select("column", "n_rows", "n_nulls", near.alias("distinct_within"), (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_within"))


@_query("SELECT CAST(l_partkey AS VARCHAR) AS name, count(DISTINCT l_orderkey) AS n_agents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def sketch_reuse(spark, table):
    """Reuse counts from one theta sketch a name and ship mode's batch; a name's agents are fewer than a sketch is exact for."""
    items, path = table("lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("name"), "l_linestatus"), f"{shared_folder(spark)}/reuse"
    for batch in [r[0] for r in items.select("l_linestatus").distinct().collect()]:
        sketches.store([sketches.sketch_reuse(items.filter(F.col("l_linestatus").eqNullSafe(F.lit(batch))), F.lit(batch).cast("string"), "l_orderkey", "name")], path)
    return sketches.reuse(spark.read.parquet(path), 20)


# Windows


@_query(
    "WITH e AS (SELECT *, lag(event_type) OVER w AS before, lag(event_id % 7) OVER w AS v, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST))"
    " SELECT user_id, event_id, CASE WHEN event_id % 7 > v THEN 'ok' WHEN event_id % 7 <= v THEN 'fail' ELSE 'unknown' END AS status FROM e WHERE place > 1 AND before IS DISTINCT FROM event_type"
)
def version_audit(spark, table):
    events = table("events").select("user_id", "event_id", "ts", "event_type", F.concat(F.lit("1."), F.col("event_id") % 7, F.lit(".0")).alias("version"))
    return versions.version_audit(events, "user_id", ("ts", "event_id"), "version", "event_type").select("user_id", "event_id", "status")


@_query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, table):
    return versions.latest_version(table("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ("ts", "event_id")).drop("ts")


@_query(
    "WITH d AS (SELECT DISTINCT l_orderkey AS agent_key, 1 AS stage, CAST(l_partkey AS VARCHAR) AS item FROM lineitem WHERE l_partkey IS NOT NULL UNION ALL SELECT DISTINCT l_orderkey, 2, CAST(l_orderkey AS VARCHAR) FROM lineitem)"
    " SELECT *, CAST(row_number() OVER (PARTITION BY agent_key ORDER BY stage, item) AS INTEGER) AS position FROM d"
)
def import_plan(spark, table):
    return deps.import_plan(table("lineitem").select(F.col("l_orderkey").alias("agent_key"), F.col("l_partkey").alias("name")))


#: Parts need the part of half their number; parts of the least size are needed by it in turn, which makes cycles.
_REQUIRES = (
    "e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 AND a.p_partkey > 1"
    " UNION SELECT b.p_partkey, a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 AND a.p_partkey > 1 WHERE a.p_size = 1),"
    " r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),"
    " c AS (SELECT r.a AS x, min(s.a) AS cycle FROM r JOIN r s ON r.b = s.a AND r.a = s.b GROUP BY 1), z AS (SELECT DISTINCT a AS x FROM r WHERE b IN (SELECT x FROM c)),"
    " l AS (SELECT x, 1 AS stage FROM n WHERE x NOT IN (SELECT a FROM e) UNION SELECT e.a, stage + 1 FROM l JOIN e ON e.b = l.x WHERE e.a NOT IN (SELECT x FROM z)),"
    " o AS (SELECT n.x AS item, CAST(max(stage) AS INTEGER) AS stage, CASE WHEN max(stage) IS NOT NULL THEN 'ok' WHEN max(cycle) IS NOT NULL THEN 'cycle' ELSE 'blocked' END AS status, max(cycle) AS cycle"
    " FROM n LEFT JOIN l USING (x) LEFT JOIN c USING (x) GROUP BY n.x)"
)


def _requires(part: DataFrame) -> DataFrame:
    keys = part.select("p_partkey", "p_size", F.expr("p_partkey div 2").alias("half")).filter("p_partkey > 1")
    down = keys.join(part.select(F.col("p_partkey").alias("half")), "half")
    up = down.filter("p_size = 1").select(F.col("half").alias("name"), F.col("p_partkey").alias("needs"))
    return down.select(F.col("p_partkey").alias("name"), F.col("half").alias("needs")).unionByName(up)


@_query(f"WITH RECURSIVE {_REQUIRES} SELECT * FROM o")
def import_order(spark, table):
    return deps.import_order(_requires(table("part")), "name", "needs")


@_query(
    f"WITH RECURSIVE {_REQUIRES}, d AS (SELECT DISTINCT l_orderkey AS t, l_partkey AS i FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL), w AS (SELECT t, i FROM d UNION SELECT t, b FROM d JOIN r ON i = a)"
    " SELECT t AS agent_key, i AS item, CASE WHEN status IS NULL THEN 1 ELSE stage END AS stage, coalesce(status, 'ok') AS status,"
    " CAST(row_number() OVER (PARTITION BY t ORDER BY CASE WHEN status IS NULL THEN 1 ELSE stage END NULLS LAST, i) AS INTEGER) AS position FROM w LEFT JOIN o ON i = item"
)
def transitive_plan(spark, table):
    return deps.transitive_plan(table("lineitem").select(F.col("l_orderkey").alias("agent_key"), F.col("l_partkey").alias("name")), _requires(table("part")))


@_query(
    "WITH s AS (SELECT event_type AS t, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)"
    " SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id NULLS FIRST ROWS 4 PRECEDING), 4) AS moving_average, round((value - lo) / (hi - lo), 4) AS min_max, round((value - mu) / sd, 4) AS z_score FROM events JOIN s ON event_type IS NOT DISTINCT FROM t"
)
def smooth_and_scale(spark, table):
    out = aggregates.smooth_and_scale(table("events").select("event_id", "event_type", "ts", "value"), "event_type", ["ts", "event_id"], "value", 5)
    return out.select("event_id", *(F.round(c, 4).alias(c) for c in ("moving_average", "min_max", "z_score")))


# Sorts and top k


@_query(
    "WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents),"
    " l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) * 1.0 / (SELECT count(*) FROM documents) AS mean),"
    " f AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN ('the', 'license', 'token', 'mail1') GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM f GROUP BY 1)"
    " SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM f JOIN d USING (t) JOIN l USING (doc_id), a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
)
def keyword_search(spark, table):
    return search.keyword_search(table("documents"), "doc_id", "text", ["the", "license", "token", "mail1"], 20)


@_query(
    "WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents),"
    " q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),"
    " l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) * 1.0 / (SELECT count(*) FROM documents) AS mean),"
    " f AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN (SELECT t FROM q) GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM f GROUP BY 1),"
    " x AS (SELECT item_id AS query, doc_id AS key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM q JOIN f USING (t) JOIN d USING (t) JOIN l USING (doc_id), a GROUP BY ALL)"
    " SELECT query, CAST(row_number() OVER o AS INTEGER) AS rank, key, score FROM x WINDOW o AS (PARTITION BY query ORDER BY score DESC, key) QUALIFY row_number() OVER o <= 5"
)
def index_search(spark, table):
    path = f"{shared_folder(spark)}/index"
    index.build_index(table("documents"), "doc_id", "text", path)
    return index.Index(spark, path).search(table("benchmark").select(F.col("item_id").alias("query"), "text"), 5)


_COSINE = (
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS vec_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS score"
    " FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) SELECT query, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"
)


@_query(_COSINE)
def vector_index_search(spark, table):
    path = f"{shared_folder(spark)}/vectors"
    vectors.build_vector_index(table("embeddings"), path)
    return vectors.VectorIndex(spark, path).search(table("embeddings").filter("vec_id % 100 = 0"), 5)


@_query(_COSINE)
def related_items(spark, table):
    return vectors.nearest(table("embeddings"), table("embeddings").filter("vec_id % 100 = 0"), 5)


@_query(
    "WITH s AS (SELECT p_brand, sum(p_retailprice) AS total FROM part GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY total DESC, p_brand NULLS FIRST) > 5 AS is_other FROM s)"
    " SELECT CASE WHEN is_other THEN 'other' ELSE p_brand END AS p_brand, is_other, round(sum(total), 2) AS total FROM t GROUP BY 1, 2"
)
def top_n_with_other(spark, table):
    return aggregates.top_n_with_other(table("part"), "p_brand", "p_retailprice", 5).withColumn("total", F.round("total", 2))


# Sets


@_query(
    "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 > 2)"
    " SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s"
)
def catalog_diff(spark, table):
    orders = table("orders").select("o_orderkey", "o_orderstatus")
    new = orders.filter("o_orderkey % 10 > 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 5, "X").otherwise(F.col("o_orderstatus")))
    return versions.catalog_diff(orders.filter("o_orderkey % 10 < 8"), new, "o_orderkey", "o_orderstatus")


@_query(
    "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 997 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 991 = 5 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 1009 <> 7)"
    " SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p"
)
def hash_tree_diff(spark, table):
    """Two releases of orders, alike in all but a few rows; only buckets that differ are read."""
    orders, path = table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), shared_folder(spark)
    new = orders.filter("o_orderkey % 1009 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 991 == 5, "X").otherwise(F.col("o_orderstatus")))
    for df, name in ((orders.filter("o_orderkey % 997 <> 0"), "old"), (new, "new")):
        hashtree.write_state(df, "o_orderkey", ["o_orderstatus", "o_totalprice"], f"{path}/{name}")
    return hashtree.States(spark, f"{path}/old", f"{path}/new").diff("o_orderkey")


# Reviews


@_query(
    "WITH h AS (SELECT l_orderkey AS agent_key, max(l_linenumber = 1) AS m, max(l_linenumber = 2) AS r FROM lineitem GROUP BY 1)"
    " SELECT agent_key, 'manifest_missing' AS rule, 'fail' AS severity, 'agent.json' AS evidence FROM h WHERE m IS NOT TRUE UNION ALL SELECT agent_key, 'readme_missing', 'warn', 'README.md' FROM h WHERE r IS NOT TRUE"
)
def check_structure(spark, table):
    kinds = F.when(F.col("l_linenumber") == 1, "manifest").when(F.col("l_linenumber") == 2, "readme").otherwise("other")
    return review.check_structure(table("lineitem").select(F.col("l_orderkey").alias("agent_key"), kinds.alias("kind")))


@_query(
    "SELECT 'hub/' || lang || '/' || doc_id AS agent_key, 'depth_shallow' AS rule, 'fail' AS severity, 'hub/' || lang || '/' || doc_id AS evidence FROM documents WHERE doc_id % 5 = 0"
    " UNION ALL SELECT lang || '/' || source || '/' || doc_id, 'depth_deep', 'fail', 'old/agent.json' FROM documents WHERE doc_id % 5 = 1"
    " UNION ALL SELECT lang || '/' || source || '/' || doc_id, 'manifest_missing', 'fail', 'agent.json' FROM documents WHERE doc_id % 5 IN (1, 2)"
    " UNION ALL SELECT lang || '/' || source || '/' || doc_id, 'readme_missing', 'warn', 'README.md' FROM documents WHERE doc_id % 5 IN (1, 3, 4)"
)
def check_depth(spark, table):
    names = F.array(*map(F.lit, ("", "old/agent.json", "README.md", "agent.json", "agent.json")))
    place, file = F.concat_ws("/", F.lit("hub"), "lang", "source", "doc_id"), F.get(names, (F.col("doc_id") % 5).cast("int"))
    paths = table("documents").select(F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", F.lit("hub"), "lang", "doc_id")).otherwise(F.concat_ws("/", place, file)).alias("path"))
    return review.check_structure(packages.classify_paths(paths))


@_query(
    "WITH c AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN text END) AS s, max(CASE WHEN role = 'assistant' THEN text END) AS a FROM conversations GROUP BY 1)"
    " SELECT conv_id AS agent_key, 'blank_system_prompt' AS rule, 'fail' AS severity, 'system_prompt' AS evidence FROM c WHERE coalesce(trim(s), '') = '' UNION ALL SELECT conv_id, 'blank_answer', 'fail', 'answer' FROM c WHERE coalesce(trim(a), '') = ''"
)
def check_completeness(spark, table):
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    agents = table("conversations").groupBy(F.col("conv_id").alias("agent_key")).agg(of("system").alias("system_prompt"), of("assistant").alias("answer"))
    return review.check_completeness(agents, ["system_prompt", "answer"])


@_query(" UNION ALL ".join(f"SELECT doc_id AS agent_key, 'prompt_{r}' AS rule, 'warn' AS severity, '{r}' AS evidence FROM documents WHERE regexp_matches(text, '{p}') IS NOT TRUE" for r, p in PROMPT_RULES))
def lint_prompts(spark, table):
    return review.lint_prompts(table("documents").select(F.col("doc_id").alias("agent_key"), "text"), PROMPT_RULES, text="text")


@_query(" UNION ALL ".join(f"SELECT doc_id AS agent_key, '{r}' AS rule, m AS match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents) GROUP BY ALL" for r, p in SENSITIVE_RULES))
def scan_sensitive(spark, table):
    return review.scan_sensitive(table("documents").select(F.col("doc_id").alias("agent_key"), "text"), SENSITIVE_RULES)


@_query(
    "WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) "
    + " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{r}' AS rule FROM l WHERE regexp_matches(line, '{p}')" for r, p in CODE_RULES)
)
def scan_code(spark, table):
    return review.scan_code(table("documents"), CODE_RULES, "doc_id", "text")


@_query(" UNION ALL ".join(f"SELECT doc_id AS agent_key, '{r}' AS licence, {str(ok).lower()} AS compatible FROM documents WHERE regexp_matches(text, '{p}')" for r, p, ok in LICENCE_RULES))
def detect_licences(spark, table):
    return review.detect_licences(table("documents").select(F.col("doc_id").alias("agent_key"), "text"), LICENCE_RULES)


@_query(
    "WITH f AS ("
    + " UNION ALL ".join([f"SELECT doc_id, 'sensitive_{r}' AS rule, 2 AS s FROM documents WHERE regexp_matches(text, '{p}')" for r, p in SENSITIVE_RULES] + [f"SELECT doc_id, 'licence_{r}', {0 if ok else 1} FROM documents WHERE regexp_matches(text, '{p}')" for r, p, ok in LICENCE_RULES])
    + "), g AS (SELECT doc_id, max(s) AS s, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reasons FROM f GROUP BY 1), l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1)"
    " SELECT d.doc_id AS agent_key, CASE WHEN g.s = 2 OR l.q = 0 THEN 'fail' WHEN g.s = 1 OR l.q IS NULL THEN 'needs-human' ELSE 'pass' END AS verdict, coalesce(reasons, '') AS reasons FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)"
)
def review_verdict(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("agent_key"), "text")
    private = review.scan_sensitive(docs, SENSITIVE_RULES).select("agent_key", F.concat(F.lit("sensitive_"), "rule").alias("rule"), F.lit("fail").alias("severity"))
    licences = review.detect_licences(docs, LICENCE_RULES).select("agent_key", F.concat(F.lit("licence_"), "licence").alias("rule"), F.when(F.col("compatible"), "warn").otherwise("unknown").alias("severity"))
    tests = table("labels").select(F.col("doc_id").alias("agent_key"), (F.col("quality") == 1).alias("passed"))
    return review.review_verdict(docs, [private, licences], tests)


@_query(
    "WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), f AS ("
    + " UNION ALL ".join(
        [f"SELECT lang, 'sensitive_{r}' AS rule, 'fail' AS severity, count(DISTINCT m) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents) GROUP BY 1" for r, p in SENSITIVE_RULES]
        + [f"SELECT lang, 'code_{r}', 'unknown', count(*) FROM l WHERE regexp_matches(line, '{p}') GROUP BY 1" for r, p in CODE_RULES]
        + [f"SELECT lang, 'licence_{r}', '{'warn' if ok else 'unknown'}', 1 FROM documents WHERE regexp_matches(text, '{p}') GROUP BY 1" for r, p, ok in LICENCE_RULES]
    )
    + ") SELECT 'generic/texts/' || coalesce(lang, 'none') AS agent_key, rule, severity, CAST(n AS BIGINT) AS n FROM f"
)
def stream_review(spark, table):
    landing = _hub(spark, table("documents"))
    out = f"{shared_folder(spark)}/findings"
    streaming.stream_review(spark, landing, out, f"{shared_folder(spark)}/progress")
    return spark.read.parquet(out).groupBy("agent_key", "rule", "severity").agg(F.count_distinct("evidence").alias("n"))


_FIRST = "array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:%d], ' ')"


@_query(
    f"WITH t AS (SELECT DISTINCT {_FIRST % 2} AS term, 2 AS k FROM benchmark UNION SELECT DISTINCT {_FIRST % 3}, 3 FROM benchmark),"
    " w AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)),"
    " g AS (SELECT doc_id, t || ' ' || lead(t) OVER o AS two, t || ' ' || lead(t) OVER o || ' ' || lead(t, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))"
    " SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, two AS g, 2 AS k FROM g UNION ALL SELECT doc_id, three, 3 FROM g) x JOIN t ON x.g = t.term AND x.k = t.k GROUP BY ALL"
)
def blocked_phrases(spark, table):
    """The first two and the first three words of each benchmark item as terms, which overlap."""
    words = tokens(F.col("text"))
    terms = table("benchmark").select(F.explode(F.array(*(F.array_join(F.slice(words, 1, n), " ") for n in (2, 3)))).alias("term"))
    return phrases.blocked_phrases(table("documents"), "doc_id", "text", terms)


@_query(
    "WITH v AS (SELECT conv_id, string_split(text, ' ')[1] AS v FROM conversations WHERE turn = 0), w AS (SELECT conv_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM conversations WHERE turn > 0)"
    " SELECT conv_id AS agent_key, CASE WHEN v IS NOT NULL THEN EXISTS (SELECT 1 FROM w WHERE w.conv_id = v.conv_id AND t = v) END AS covered FROM v"
)
def changelog_coverage(spark, table):
    turns = table("conversations").withColumnRenamed("conv_id", "agent_key")
    return review.changelog_coverage(turns.filter("turn = 0").select("agent_key", F.split("text", " ")[0].alias("version")), turns.filter("turn > 0").select("agent_key", F.col("text").alias("content")))


# Duplicates and overlap


@_query(
    "WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)"
    " SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS kept, count(*) OVER (PARTITION BY t) AS group_size FROM n"
)
def exact_duplicates(spark, table):
    return search.exact_duplicates(table("documents"), "doc_id", "text")


def _grams(table: str, key: str, n: int) -> str:
    words = f"SELECT {key}, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})"
    gram = " || ' ' || ".join(["t", *(f"lead(t, {k}) OVER (PARTITION BY {key} ORDER BY i)" for k in range(1, n))])
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, {gram} AS g FROM ({words})) WHERE g IS NOT NULL"


#: Pairs of representatives with a similarity of 0.8 of five-word n-grams.
_NEAR = (
    f"d AS ({_grams('documents', 'doc_id', 5)}), s AS (SELECT doc_id, list(g ORDER BY g) AS g FROM d GROUP BY 1),"
    " r AS (SELECT min(doc_id) AS id, g FROM s GROUP BY g), e AS (SELECT id, len(g) AS n, unnest(g) AS h FROM r),"
    " p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY ALL)"
)


@_query(f"WITH {_NEAR} SELECT id_a, id_b, round(c / (na + nb - c), 6) AS similarity FROM p WHERE c >= 0.8 * (na + nb - c)")
def near_duplicates(spark, table):
    return search.near_duplicates(table("documents"), "doc_id", "text", 5, 0.8).withColumn("similarity", F.round("similarity", 6))


@_query(
    f"WITH RECURSIVE {_NEAR}, m AS (SELECT doc_id, coalesce(r.id, doc_id) AS representative FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN r ON s.g = r.g),"
    " k AS (SELECT id_a AS a, id_b AS b FROM p WHERE c >= 0.8 * (na + nb - c) UNION ALL SELECT id_b, id_a FROM p WHERE c >= 0.8 * (na + nb - c)),"
    " w AS (SELECT representative AS x, representative AS y FROM m UNION SELECT x, b FROM w JOIN k ON y = a), g AS (SELECT x, min(y) AS component FROM w GROUP BY 1)"
    " SELECT doc_id, representative, component, count(*) OVER (PARTITION BY component) AS group_size FROM m JOIN g ON x = representative"
)
def duplicate_groups(spark, table):
    return groups.duplicate_groups(table("documents"), "doc_id", "text")


@_query(f"WITH d AS ({_grams('documents', 'doc_id', 8)}), b AS ({_grams('benchmark', 'item_id', 8)}) SELECT doc_id, count(*) AS n_shared FROM d WHERE g IN (SELECT g FROM b) GROUP BY 1")
def overlap_with_corpus(spark, table):
    return search.overlap_with_corpus(table("documents"), "doc_id", "text", table("benchmark"), "text", 8)


def _places(table: str, key: str, n: int) -> str:
    words = f"SELECT {key}, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})"
    gram = " || ' ' || ".join(["t", *(f"lead(t, {k}) OVER (PARTITION BY {key} ORDER BY i)" for k in range(1, n))])
    return f"SELECT * FROM (SELECT {key}, i, {gram} AS g FROM ({words})) WHERE g IS NOT NULL"


@_query(
    f"WITH d AS ({_places('documents', 'doc_id', 8)}), b AS ({_places('benchmark', 'item_id', 8)}),"
    " m AS (SELECT doc_id, item_id, d.i AS p, d.i - b.i AS diag, d.i - row_number() OVER (PARTITION BY doc_id, item_id, d.i - b.i ORDER BY d.i) AS run FROM d JOIN b USING (g))"
    " SELECT doc_id, min(p) AS start, max(p) + 8 AS \"end\", item_id AS item, min(p) - diag AS item_start FROM m GROUP BY doc_id, item_id, diag, run"
)
def shared_passages(spark, table):
    return passages.shared_passages(table("documents"), "doc_id", "text", table("benchmark"), "item_id", "text", 8)


# Preparation


@_query(
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'), '#{3,}|\\*{3,}|%{3,}|={3,}|_{3,}|-{3,}', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM documents"
)
def clean_text(spark, table):
    return table("documents").select("doc_id", prep.clean_text(F.col("text")).alias("text"))


@_query("SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(a) + 1), lambda i: {'i': i, 'first': list_position(a, a[i]) = i}), lambda x: x['first']), lambda x: a[x['i']]), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def drop_repeated_lines(spark, table):
    return table("documents").select("doc_id", prep.drop_repeated_lines(F.col("text")).alias("text"))


@_query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 97 END AS amount, CASE WHEN event_id % 11 = 0 THEN 'amount' END AS rejected_column FROM events")
def cast_or_reject(spark, table):
    text = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.col("event_id") % 97).cast("string"))
    good, rejects = prep.cast_or_reject(table("events").select("event_id", text.alias("amount")), {"amount": "long"})
    return good.withColumn("rejected_column", F.lit(None).cast("string")).unionByName(rejects.withColumn("amount", F.lit(None).cast("long")))


@_query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) SELECT o_orderkey, p IS NULL AS o_totalprice_imputed, round(coalesce(p, (SELECT median(p) FROM o)), 4) AS o_totalprice FROM o")
def impute(spark, table):
    holes = table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return prep.impute(holes, ["o_totalprice"], "median").withColumn("o_totalprice", F.round("o_totalprice", 4))


@_query("SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<a [^>]*href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links FROM pages")
def html_to_rows(spark, table):
    return prep.html_to_rows(table("pages"), "page_id", "html").select("page_id", "title", "heading", "n_links")


@_query("SELECT CAST(b AS INTEGER) AS bin, count(l_extendedprice) AS n_rows FROM range(1, 21) AS t(b) LEFT JOIN lineitem ON least(greatest(floor(l_extendedprice / 5000.0) + 1, 1), 20) = b GROUP BY 1")
def price_histogram(spark, table):
    return aggregates.histogram(table("lineitem"), "l_extendedprice", 0.0, 100000.0, 20)


@_query(
    "WITH c AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM c), s AS (SELECT unnest(generate_series((SELECT min(d) FROM c), (SELECT max(d) FROM c), INTERVAL 1 DAY)) AS d)"
    " SELECT k.event_type, strftime(s.d, '%Y-%m-%d') AS bucket, coalesce(n, 0) AS n_rows FROM k CROSS JOIN s LEFT JOIN c ON c.event_type = k.event_type AND c.d = s.d"
)
def time_buckets(spark, table):
    return aggregates.time_buckets(table("events"), "ts", "event_type").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@_query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, " + ", ".join(f"count(CASE WHEN o_orderpriority = '{p}' THEN 1 END) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def pivot_table(spark, table):
    out = aggregates.pivot_table(table("orders"), [F.year("o_orderdate").alias("year")], "o_orderpriority", PRIORITIES, F.count(F.lit(1)))
    return out.na.fill(0, PRIORITIES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which dependencies does this environment miss, agent by agent? Manifests are packed as JSON, parsed, flattened and compared with the registry."""
    agents = _orders_as_agents(spark.read.parquet(f"{folder}/lineitem.parquet"))
    files = agents.select("agent_key", F.to_json(F.struct(F.col("agent_key").cast("string").alias("id"), "skills", "mcps")).alias("content"))
    bindings = manifest.flatten_bindings(packages.parse_manifests(files).filter("status = 'ok'"))
    registry = spark.read.parquet(f"{folder}/part.parquet").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("name"))
    return deps.missing_platform_deps(bindings, registry, ["name"])
