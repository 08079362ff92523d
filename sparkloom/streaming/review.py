"""Reviewing packages as they land."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.storage import checkpointed
from sparkloom.operators import review
from sparkloom.plans.schemas import CODE_RULES, LICENCE_RULES, NEEDED, PROMPT_RULES, REQUIRED, SENSITIVE_RULES
from sparkloom.sources.packages import classify_paths, parse_manifests


def _holds(rule: str) -> Column:
    """Whether a line can match a rule; looks for plain text only."""
    return reduce(Column.__or__, [F.contains("line", F.lit(x)) for x in NEEDED[rule]]) if rule in NEEDED else F.lit(True)


def _line_findings(files: DataFrame) -> DataFrame:
    """Findings of sensitive content, risky code and licences. Files are read once, by line: no match of these rules goes beyond one. A licence counts once a file, sensitive content once an agent."""
    lines = files.select("agent_key", "path", "kind", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    private, risky = F.col("kind") != "mcp", F.col("kind").isin("skill", "mcp")
    where = F.concat_ws(":", "path", (F.col("line_no") + 1).cast("string"))
    row = lambda rule, severity, evidence, file: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), evidence.alias("evidence"), file.alias("file"))
    none = F.lit(None).cast("string")
    matches = lambda r, p: F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(0)), lambda m: row(f"sensitive_{r}", "fail", m, none))
    found = [F.when(private & _holds(r), matches(r, p)) for r, p in SENSITIVE_RULES]
    found += [F.when(risky & _holds(r) & F.col("line").rlike(p), F.array(row(f"code_{r}", "unknown", where, none))) for r, p in CODE_RULES]
    found += [F.when(_holds(r) & F.col("line").rlike(p), F.array(row(f"licence_{r}", "warn" if ok else "unknown", F.lit(r), F.col("path")))) for r, p, ok in LICENCE_RULES]
    some = lines.filter(reduce(Column.__or__, [_holds(r[0]) for r in (*SENSITIVE_RULES, *CODE_RULES, *LICENCE_RULES)]))
    each = some.select("agent_key", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f")).select("agent_key", "f.*")
    return each.distinct().drop("file")


def review_files(files: DataFrame) -> DataFrame:
    """Findings of files (path, content): completeness, prompts, sensitive content, risky code, licences (a person looks at those that aren't compatible). Each file is judged by itself, so batches add up."""
    placed = classify_paths(files)
    agents = parse_manifests(checkpointed(placed.filter("kind = 'manifest'").select("agent_key", "content")))
    good = agents.filter("status = 'ok'")
    corrupt = agents.filter("status = 'corrupt'").select("agent_key", F.lit("manifest_corrupt").alias("rule"), F.lit("fail").alias("severity"), F.lit("agent.json").alias("evidence"))
    return (
        review.check_completeness(good, REQUIRED)
        .unionByName(review.lint_prompts(good, PROMPT_RULES))
        .unionByName(corrupt)
        .unionByName(_line_findings(placed.filter("kind in ('manifest', 'readme', 'skill', 'mcp')")))
    )


def stream_review(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """Reviews every newly landed file once and appends its findings to out (Parquet). Submissions land below new paths; an edited file isn't read again."""
    hub = landing.rstrip("/").rpartition("/")[2]
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(landing)
    path = F.concat(F.lit(f"{hub}/"), F.substring_index(F.col("_metadata.file_path"), f"/{hub}/", -1))

    def one(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again replaces its own part.
        review_files(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    named = files.select(path.alias("path"), F.col("value").alias("content"))
    named.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
