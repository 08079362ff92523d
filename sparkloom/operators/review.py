"""Review checks. Their findings have agent_key, rule, severity and evidence, and only gather evidence for a person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.operators.deps import small


def _long(wide: DataFrame, key: str, rules: dict[str, tuple]) -> DataFrame:
    """A finding for each rule whose condition holds: {rule: (condition, severity, evidence)}."""
    found = F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(e).alias("evidence"))) for r, (c, s, e) in rules.items()))
    return wide.select(F.col(key).alias("agent_key"), F.explode(F.array_compact(found)).alias("f")).select("agent_key", "f.*")


def check_structure(packages: DataFrame, key: str = "agent_key", kind: str = "kind") -> DataFrame:
    """Findings: no manifest fails, no README warns. With the columns path and file, a file above an agent's folder and a manifest below its top fail too (the first by its path)."""
    own = packages.filter(F.col(key).isNotNull()) if {"path", "file"} <= {*packages.columns} else packages
    has = own.groupBy(key).agg(*(F.max((F.col(kind) == k).cast("int")).alias(k) for k in ("manifest", "readme")))
    missing = _long(has, key, {"manifest_missing": (F.coalesce("manifest", F.lit(0)) == 0, "fail", "agent.json"), "readme_missing": (F.coalesce("readme", F.lit(0)) == 0, "warn", "README.md")})
    if own is packages:
        return missing
    shallow = packages.filter(F.col(key).isNull()).select(F.col("path").alias("agent_key"), F.lit("depth_shallow").alias("rule"), F.lit("fail").alias("severity"), F.col("path").alias("evidence"))
    deep = own.filter(F.col("file").rlike("/agent\\.json$")).select(F.col(key).alias("agent_key"), F.lit("depth_deep").alias("rule"), F.lit("fail").alias("severity"), F.col("file").alias("evidence"))
    return missing.unionByName(shallow).unionByName(deep)


def check_completeness(agents: DataFrame, required: list[str], key: str = "agent_key") -> DataFrame:
    """Findings: a required field that is null or blank fails."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return _long(agents, key, {f"blank_{c}": (blank(c), "fail", c) for c in required})


def lint_prompts(df: DataFrame, rules: list[tuple[str, str]], key: str = "agent_key", text: str = "system_prompt") -> DataFrame:
    """Findings: a rule whose pattern the text lacks warns."""
    return _long(df, key, {f"prompt_{r}": (~F.coalesce(F.col(text).rlike(p), F.lit(False)), "warn", r) for r, p in rules})


def scan_sensitive(df: DataFrame, rules: list[tuple[str, str]], key: str = "agent_key", text: str = "text") -> DataFrame:
    """key, rule, match, n: each different match of each rule in a text and how often it occurs. The text is read once."""
    found = F.array(*(F.struct(F.lit(r).alias("rule"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("m")) for r, p in rules))
    each = df.select(key, F.explode(found).alias("f")).select(key, "f.rule", F.explode("f.m").alias("match"))
    return each.groupBy(key, "rule", "match").agg(F.count("*").alias("n"))


def scan_code(df: DataFrame, rules: list[tuple[str, str]], key: str = "path", text: str = "content") -> DataFrame:
    """key, line_no (from 1), rule: lines that match risky patterns. Text only; nothing is run."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules)))
    return lines.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(hits).alias("rule"))


def detect_licences(df: DataFrame, rules: list[tuple[str, str, bool]], key: str = "agent_key", text: str = "text") -> DataFrame:
    """key, licence, compatible: licence statements found in a text."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(r).alias("licence"), F.lit(ok).alias("compatible"))) for r, p, ok in rules)))
    return df.select(key, F.explode(found).alias("f")).select(key, "f.*")


def blocked_terms(df: DataFrame, terms: DataFrame, key: str = "agent_key", text: str = "text", mode: str = "word") -> DataFrame:
    """key, n_hits, n_terms: how many tokens of a text are blocked, and how many different ones. terms: term."""
    words = df.select(key, F.explode(tokens(F.col(text), mode)).alias("term"))
    blocked = terms.select(F.lower("term").alias("term")).distinct()
    return words.join(small(blocked), "term").groupBy(key).agg(F.count("*").alias("n_hits"), F.count_distinct("term").alias("n_terms"))


def changelog_coverage(agents: DataFrame, changelogs: DataFrame, key: str = "agent_key") -> DataFrame:
    """key, covered: whether the changelog has the version as a token between blanks; null without a version, false without a changelog."""
    logs = changelogs.groupBy(key).agg(F.collect_set("content").alias("logs"))
    words = F.flatten(F.transform(F.coalesce("logs", F.array().cast("array<string>")), lambda t: F.split(t, r"\s+")))
    return agents.join(logs, key, "left").select(key, F.when(F.col("version").isNotNull(), F.array_contains(words, F.col("version"))).alias("covered"))


def review_verdict(agents: DataFrame, findings: list[DataFrame], test_reports: DataFrame, key: str = "agent_key") -> DataFrame:
    """key, verdict {pass, fail, needs-human}, reasons: a failing finding or test fails; an unknown finding or no test report needs a person."""
    every = reduce(DataFrame.unionByName, [f.select(F.col("agent_key").alias(key), "rule", "severity") for f in findings])
    worst = every.groupBy(key).agg(F.max((F.col("severity") == "fail").cast("int")).alias("fails"), F.max((F.col("severity") == "unknown").cast("int")).alias("unknowns"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("reasons"))
    tests = test_reports.groupBy(key).agg(F.min(F.col("passed").cast("int")).alias("passed"))
    joined = agents.select(key).distinct().join(worst, key, "left").join(tests, key, "left")
    verdict = F.when((F.col("fails") == 1) | (F.col("passed") == 0), "fail").when((F.col("unknowns") == 1) | F.col("passed").isNull(), "needs-human").otherwise("pass")
    return joined.select(key, verdict.alias("verdict"), F.coalesce("reasons", F.lit("")).alias("reasons"))
