"""Flattening manifests, finding agents, and pull-request titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_bindings(agents: DataFrame, key: str = "agent_key") -> DataFrame:
    """key, kind {skill, mcp}, name, custom: one row a bound skill or MCP. Null or empty arrays give none."""
    one = lambda column, kind: agents.select(key, F.lit(kind).alias("kind"), F.explode(column).alias("b")).select(key, "kind", "b.name", "b.custom")
    return one("skills", "skill").unionByName(one("mcps", "mcp"))


def flatten_examples(agents: DataFrame, key: str = "agent_key") -> DataFrame:
    """key, position (from 0), turn, role, text of each example turn."""
    return agents.select(key, F.posexplode("examples").alias("position", "e")).select(key, "position", "e.*")


def flatten_params(agents: DataFrame, casts: dict[str, str], key: str = "agent_key", params: str = "params") -> DataFrame:
    """key, param, value, typed: casts names the type of a parameter; typed is its value as a double where that works, else null."""
    rows = agents.select(key, F.explode(params).alias("param", "value"))
    typed = F.lit(None).cast("double")
    for name, kind in casts.items():
        typed = F.when(F.col("param") == name, F.col("value").try_cast(kind).try_cast("double")).otherwise(typed)
    return rows.withColumn("typed", typed)


def flatten_kb_refs(agents: DataFrame, key: str = "agent_key") -> DataFrame:
    """key, kb_ref: one row a knowledge-base reference."""
    return agents.select(key, F.explode("kb_refs").alias("kb_ref"))


def facet_filter(agents: DataFrame, params: dict | None = None, map_column: str = "params", **equals) -> DataFrame:
    """Rows whose columns equal the given values; a list means any of them, a (low, high) tuple a closed range. Pushed down to the scan.

    params are the same for entries of the map of parameters; they are compared as the type of the value asked for, and a
    parameter that is missing or of another type doesn't match.
    """
    fits = lambda column, value: column.between(*value) if isinstance(value, tuple) else column.isin(value) if isinstance(value, list) else column == value
    for name, value in equals.items():
        agents = agents.filter(fits(F.col(name), value))
    kinds = {bool: "boolean", int: "long", float: "double"}
    for name, value in (params or {}).items():
        one = value[0] if isinstance(value, (tuple, list)) else value
        agents = agents.filter(fits(F.col(map_column)[name].try_cast(kinds.get(type(one), "string")), value))
    return agents


def parse_pr_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds is_new_agent and display_name (null if the title has another form)."""
    name = F.regexp_extract(F.col(title), r"^\[new agent\] (.+)$", 1)
    return df.withColumns({"is_new_agent": F.coalesce(name != "", F.lit(False)), "display_name": F.when(name != "", name)})
