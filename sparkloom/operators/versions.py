"""Version history and catalogue states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import version_parts


def version_audit(snapshots: DataFrame, key: str = "agent_key", order: tuple[str, ...] = ("snapshot_ts",), version: str = "version", content: str = "content_hash") -> DataFrame:
    """The snapshots whose content changed from the one before, with status: ok (version grew), fail (it didn't), unknown (a version isn't dotted integers)."""
    w = Window.partitionBy(key).orderBy(*order)
    parts = snapshots.withColumn("parts", version_parts(F.col(version)))
    seen = parts.withColumns({"before": F.lag("parts").over(w), "content_before": F.lag(content).over(w), "position": F.row_number().over(w)})
    changed = seen.filter((F.col("position") > 1) & ~F.col(content).eqNullSafe(F.col("content_before")))
    status = F.when(F.col("parts").isNull() | F.col("before").isNull(), "unknown").when(F.col("parts") > F.col("before"), "ok").otherwise("fail")
    return changed.withColumn("status", status).drop("parts", "before", "content_before", "position")


def latest_version(snapshots: DataFrame, key: str = "agent_key", order: tuple[str, ...] = ("snapshot_ts",)) -> DataFrame:
    """The newest snapshot of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return snapshots.withColumn("newest", F.row_number().over(w)).filter("newest = 1").drop("newest")


def catalog_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change {added, removed, changed}; rows without change don't appear. Nulls equal each other, as keys and as content."""
    a, b = old.select(F.col(key).alias("old_key"), F.col(content).alias("a"), F.lit(1).alias("x")), new.select(F.col(key).alias("new_key"), F.col(content).alias("b"), F.lit(1).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    met = a.join(b, F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    return met.select(F.coalesce("old_key", "new_key").alias(key), change.alias("change")).filter("change is not null")
