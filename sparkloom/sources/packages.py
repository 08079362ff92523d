"""Reading and writing package trees, manifests and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.schemas import MANIFEST


def classify_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds root, category, agent, agent_key, file and kind of hub/<root>/<category>/<agent>/<file>. A path that is too short gets nulls and kind other."""
    parts = F.split(F.col(path), "/")
    at = lambda i: F.get(parts, F.lit(i))
    file = F.array_join(F.slice(parts, 5, 1000), "/")
    kind = (
        F.when(file == "agent.json", "manifest").when(F.lower(file) == "readme.md", "readme").when(F.lower(file).rlike(r"^changelog[^/]*$"), "changelog")
        .when(file.startswith("skills/"), "skill").when(file.startswith("mcps/"), "mcp").otherwise("other")
    )
    deep = F.size(parts) >= 5
    pick = lambda c: F.when(deep, c)
    return df.withColumns(
        {"root": pick(at(1)), "category": pick(at(2)), "agent": pick(at(3)), "agent_key": pick(F.concat_ws("/", at(1), at(2), at(3))), "file": pick(file), "kind": F.when(deep, kind).otherwise("other")}
    )


def scan_packages(spark: SparkSession, root: str) -> DataFrame:
    """path (from the hub's folder name on), size, mtime, content (text files) and the columns of classify_paths, of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hub = root.rstrip("/").rpartition("/")[2]
    path = F.concat(F.lit(f"{hub}/"), F.substring_index(F.col("_metadata.file_path"), f"/{hub}/", -1))
    text = F.when(F.col("_metadata.file_name").rlike(r"(?i)\.(json|md|py|txt|ya?ml)$"), F.decode("content", "UTF-8"))
    return classify_paths(files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), text.alias("content")))


def parse_manifests(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds the manifest's columns, status {ok, corrupt} and raw. Text that isn't a JSON object (or null, empty) is corrupt; unknown keys stay in raw."""
    parsed = df.withColumn("manifest", F.from_json(F.col(content), MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("manifest").isNotNull() & F.col("manifest._corrupt_record").isNull() & F.col(content).rlike(r"^\s*\{")
    out = parsed.withColumns({"status": F.when(good, "ok").otherwise("corrupt"), "raw": F.col(content)})
    return out.select("*", "manifest.*").drop("manifest", content)


def write_catalog(df: DataFrame, path: str) -> None:
    """Parquet by root and category; rows of a category are written together, hot ones in several files."""
    df.repartition("root", "category").write.mode("overwrite").partitionBy("root", "category").parquet(path)


def read_catalog(spark: SparkSession, path: str, root: str | None = None, category: str | None = None) -> DataFrame:
    """The catalogue, pruned to partitions."""
    df = spark.read.parquet(path)
    for name, value in (("root", root), ("category", category)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def convert_format(spark: SparkSession, src: str, src_fmt: str, dst: str, dst_fmt: str, schema: str) -> DataFrame:
    """Reads src with a declared schema, writes dst, and gives dst back with that schema. CSV and XML lose the difference of null and empty text."""
    options = {"csv": {"header": "true"}, "xml": {"rowTag": "row", "rootTag": "rows"}}
    spark.read.format(src_fmt).schema(schema).options(**options.get(src_fmt, {})).load(src).write.mode("overwrite").format(dst_fmt).options(**options.get(dst_fmt, {})).save(dst)
    return spark.read.format(dst_fmt).schema(schema).options(**options.get(dst_fmt, {})).load(dst)


def custom_name(file: Column) -> Column:
    """The name of a bundled skill or MCP: its file name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
