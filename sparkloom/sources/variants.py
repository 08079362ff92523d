"""Manifests as VARIANT: keys outside the declared schema keep their types, are stored in columns, and can be filtered."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a facet asks for, by the type of its value; a bool isn't asked for as a number.
KINDS = {bool: "boolean", int: "long", float: "double", str: "string"}


def parse_variants(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds manifest (variant; null if corrupt) and status {ok, corrupt}. Text that isn't one JSON object (or null, empty) is corrupt. Parsed once; later steps read the variant."""
    parsed = F.try_parse_json(F.col(content))
    # parse_json takes empty text for null, and other values than objects for what they are.
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return df.withColumns({"manifest": F.when(good, parsed), "status": F.when(good, "ok").otherwise("corrupt")})


@contextmanager
def _shredding(spark: SparkSession):
    names = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def write_variants(df: DataFrame, path: str) -> None:
    """Parquet whose variants are shredded: keys that are frequent and of one type become columns of their own, the rest stays beside them."""
    with _shredding(df.sparkSession):
        df.write.mode("overwrite").parquet(path)


def at(column: str | Column, path: str, kind: str) -> Column:
    """The value at a JSON path if it has that type, else null: numbers and strings don't match each other, whole numbers are doubles too."""
    v = F.col(column) if isinstance(column, str) else column
    own = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    families = {"long": r"^(BIGINT|DECIMAL\([0-9]+,0\))", "double": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": r"^STRING", "boolean": r"^BOOLEAN"}
    return F.when(own.rlike(families[kind]), F.try_variant_get(v, path, kind)) if kind in families else F.try_variant_get(v, path, kind)


def variant_facet(df: DataFrame, params: dict, column: str = "manifest", strict: bool = True) -> DataFrame:
    """Rows whose values at JSON paths equal the given ones; a list means any of them, a (low, high) tuple a closed range.

    strict: only values of the asked-for type match; else values that can be cast do, and on shredded files the scan then reads the
    columns of these keys alone.
    """
    for path, value in params.items():
        one = value[0] if isinstance(value, (tuple, list)) else value
        kind = KINDS[type(one)]
        own = at(column, path, kind) if strict else F.try_variant_get(column, path, kind)
        df = df.filter(own.between(*value) if isinstance(value, tuple) else own.isin(value) if isinstance(value, list) else own == value)
    return df


def variant_keys(df: DataFrame, column: str = "manifest") -> DataFrame:
    """key, kind, n_rows: the keys of the top level, with the type of their values, and how many rows have them. A key may come with several types."""
    spark = df.sparkSession
    rows = df.filter(F.col(column).isNotNull()).select(column)
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col(column).outer())).select("key", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind"))
    return each.groupBy("key", "kind").agg(F.count("*").alias("n_rows"))
