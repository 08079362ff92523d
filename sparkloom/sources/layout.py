"""Clustered catalogue files: rows in Z-order of several facets, so that filters on any of them skip row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a facet; its values are dealt to 2 ** BITS ranges of about as many rows.
BITS = 8


def _ordered(df: DataFrame, facet: str) -> Column:
    """A number in the order of the facet: of text, its first six bytes."""
    kind = dict(df.dtypes)[facet]
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(facet).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    if kind in ("date",) or kind.startswith("timestamp"):
        return F.unix_micros(F.col(facet).cast("timestamp"))
    return F.col(facet).cast("double")


def with_z_order(df: DataFrame, facets: list[str], column: str = "z_order", bits: int = BITS) -> DataFrame:
    """Adds the bits of each facet's range, taken in turn. Ranges come from approximate quantiles, so skewed facets are cut where their rows are; nulls are in a range of their own."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers, places = [f"{column}_n{i}" for i in range(len(facets))], [f"{column}_p{i}" for i in range(len(facets))]
    placed = df.withColumns({n: _ordered(df, f).cast("double") for n, f in zip(numbers, facets, strict=True)})
    ends = placed.agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in numbers)).first()  # 2 ** bits numbers a facet
    splits = [[-float("inf"), *sorted(set(ends[n] or [0.0])), float("inf")] for n in numbers]
    placed = Bucketizer(splitsArray=splits, inputCols=numbers, outputCols=places, handleInvalid="keep").transform(placed)
    bit = lambda i, b: F.shiftleft(F.shiftright(F.col(places[i]).cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(facets) + i)
    z = reduce(Column.bitwiseOR, (bit(i, b) for i in range(len(facets)) for b in range(bits + 1)))
    return placed.withColumn(column, z).drop(*numbers, *places)


def write_clustered(df: DataFrame, path: str, facets: list[str], bloom: list[str] | None = None, files: int | None = None, row_group: int = 8 << 20) -> None:
    """Parquet in Z-order of the facets: files and row groups hold narrow ranges of all of them, which their min/max figures tell the scan. bloom: columns that get Bloom filters, for equality on values without an order."""
    placed = with_z_order(df, facets)
    dealt = (placed.repartitionByRange(files, "z_order") if files else placed.repartitionByRange("z_order")).sortWithinPartitions("z_order").drop("z_order")
    out = dealt.write.mode("overwrite").option("parquet.block.size", str(row_group))
    for c in bloom or []:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
