"""Data preparation: cleaning, typed columns, imputation, extraction from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import checkpointed


def clean_text(text: Column) -> Column:
    """Control characters and runs of three or more symbols (#, *, %, =, _, -) go, runs of blanks become one space, ends are trimmed. Null stays null."""
    no_controls = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    no_symbols = F.regexp_replace(no_controls, r"#{3,}|\*{3,}|%{3,}|={3,}|_{3,}|-{3,}", " ")
    return F.trim(F.regexp_replace(no_symbols, r"[ \t\n\r\f]+", " "))


def drop_repeated_lines(text: Column) -> Column:
    """The text with the first of equal lines only. Null stays null."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def cast_or_reject(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rows whose columns convert, with the new types; the other rows as they were, with the first column at fault. Nulls are good."""
    fault = F.coalesce(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()))
    marked = df.withColumn("rejected_column", fault)
    good = marked.filter("rejected_column is null").drop("rejected_column")
    return good.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()}), marked.filter("rejected_column is not null")


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of the values that aren't null; None without any.

    Equal values are counted first, so a common one is no load. The counts are dealt by ranges of values, the driver sees one
    sum a range, and only the ranges that hold the middle are ordered.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    counts = checkpointed(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["c"]) for r in counts.groupBy("part").agg(F.sum("c").alias("c")).collect())
    total = sum(c for _, c in sums)
    if not total:
        return None
    middle, before, found = {(total - 1) // 2, total // 2}, 0, []
    for part, c in sums:
        if ranks := [m for m in middle if before <= m < before + c]:
            up_to = counts.filter(F.col("part") == part).withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("v")) + before)
            found += [up_to.filter(F.col("upto") > m).agg(F.min("v")).first()[0] for m in ranks]
        before += c
    return sum(found) / len(found)


def impute(df: DataFrame, columns: list[str], strategy: str | float) -> DataFrame:
    """Nulls of columns filled with the mean, the median or a constant, and <column>_imputed. A column of nulls only stays null."""
    if strategy == "median":
        fills = {c: median(df, c) for c in columns}
    elif isinstance(strategy, str):
        row = df.agg(*(F.avg(c).alias(c) for c in columns)).first()  # one row
        fills = {c: row[c] for c in columns}
    else:
        fills = dict.fromkeys(columns, strategy)
    flags = {f"{c}_imputed": F.col(c).isNull() for c in columns}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(fills[c])) for c in columns})


#: Character references by name; the ampersand's comes last, so that nothing is decoded twice.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–", "euro": "€", "amp": "&"}


def unescaped(text: Column) -> Column:
    """text with its numeric character references and those of ENTITIES decoded; others stay."""
    digits = lambda p: F.regexp_extract(p, r"^(?:[xX]([0-9A-Fa-f]{1,6})|[0-9]{1,7});", 1)
    number = lambda p: F.regexp_extract(p, r"^([0-9]{1,7});", 1)
    code = lambda p: F.when(digits(p) != "", digits(p)).when(number(p) != "", F.conv(number(p), 10, 16))
    point = lambda p: F.conv(code(p), 16, 10).cast("long")
    good = lambda p: point(p).between(1, 0x10FFFF) & ~point(p).between(0xD800, 0xDFFF)
    decoded = lambda p: F.concat(F.decode(F.unhex(F.lpad(code(p), 8, "0")), "UTF-32"), F.regexp_replace(p, r"^[xX]?[0-9A-Fa-f]{1,7};", ""))
    pieces = F.transform(F.split(text, "&#"), lambda p, i: F.when(i == 0, p).when(F.coalesce(good(p), F.lit(False)), decoded(p)).otherwise(F.concat(F.lit("&#"), p)))
    out = F.when(text.contains("&#"), F.array_join(pieces, "")).otherwise(text)
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def html_to_rows(df: DataFrame, key: str, html: str, decode: bool = False) -> DataFrame:
    """key, title, heading, text, links, n_links of each page; scripts, styles and tags are no text. Links may be in double, single or no quotes. decode: character references too. A null page counts as an empty one."""
    plain = unescaped if decode else lambda c: c
    page = F.coalesce(F.col(html), F.lit(""))
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = plain(F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " ")))
    quoted = F.regexp_extract_all(page, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    links = F.transform(quoted, lambda x: plain(F.regexp_replace(x, r"""^["']|["']$""", "")))
    first = lambda tag: plain(F.regexp_extract(page, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return df.select(key, first("title").alias("title"), first("h1").alias("heading"), text.alias("text"), links.alias("links"), F.size(links).alias("n_links"))
