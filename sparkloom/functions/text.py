"""Column functions on text, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; Java and RE2 agree on it.
NOT_WORD = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; used inside the lambda of a higher-order function it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column, mode: str = "word") -> Column:
    """Lower-case words; with mode "char", pairs of neighbouring letters and digits, for scripts without spaces. Empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if mode == "char":
        two = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        pairs = lambda run: F.when(F.length(run) >= 2, two(run)).when(F.length(run) == 1, F.array(run)).otherwise(F.array().cast("array<string>"))
        return let(F.regexp_replace(low, NOT_WORD, ""), pairs)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """The distinct word n-grams, joined by spaces; empty below n words."""
    none = F.array().cast("array<string>")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(grams(w))).otherwise(none))


def version_parts(version: Column) -> Column:
    """Dotted integers as array<int> padded to three; null for anything else."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("int"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 3)), 1, F.greatest(F.size(parts), F.lit(3)))
    return F.when(version.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9})*$"), padded)


def normalized(text: Column) -> Column:
    """Lower case, every run of blanks as one space, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
