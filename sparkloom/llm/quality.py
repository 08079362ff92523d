"""Quality rules whose cutoffs are chosen under a guaranteed limit of false rejections (DataFrame functions only).

A document is rejected by the fixed base rules, or because its rarity is below its stratum's cutoff. A rule's tail at a document
is the share of the stratum's documents (those that pass the base rules) that measure as much or more; rarity is the
least tail of the RULES, in millionths, so one number orders the documents from the oddest on, and needs no labels.
The cutoff comes from labelled holdouts. With n good holdouts in a stratum, a cutoff that rejects k of them is admitted if the
exact (Clopper-Pearson) binomial test of "the false rejection rate exceeds alpha" rejects: P(Bin(n, alpha) <= k) <= delta
/ strata. Cutoffs are tried from the loosest to the tightest, and k only grows that way, so fixed-sequence testing needs no
correction within a stratum; across strata delta is divided (Bonferroni). So with probability 1 - delta, in all strata
at once, the cutoff rejects at most alpha of the good documents that pass the base rules; what base rules reject is
no part of this promise. Holdouts must be a random sample of the stratum's good documents. Tails are counted over all
documents, holdouts included, so rarity isn't quite fixed before they are drawn: the bound holds but for what the holdouts
themselves move the tails by, each by one in the stratum's size.

Defined results: a null text has no words and fails the base rules; a null stratum is a stratum of its own; a
stratum with too few good holdouts gets no cutoff (at alpha 0.01 and four strata that is below 436), so only the base rules
hold there; repeated labels of a document count as one (good only if all are good); labels without a document, or with null
values, are ignored; repeated documents each get a row; an empty table gives no rows. Columns of the input that
clash with a measure's name are replaced in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import BLANKS, checkpointed, fresh, let, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
GRAM = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: name: (numerator, denominator), compared in thousandths.
RULES = {
    "repeats": ("n_repeat_words", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "long_words": ("word_chars", "n_words * 100"),
}
#: Cutoffs run from 0 to STEPS thousandths; larger measures count as STEPS.
STEPS = 1000
ALPHA, DELTA = 0.01, 0.05
MILLION = 1_000_000
#: Tables of tails and cutoffs, and keys of rejected rows, are broadcast up to this count, else shuffled.
MAX_BROADCAST = 500_000


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 5-word window which occurs twice or more. Windows are compared by a 64-bit hash of word hashes."""

    def covered(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            hit = F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False)))
            return let(
                F.sort_array(F.transform(hit, lambda x: x["i"])),
                lambda p: F.aggregate(
                    p,
                    F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n")),
                    lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(GRAM), x - a["last"])).alias("n")),
                    lambda a: a["n"],
                ),
            )

        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(placed, of_sorted))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(GRAM)))))
    return F.when(F.size(w) < GRAM, 0).otherwise(let(grams, covered))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns MEASURES, all long, of whole texts, and base_failed."""
    t, ws = F.coalesce(F.col(text), F.lit("")), fresh(df, "words_of_text")
    all_lines = F.split(t, "\n")
    lines = F.filter(all_lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    both = F.struct(F.size(all_lines).alias("all"), F.size(lines).alias("full"), F.size(F.array_distinct(lines)).alias("kinds"))
    of_lines = fresh(df, "lines_of_text")
    out = df.withColumns({ws: words(F.col(text)), of_lines: both})
    out = out.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.col(of_lines)["full"] - F.col(of_lines)["kinds"]).cast("long"),
            "n_repeat_words": _repeat_words(F.col(ws)).cast("long"),
            "n_lines": F.col(of_lines)["all"].cast("long"),
        }
    ).drop(ws, of_lines)
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def _level(rule: str) -> Column:
    """The largest cutoff, from 0 to STEPS, that rejects the document; -1 if none does. Rejected: 1000 * numerator > cutoff * denominator."""
    a, b = RULES[rule]
    return F.when(F.expr(f"{a} > 0 and {b} > 0"), F.least(F.expr(f"(1000 * {a} - 1) div ({b})"), F.lit(STEPS))).otherwise(F.lit(-1)).cast("int")


def critical(n: Column, alpha: float, delta: Column) -> Column:
    """The largest k with P(Bin(n, alpha) <= k) <= delta, -1 if there is none. Sums of logarithms, k up to n * alpha."""
    first = n * math.log1p(-alpha)

    def step(a: Column, k: Column) -> Column:
        term = a["term"] + F.log((n - k + 1) / k) + math.log(alpha / (1 - alpha))
        total = F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= F.log(delta), k).otherwise(a["best"]).alias("best"))

    start = F.struct(first.alias("term"), first.alias("total"), F.when(first <= F.log(delta), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("best"))
    ks = F.when(F.floor(n * alpha) >= 1, F.sequence(F.lit(1).cast("long"), F.floor(n * alpha))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(ks, start, step, lambda a: a["best"])


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its count is within the bound."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def with_rarity(figures: DataFrame, stratum: str) -> DataFrame:
    """figures (measures, base_failed) with rarity. At most STEPS + 1 tails a stratum and rule are counted, joined and held."""
    sizes = figures.filter("not base_failed").groupBy(stratum).agg(F.count("*").alias("size"))
    long = figures.filter("not base_failed").select(stratum, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES))).alias("x")).select(stratum, "x.*")
    counts = long.filter("level >= 0").groupBy(stratum, "rule", "level").agg(F.count("*").alias("c"))
    above = Window.partitionBy(stratum, "rule").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tails = counts.withColumn("tail", F.sum("c").over(above)).join(sizes.withColumnRenamed(stratum, "of"), F.col(stratum).eqNullSafe(F.col("of")))
    tails = checkpointed(tails.select(F.col(stratum).alias("of"), "rule", "level", F.expr(f"{MILLION} * tail div size").alias("share")))
    out, shares = figures, []
    for i, r in enumerate(RULES):
        own = tails.filter(F.col("rule") == r).select(F.col("of").alias(f"of_{i}"), F.col("level").alias(f"level_{i}"), F.col("share").alias(f"share_{i}"))
        out = out.join(_few(own), out[stratum].eqNullSafe(own[f"of_{i}"]) & (_level(r) == own[f"level_{i}"]), "left")
        shares.append(F.coalesce(f"share_{i}", F.lit(MILLION)))
    return out.withColumn("rarity", F.least(*shares)).drop(*(f"{c}_{i}" for c in ("of", "level", "share") for i in range(len(RULES))))


def cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff: the least rarity that stays, for each stratum with an admitted cutoff. good: rarity of good holdouts."""
    counts = checkpointed(good.groupBy(stratum, "rarity").agg(F.count("*").alias("c")))  # at most rules * (STEPS + 1) + 1 rows a stratum
    strata = max(1, counts.select(F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).distinct().count())
    by = Window.partitionBy(stratum)
    tally = counts.withColumns({"n": F.sum("c").over(by), "below": F.coalesce(F.sum("c").over(by.orderBy("rarity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    limits = tally.groupBy(stratum).agg(F.first("n").alias("n")).select(F.col(stratum).alias("of"), critical(F.col("n"), alpha, F.lit(delta / strata)).alias("most"))
    admitted = tally.join(limits.filter("most >= 0"), F.col(stratum).eqNullSafe(F.col("of"))).filter("below <= most")
    return admitted.groupBy(stratum).agg(F.max("rarity").alias("cutoff"))


def _good(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min(F.expr("quality = 1 and toxic = 0")).alias("good")).filter("good").select("doc_id")


def _judged(figures: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """figures with rarity, cutoff (null: none) and kept."""
    scored = with_rarity(figures, stratum)
    limits = checkpointed(cutoffs(scored.filter("not base_failed").join(_good(labels), "doc_id", "left_semi"), stratum, alpha, delta).withColumnRenamed(stratum, "stratum_of"))
    out = scored.join(_few(limits), scored[stratum].eqNullSafe(limits["stratum_of"]), "left").drop("stratum_of")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("rarity") >= F.col("cutoff"), F.lit(True)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed, rarity, cutoff and kept of every document. Texts are measured once; only the figures are stored for the further readings."""
    own = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")
    figures = checkpointed(measures(own).select("doc_id", "stratum", *MEASURES, "base_failed"))
    return _judged(figures, labels, "stratum", alpha, delta).withColumnRenamed("stratum", stratum)


def keep_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Texts are measured once, into a table of figures keyed by two hashes of the row's id, stratum and text; the second reading
    only hashes them and leaves out the keys of rejected rows.
    """
    row = F.struct(F.col("doc_id").alias("i"), F.col(stratum).alias("s"), F.col("text").alias("t"))
    keyed = docs.select("doc_id", F.col(stratum).alias("stratum"), "text", F.xxhash64(row).alias("k1"), F.xxhash64(F.lit(1), row).alias("k2"))
    figures = checkpointed(measures(keyed).select("doc_id", "stratum", "k1", "k2", *MEASURES, "base_failed"))
    gone = checkpointed(_judged(figures, labels, "stratum", alpha, delta).filter("not kept").select("k1", "k2").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(row).alias("k1"), F.xxhash64(F.lit(1), row).alias("k2"))
    return packed.join(_few(gone), ["k1", "k2"], "left_anti").select("row.*")
