"""Licence scan by paragraph: sparse word n-gram logistic regression, a calibrated unknown class, template comparison (DataFrame functions only).

A paragraph is a line, put together with the next one where a long line breaks inside a sentence. Features are the presence of
word uni-, bi- and trigrams of the examples. Multinomial logistic regression with an L1 penalty is fitted on the templates,
cuttings of them, the NAMES of families in CARRIERS, the names of OTHERS in the same carriers (class unknown, so that names and not
carriers tell), and clean paragraphs of the corpus (class unknown, at most NEGATIVES). A paragraph is clean if it shares
no trigram with a template, holds none of LICENCE_WORDS and no pair of words of a family's name: what the corpus says about
licences is neither called unknown nor used to calibrate.
Calibration is by cross-fitting: wordings (with all their cuttings), carriers and clean paragraphs fall into FOLDS, and each is judged by a
model that saw none of its fold. On these judgements a temperature is chosen by likelihood, and the probability above which
a family counts is set so that at most FALSE_SHARE of the clean paragraphs reach it; below it a paragraph is unknown; nothing
else decides. The model in use is fitted on all folds. The prediction is then compared with the family's templates: template_overlap is the
largest share of common trigrams, of the paragraph's or of a template's, and a prediction is confirmed if the share is at
least CONFIRM. A family's probability passes the cutoff only if n-grams that speak for it outweigh the bias, so lines
that hold none of the anchors, words one of which is in every such selection of n-grams, are unknown for certain and aren't scored.

Defined results: null and blank texts have no paragraphs; paragraphs without licence give no row; repeated documents each
have rows; an empty table gives no rows. Words are split at what isn't a letter or digit, and compared in lower case.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed

NEGATIVES, CONFIRM, LEAST, FOLDS, FALSE_SHARE = 1_500, 0.5, 0.6, 3, 0.001
#: A line break inside a sentence: behind a line of 40 characters or more without a closing mark, before a small letter, digit or bracket.
_WRAPPED = r"\n(?<=[^\n]{40}[^.!?:;\s]\n)(?=[a-z0-9(])"
UNKNOWN = "unknown"
#: Usual wordings of licence notices, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "Distributed under the terms of the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Distributed under the MIT License. See LICENSE for more information.",
        "This software is available under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL, version 3.",
        "Distributed under the terms of the GNU General Public License v3.0.",
        "This software is licensed under the GPLv3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the CC BY-NC 4.0 license.",
        "Distributed under a Creative Commons BY-NC 4.0 licence.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        "Distributed under the terms of the 3-clause BSD license.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the CC BY 4.0 license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
}
FAMILIES = sorted(TEMPLATES)
#: Usual names of these families, names of other licences, wordings that carry a name, and words that speak of licences.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License 2.0"],
    "mit": ["MIT License", "MIT licence", "MIT", "Expat License", "The MIT License (MIT)"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0", "GNU GPL version 3", "GPL-3.0-or-later"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons BY-NC 4.0 licence"],
    "bsd-3-clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-clause BSD license", "New BSD License", "modified BSD license"],
    "cc-by-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
}
OTHERS = [
    "Mozilla Public License 2.0", "MPL-2.0", "GNU Lesser General Public License version 2.1", "LGPL-2.1", "LGPLv3", "GNU Affero General Public License version 3", "AGPL-3.0",
    "GNU General Public License, version 2", "GPLv2", "GPL-2.0", "Eclipse Public License 2.0", "ISC License", "zlib License", "BSD 2-Clause License", "CC BY-SA 4.0",
    "CC BY-NC-SA 4.0", "CC0 1.0", "Boost Software License", "Artistic License 2.0", "proprietary license", "commercial licence",
]
CARRIERS = [
    "{}", "License: {}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}.",
    "This software is available under the {}, see LICENSE.", "The code is covered by the {} as published.", "SPDX-License-Identifier: {}", "Copyright by the authors. {} applies.", "Made available under {}",
]
PLAIN = [
    "the work of this program", "a copy of the software is free", "version 3 of the terms", "you may use this file", "", "the license of the driver was renewed", "a licence to fish is needed here",
    "she had no license to do it", "licenses are sold at the counter", "see the license for details", "all rights reserved", "under the public law of this land", "creative work in the commons",
    "er kommt mit uns nach Hause", "mit dem Auto in die Stadt", "das ist mit Abstand zu viel", "mit freundlichen Grüßen", "nicht mit mir, sagte sie", "wir sind mit allem fertig", "und mit einem Mal war es still",
    "sie sprach mit ihm", "ein Haus mit Garten", "mit der Zeit wird es besser",
]
LICENCE_WORDS = ["license", "licence", "licensed", "licenced", "licenses", "licences", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "apache", "spdx", "bsd", "mpl", "gnu", "copyright"]


def _split(text: str | Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def words(text: Column) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """The distinct word n-grams of w."""
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def _features(w: Column) -> Column:
    return F.concat(grams(w, 1), grams(w, 2), grams(w, 3))


def _examples(spark: SparkSession) -> DataFrame:
    """family, line and wording (the template or carrier it is from): templates, their beginnings if long, their quotation inside other words, and names in carriers."""
    rows = []
    for family, lines in TEMPLATES.items():
        for line in lines:
            parts = line.split()
            cuts = [line, f"Notice: {line}", f"{line} All rights reserved."]
            cuts += [" ".join(parts[:-2])] * (len(parts) > 8) + [" ".join(parts[: 2 * len(parts) // 3])] * (len(parts) > 14)
            rows += [(family, cut, line) for cut in cuts]
    rows += [(family, carrier.format(name), carrier) for family, names in [*NAMES.items(), (UNKNOWN, OTHERS)] for name in names for carrier in CARRIERS]
    rows += [(UNKNOWN, line, line) for line in PLAIN]
    return spark.createDataFrame(rows, "family string, line string, wording string")


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, paragraph (from 0) and line of each paragraph that isn't blank."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, _WRAPPED, " "), "\n")).alias("paragraph", "line"))
    return lines.filter(F.btrim("line") != "")


def fit(docs: DataFrame, text: str = "text") -> dict:
    """weights: {n-gram: weight by class}, bias, classes, temperature, cutoff, anchors. Reads at most NEGATIVES paragraphs of docs."""
    spark = docs.sparkSession
    known = _examples(spark).withColumns({"w": words(F.col("line")), "clean": F.lit(False)})
    template_grams = [r[0] for r in _templates(spark).select("gram").distinct().collect()]
    names = spark.createDataFrame([(n,) for each in NAMES.values() for n in each], "line string").select(words(F.col("line")).alias("w"))
    name_pairs = [r[0] for r in names.select(F.explode(grams(F.col("w"), 2))).distinct().collect()]
    hashed = docs.filter(F.col(text).isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), F.substring(F.col(text), 1, 4000).alias(text))
    picked = [r["h"] for r in hashed.groupBy("h").agg(F.count("*")).orderBy("h").limit(NEGATIVES // 3).select("h").collect()]
    texts = hashed.filter(F.col("h").isin(picked)).dropDuplicates(["h"])
    lines = paragraphs(texts, text).select(F.lit(UNKNOWN).alias("family"), F.substring("line", 1, 400).alias("line")).withColumn("w", words(F.col("line")))
    among = lambda own, listed: F.arrays_overlap(own, F.array(*map(F.lit, listed)))
    clean = lines.filter(~among(grams(F.col("w"), 3), template_grams) & ~among("w", LICENCE_WORDS) & ~among(grams(F.col("w"), 2), name_pairs))
    clean = clean.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).withColumns({"wording": F.col("line"), "clean": F.lit(True)})
    data = known.unionByName(clean).select("family", "line", "wording", "clean", _features(F.col("w")).alias("f"))
    counter = CountVectorizer(inputCol="f", outputCol="x", binary=True, minDF=1.0).fit(known.select(_features(F.col("w")).alias("f")))
    classes = [*FAMILIES, UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    size = F.when(F.col("clean"), 1.0).otherwise(3.0)
    fold = F.pmod(F.xxhash64("wording"), F.lit(FOLDS)).cast("int")
    ready = counter.transform(data).select("line", "clean", "f", "x", label.cast("double").alias("y"), size.alias("size"), fold.alias("fold"))
    ready = checkpointed(ready.coalesce(1))  # a bounded sample

    def fitted(rows: DataFrame) -> tuple[dict[str, list[float]], list[float]]:
        solver = LogisticRegression(featuresCol="x", labelCol="y", weightCol="size", regParam=0.002, elasticNetParam=1.0, family="multinomial", maxIter=40, tol=1e-4, standardization=False)
        model = solver.fit(rows)
        matrix, bias = model.coefficientMatrix.toArray(), list(model.interceptVector.toArray())
        bias += [-30.0] * (len(classes) - len(bias))
        return {g: [float(matrix[c][j]) if c < len(matrix) else 0.0 for c in range(len(classes))] for j, g in enumerate(counter.vocabulary) if any(matrix[c][j] for c in range(len(matrix)))}, bias

    weights, bias = fitted(ready)
    used = F.array_intersect("f", F.array(*map(F.lit, sorted({w for g in counter.vocabulary for w in g.split()}))))
    seen = {r["w"]: r["n"] for r in ready.filter("clean").select(F.explode(used).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    logits = []
    for k in range(FOLDS):
        others_weights, others_bias = fitted(ready.filter(F.col("fold") != k))
        holdout = [(r["f"], int(r["y"]), r["clean"]) for r in ready.filter(F.col("fold") == k).select("f", "y", "clean").collect()]  # bounded by the sample
        logits += [([b + sum(others_weights[g][c] for g in f if g in others_weights) for c, b in enumerate(others_bias)], y, clean) for f, y, clean in holdout]

    def probabilities(z: list[float], t: float) -> list[float]:
        top = max(z)
        e = [math.exp((x - top) / t) for x in z]
        return [x / sum(e) for x in e]

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: sum(-math.log(max(1e-12, probabilities(z, t)[y])) for z, y, _ in logits)) if logits else 1.0
    worst = sorted((max(probabilities(z, temperature)[:-1]) for z, _, clean in logits if clean), reverse=True)
    cutoff = max(LEAST, worst[int(FALSE_SHARE * len(worst))] if worst else 0.0)
    return {"weights": weights, "bias": bias, "classes": classes, "temperature": temperature, "cutoff": cutoff, "anchors": anchors(weights, bias, temperature, cutoff, seen)}


def anchors(weights: dict[str, list[float]], bias: list[float], temperature: float, cutoff: float, seen: dict[str, int]) -> list[str] | None:
    """Words one of which is in every paragraph that passes the cutoff; None if a paragraph can pass it without any n-gram.

    A family's probability is at most that against unknown alone, so its n-grams must add up to `need` over those of unknown. An n-gram is
    represented by the word that the sample has least (seen: paragraphs by word), the longer one on ties. Words that the
    sample has most are left out as long as all n-grams they represent don't add up to `need` for any family.
    """
    need = [temperature * math.log(cutoff / (1 - cutoff)) - (b - bias[-1]) - 1e-6 for b in bias[:-1]]
    if min(need) <= 0:
        return None
    sums: dict[str, list[float]] = {}
    for g, w in weights.items():
        word = min(g.split(), key=lambda x: (seen.get(x, 0), -len(x), x))
        own = sums.setdefault(word, [0.0] * len(need))
        for c in range(len(need)):
            own[c] += max(0.0, w[c] - w[-1])
    left, out = need, []
    for word in sorted(sums, key=lambda x: (-seen.get(x, 0), x)):
        if all(n > s for n, s in zip(left, sums[word], strict=True)):
            left = [n - s for n, s in zip(left, sums[word], strict=True)]
        else:
            out.append(word)
    return sorted(out)


def scan(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, template_overlap, confirmed of each paragraph with a licence."""
    spark = docs.sparkSession
    model = model or fit(docs, text)
    names = model["classes"]
    # The tables below are as large as the templates, whatever the corpus.
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in model["weights"].items()] or [("", *([0.0] * len(names)))], f"gram string, {', '.join(f'w{i} double' for i in range(len(names)))}")
    templates = _templates(spark)
    near = paragraphs(docs.select("doc_id", F.col(text).alias("text")))
    if model["anchors"] is not None:
        near = near.filter(F.arrays_overlap(_split("line"), F.array(*map(F.lit, model["anchors"])).cast("array<string>")))
    near = near.withColumns({"row": F.monotonically_increasing_id(), "w": words(F.col("line"))})
    key = ["row", "doc_id", "paragraph"]
    hits = near.select(*key, F.explode(_features(F.col("w"))).alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = hits.groupBy(*key).agg(*(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"z{i}") for i in range(len(names))))
    scaled = [(F.col(f"z{i}") + model["bias"][i]) / model["temperature"] for i in range(len(names))]
    total = sum((F.exp(s - F.greatest(*scaled)) for s in scaled[1:]), F.exp(scaled[0] - F.greatest(*scaled)))
    chance = F.array(*(F.struct((F.exp(s - F.greatest(*scaled)) / total).alias("p"), F.lit(n).alias("family")) for s, n in zip(scaled[:-1], names[:-1], strict=True)))
    best = sums.select(*key, F.array_max(chance).alias("b")).filter(F.col("b.p") > model["cutoff"]).select("row", "b.family", F.col("b.p").alias("probability"))
    mine = near.join(best, "row").select(*key, "family", "probability", F.size(grams(F.col("w"), 3)).alias("own"), F.explode_outer(grams(F.col("w"), 3)).alias("gram"))
    shared = mine.join(F.broadcast(templates), ["family", "gram"], "left").groupBy(*key, "family", "probability", "own", "template").agg(F.count("template").alias("n"), F.first("size").alias("size"))
    overlap = F.max(F.coalesce(F.greatest(F.try_divide("n", "own"), F.try_divide("n", "size")), F.lit(0.0)))
    out = shared.groupBy(*key, "family", "probability").agg(overlap.alias("template_overlap"))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("template_overlap", 6).alias("template_overlap"), (F.col("template_overlap") >= CONFIRM).alias("confirmed"))


def _templates(spark: SparkSession) -> DataFrame:
    """family, template, gram, size (trigrams of the template)."""
    rows = spark.createDataFrame([(f, i, t) for f, lines in TEMPLATES.items() for i, t in enumerate(lines)], "family string, template int, line string")
    g = rows.withColumn("g", grams(words(F.col("line")), 3))
    return g.select("family", "template", F.size("g").alias("size"), F.explode("g").alias("gram"))


def report(docs: DataFrame) -> DataFrame:
    """The licences of all documents."""
    return scan(docs.select("doc_id", "text"))
