"""Licence scans with a trained paragraph classifier.

Every paragraph of every text is counted into sparse word n-grams (one to three words). A paragraph is a line, or several short lines of
which none but the last ends a sentence: a notice that was wrapped. A multinomial logistic regression tells the licence
families and `none` apart. It is trained on licence texts and on sentences that name a licence (below), and on a bounded
sample of the corpus' own paragraphs (`sample_docs` documents of smallest text hash, `sample_paragraphs` paragraphs at most, 2,000
characters of each; those that share half of a template left out).

Rows held out (other sentence forms, texts with words left out, other paragraphs of the corpus) calibrate it: a Platt curve from
the log odds of the likeliest family to the probability that it is right. A family counts from a calibrated probability of
`least_probability`, and must be confirmed by comparison with the templates: the bigrams shared with one of its own make up `least_overlap` of
the smaller of paragraph and template, and no less than with another family's text. What is likelier a licence than not but is not told or not confirmed is `unknown`. Where joined
lines have no family, each of them is judged by itself.

All of it uses DataFrame functions and Spark ML transformers only. Templates are joined by hashed bigrams, for paragraphs that
are likelier a licence than not.

Defined cases: a null or empty text has no licence; repeated rows are scanned each; null ids are kept; an empty table gives an empty
result (the classifier then knows no corpus paragraph); columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint

#: The texts of short licences, and the notices by which long ones are declared.
TEXTS = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-sa": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "cc-by-nc": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
}

#: How licences are called, short identifiers last.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Licence v2.0", "Apache-2.0"],
    "mit": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "isc": ["ISC License", "ISC licence", "ISC"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2 or later", "GNU GPL v3", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0-or-later"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "epl-2.0": ["Eclipse Public License 2.0", "EPL-2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0"],
    "unlicense": ["The Unlicense", "Unlicense"],
    "proprietary": ["Copyright (c) the authors. All rights reserved", "proprietary license, all rights reserved"],
}
FORMS = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "SPDX-License-Identifier: {}", "License: {}", "Distributed under the terms of the {}",
    "Published under {}.", "This file is made available under the {}, see below.", "Licensed under {}.", "{}", "Copyright 2021 the authors. Licensed under the {}. See the file for details.",
    "All code in this repository is covered by the {}.",
)
HELD_FORMS = ("This project uses the {} license.", "the library is licensed under the {}, see the website", "Copyright 2019 Jane Doe. Released under the {}", "For more information: this document is under the {}.", "// SPDX-License-Identifier: {}")
#: Sentences with such words that declare nothing; every second one is held out.
PLAIN = (
    "You need a driving licence to rent a car in this town.", "His licence was taken away by the general court last year.", "The software was released to the public in the spring.", "She has a degree from MIT and another one from Yale.",
    "All seats are reserved for the public of the festival.", "The general public may use the library without a fee.", "The Apache live in the south of the country.", "They have permission to use the hall free of charge.",
    "The copyright of a song belongs to whom?", "The version of the story that we know is the second one.", "Source and binary stars are seen at night.", "The terms of the treaty were published in full.",
    "License plates are made of metal.", "The author has all the rights he needs.", "Rights and duties of the members are reserved to the assembly.", "The eclipse was seen by the public in 2024.",
    "Distribution of the goods is under way.", "No part of the building may be used without care.", "", "See the file for details.", "For more information see the website.", "Copyright 2021 the authors.",
)
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, *TEXTS]
_CUT = r"[^\p{L}\p{N}]+"
_JOINT = "\x1e"  # between the lines of a paragraph of several
_WRAP = r"(?md)\n(?<=^.{1,100}\n)(?<![.!?]\n)(?=.{1,100}$)"


@dataclass(frozen=True)
class ScanOptions:
    sample_docs: int = 500
    sample_paragraphs: int = 2000
    least_overlap: float = 0.6
    least_probability: float = 0.5


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _grams(text: str, n: int) -> list[str]:
    words = _words(text)
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def training_texts() -> list[tuple[str, str]]:
    """(text, family): licence texts, their sentences, and names in the forms of FORMS."""
    out = [(form.format(name), family) for family, names in NAMES.items() for name in names for form in FORMS]
    for family, texts in TEXTS.items():
        for text in texts:
            out += [(text, family), (f"Copyright 2021 the authors. {text}", family)]
            words = text.split()
            if len(words) > 16:
                out += [(" ".join(words[: len(words) // 2]), family), (" ".join(words[len(words) // 2 :]), family)]
    return out


def held_out_texts() -> list[tuple[str, str]]:
    """(text, family) that training does not see: other forms, and texts with every sixth to second word left out."""
    out = [(form.format(name), family) for family, names in NAMES.items() for name in names for form in HELD_FORMS]
    thinned = lambda t, k, at: " ".join(w for i, w in enumerate(t.split()) if i % k != at)
    return out + [(thinned(t, k, at), family) for family, texts in TEXTS.items() for t in texts for k in (6, 4, 3, 2) for at in range(k) if len(t.split()) > 6]


def _vocabulary() -> list[str]:
    """Bigrams and trigrams of the training texts, and single words that only a licence's name has."""
    texts = [t for t, _ in training_texts()]
    single = {w for names in NAMES.values() for name in names for w in _words(name) if len(w) > 3 and not w.isalpha() or w in ("spdx", "unlicense", "zlib", "agpl", "lgpl", "gpl", "affero", "lesser", "noncommercial", "sharealike")}
    return sorted({g for t in texts for n in (2, 3) for g in _grams(t, n)} | single)


VOCABULARY = _vocabulary()


def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, different bigrams) of each text and of each name of two words or more; of a name of one word, what stands with it."""
    phrases = [(family, t) for family, texts in TEXTS.items() for t in texts]
    for family, names in NAMES.items():
        for name in names:
            phrases += [(family, name)] if len(_words(name)) > 1 else [(family, form.format(name)) for form in ("identifier {}", "license {}", "{} license", "{} licence")]
    return [(family, i, list(dict.fromkeys(_grams(t, 2)))) for i, (family, t) in enumerate(phrases)]


def _featured(paragraphs: DataFrame) -> DataFrame:
    """Adds _two (bigrams) and _features to a table with a column _paragraph."""
    words = F.filter(F.split(F.lower(F.coalesce("_paragraph", F.lit(""))), _CUT), lambda w: w != "")
    counted = paragraphs.withColumn("_words", words)
    for n, name in ((2, "_two"), (3, "_three")):
        counted = NGram(n=n, inputCol="_words", outputCol=name).transform(counted)
    counted = counted.withColumn("_grams", F.concat("_words", "_two", "_three")).drop("_words", "_three")
    vector = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="_grams", outputCol="_features", binary=True)
    return vector.transform(counted).drop("_grams")


@dataclass
class Classifier:
    model: LogisticRegressionModel
    slope: float  # of the Platt curve
    shift: float


def _log_odds(p: Column) -> Column:
    kept = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(kept / (1 - kept))


def _scored(featured: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Adds _none (probability of no licence), _number and _top (class and probability of the likeliest family)."""
    model = model.copy()
    for name in ("rawPredictionCol", "predictionCol"):
        model.set(model.getParam(name), "")
    scored = model.setProbabilityCol("_p").transform(featured).withColumn("_p", vector_to_array("_p")).drop("_features")
    scored = scored.withColumn("_top", F.array_max(F.slice("_p", 2, len(TEXTS)))).withColumn("_none", F.get("_p", F.lit(0)))
    return scored.withColumn("_number", F.array_position(F.slice("_p", 2, len(TEXTS)), F.col("_top")).cast("int")).drop("_p")


def _corpus_sample(docs: DataFrame, options: ScanOptions, text_col: str) -> list[str]:
    """Different paragraphs without a licence, at most sample_paragraphs of them."""
    rows = docs.select(F.col(text_col).alias("_text")).where("trim(_text) <> ''").withColumn("_hash", F.xxhash64("_text"))
    last = rows.select("_hash").distinct().orderBy("_hash").limit(options.sample_docs).agg(F.max("_hash")).first()[0]
    rows = rows.where(F.col("_hash") <= F.lit(last)) if last is not None else rows
    lines = rows.select(F.explode(F.split("_text", "\n")).alias("_paragraph")).where("trim(_paragraph) <> ''").select(F.substring("_paragraph", 1, 2000).alias("_paragraph")).distinct()
    sample = [r._paragraph for r in lines.orderBy(F.xxhash64("_paragraph")).limit(options.sample_paragraphs).collect()]
    own = [set(grams) for _, _, grams in templates()]

    def licensed(paragraph: str) -> bool:
        two = set(_grams(paragraph, 2))
        return any(2 * len(two & x) >= min(len(two), len(x)) if len(x) > 2 else x <= two for x in own) if two else False

    return [p for p in sample if not licensed(p)]


def train(docs: DataFrame, options: ScanOptions = ScanOptions(), text_col: str = "text") -> Classifier:
    spark = docs.sparkSession
    number = {c: i for i, c in enumerate(CLASSES)}
    plain = _corpus_sample(docs, options, text_col)
    rows = [(t, 0, i % 4 == 0) for i, t in enumerate(plain)] + [(t, 0, i % 2 == 1) for i, t in enumerate(PLAIN)]
    rows += [(t, number[family], False) for t, family in training_texts()] + [(t, number[family], True) for t, family in held_out_texts()]
    table = _featured(spark.createDataFrame(rows, "_paragraph string, label int, held boolean").coalesce(1)).drop("_two", "_paragraph").persist()
    try:
        counts = {r.label: r["count"] for r in table.where("NOT held").groupBy("label").count().collect()}
        weight = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1.0 / n)]), F.col("label"))
        regression = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=30, standardization=False)
        model = regression.fit(table.where("NOT held").withColumn("weight", weight))
        held = _scored(table.where("held"), model).select(_log_odds(F.col("_top")).alias("odds"), (F.col("_number") == F.col("label")).cast("int").alias("right"))
        slope, shift = _platt(spark, [(float(r.odds), int(r.right)) for r in held.collect()])  # as many as held-out rows
    finally:
        table.unpersist()
    return Classifier(model, slope, shift)


def _platt(spark: SparkSession, rows: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (log odds, right or wrong); the log odds themselves if all are right or all are wrong."""
    if len({right for _, right in rows}) < 2:
        return 1.0, 0.0
    from pyspark.ml.linalg import Vectors

    table = spark.createDataFrame([(Vectors.dense([odds]), right) for odds, right in rows], ["x", "right"]).coalesce(1)
    curve = LogisticRegression(featuresCol="x", labelCol="right", regParam=1e-6, maxIter=50).fit(table)
    return float(curve.coefficients[0]), float(curve.intercept)


def _template_table(spark: SparkSession) -> DataFrame:
    rows = [(CLASSES.index(family), i, len(grams), g) for family, i, grams in templates() for g in grams]
    return spark.createDataFrame(rows, "_t_number int, _template int, _t_size int, _gram string")


def judge(units: DataFrame, keys: list[str], classifier: Classifier, options: ScanOptions = ScanOptions()) -> DataFrame:
    """keys..., _family (a family or `unknown`) and _probability (calibrated) of the units (with a column _paragraph) that are likelier a licence than not."""
    scored = _scored(_featured(units), classifier.model)
    probability = 1 / (1 + F.exp(-(F.lit(classifier.slope) * _log_odds(F.col("_top")) + F.lit(classifier.shift))))
    likely = scored.where("_none < 0.5").select(*keys, "_number", probability.alias("_probability"), F.array_distinct("_two").alias("_two"))
    likely = checkpoint(likely.distinct())
    known = _template_table(units.sparkSession)  # a fixed table
    grams = likely.select(*keys, "_number", F.size("_two").alias("_size"), F.explode("_two").alias("_g"))
    shared = grams.join(F.broadcast(known), F.col("_g") == F.col("_gram"))
    best = shared.groupBy(*keys, "_number", "_template").agg((F.count("*") / F.least(F.first("_size"), F.first("_t_size"))).alias("_overlap"), F.first("_t_number").alias("_t_number"), F.first("_t_size").alias("_t_size"))
    own = F.col("_t_number") == F.col("_number")
    best = best.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_number").alias("_b_number")).agg(
        F.max(F.when(own, F.col("_overlap"))).alias("_overlap"), F.max(F.when(~own & (F.col("_t_size") > 8), F.col("_overlap"))).alias("_other")
    )
    same = F.col("_number") == F.col("_b_number")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    name = F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("_number"))
    sure = (F.col("_probability") >= options.least_probability) & (F.coalesce("_overlap", F.lit(0.0)) >= F.greatest(F.lit(options.least_overlap), F.coalesce("_other", F.lit(0.0))))
    return likely.join(best, same, "left").select(*keys, F.when(sure, name).otherwise(F.lit(UNKNOWN)).alias("_family"), "_probability")


def classify(paragraphs: DataFrame, classifier: Classifier, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds _family (a family, `unknown` or `none`) and _probability to a table with a column _paragraph."""
    hashed = paragraphs.withColumn("_unit", F.xxhash64("_paragraph"))
    found = judge(hashed.select("_unit", "_paragraph"), ["_unit"], classifier, options).withColumnRenamed("_unit", "_of")
    judged = hashed.join(found, F.col("_unit") == F.col("_of"), "left").drop("_unit", "_of")
    return judged.withColumns({"_family": F.coalesce("_family", F.lit(NONE)), "_probability": F.coalesce("_probability", F.lit(0.0))})


def units_of(text: Column) -> Column:
    """The paragraphs of a text, array of (paragraph, line, words): line 0 is the whole of it, 1 and so on its lines if it has several."""
    paragraphs = F.split(F.regexp_replace(text, _WRAP, _JOINT), "\n")
    one = lambda i, line, words: F.struct(i.alias("paragraph"), line.alias("line"), words.alias("words"))

    def both(p: Column, i: Column) -> Column:
        lines = F.transform(F.split(p, _JOINT), lambda x, k: one(i, k + 1, x))
        return F.when(F.contains(p, F.lit(_JOINT)), F.concat(F.array(one(i, F.lit(0), p)), lines)).otherwise(F.array(one(i, F.lit(0), p)))

    return F.flatten(F.transform(paragraphs, both))


def scan(docs: DataFrame, options: ScanOptions = ScanOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, licenses (sorted families, comma-joined), n_licensed and n_unknown (paragraphs with a family, with an unknown licence)."""
    classifier = train(docs, options, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    units = rows.select("_id", "_hash", F.explode(units_of(F.col("_text"))).alias("_u"))
    units = units.select("_id", "_hash", F.col("_u.paragraph").alias("_at"), F.col("_u.line").alias("_line"), F.col("_u.words").alias("_paragraph"))
    found = judge(units, ["_id", "_hash", "_at", "_line"], classifier, options)
    named = F.col("_family") != UNKNOWN
    whole = (F.col("_line") == 0) & named
    per_paragraph = found.groupBy("_id", "_hash", "_at").agg(
        F.max(F.when(whole, F.col("_family"))).alias("_whole"),
        F.collect_list(F.when(named & (F.col("_line") > 0), F.col("_family"))).alias("_lines"),
        F.count_if(F.col("_line") == 0).alias("_unknown"),
    )
    families = F.when(F.col("_whole").isNotNull(), F.array("_whole")).otherwise(F.col("_lines"))
    per_paragraph = per_paragraph.select("_id", "_hash", families.alias("_families"), F.when(F.size(families) == 0, F.least(F.lit(1), "_unknown")).otherwise(0).alias("_unknown"))
    per_text = per_paragraph.groupBy(F.col("_id").alias("_f_id"), F.col("_hash").alias("_f_hash")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_families")))), ",").alias("licenses"),
        F.sum(F.size("_families")).alias("n_licensed"),
        F.sum("_unknown").alias("n_unknown"),
    )
    per_text = checkpoint(per_text)
    slim = rows.select("_id", "_hash").join(per_text, F.col("_id").eqNullSafe(F.col("_f_id")) & (F.col("_hash") == F.col("_f_hash")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return slim.select(F.col("_id").alias(id_col), F.coalesce("licenses", F.lit("")).alias("licenses"), count("n_licensed"), count("n_unknown"))
