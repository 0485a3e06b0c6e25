"""Licence notices by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line or a run of lines: notices stand on lines of their own or are wrapped over several, so a line that is not confirmed
alone is judged again with the lines after it, up to a blank one or the words of the longest template. Its features are word 1-grams and
2-grams that hold an anchor (a word of the licence templates that no ordinary training sentence has, or two long words that follow each
other in a template and in no ordinary sentence), so lines without an anchor have no features and are unknown by the bias alone; they are
left out before any n-gram is built. A multinomial logistic regression with an elastic net gives the family; a temperature, fitted on
variants that the regression did not see, calibrates it, with `unknown` as one of the classes. A family is confirmed if the line or run
covers enough of one of its templates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm.common import id_and_text

UNKNOWN = "unknown"
#: Share of a template's distinct words that a line must have to confirm it; least calibrated probability of a family.
COVER, LEAST = 0.7, 0.5
#: Words of a run for a word of a template, and words of another kind that may come before the notice in its first line.
WIDER, LEAD = 1.5, 8

# Public notices by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU GPL v2."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the GNU LGPL."],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "Public-Domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "This work is in the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright 2021 Example Corporation. All rights reserved.", "This software is proprietary and confidential."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the GNU AGPL v3."],
    "ISC": [
        "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Boost Software License 1.0."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the European Union Public Licence 1.2."],
    "EPL-2.0": ["This program is made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License."],
    "CDDL-1.0": ["Licensed under the Common Development and Distribution License, version 1.0.", "SPDX-License-Identifier: CDDL-1.0", "Released under the CDDL."],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "For more information, please refer to http://unlicense.org"],
    "Zlib": [
        "Released under the zlib License.", "SPDX-License-Identifier: Zlib", "This software is provided as-is, without any express or implied warranty, and altered source versions must be plainly marked as such.",
    ],
    "WTFPL": ["Do What The Fuck You Want To Public License", "SPDX-License-Identifier: WTFPL", "Released under the WTFPL."],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "Released under the terms of the Perl Artistic License."],
    "PSF-2.0": ["Licensed under the Python Software Foundation License Version 2.", "SPDX-License-Identifier: PSF-2.0", "Released under the PSF license."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "Released under the SIL OFL."],
    "MS-PL": ["Licensed under the Microsoft Public License.", "SPDX-License-Identifier: MS-PL", "Released under the Microsoft Public License (Ms-PL)."],
    "MS-RL": ["Licensed under the Microsoft Reciprocal License.", "SPDX-License-Identifier: MS-RL", "Released under the Microsoft Reciprocal License (Ms-RL)."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "GFDL": ["Permission is granted to copy this document under the terms of the GNU Free Documentation License.", "SPDX-License-Identifier: GFDL-1.3-or-later", "Released under the GNU FDL."],
    "ODbL-1.0": ["This database is made available under the Open Database License.", "SPDX-License-Identifier: ODbL-1.0", "Licensed under the ODbL."],
    "PostgreSQL": ["Released under the PostgreSQL License.", "SPDX-License-Identifier: PostgreSQL", "Licensed under the PostgreSQL Licence."],
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: AFL-3.0", "Released under the Academic Free License."],
    "OSL-3.0": ["Licensed under the Open Software License version 3.0.", "SPDX-License-Identifier: OSL-3.0", "Released under the Open Software License."],
}
# Notices that the temperature is fitted on, none of which the regression sees.
CALIBRATION: dict[str, list[str]] = {
    "MIT": ["The code is distributed under the MIT license, see LICENSE.", "License: MIT"], "Apache-2.0": ["License: Apache 2.0", "Distributed under the Apache License 2.0."],
    "GPL-3.0": ["The code is GNU GPL version 3 or later.", "License: GPL-3.0"], "GPL-2.0": ["The code is GNU GPL version 2 only.", "License: GPL-2.0"], "LGPL": ["License: LGPL", "The library is under the GNU Lesser GPL."],
    "BSD": ["License: BSD", "Use of this source code is governed by a BSD-style license."], "MPL-2.0": ["License: MPL 2.0", "The file is under the Mozilla Public License."], "CC-BY": ["Text is under CC BY 4.0.", "The photos are under a Creative Commons Attribution license."],
    "CC-BY-NC": ["Text is under CC BY-NC 4.0.", "The photos are under a Creative Commons NonCommercial license."], "Public-Domain": ["To the extent possible the authors waive all rights under CC0.", "The file is placed in the public domain."],
    "Proprietary": ["Proprietary and confidential.", "No part may be copied, all rights are reserved."], "AGPL-3.0": ["License: AGPL"], "ISC": ["License: ISC"], "BSL-1.0": ["License: Boost"], "EUPL-1.2": ["License: EUPL"], "EPL-2.0": ["License: Eclipse Public License"],
    "CDDL-1.0": ["License: CDDL"], "Unlicense": ["License: Unlicense"], "Zlib": ["License: zlib"], "WTFPL": ["License: WTFPL"], "Artistic-2.0": ["License: Artistic 2.0"], "PSF-2.0": ["License: PSF"], "OFL-1.1": ["License: SIL OFL 1.1"], "MS-PL": ["License: MS-PL"],
    "MS-RL": ["License: MS-RL"], "CC-BY-ND": ["Text is under CC BY-ND 4.0."], "GFDL": ["License: GNU FDL"], "ODbL-1.0": ["License: ODbL"], "PostgreSQL": ["License: PostgreSQL"], "AFL-3.0": ["License: Academic Free License"], "OSL-3.0": ["License: Open Software License"],
    UNKNOWN: [
        "She took an artistic view of the old town hall.", "The eclipse was seen in all of Europe on Monday.", "A boost to the economy is expected by the bank.", "He learned Python and SQL at the academic centre.", "The new font is open to readers of the paper.",
        "Microsoft reported sales for the quarter.", "The Apache helicopter landed by the river.", "They lost the licence to fish in the lake.", "The database is open on weekdays.", "Students at MIT built a small robot.", "The public library will be closed.", "The union asked for a fee from the members.",
    ],
}
# Sentences that name no licence of a text.
ORDINARY = [
    "The quick brown fox jumps over the lazy dog and is free to run.", "You may use this file to work with any person in the project.", "A copy of the form was released to the public in version 3 of the report.",
    "The terms of the work are subject to the source and the following conditions.", "Please obtain the code from the foundation at once, with or without the associated files.", "Version 2.0 of the program is an international work published by a general.",
    "El texto de la casa es para todos los que pueden usar el programa.", "Der Text steht in der Form, in der er von der Stiftung kam.", "Le texte est sous la forme que vous pouvez lire dans le document.", "This is a free charge of the person in the domain.",
    "The reserved table by the window was met with attribution to the corporation.", "He passed the driving test under the common law and can modify or use binary forms.", "Identifier 4.0 is example 2021 of the or later clause, provided the software and files are permitted.",
    "It was not as if he had gone into that deal, so what can it do for us, and why not?", "See http and www on the page that came in as it was, not into it.", "He asked for the documentation of the modification, as that was not in it.",
    "Er kam mit dem Rad und ging mit ihr in die Stadt.",
    "The commons of the village are open to all by right.", "Her creative work is granted hereby in compliance with the code except source.",
]
# Frequent English words, which are no anchors whatever templates hold them.
COMMON = """a about all also altered an and any are as as-is at available be been but by can copy could did do does each express first for from had has have he her him his how i if implied in information into is it its
made made may me more most must my new no not of on one only open or other our out plainly please purpose refer see she should so some source such than that the their them then there these they this to up use used
versions want want was we were what when which who will with without would you your""".split()  # fmt: skip
# Fixed value: the form of a word.
_WORDS = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({_WORDS})"), F.lit(1))


def _grams(words: Column) -> Column:
    """1-grams and 2-grams of a word array."""
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.try_element_at(words, (i + 1).cast("int")), F.try_element_at(words, (i + 2).cast("int"))))
    return F.when(F.size(words) >= 2, F.concat(words, two)).otherwise(words)


def _examples(spark: SparkSession) -> DataFrame:
    """family, line, part (0 to fit, 1 to calibrate). To fit: the templates plain, in upper case, after a lead, with words around them, as a
    comment, and as a first half. To calibrate: other notices and sentences."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in ORDINARY]
    base = spark.createDataFrame(rows, "family string, line string")
    words = F.split("line", " ")
    half = F.concat_ws(" ", F.slice(words, 1, F.greatest(F.lit(4), F.ceil(F.size(words) * 0.6).cast("int"))))
    forms = [(F.col("line"), 0), (F.upper("line"), 0), (F.concat(F.lit("Copyright (c) 2019 the authors. "), F.col("line")), 0), (half, 0), (F.concat(F.lit("Note: "), F.col("line"), F.lit(" See the file for details.")), 0), (F.concat(F.lit("# "), F.lower("line")), 0)]
    all_ = reduce(DataFrame.unionAll, [base.select("family", line.alias("line"), F.lit(part).alias("part")) for line, part in forms])
    # The lead of a copyright line alone decides nothing for ordinary sentences.
    fit = all_.where(~((F.col("family") == UNKNOWN) & F.col("line").startswith("Copyright")))
    return fit.unionAll(spark.createDataFrame([(f, t, 1) for f, ts in CALIBRATION.items() for t in ts], "family string, line string, part int"))


class LicenceModel:
    """Anchors, coefficients by gram, biases and temperature; bounded by the templates."""

    def __init__(self, spark: SparkSession) -> None:
        examples = _examples(spark).withColumn("words", _words(F.col("line")))
        of = lambda kind: {r["w"] for r in examples.where(F.col("part") == 0).where(kind).select(F.explode("words").alias("w")).distinct().collect()}
        ordinary, licence = of(F.col("family") == UNKNOWN), of(F.col("family") != UNKNOWN)
        self.anchors = sorted(w for w in licence - ordinary if len(w) > 1 and not w.replace(".", "").isdigit() and w not in COMMON and w not in ("see", "note", "details", "authors", "www"))
        told = [(_plain_words(t), f) for f, ts in [*TEMPLATES.items(), (UNKNOWN, ORDINARY)] for t in ts]
        pairs = lambda unknown: {f"{a} {b}" for ws, f in told if (f == UNKNOWN) == unknown for a, b in zip(ws, ws[1:]) if min(len(a), len(b)) > 3}
        self.phrases = sorted(p for p in pairs(False) - pairs(True) if not set(p.split()) & set(self.anchors))
        # Versions tell families apart, but no line is looked at for them alone.
        self.versions = sorted({f"{a} {b}" for ws, f in told if f != UNKNOWN for a, b in zip(ws, ws[1:]) if a == "version" and b[0].isdigit()})
        self.longest = math.ceil(max(len(ws) for ws, f in told if f != UNKNOWN) * WIDER) + LEAD
        marked = examples.withColumn("grams", self._anchored(F.col("words")))
        vectors = CountVectorizer(inputCol="grams", outputCol="x", binary=True).fit(marked.where("part = 0"))
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        y = reduce(lambda acc, k: acc.when(F.col("family") == self.families[k], F.lit(float(k))), range(1, len(self.families)), F.when(F.col("family") == self.families[0], F.lit(0.0)))
        data = vectors.transform(marked.withColumn("y", y)).coalesce(1).cache()
        fitted = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.003, elasticNetParam=0.3, maxIter=60, standardization=False).fit(data.where("part = 0"))
        matrix, self.bias = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector]
        self.weights = {g: [float(v) for v in matrix[:, j]] for j, g in enumerate(vectors.vocabulary) if abs(matrix[:, j]).max() > 1e-9}
        self.temperature = self._calibrate(data.where("part = 1").select("y", "grams").collect())
        self.templates = {f: [sorted(set(_plain_words(t))) for t in ts] for f, ts in TEMPLATES.items()}

    def _anchored(self, words: Column) -> Column:
        anchors = F.array(*[F.lit(a) for a in self.anchors])
        return F.array_distinct(F.filter(_grams(words), lambda g: F.arrays_overlap(F.split(g, " "), anchors) | g.isin(self.phrases + self.versions)))

    def logits(self, grams: list[str]) -> list[float]:
        return [b + sum(self.weights[g][k] for g in grams if g in self.weights) for k, b in enumerate(self.bias)]

    def _calibrate(self, rows: list) -> float:
        """The temperature with the least log loss on the second part of the examples (a few hundred rows at most)."""
        cases = [(int(r["y"]), self.logits(r["grams"])) for r in rows]

        def loss(t: float) -> float:
            total = 0.0
            for y, z in cases:
                top = max(z) / t
                total -= z[y] / t - top - math.log(sum(math.exp(v / t - top) for v in z))
            return total

        return min((0.25 * 1.15**i for i in range(30)), key=loss)

    def trigger(self) -> str:
        """Matches where an anchor stands; alternatives share their first letter, as flat ones are slow."""
        by: dict[str, list[str]] = {}
        for a in [*self.anchors, *self.phrases]:
            by.setdefault(a[0], []).append(a[1:].replace(".", r"\.").replace("+", r"\+").replace(" ", "[^a-z0-9]+"))
        return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + r")(?![a-z0-9])"

    def with_guess(self, lines: DataFrame) -> DataFrame:
        """Adds guess (family) and probability (calibrated). Each step is a column of its own, so that lambdas name it and nothing is
        computed anew inside them."""
        table = F.create_map(*[x for g, w in sorted(self.weights.items()) for x in (F.lit(g), F.array(*[F.lit(v) for v in w]))])
        start, zero = F.array(*[F.lit(b) for b in self.bias]), F.array(*[F.lit(0.0)] * len(self.bias))
        out = lines.withColumn("z", F.aggregate("grams", start, lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(table, g), zero), lambda a, b: a + b)))
        out = out.withColumn("top", F.array_max("z"))
        out = out.withColumn("total", F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp((v - F.col("top")) / self.temperature)))
        out = out.withColumn("at", F.array_position("z", F.col("top")).cast("int"))
        return out.withColumn("guess", F.element_at(F.array(*[F.lit(f) for f in self.families]), F.col("at"))).withColumn("probability", 1 / F.col("total")).drop("z", "top", "total", "at")

    def covered(self, words: Column, family: Column, run: Column) -> Column:
        """The largest share of a template of the family that the words of a line cover, or of a run the first ones: as many as the
        template may take with other words between."""
        out = F.lit(0.0)
        for f, ts in self.templates.items():
            near = lambda t: F.slice(words, F.lit(1), F.when(run == 1, math.ceil(len(t) * WIDER) + LEAD).otherwise(F.size(words)))
            shares = [F.size(F.array_intersect(near(t), F.array(*[F.lit(w) for w in t]))) / len(t) for t in ts]
            out = F.when(family == f, F.greatest(*shares, F.lit(0.0))).otherwise(out)
        return out


def _plain_words(line: str) -> list[str]:
    import re

    return re.findall(_WORDS, line.lower())


_fitted: dict[str, LicenceModel] = {}


def licence_model(spark: SparkSession) -> LicenceModel:
    """The model, trained once an application."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted[key] = LicenceModel(spark)
    return _fitted[key]


def licence_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, cover: float = COVER) -> DataFrame:
    """A row per line with an anchor in it or reaching from it into the next line: doc_id, line_no (from 0), line, family (or unknown),
    probability, covered, confirmed. A run that confirms what its first line alone does not counts at that line."""
    model = licence_model(docs.sparkSession)
    has = lambda c: c.rlike(model.trigger())
    base = id_and_text(docs, id_col, text_col).where(has(F.col("text"))).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("lines"))
    line = lambda i: F.coalesce(F.try_element_at("lines", i.cast("int")), F.lit(""))
    base = base.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: has(F.concat_ws(" ", line(i), F.substring(line(i + 1), 1, 80)))))
    # A run takes a word a line at least, so no more lines than words.
    rows = base.select("row", "doc_id", F.explode(F.transform("at", lambda i: F.struct((i - 1).alias("line_no"), line(i).alias("line"), F.slice("lines", i, F.lit(model.longest)).alias("run")))).alias("x")).select("row", "doc_id", "x.*")
    rows = rows.withColumn("stop", F.array_position(F.transform("run", lambda x: F.trim(x).isin("", "\r")), True))
    rows = rows.withColumn("run", F.when(F.col("stop") > 0, F.slice("run", F.lit(1), F.greatest(F.col("stop").cast("int") - 1, F.lit(0)))).otherwise(F.col("run")))

    whole = _words(F.array_join(F.transform("run", lambda x: F.substring(x, 1, 2000)), " "))
    units = F.array(F.struct(F.lit(0).alias("of_run"), _words(F.col("line")).alias("words")), F.struct(F.lit(1).alias("of_run"), F.when(F.size("run") > 1, F.slice(whole, 1, model.longest)).alias("words")))
    rows = rows.select("row", "doc_id", "line_no", "line", F.explode(units).alias("u")).select("row", "doc_id", "line_no", "line", "u.*").where("words is not null")
    named = model.with_guess(rows.withColumn("grams", model._anchored(F.col("words"))))
    named = named.withColumn("covered", model.covered(F.col("words"), F.col("guess"), F.col("of_run")))
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") >= least)
    named = named.select("row", "doc_id", "line_no", "line", "of_run", F.struct(F.when(sure, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "covered", (sure & (F.col("covered") >= cover)).alias("confirmed")).alias("found"))
    # A line alone counts unless only its run is confirmed, and a run only where the next line, or its run, does not confirm the same.
    best = named.groupBy("row", "line_no").agg(F.first("doc_id").alias("doc_id"), F.first("line").alias("line"), F.min_by("found", "of_run").alias("alone"), F.max_by("found", F.struct("found.confirmed", -F.col("of_run"))).alias("found"))
    after = F.lead(F.struct("line_no", "found")).over(Window.partitionBy("row").orderBy("line_no"))
    again = (F.col("after.line_no") == F.col("line_no") + 1) & F.col("after.found.confirmed") & (F.col("after.found.family") == F.col("found.family"))
    best = best.withColumn("after", after).withColumn("found", F.when(~F.col("alone.confirmed") & again, F.col("alone")).otherwise(F.col("found")))
    return best.select("doc_id", "line_no", "line", "found.*")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, families (confirmed ones, sorted, joined by a comma; null if none), n_lines (confirmed lines),
    n_unconfirmed (lines with a family that no template confirms), probability (largest of the confirmed lines; null if none).

    Null and empty texts have no lines. Rows that repeat an id are scanned each and share the findings of the id; so are null ids. Ties of
    families fall to the first in alphabetical order. Other columns are ignored.
    """
    found = licence_lines(docs, id_col, text_col).where(F.col("family") != UNKNOWN)
    by = found.groupBy("doc_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"),
        F.count_if("confirmed").alias("n_lines"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    ).withColumnRenamed("doc_id", "_id")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(by, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.when(F.col("families") != "", F.col("families")).alias("families"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"), "probability")
