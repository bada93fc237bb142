"""Licence scans, in DataFrame functions and Spark's DataFrame-based ML only.

A paragraph that holds a licence cue is classified by a multinomial logistic regression
over its word 1- to 3-grams (present or not; n-grams outside the training texts count
nothing), trained on ``NOTICES``: notices of each family and ``unknown`` paragraphs that
speak of licences without granting one. Its scores are divided by a temperature chosen
on ``CALIBRATION``, a second set of labelled paragraphs, so probabilities are calibrated;
a best family below ``MIN_PROBABILITY`` counts as unknown. A family is confirmed only if
the paragraph covers ``MIN_COVER`` of the 2-grams of one of that family's templates.

A paragraph is a run of lines without a blank line between. In a text without blank lines each
line is one; the lines up to one that ends a sentence (``.``, ``!`` or ``?``) are judged
together as well, and count as one paragraph if that confirms a family that none of them
shows alone: a notice wrapped over lines.

Templates are the notices and the licence rows of ``CALIBRATION``, which have short wordings.

A paragraph is judged if it holds a cue, or if it covers ``MIN_COVER`` of a notice without
one, so none that could be confirmed is passed over. ``ANCHORS`` leave out early what can be
neither: cues, and words without which less than that is left of each notice's 2-grams.

Edge cases: null and empty texts and texts without a cue or such cover have no paragraphs; repeated
rows get the same answer each; documents are told apart by id and text. Ties between families go to the first
label. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
MIN_PROBABILITY, MIN_COVER = 0.5, 0.6
TEMPERATURES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0)

# A paragraph that holds one of these (in lower case) is judged.
CUES = ("licens", "licenc", "copyright", "domain", "permission", "redistribut", "warrant", "spdx", "cc by", "cc-by", "cc0", "copyleft",
        "rights reserved", "gpl", "gnu", "creative commons")

# Licence notices by family, as published or as commonly worded, and paragraphs that are none.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Released under the Apache 2.0 license."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "Distributed under the GNU GPL, version 2 or later."),
    ("gpl", "Released under the GPL v3 license."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "Released under the BSD License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Licensed under the BSD 3-Clause license."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "This work is in the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright 2020 Example Inc. All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced without the prior written permission of the publisher."),
    (UNKNOWN, "You need a driving licence to rent a car here."),
    (UNKNOWN, "She passed the test and got her license in the spring."),
    (UNKNOWN, "The license plate was hard to read in the dark."),
    (UNKNOWN, "The bar lost its liquor license last year."),
    (UNKNOWN, "Ask your teacher for permission before you leave the room."),
    (UNKNOWN, "The warranty covers two years of normal use."),
    (UNKNOWN, "There is no warrant for his arrest."),
    (UNKNOWN, "The company sells a license for every user of the software."),
    (UNKNOWN, "Copyright law protects authors of books and music."),
    (UNKNOWN, "The firm licensed the patent to several makers of phones."),
    (UNKNOWN, "A poetic licence may be used in this version of the story."),
    (UNKNOWN, "The state will redistribute the land to the farmers."),
    (UNKNOWN, "The general public may enter free of charge with permission of the guard."),
    (UNKNOWN, "Please read the license of each source before you use this file."),
    (UNKNOWN, "The work under way at the public domain office goes on."),
    (UNKNOWN, "This version of the licence exam is for doctors."),
    (UNKNOWN, "Licensed under the Eclipse Public License, version 2.0."),
    (UNKNOWN, "SPDX-License-Identifier: Zlib"),
    (UNKNOWN, "Released under the Boost Software License."),
    (UNKNOWN, "This work is licensed under the Open Data Commons Attribution License."),
    (UNKNOWN, "Distributed under the terms of our own license."),
]

# Labelled paragraphs on which the temperature is chosen.
CALIBRATION = [
    ("mit", "The code is released under the MIT license"), ("mit", "License: MIT License"),
    ("apache-2.0", "It is licensed under Apache License 2.0"), ("apache-2.0", "This file is licensed under the Apache License, Version 2.0"),
    ("gpl", "The program is licensed under the GNU General Public License version 3"), ("gpl", "Released under the GNU GPL"),
    ("lgpl", "Released under the GNU Lesser General Public License"), ("bsd", "Distributed under the BSD 3-Clause License"),
    ("cc-by-nc", "The data are licensed under CC BY-NC 4.0"), ("cc-by", "The text is available under CC BY 4.0"),
    ("cc-by-sa", "Text is available under CC BY-SA 4.0"), ("mpl-2.0", "Released under the Mozilla Public License 2.0"),
    (UNKNOWN, "He works without a license in this state"), (UNKNOWN, "The shop has a license to sell beer"),
    (UNKNOWN, "They gave us permission to use the hall"), (UNKNOWN, "The warranty of this car is void"),
    (UNKNOWN, "A software license can be costly"), (UNKNOWN, "The copyright of the song was sold"),
    (UNKNOWN, "His pilot licence was taken away last year"), (UNKNOWN, "The public may visit the domain in summer"),
    (UNKNOWN, "Licensed under the European Union Public Licence, version 1.2"), (UNKNOWN, "Released under the Artistic License 2.0"),
    (UNKNOWN, "SPDX-License-Identifier: PostgreSQL"), (UNKNOWN, "Licensed under the Example Community License, version 3"),
    (UNKNOWN, "Released under the Open Font License"), (UNKNOWN, "This file is licensed under the terms of the vendor"),
]


def _pairs(notice: str) -> list[str]:
    w = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", notice.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


TEMPLATES = [(family, text) for family, text in NOTICES + CALIBRATION if family != UNKNOWN]
#: (family, distinct 2-grams) of the templates.
NOTICE_PAIRS = [(family, _pairs(text)) for family, text in TEMPLATES]


def _anchors() -> tuple[str, ...]:
    """The cues, and longest words of the notices until no text without any of them covers
    ``MIN_COVER`` of a notice."""
    out = list(CUES)
    for _, pairs in NOTICE_PAIRS:
        while len(left := [p for p in pairs if not any(c in w for w in p.split() for c in out)]) / len(pairs) >= MIN_COVER:
            out.append(max((w for p in left for w in p.split()), key=lambda w: (len(w), w)))
    return tuple(out)


ANCHORS = _anchors()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _grams(w: Column, size: int) -> Column:
    last = F.size(w) - size
    join = lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), join)).otherwise(F.array().cast("array<string>"))


def _featured(rows: DataFrame) -> DataFrame:
    """``rows`` (text) with the columns words and terms (distinct 1- to 3-grams)."""
    w = F.col("words")
    return (rows.withColumn("words", _words(F.col("text")))
            .withColumn("terms", F.array_distinct(F.concat(_grams(w, 1), _grams(w, 2), _grams(w, 3)))))


def _has_cue(text: str, cues: tuple[str, ...] = CUES) -> Column:
    cue = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in cues])
    return F.exists(F.array(F.lower(F.col(text))), cue)          # the text is lowered once


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    values = ", ".join("('{}', '{}')".format(f, t.replace("'", "''")) for f, t in rows)
    return spark.sql(f"SELECT family, text FROM VALUES {values} AS t(family, text)")


def _probabilities(raw: Column, temperature: Column | float) -> Column:
    """Softmax of scores divided by the temperature."""
    e = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


class LicenceModel:
    """The classifier: vectorizer and regression, labels by class number, temperature."""

    def __init__(self, stages: PipelineModel, labels: list[str], temperature: float):
        self.stages, self.labels, self.temperature = stages, labels, temperature

    def classified(self, rows: DataFrame) -> DataFrame:
        """``rows`` (text) with words, family and probability."""
        raw = self.stages.transform(_featured(rows)).withColumn("p", _probabilities(vector_to_array("rawPrediction"), self.temperature))
        best = F.array_max("p")
        family = F.array(*[F.lit(x) for x in self.labels])[(F.array_position("p", best) - 1).cast("int")]
        return (raw.withColumn("probability", best).withColumn("family", F.when(best >= MIN_PROBABILITY, family).otherwise(F.lit(UNKNOWN)))
                .drop("p", "terms", "tf", "rawPrediction", "modelProbability", "prediction"))


def train(spark: SparkSession) -> LicenceModel:
    labels = sorted({f for f, _ in NOTICES})
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("family")).cast("double") - 1
    rows = _featured(_table(spark, NOTICES)).withColumn("label", number).coalesce(1).cache()      # fixed size
    vectorizer = CountVectorizer(inputCol="terms", outputCol="tf", binary=True).fit(rows)
    regression = LogisticRegression(featuresCol="tf", labelCol="label", probabilityCol="modelProbability", family="multinomial",
                                    regParam=0.003, maxIter=60).fit(vectorizer.transform(rows))
    rows.unpersist()
    stages = PipelineModel([vectorizer, regression])
    held = stages.transform(_featured(_table(spark, CALIBRATION)).withColumn("label", number)).withColumn("raw", vector_to_array("rawPrediction"))
    loss = held.select(*[F.sum(-F.log(_probabilities(F.col("raw"), t)[F.col("label").cast("int")])).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    return LicenceModel(stages, labels, min(zip(loss, TEMPERATURES, strict=True))[1])


def _covers_a_notice(text: str) -> Column:
    """Whether ``MIN_COVER`` of some notice's 2-grams occur in the text."""
    known = F.array(*[F.lit(p) for p in sorted({p for _, pairs in NOTICE_PAIRS for p in pairs})])
    covers = lambda own: reduce(lambda a, b: a | b, [
        F.size(F.array_intersect(own, F.array(*[F.lit(p) for p in pairs]))) / len(pairs) >= MIN_COVER for _, pairs in NOTICE_PAIRS])
    pairs = F.transform(F.array(_words(F.col(text))), lambda w: F.array_intersect(_grams(w, 2), known))
    return F.exists(pairs, covers)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, run, whole, text): paragraphs to judge; rows of one id and text once.
    ``whole`` marks several lines that are judged together beside their ``run``'s single ones."""
    anchored = (docs.where(_has_cue("text", ANCHORS)).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
                .dropDuplicates(["doc_id", "text_hash"]))
    blank = r"\n[ \t\r]*\n\s*"
    lines, parted = F.split("text", r"\r?\n"), F.col("text").rlike(blank)
    runs = F.when(parted, F.split("text", blank)).otherwise(F.split("text", r"(?<=[.!?])[ \t]*\r?\n"))
    each = F.when(F.col("parted") | (F.size(lines) == 1), F.array("text")).otherwise(F.concat(lines, F.array("text")))
    rows = (anchored.select("doc_id", "text_hash", parted.alias("parted"), F.posexplode(runs).alias("run", "text"))
            .where(_has_cue("text", ANCHORS))
            .select("doc_id", "text_hash", "run", F.size(each).alias("parts"), F.posexplode(each).alias("place", "text")))
    judged = rows.where(_has_cue("text", ANCHORS)).where(_has_cue("text") | _covers_a_notice("text"))
    return judged.select("doc_id", "text_hash", "run", ((F.col("parts") > 1) & (F.col("place") == F.col("parts") - 1)).alias("whole"), "text")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, n_cues, n_confirmed, n_unknown, best_probability) per row of ``docs``:
    the confirmed families, sorted and comma-joined, and counts of paragraphs."""
    spark = docs.sparkSession
    model = train(spark)
    known = model.classified(paragraphs(docs)).withColumn("pairs", F.array_distinct(_grams(F.col("words"), 2)))
    notices = (_table(spark, TEMPLATES).withColumn("w", _words(F.col("text")))
               .groupBy("family").agg(F.collect_list(F.array_distinct(_grams(F.col("w"), 2))).alias("notices")))      # fixed size
    cover = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(F.col("pairs"), n)) / F.greatest(F.size(n), F.lit(1))))
    judged = known.join(F.broadcast(notices), "family", "left").withColumn("confirmed", F.coalesce(cover >= MIN_COVER, F.lit(False)))
    one, sure = ~F.col("whole"), F.col("confirmed")
    by_run = judged.groupBy("doc_id", "text_hash", "run").agg(
        F.collect_set(F.when(sure & one, F.col("family"))).alias("families"), F.collect_set(F.when(sure & ~one, F.col("family"))).alias("joined"),
        F.count_if(one).alias("cues"), F.count_if(one & sure).alias("confirmed"), F.count_if(one & (F.col("family") == UNKNOWN)).alias("unknown"),
        F.max(F.when(sure & one, F.col("probability"))).alias("best"), F.max(F.when(sure & ~one, F.col("probability"))).alias("joined_best"))
    wrapped = (F.col("confirmed") == 0) & (F.size("joined") > 0)
    pick = lambda a, b: F.when(wrapped, a).otherwise(b)
    zero, single = F.lit(0).cast("long"), F.lit(1).cast("long")
    found = by_run.groupBy("doc_id", "text_hash").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pick(F.col("joined"), F.col("families")))))), ",").alias("licences"),
        F.sum(pick(single, F.col("cues"))).alias("n_cues"), F.sum(pick(single, F.col("confirmed"))).alias("n_confirmed"),
        F.sum(pick(zero, F.col("unknown"))).alias("n_unknown"), F.max(F.round(pick(F.col("joined_best"), F.col("best")), 6)).alias("best_probability"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    none = F.lit(0).cast("long")
    return (base.join(found, base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_hash"] == found["text_hash"]), "left")
            .select(base["doc_id"], F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_cues", none).alias("n_cues"),
                    F.coalesce("n_confirmed", none).alias("n_confirmed"), F.coalesce("n_unknown", none).alias("n_unknown"), "best_probability"))
