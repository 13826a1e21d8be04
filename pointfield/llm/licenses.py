"""License scans with a trained paragraph classifier; DataFrame functions and Spark ML's JVM models only.

A logistic regression over hashed word unigrams and bigrams tells licence families from one another and from text that is
no licence. It is fitted on the templates below and cuts of them, against a bounded sample of the corpus and
sentences that use the same words otherwise. A fifth of the templates, whole, and of the negative examples is held out of a first fit; on it a
temperature and the least probability for a verdict are set, below which a passage is unknown. A verdict counts only if the passage
and one template of the family have at least CONFIRM of the smaller one's word trigrams in common, one of them a trigram of no other family.

Paragraphs are parted by blank lines. What is classified are the passages of a paragraph in which template trigrams follow one
another, whatever lines they are wrapped in, each widened to its line's ends by at most WIDE words, and all that is left, line by line: what
the classifier takes for a licence there, no template can confirm. Passages are cut out of the text inside the row, and lines that the model takes for no licence go
where they are read, so what is written and shuffled grows with licence text, not with texts.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

#: Features of the classifier; distinct texts of the corpus that are read for negative examples, at most about so many.
FEATURES, SAMPLE_ROWS = 4096, 2_000
CONFIRM = 0.5
UNKNOWN = "unknown"
#: Words without a template trigram that a passage bridges, and by which it is widened.
GAP, WIDE = 10, 10

# Licence families with the identifiers and names that notices use.
NAMED = [
    ("MIT", "MIT", "MIT License"),
    ("Apache-2.0", "Apache-2.0", "Apache License, Version 2.0"),
    ("GPL", "GPL-3.0-or-later", "GNU General Public License, version 3"),
    ("GPL", "GPL-2.0-only", "GNU General Public License, version 2"),
    ("LGPL", "LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1"),
    ("LGPL", "LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL", "AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("BSD", "BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD", "BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("ISC", "ISC", "ISC License"),
    ("Zlib", "Zlib", "zlib License"),
    ("BSL-1.0", "BSL-1.0", "Boost Software License, Version 1.0"),
    ("EPL", "EPL-2.0", "Eclipse Public License, version 2.0"),
    ("EUPL", "EUPL-1.2", "European Union Public Licence, version 1.2"),
    ("Artistic", "Artistic-2.0", "Artistic License 2.0"),
    ("OFL", "OFL-1.1", "SIL Open Font License, Version 1.1"),
    ("CC-BY", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC0", "CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
]
NOTICES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.")
# Short passages of public licence texts and their usual notices, by family.
PASSAGES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "Released under CC0 1.0 Universal."),
    ("CC0", "Released under CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related rights to this work and dedicates it to the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright 2020 the authors. All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("AGPL", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 4.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
]
TEMPLATES = list(dict.fromkeys(PASSAGES + [(f, form.format(name)) for f, _, name in NAMED for form in NOTICES] + [(f, f"SPDX-License-Identifier: {x}") for f, x, _ in NAMED]))
# Sentences that use the words of licences for something else.
OTHERWISE = [
    "The driver renewed his licence at the town hall on Monday.",
    "She asked for permission to leave the room early.",
    "The shop offers a two year warranty on every bicycle.",
    "A copyright dispute between the two bands was settled out of court.",
    "The council wants to redistribute the money among the schools.",
    "Poetic license allows the author to bend the facts.",
    "Without the permission of the owner nobody may enter the garden.",
    "He works in the public domain of the city library.",
    "The pub lost its license to serve alcohol last year.",
    "An unwarranted claim is no reason to change the plan.",
    "The fishing licence costs ten euros and is valid for a week.",
    "The copyright office opens at nine in the morning.",
]



def _grams(text: str) -> list[str]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def _families() -> tuple[dict, dict]:
    """By family, the trigram sets of its templates, and those of its trigrams that no other family's templates have."""
    sets: dict[str, list[list[str]]] = {}
    where: dict[str, set[str]] = {}
    for family, text in TEMPLATES:
        grams = list(dict.fromkeys(_grams(text)))
        sets.setdefault(family, []).append(grams)
        for g in grams:
            where.setdefault(g, set()).add(family)
    return sets, {f: sorted(g for g, fs in where.items() if fs == {f}) for f in sets}


SETS, OWN = _families()


def _trie(words: list[str], space: str) -> str:
    """A pattern of these texts that branches by character."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [(space if c == " " else c) + _trie(rest, space) for c, rest in sorted(heads.items()) if c]
    end = ["(?![a-z0-9])"] if "" in heads else []
    return (parts + end)[0] if len(parts + end) == 1 else "(?:" + "|".join(parts + end) + ")"


_ALL = sorted({g for some in SETS.values() for t in some for g in t})
#: Finds, in lower case, whatever has one of the templates' trigrams among its words.
SHARED = "(?<![a-z0-9])" + _trie(_ALL, "[^a-z0-9]+")
# Marks on words: a template trigram begins here; a line begins here.
_HIT, _LINE = "\u0001", "\u0002"
_STARTS = f"(?<= )(?={_LINE}?{_trie(_ALL, f' {_LINE}?')})"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct word n-grams; the whole sequence when it is shorter."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, many).otherwise(F.array(F.array_join(words, " "))))


def terms(words: Column) -> Column:
    """The words and word pairs of ``features``, repeated ones too: a binary hash has no use for counts."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def features(words: Column) -> Column:
    return F.concat(F.array_distinct(words), ngrams(words, 2))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text in lower case: what blank lines part, if there is anything but white space in it."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\n[ \t\r\f]*\n"), lambda p: p.rlike(r"\S"))


def passages(paragraph: Column) -> Column:
    """The words of each passage of a paragraph (in lower case) in which template trigrams follow one another."""
    return F.when(paragraph.rlike(SHARED), _cut(paragraph, False)).otherwise(F.array().cast("array<array<string>>"))


def _cut(paragraph: Column, rest: bool = True) -> Column:
    """(passages array<array<string>>, rest array<string>) of a paragraph with a template trigram, or its passages alone: the words of each passage, and the stretches of its
    lines that are in none."""

    def of_words(words: Column) -> Column:
        # Positions count from 0.
        at = F.sequence(F.lit(0), F.size(words) - 1)
        hits = F.filter(at, lambda i: F.startswith(words[i], F.lit(_HIT)))
        lines = F.filter(at, lambda i: F.contains(F.substring(words[i], 1, 2), F.lit(_LINE)))
        return _let(hits, lambda h: _let(lines, lambda ls: of_hits(words, h, ls)))

    def of_hits(words: Column, hits: Column, lines: Column) -> Column:
        far = GAP + 3
        first = F.filter(hits, lambda h, i: (i == 0) | (h - F.get(hits, i - 1) > far))
        last = F.filter(hits, lambda h, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) - h > far))

        def reach(a: Column, b: Column) -> Column:
            end = F.least(b + 2, F.size(words) - 1)
            begin = F.array_max(F.filter(lines, lambda x: x <= a))
            stop = F.coalesce(F.array_min(F.filter(lines, lambda x: x > end)) - 1, F.size(words) - 1)
            return F.struct(F.greatest(begin, a - WIDE).alias("begin"), F.least(stop, end + WIDE).alias("stop"))

        return _let(F.zip_with(first, last, reach), lambda reaches: parted(words, reaches))

    def parted(words: Column, reaches: Column) -> Column:
        plain = lambda w: F.translate(w, _HIT + _LINE, "")
        found = F.transform(reaches, lambda s: F.transform(F.slice(words, s["begin"] + 1, s["stop"] - s["begin"] + 1), plain))
        if not rest:
            return found
        within = lambda i: F.exists(reaches, lambda s: (i >= s["begin"]) & (i <= s["stop"]))
        left = F.transform(words, lambda w, i: F.when(within(i), F.lit("\n")).when(F.contains(F.substring(w, 1, 2), F.lit(_LINE)), F.concat(F.lit("\n"), plain(w))).otherwise(plain(w)))
        return F.struct(found.alias("passages"), lines_of(F.array_join(left, " ")).alias("rest"))

    lines = F.split(paragraph, "[\r\n]+")
    begun = F.flatten(F.transform(lines, lambda line: F.transform(tokens(line), lambda w, i: F.when(i == 0, F.concat(F.lit(_LINE), w)).otherwise(w))))
    marked = F.regexp_replace(F.concat(F.lit(" "), F.array_join(begun, " ")), _STARTS, _HIT)
    return _let(F.split(F.substr(marked, F.lit(2)), " "), of_words)


def lines_of(paragraph: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(paragraph, "[\r\n]+"), lambda p: p.rlike("[a-z0-9]"))


def _confirmed(family: Column, own: Column) -> Column:
    """Whether trigrams suffice for a family."""
    sets = F.from_json(F.lit(json.dumps(SETS)), "map<string,array<array<string>>>")
    only = F.from_json(F.lit(json.dumps(OWN)), "map<string,array<string>>")
    like = F.exists(F.element_at(sets, family), lambda t: F.size(F.array_intersect(own, t)) >= CONFIRM * F.least(F.size(own), F.size(t)))
    return F.coalesce(F.arrays_overlap(own, F.element_at(only, family)) & like, F.lit(False))


class Classifier:
    """A fitted model, its families in the order of their numbers, temperature and least probability."""

    def __init__(self, spark: SparkSession, background: DataFrame):
        """``background``: a column ``text`` of a bounded number of texts of the corpus. One line of each without a template trigram, and
        the passages that no template confirms, are taken as no licence."""
        self.families = sorted(SETS) + [UNKNOWN]
        templates = spark.createDataFrame(TEMPLATES, "family string, text string")
        fold = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(5)).cast("int").alias("k")
        words = templates.select("family", fold(F.col("text")), tokens(F.col("text")).alias("w"))
        # cuts: the front, the back and the middle of every template, and both ends within other words; all in the template's fold
        size = F.size("w")
        half = F.ceil(size / 2).cast("int")
        cuts = F.array(F.col("w"), F.slice("w", F.lit(1), F.greatest(half + 1, F.lit(4))), F.slice("w", F.least(half, F.greatest(size - 4, F.lit(1))), size), F.concat(F.array(*map(F.lit, ("copyright", "2020", "the", "authors"))), F.col("w")), F.concat(F.col("w"), F.array(*map(F.lit, ("see", "license", "txt", "for", "details")))))
        positive = words.select("family", "k", F.explode(cuts).alias("w"))
        lines = F.filter(F.split("text", "[\r\n]+"), lambda p: p.rlike(r"\S") & ~F.lower(p).rlike(SHARED))
        line = F.get(lines, F.pmod(F.crc32(F.col("text").cast("binary")), F.greatest(F.size(lines), F.lit(1))).cast("int"))
        near = background.select(F.explode(paragraphs(F.col("text"))).alias("p")).select(F.explode(passages(F.col("p"))).alias("w"))
        near = near.where(~_any_confirmed(F.col("w")))
        other = spark.createDataFrame([(t,) for t in OTHERWISE], "text string").union(background.select(line.alias("text")).where("text is not null")).select(tokens(F.col("text")).alias("w")).union(near)
        negative = other.select(F.lit(UNKNOWN).alias("family"), fold(F.array_join("w", " ")), "w")
        label = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        rows = positive.union(negative).where(F.size("w") > 0).select("k", label.cast("double").alias("label"), features(F.col("w")).alias("grams"))
        self.hash = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
        rows = materialize(rows, "license-sample").coalesce(2)  # a bounded sample
        rows = self.hash.transform(rows).withColumn("weight", F.when(F.col("label") == len(self.families) - 1, 0.2).otherwise(1.0))
        fit = lambda df: LogisticRegression(maxIter=40, regParam=0.001, family="multinomial", weightCol="weight", aggregationDepth=2).fit(df)
        # Calibration: fitted without the whole templates and examples of one fold, judged on them.
        logits = materialize(fit(rows.where("k <> 4")).transform(rows.where("k = 4")).select("label", "weight", vector_to_array("rawPrediction").alias("z")), "license-held-out")
        scales = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]
        right = F.get("z", F.col("label").cast("int"))
        loss = [(F.sum(F.col("weight") * -F.log(F.greatest(F.lit(1e-9), _probability(F.col("z"), right, t)))) / F.sum("weight")).alias(f"t{i}") for i, t in enumerate(scales)]
        found = logits.agg(*loss).first()
        self.scale = min(zip(found, scales, strict=True))[1] if found and found[0] is not None else 1.0
        last = len(self.families) - 1
        wrong = logits.where(F.col("label") == last).agg(F.max(_probability(F.col("z"), F.array_max(F.slice("z", 1, last)), self.scale))).first()[0]
        self.least = max(0.2, min(0.9, (wrong or 0.0)))
        self.model = fit(rows)
        self.first = self.model.copy({self.model.rawPredictionCol: "", self.model.probabilityCol: ""})

    def suspected(self, df: DataFrame, words: str, also: Column) -> DataFrame:
        """The rows of ``df`` whose words the model takes for a family rather than for no licence, and those for which ``also`` holds. Nothing is written."""
        scored = self.first.transform(self.hash.transform(df.withColumn("grams", terms(F.col(words)))))
        return scored.where(also | (F.col("prediction") < len(self.families) - 1)).select(*df.columns)

    def classify(self, df: DataFrame, words: str) -> DataFrame:
        """``df`` with family, probability and likely for its column of words; family is ``unknown`` below the least probability, if
        the classifier says so, or if no template of the family confirms it. What is likely lacks at most that confirmation. The
        columns grams, features, rawPrediction, probability and prediction must be free; an empty input gives no rows."""
        scored = self.model.transform(self.hash.transform(df.withColumn("grams", features(F.col(words)))))
        # Written, so that what follows reads the numbers instead of working them out again for each use.
        scored = materialize(scored.select(*df.columns, vector_to_array("rawPrediction").alias("_z")), "license-scores")
        family = F.element_at(F.array(*map(F.lit, self.families)), F.array_position("_z", F.array_max("_z")).cast("int"))
        scored = scored.withColumn("_family", family).withColumn("probability", _probability(F.col("_z"), F.array_max("_z"), self.scale))
        likely = (F.col("_family") != UNKNOWN) & (F.col("probability") >= self.least)
        sure = likely & _confirmed(F.col("_family"), ngrams(F.col(words), 3))
        return scored.withColumn("likely", likely).withColumn("family", F.when(sure, F.col("_family")).otherwise(F.lit(UNKNOWN))).drop("_z", "_family")


def _any_confirmed(words: Column) -> Column:
    own = ngrams(words, 3)
    return F.exists(F.array(*map(F.lit, sorted(SETS))), lambda f: _confirmed(f, own))


def _probability(z: Column, own: Column, scale: float) -> Column:
    """That of a class with the score ``own`` among scores z."""
    return F.exp((own - F.array_max(z)) / scale) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max(z)) / scale))


def background(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` distinct texts at most, chosen by a hash of the text; a text counts once however many rows have it."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    hashed = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text", F.lit(11)).alias("_h"), "text")
    some = hashed.where(F.pmod("_h", F.lit(1_000_003)) < F.lit(share * 1_000_003)).groupBy("_h").agg(F.first("text").alias("text"))
    return materialize(some.select("text"), "license-background")


def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """A classifier whose negative examples come from ``background``. An empty input leaves the sentences that use the words otherwise."""
    return Classifier(docs.sparkSession, background(docs, sample_rows))


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_paragraphs, findings array<struct<paragraph, passage, family, probability>>, unconfirmed
    array<struct<paragraph, line, probability>>). Findings are the passages around template trigrams that the classifier takes for a licence, by paragraph and place
    from 1; ``unknown`` where no template confirms it. All other words are classified line by line; of these, unconfirmed are those taken for a licence, by paragraph and
    number of the line, or of what the passages leave of it, from 1.

    Null and empty texts have no paragraphs. Repeated rows get equal results; null ids
    are ids. Other columns are ignored, whatever their names. An empty input gives no rows.
    """
    numbered = F.transform(F.col("_paragraphs"), lambda p, i: F.struct((i + 1).cast("long").alias("paragraph"), p.alias("t"), p.rlike(SHARED).alias("near")))
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_uid"), paragraphs(F.col(text_col)).alias("_paragraphs"))
    rows = rows.select("_uid", "_id", F.size("_paragraphs").cast("long").alias("n_paragraphs"), numbered.alias("_paragraphs"))
    # A head for each row, with the paragraphs to be cut, and the lines of the others.
    near = F.transform(F.filter("_paragraphs", lambda s: s["near"]), lambda s: s.dropFields("near"))
    part = lambda head, paragraph, line, text: F.struct(head.alias("near"), paragraph.cast("long").alias("paragraph"), line.cast("long").alias("line"), text.cast("string").alias("t"))
    nothing = F.lit(None).cast("array<struct<paragraph:bigint,t:string>>")
    lines = F.flatten(F.transform(F.filter("_paragraphs", lambda s: ~s["near"]), lambda s: F.transform(lines_of(s["t"]), lambda t, i: part(nothing, s["paragraph"], i + 1, t))))
    parts = F.concat(F.array(part(near, F.lit(None), F.lit(None), F.lit(None))), lines)
    rows = rows.select("_uid", "_id", "n_paragraphs", F.explode(parts).alias("_part")).select("_uid", "_id", "n_paragraphs", "_part.*")
    rows = rows.withColumn("_w", F.coalesce(tokens(F.col("t")), F.array().cast("array<string>"))).drop("t")
    rows = materialize(classifier.suspected(rows, "_w", F.col("near").isNotNull()), "license-paragraphs")
    heads = rows.where(F.col("near").isNotNull())
    cut = heads.where(F.size("near") > 0).select("_uid", F.explode("near").alias("_n")).select("_uid", F.col("_n.paragraph").alias("paragraph"), _cut(F.col("_n.t")).alias("_cut"))
    cut = materialize(cut.select("_uid", "paragraph", "_cut.*"), "license-passages")
    found = cut.select("_uid", "paragraph", F.posexplode("passages").alias("passage", "_w"))
    found = classifier.classify(found, "_w").where("likely").select("_uid", F.struct("paragraph", (F.col("passage") + 1).cast("long").alias("passage"), "family", "probability").alias("_f"))
    found = found.groupBy("_uid").agg(F.array_sort(F.collect_list("_f")).alias("_found"))
    left = cut.select("_uid", "paragraph", F.posexplode("rest").alias("line", "t")).select("_uid", "paragraph", (F.col("line") + 1).cast("long").alias("line"), tokens(F.col("t")).alias("_w"))
    left = rows.where(F.col("near").isNull()).select(*left.columns).unionByName(classifier.suspected(left, "_w", F.lit(False)))
    left = classifier.classify(left, "_w").where("likely").select("_uid", F.struct("paragraph", "line", "probability").alias("_l"))
    left = left.groupBy("_uid").agg(F.array_sort(F.collect_list("_l")).alias("_left"))
    none = F.array().cast("array<struct<paragraph:bigint,passage:bigint,family:string,probability:double>>")
    silent = F.array().cast("array<struct<paragraph:bigint,line:bigint,probability:double>>")
    out = heads.select("_uid", "_id", "n_paragraphs").join(found, "_uid", "left").join(left, "_uid", "left")
    return out.select(F.col("_id").alias(id_col), "n_paragraphs", F.coalesce("_found", none).alias("findings"), F.coalesce("_left", silent).alias("unconfirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = F.filter("findings", lambda f: f["family"] != UNKNOWN)
    return scan(docs, fitted(docs)).select(
        "doc_id",
        "n_paragraphs",
        F.size(known).cast("long").alias("n_licensed"),
        (F.size("findings") - F.size(known) + F.size("unconfirmed")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda f: f["family"]))), ",").alias("families"),
    )
