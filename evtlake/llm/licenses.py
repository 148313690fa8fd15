"""Licence scans with DataFrame functions alone: base phrases, and a positional rare-token index of licence templates.

The index holds the postings of each template's own rarest words (highest inverse document frequency, counted over all documents). A
file's words are looked up in it first; a template with enough of its words in the file is verified by its mandatory
phrases; then the places of the words meet the template's postings by relative position: it is found where enough of its
indexed words agree on one shift, give or take `DRIFT` places for lines put in. What is asked is a share of the template's
words, not of those that the file holds, so a mention of a licence's name is no licence. The score is that share.

Defined results: a null text is empty: no words, no labels, score 0; an empty table gives no rows; repeated rows and those
with a null doc_id are scanned each on their own (they are numbered once, in a written table); phrases are found wherever
their words stand consecutively; words as rare as each other rank by their text; further columns are ignored. A very long
text is one row like any other: its words are one array in its task, and only looked-up words leave it.

Phrases and templates below are lower-case words joined by one space. A template's label is its name up to a slash. Other
templates, such as whole licence texts from files, are an argument of `scanned`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# Phrases of the contract and their labels; licence texts or their notices, each with its mandatory phrases.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge"],
    ),
    "mit/notice": ("released under the mit license", ["under the mit license"]),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["redistribution and use in source and binary forms"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        ["gnu general public license"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ["gnu lesser general public license"],
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["permission to use copy modify and or distribute this software for any purpose"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software released into the public domain"],
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    "cc-by-sa": ("licensed under the creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    "cc-by-sa/notice": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc-by-nc": ("licensed under the creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    "cc-by-nc/notice": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "proprietary": ("all rights reserved no part of this document may be reproduced without permission", ["all rights reserved"]),
}
#: Rarest words of a template that are indexed; the share of them that must agree, and that of a template with fewer than
#: twice as many distinct words; places that a shift may drift (a band and a half at most).
LOOKUPS, LEAST_SHARE, SHORT_SHARE, DRIFT = 12, 0.5, 0.8, 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text: Column) -> Column:
    """A-Z lower-cased words joined by one space."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), LETTERS, LETTERS.lower())
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, phrase: str, n_words: Column) -> Column:
    """(number, first, last) of the places of a phrase; null without any."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    parts = F.split(padded, f" {phrase}(?= )")
    first = _spaces(F.element_at(parts, 1))
    last = n_words - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    found = F.struct((F.size(parts) - 1).cast("bigint").alias("n"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), F.lit(BASE[phrase]).alias("label"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found)


def _vocabulary(templates: dict[str, tuple[str, list[str]]]) -> list[str]:
    return sorted({w for text, _ in templates.values() for w in text.split()})


def document_counts(norm: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """For each word of the templates the number of documents that hold it, and under '' that of all."""
    words = F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, vocabulary)))
    rows = norm.select(F.explode(F.concat(F.array(F.lit("")), F.array_except(words, F.array(F.lit(""))))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # as many rows as the templates have words


def indexed_words(text: str, rarity: dict[str, float]) -> tuple[list[str], int]:
    """A template's rarest words and how many of them must agree."""
    own = sorted(set(text.split()), key=lambda w: (-rarity[w], w))
    top = own[:LOOKUPS]
    return top, math.ceil((LEAST_SHARE if len(own) >= 2 * LOOKUPS else SHORT_SHARE) * len(top))


def scanned(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every document. templates: name to
    (text, mandatory phrases); TEMPLATES if not given."""
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    norm = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_words(F.col("text")).alias("norm"))
    vocabulary = _vocabulary(templates)
    counts = document_counts(norm, vocabulary)
    total = counts.get("", 0)
    rarity = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    index = {t: indexed_words(text, rarity) for t, (text, _) in templates.items()}
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(_spaces(F.col("norm")) + 1).cast("bigint")
    base = F.filter(F.array(*(_places(F.col("norm"), p, F.col("n_words")) for p in BASE)), lambda x: x.isNotNull())
    rare = sorted({w for top, _ in index.values() for w in top})
    places = F.filter(F.transform(F.split("norm", " "), lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    files = norm.withColumn("n_words", n_words).withColumn("base", base).withColumn("places", places)
    # Templates with enough indexed words in the file; of those, as there are few, the mandatory phrases are looked for.
    strings = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    known = F.array(*(F.struct(F.lit(t).alias("template"), strings(top).alias("top"), F.lit(need).alias("need"), strings(templates[t][1]).alias("must")) for t, (top, need) in index.items()))
    held = F.transform("places", lambda p: p["word"])
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    possible = F.when(F.size("places") > 0, F.filter(known, lambda t: F.size(F.array_intersect(t["top"], held)) >= t["need"]))
    verified = F.transform(F.filter("possible", lambda t: F.forall(t["must"], lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))), lambda t: t["template"])
    files = files.withColumn("possible", possible).withColumn("verified", F.when(F.size("possible") > 0, verified))
    some = F.size("verified") > 0
    files = written(files.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", "base", F.when(some, F.col("verified")).alias("verified"), F.when(some, F.col("places")).alias("places")), "files")
    postings = [(w, t, i, len(index[t][0]), index[t][1]) for t, (text, _) in templates.items() for i, w in enumerate(text.split()) if w in index[t][0]]
    postings = spark.createDataFrame(postings, "word string, template string, place int, n_top int, need int")
    hits = files.where("verified IS NOT NULL").select("uid", "verified", F.explode("places").alias("p")).select("uid", "verified", "p.word", "p.at")
    hits = hits.join(F.broadcast(postings), "word").where(F.array_contains("verified", F.col("template")))  # the templates alone
    shift = F.col("at") - F.col("place")
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.floor((shift + i * DRIFT // 2) / DRIFT).alias("band")) for i in range(2)))
    agreed = hits.select("uid", "template", "word", "n_top", "need", F.explode(bands).alias("b")).groupBy("uid", "template", "b", "n_top", "need").agg(F.count_distinct("word").alias("n"))
    agreed = agreed.where("n >= need").withColumn("share", F.col("n") / F.col("n_top"))
    label = F.substring_index("template", "/", 1)
    found = agreed.groupBy("uid").agg(F.collect_set(label).alias("more"), F.max("share").alias("share"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>"))))
    return files.join(found, "uid", "left").select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
    )
