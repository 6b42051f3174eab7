"""License scans by diagonal voting.

Texts are cut into words once. Of a document's rolling word 3-gram hashes those that a bitmap of the templates' hashes lets pass are kept, with
their words, and joined to the places of the templates. A match of place p in the document and q in the template votes for
diagonal p - q; votes are added up by diagonal, neighbouring diagonals (a word put in or left out) are merged, and a span counts if it holds
enough of the template densely enough. The join compares hashes and then the words themselves, so every vote is verified. Beside
that, fixed base phrases are counted. DataFrame functions only; the texts are never shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import ascii_lower, durable, ships, table, text_hash

ships(__name__)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, SHIFT, SHARE, DENSE, ENOUGH = 3, 2, 0.8, 0.5, 16
#: Words (64 bits each) of the bitmap that grams are tested with, and templates' grams up to which it and the broadcast table are used.
BITMAP, MOST_GRAMS = 2048, 20_000
# Base phrases with their labels, and the words of well-known public license notices.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("reserved", "copyright all rights reserved"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    *((label, f"spdx license identifier {name}") for label, name in (("mit", "mit"), ("isc", "isc"), ("apache-2.0", "apache 2 0"), ("gpl", "gpl 2 0 only"), ("gpl", "gpl 2 0 or later"), ("gpl-3.0", "gpl 3 0 only"), ("gpl-3.0", "gpl 3 0 or later"), ("lgpl", "lgpl 2 1 or later"), ("agpl", "agpl 3 0 or later"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("mpl-2.0", "mpl 2 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"))),
]


def needed(n_words: int) -> int:
    """Votes that a span needs: a share of the template, of a long one at least five in a row."""
    return max(2, -(-int(10 * SHARE) * min(n_words - GRAM + 1, ENOUGH) // 10))


def default_templates(spark) -> DataFrame:
    """The notices above as a table (label, text)."""
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def grams(templates: DataFrame) -> DataFrame:
    """(t, label, q, need, most, g, words): a row for each place q of each template (label, text). Templates under GRAM words have none."""
    w = F.split(F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")
    rows = templates.select("label", w.alias("w")).distinct().select("label", "w", F.xxhash64("label", "w").alias("t")).filter(F.size("w") >= GRAM)
    most = F.least(F.size("w") - (GRAM - 1), F.lit(ENOUGH))
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (GRAM - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, GRAM))))
    rows = rows.select("t", "label", most.alias("most"), places.alias("q", "words"))
    parts = F.split("words", " ")
    return rows.select("t", "label", "q", F.greatest(F.lit(2), F.ceil(F.lit(int(10 * SHARE)) * F.col("most") / 10)).cast("int").alias("need"), "most", F.xxhash64(*[F.get(parts, i) for i in range(GRAM)]).alias("g"), "words")


def count_of(c: str, sub: str) -> Column:
    return ((F.length(c) - F.length(F.replace(F.col(c), F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns() -> list[Column]:
    """n_words, n_base, first_word, last_word and base_labels (array) of the words `w` and of `_j`, the words with spaces between and around."""
    n = F.size("w").cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        has = F.contains("_j", F.lit(f" {phrase} "))
        counts.append(F.when(has, F.regexp_count("_j", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(has, spaces(F.substring_index("_j", f" {phrase} ", 1))))
        lasts.append(F.when(has, n - spaces(F.substring_index("_j", f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return [n.alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base_labels")]


def scanned(docs: DataFrame, id_col: str, places: DataFrame) -> DataFrame:
    """_id, _h, the columns of base phrases, and _hits (p, g, words): the grams that may be some template's."""
    words = docs.select(F.col(id_col).alias("_id"), text_hash().alias("_h"), F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    words = words.select("_id", "_h", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("_j"))
    known = [r["g"] for r in places.select("g").distinct().limit(MOST_GRAMS + 1).collect()]
    w = F.col("w")
    hashes = F.transform(w, lambda x, i: F.struct(i.alias("p"), F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("g")))
    if len(known) <= MOST_GRAMS:
        bits = [0] * BITMAP
        for g in known:
            bits[(g & (64 * BITMAP - 1)) >> 6] |= 1 << (g & 63)
        bitmap = F.lit([x - (1 << 64) if x >> 63 else x for x in bits])
        hashes = F.filter(hashes, lambda x: F.getbit(F.get(bitmap, F.shiftright(x["g"].bitwiseAND(64 * BITMAP - 1), 6).cast("int")), x["g"].bitwiseAND(63).cast("int")) == 1)
    hits = F.transform(hashes, lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"), F.concat_ws(" ", F.slice(w, x["p"] + 1, GRAM)).alias("words")))
    return durable(words.select("_id", "_h", *phrase_columns(), hits.alias("_hits")))


def voted_spans(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Verified spans: _id, _h, label, start, end (words), votes, score."""
    few = places.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    hits = docs.select("_id", "_h", F.inline("_hits")).join(F.broadcast(places) if few else places, ["g", "words"])
    diagonals = hits.groupBy("_id", "_h", "t", "label", "need", "most", (F.col("p") - F.col("q")).alias("d")).agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
    by = Window.partitionBy("_id", "_h", "t").orderBy("d")
    islands = diagonals.withColumn("_new", F.when(F.col("d") - F.lag("d").over(by) <= SHIFT, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(by))
    spans = islands.groupBy("_id", "_h", "t", "label", "need", "most", "_k").agg(F.sum("n").alias("votes"), F.min("a").alias("start"), F.max("b").alias("_b"))
    spans = spans.filter((F.col("votes") >= F.col("need")) & (F.col("votes") >= DENSE * (F.col("_b") - F.col("start") + 1)))
    return spans.select("_id", "_h", "label", "start", (F.col("_b") + GRAM).alias("end"), "votes", F.least(F.lit(1.0), F.col("votes") / F.col("most")).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", templates: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    templates (label, text): notices of any number, TEMPLATES by default. The score is 1 with a base phrase, else the best span's share
    of its template (of a long one, of ENOUGH grams), else 0. Null and empty texts have no words. Rows that repeat an id are told
    apart by a hash of their text; equal rows have equal results. Other columns are dropped.
    """
    places = durable(grams(default_templates(docs.sparkSession) if templates is None else templates))
    base = scanned(docs, id_col, places)
    found = voted_spans(base, places).dropDuplicates(["_id", "_h", "label", "start", "end"])
    found = found.groupBy("_id", "_h").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"), F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"))
    found = found.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "_labels", "_score", "spans")
    both = base.join(found, base["_id"].eqNullSafe(found["_id2"]) & (base["_h"] == found["_h2"]), "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return both.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", text(F.col("base_labels")).alias("base_labels"), text(F.concat("base_labels", F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"), "spans")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def sql() -> str:
    rows = ", ".join(f"({t}, '{label}', {needed(len(text.split()))}, {min(len(text.split()) - GRAM + 1, ENOUGH)}, {text.split()})" for t, (label, text) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in BASE.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT * FROM (VALUES {rows}) AS v(t, label, need, most, tw)),
g AS (SELECT t, label, need, most, q, tw[q + 1] || ' ' || tw[q + 2] || ' ' || tw[q + 3] AS k FROM (SELECT *, unnest(range(0, len(tw) - 2)) AS q FROM m)),
x AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d)),
dg AS (SELECT doc_id, t, label, need, most, p - q AS dd, count(*) AS n, min(p) AS a, max(p) AS b FROM x JOIN g USING (k) GROUP BY ALL),
il AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY dd ROWS UNBOUNDED PRECEDING) AS kk
       FROM (SELECT *, CASE WHEN dd - lag(dd) OVER (PARTITION BY doc_id, t ORDER BY dd) <= {SHIFT} THEN 0 ELSE 1 END AS new FROM dg)),
sp AS (SELECT doc_id, label, sum(n) AS votes, any_value(most) AS most, min(a) AS a, max(b) AS b FROM il GROUP BY doc_id, t, label, need, kk HAVING sum(n) >= any_value(need) AND sum(n) >= {DENSE} * (max(b) - min(a) + 1)),
bp AS (SELECT doc_id, label, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d), (VALUES {base}) AS v(label, bw) WHERE w[p + 1] = bw[1] AND w[p + 1:p + len(bw)] = bw),
bl AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bp GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bp UNION ALL SELECT doc_id, label FROM sp) GROUP BY doc_id),
sc AS (SELECT doc_id, max(least(1.0, votes / most)) AS score FROM sp GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""
