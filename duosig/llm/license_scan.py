"""Licences in texts by diagonal voting: word k-grams meet the templates' places, and offsets that agree are one span. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose places are found exactly, and their labels: fixed values.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Wordings that may be changed a little, and their labels: fixed values, from the published licences.
WORDINGS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]

#: Words of a gram of phrases and of wordings.
SHORT, LONG = 2, 5
#: A span counts where so many hundredths of the template's words, and of its own, have matched.
LEAST_PERCENT = 80
#: Wordings of fewer words have to be whole, as a version's number is one word of them.
LOOSE_WORDS = 20
#: Everything in ASCII that is no letter or digit, once letters are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is an ASCII letter alone; it stays apart from k.
KELVIN, NO_K = "K", "ĸ"


def templates(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, wordings: list[tuple[str, str]] = WORDINGS) -> DataFrame:
    """(template, label, base, size, k): a template's words number size; its grams have k words."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in wordings]
    if any(len(text.split()) < (SHORT if base else LONG) for _, text, base in rows):
        raise ValueError(f"a phrase needs {SHORT} words and a wording {LONG}")
    named = F.inline(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for i, (label, text, base) in enumerate(rows)]))
    known = spark.range(1).select(named).select("template", "label", "base", F.split("text", "\\s+").alias("words"))
    return known.withColumns({"size": F.size("words"), "k": F.when(F.col("base"), SHORT).otherwise(LONG)})


def _gram(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def template_grams(known: DataFrame) -> DataFrame:
    """A row for every place of every template: its gram's hash and words. As many rows as the templates have words."""
    each = known.select("template", "label", "base", "size", F.col("k").alias("gram_k"), "words", F.posexplode("words").alias("tpos", "_w")).where("tpos <= size - gram_k")
    hashed = F.when(F.col("gram_k") == SHORT, _gram("words", F.col("tpos"), SHORT)).otherwise(_gram("words", F.col("tpos"), LONG))
    return each.select("template", "label", "base", "size", "gram_k", "tpos", hashed.alias("gram_h"), F.expr("slice(words, tpos + 1, gram_k)").alias("gram"))


def votes(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place of a text whose gram stands in a template, and one without a template for each text.

    Hashes meet by join, and words decide. Texts go no further than this: a row has the text's number of words and the places.
    """
    folded = F.lower(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(KELVIN), F.lit(NO_K)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(folded, BETWEEN, -1), "").alias("words"))
    rows = rows.select("doc_id", "row", "words", F.size("words").alias("n_words"))
    placed = rows.select("*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "_w"))
    at, left = F.col("pos"), F.col("n_words") - F.col("pos")
    one = lambda k: F.when(left >= k, _gram("words", at, k))
    # The place after the last word stands for the text itself.
    grams = placed.withColumn("h", F.explode(F.when(left > 0, F.array(one(SHORT), one(LONG))).otherwise(F.array(F.lit(None).cast("long")))))
    # The words are compared where hashes are equal, and are no key of the join.
    words = F.coalesce(F.slice("words", F.col("pos") + 1, F.col("gram_k")) == F.col("gram"), F.lit(False))
    met = grams.join(F.broadcast(template_grams(known)), (F.col("h") == F.col("gram_h")) & words, "left")
    return met.where("template is not null or pos = n_words").select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), "pos", "template", "label", "base", "size", "gram_k", "tpos")


def _covered(places: str, k: str) -> Column:
    """How many words grams of k words at distinct sorted places cover."""
    return F.expr(f"aggregate({places}, named_struct('n', 0, 'to', 0), (a, p) -> named_struct('n', a.n + p + {k} - greatest(p, a.to), 'to', p + {k}), a -> a.n)")


def spans_of(found: DataFrame) -> DataFrame:
    """Votes as spans: (doc_id, row, n_words, template, label, base, start, stop, share), share null where it doesn't hold; texts keep their row without a template.

    Votes are summed by offset (place in the text less place in the template). Offsets of a wording that differ by no more than a tenth of its
    words, as words put in or left out shift them, are one span; those of one that has to be whole stand alone. A span holds where the template's
    words that its grams cover, each once, are LEAST_PERCENT of the template's and of its own; a phrase, and a wording of fewer than LOOSE_WORDS, has to be whole.
    """
    dealt = found.repartition("row")
    key = ["doc_id", "row", "n_words", "template", "label", "base", "size", "gram_k"]
    diagonals = dealt.withColumn("offset", F.col("pos") - F.col("tpos")).groupBy(*key, "offset").agg(F.collect_set("tpos").alias("_t"), F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    by = Window.partitionBy("row", "template").orderBy("offset")
    whole = F.col("base") | (F.col("size") < LOOSE_WORDS)
    drift = F.when(whole, 0).otherwise(F.floor(F.col("size") / 10))
    new = F.coalesce(F.col("offset") - F.lag("offset").over(by) > drift, F.lit(True))
    bands = diagonals.withColumn("_new", new.cast("int")).withColumn("band", F.sum("_new").over(by))
    merged = bands.groupBy(*key, "band").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("_t"), F.min("_low").alias("start"), (F.max("_high") + F.first("gram_k")).alias("stop"))
    judged = merged.withColumn("_n", _covered("_t", "gram_k"))
    least = F.when(whole, 100).otherwise(LEAST_PERCENT)
    holds = (100 * F.col("_n") >= least * F.col("size")) & (100 * F.col("_n") >= least * (F.col("stop") - F.col("start")))
    return judged.select("doc_id", "row", "n_words", "template", "label", "base", "start", "stop", F.when(holds, F.col("_n") / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (start, stop, label, base, share; by start), in words from 0, ends exclusive.

    Every word gram of every whole text is joined with the templates' places, which are as many as the templates have words and are
    broadcast; no gram is left out. What matches is shuffled once, by text, so that no copy or wording that many texts share is a group.
    A null text is empty and has no words; a text shorter than a gram has no spans; places that overlap or repeat all count. Rows that share a doc_id,
    or repeat one, are apart, and a null doc_id is kept; an empty table gives no rows. Other columns aren't read.
    """
    known = templates(docs.sparkSession) if known is None else known
    span = F.when(F.col("share").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label", "base", "share"))
    each = spans_of(votes(docs, known, id_col, text_col)).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"))
    return each.drop("row")
