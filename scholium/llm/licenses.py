"""Licence scans by a positional rare-token index, in DataFrame functions only.

Templates, whole notices and the short sentences that stand for them, are indexed by word and position. A document is looked up,
for each template whose mandatory key phrase it has, by its words of highest IDF among those of the template outside the key phrase
(document frequencies are counted over the whole corpus); postings are intersected by relative position, that is, a word agrees with
an alignment if its offset between document and template is that of the key phrase, give or take ``SLACK`` words that an edit put in or
took out. A template is found where at least ``SHARE`` of its rarest words agree around its key phrase, which is thereby verified; the phrase
alone, in a sentence of another kind, is no notice. Base phrases are found wherever their words stand consecutively.

Null and empty texts: no word, no label, score 0. Ties in IDF go to the alphabetically first word. Repeated rows and rows
without an id get a row each. A very long text is one row of its words, of which only licence words go further. Empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import written
from .common import LOWER, UPPER

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases and labels, as the contract fixes them; the word that stands for each phrase and its place in it.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
ANCHORS = (("mit", 2), ("apache", 0), ("nc", 2))
#: Notices by label, in the words of their public texts (lower case, without punctuation), with the key phrase that must
#: stand in the document: the first place of it in the notice counts.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
     software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
     sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
     conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the
     software""", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
     a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
     distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
     the license for the specific language governing permissions and limitations under the license""", "apache license"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
     redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
     documentation and or other materials provided with the distribution""", "redistribution and use in source and binary forms"),
    ("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
     the free software foundation either version 2 of the license or at your option any later version""", "general public license as published by the free software foundation either version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
     the free software foundation either version 3 of the license or at your option any later version""", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
     published by the free software foundation""", "gnu lesser general public license"),
    ("agpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as
     published by the free software foundation either version 3 of the license""", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
     file you can obtain one at http mozilla org mpl 2 0""", "mozilla public license v 2"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
     distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
     means""", "free and unencumbered software released into the public domain"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
     above copyright notice and this permission notice appear in all copies""", "permission to use copy modify and or distribute this software for any purpose"),
)
#: Function words are no licence words: they tell nothing and occur everywhere.
COMMON = frozenset("a an and any are as be by for from in is it may of on or that the this to with you not no 0 1 2 3 4 v".split())
#: Words looked up in a document for each template, what share of so many must agree, and words by which an edit may move them.
TOP, SHARE, SLACK = 8, 0.5, 3


def licence_words() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD.replace("\\\\", "\\")), F.lit(0))


def _places(w: str, phrase: str, anchor: str, at: int) -> str:
    """SQL for the starts of ``phrase`` in the word array ``w``, searched by its rarest word."""
    parts = phrase.split()
    test = " and ".join(f"{w}[i + {k}] = '{p}'" for k, p in sorted(enumerate(parts), key=lambda x: x[0] != at))
    return f"filter(sequence(0, size({w}) - {len(parts)}), i -> {test})"


def key_starts() -> list[int]:
    """Where each template's key phrase stands in it, in words."""
    return [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for _, text, key in TEMPLATES for w, k in [(text.split(), key.split())]]


def postings() -> list[tuple[str, int, int]]:
    """Words outside the key phrase, with template and place."""
    spans = [range(k, k + len(key.split())) for k, (_, _, key) in zip(key_starts(), TEMPLATES)]
    return [(w, k, p) for k, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split()) if w not in COMMON and p not in spans[k]]


def wanted() -> list[int]:
    """How many rare words each template is looked up by: ``TOP``, or all that it has outside its key phrase."""
    return [min(TOP, len({w for w, t, _ in postings() if t == k})) for k in range(len(TEMPLATES))]


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document: word count, base places, licence words with their positions, and the alignments (template, offset) at
    which a key phrase of its stands."""
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    base = base.withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    out = base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), "w", "joined", F.array_intersect("w", F.array(*map(F.lit, licence_words()))).alias("has"))
    for (phrase, label), (anchor, at) in zip(BASE, ANCHORS):
        # Most documents lack the phrase as a string, and then no position is looked at.
        out = out.withColumn(f"at_{label}", F.when(F.col("joined").contains(f" {phrase} "), F.expr(_places("w", phrase, anchor, at))).otherwise(F.array().cast("array<int>")))
    none = "cast(array() as array<struct<template:int,offset:int>>)"
    keys = ", ".join(
        f"case when contains(joined, ' {key} ') then transform({_places('w', key, key, 0)}, i -> struct({k} as template, i - {start} as offset)) else {none} end"
        for k, ((_, _, key), start) in enumerate(zip(TEMPLATES, key_starts()))
    )
    marked = ", ".join(f"'{w}'" for w in licence_words())
    hits = F.expr(f"filter(transform(w, (x, i) -> struct(i as pos, x as word)), h -> h.word in ({marked}))")
    return (
        out.withColumn("keys", F.when(F.size("has") > 0, F.expr(f"concat({keys})")).otherwise(F.expr(none)))
        .select("doc_id", "row", "n_words", *(f"at_{label}" for _, label in BASE), "has", "keys", F.when(F.size("keys") > 0, hits).alias("hits"))
    )


def method_labels(found: DataFrame) -> DataFrame:
    """Rows ``(row, found, share)`` from ``scanned``: the labels of the verified alignments and the best one's share of agreeing words."""
    spark = found.sparkSession
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1)))
    # One row for each licence word: as many as the templates have, whatever the corpus.
    df = found.select(F.explode("has").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("one", F.lit(1))
    idf = df.join(total, "one").select("word", F.log((F.col("total") + 1) / (F.col("df") + 0.5)).alias("idf"))
    looked = found.where("size(keys) > 0").select("row", "has", "hits", "keys")
    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("tpos", T.IntegerType())])
    places = spark.createDataFrame(postings(), kind)
    # A template's words are ranked among themselves, so that no other notice of the document takes their places.
    chosen = (
        looked.select("row", "keys", F.explode("has").alias("word")).join(F.broadcast(idf), "word").join(F.broadcast(places.select("word", "template").distinct()), "word")
        .where(F.exists("keys", lambda k: k["template"] == F.col("template"))).groupBy("row", "template")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("x"), "word"))), 1, TOP).getField("word").alias("top"))
    )
    at = (
        looked.select("row", "hits").join(chosen, "row")
        .select("row", "template", F.explode(F.filter("hits", lambda h: F.array_contains(F.col("top"), h["word"]))).alias("h"))
        .select("row", "template", "h.*").join(F.broadcast(places), ["word", "template"])
        .select("row", "template", "word", (F.col("pos") - F.col("tpos")).alias("offset"))
    )
    aligned = looked.select("row", F.explode("keys").alias("k")).select("row", "k.template", F.col("k.offset").alias("key")).distinct()
    near = aligned.withColumn("offset", F.explode(F.sequence(F.col("key") - SLACK, F.col("key") + SLACK)))
    agreed = at.join(near, ["row", "template", "offset"]).groupBy("row", "template", "key").agg(F.count_distinct("word").alias("agree"))
    good = agreed.withColumn("share", F.col("agree") / F.array(*map(F.lit, wanted()))[F.col("template")]).where(F.col("share") >= SHARE)
    labels = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    return good.groupBy("row").agg(F.collect_set(labels[F.col("template")]).alias("found"), F.max("share").alias("share"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns. ``score``: 1 with a base phrase, else the share of rare words that agree with the best notice found, 0 without one."""
    found = written(scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "licences")
    extra = method_labels(found)
    out = found.drop("has", "hits", "keys").join(extra, "row", "left")
    places = F.concat(*(F.col(f"at_{label}") for _, label in BASE))
    base = F.filter(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in BASE)), lambda x: x.isNotNull())
    return out.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def places_by_hand(text: str | None) -> tuple[int, list[int], list[str]]:
    """Words, base places and base labels of one text, for tests."""
    low = (text or "").translate(str.maketrans(UPPER, LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(i for i, _ in found), sorted({x for _, x in found})


def labels_by_hand(texts: list[str | None]) -> list[dict[str, float]]:
    """The method's labels of some texts, with their best shares, by its definition, for tests: every template at every place of its key phrase."""
    low = str.maketrans(UPPER, LOWER)
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for t in texts]
    df = {w: sum(w in set(x) for x in split) for w in licence_words()}
    out = []
    for w in split:
        mine: dict[str, float] = {}
        for (label, text, key), start in zip(TEMPLATES, key_starts()):
            t, k = text.split(), key.split()
            outside = [(p, x) for p, x in enumerate(t) if x not in COMMON and not start <= p < start + len(k)]
            rare = {x for _, x in outside}
            top = sorted(rare & set(w), key=lambda x: (-math.log((len(texts) + 1) / (df[x] + 0.5)), x))[:TOP]
            for i in (i for i in range(len(w)) if w[i : i + len(k)] == k):
                agree = {x for p, x in outside if x in top and any(0 <= (at := i - start + p + d) < len(w) and w[at] == x for d in range(-SLACK, SLACK + 1))}
                share = len(agree) / min(TOP, len(rare))
                if share >= SHARE:
                    mine[label] = max(mine.get(label, 0), share)
        out.append(mine)
    return out
