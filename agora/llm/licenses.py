"""License scans by diagonal voting.

Texts are lower-cased in A-Z and cut into words of ASCII letters, digits and anything beyond ASCII.  Every template, a phrase or
the text of a notice, is cut alike.  All rolling k-word windows of the documents meet the windows of the templates in a join on
their hash, which is then checked word by word.  A match of document place p and template place q votes for the diagonal p - q,
where that template would begin; votes are aggregated by diagonal, diagonals at most ``band`` apart (words put in or left out)
are merged to one place, and a place is kept if the template's words that its matches cover are at least ``least`` of them.

Windows have LONG words for templates of at least that many, else SHORT.  Templates under WHOLE words must match whole:
no band, every word.  Windows that no template has are told by a set in the same projection, so that only those that can
meet a template are stored and joined.  Only DataFrame functions are used.

Defined results: a null or empty text has no word and no place.  Labels are distinct, sorted, joined by commas, and empty
without any.  A template of one word, or of none, matches nothing.  Repeated rows and null ids are documents of their own.  Other
columns of the input are kept; an added column replaces one of its name.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT, LONG, WHOLE = 2, 5, 8


@dataclass(frozen=True)
class Template:
    """A text that stands for a license; a ``base`` one is also counted and located."""

    label: str
    text: str
    base: bool = False


BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

# What the licenses themselves ask to be put into files.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def word_list(text: Column) -> Column:
    """The words of a text, lower-cased; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), lambda w: w != "")


def _once(value: Column) -> Column:
    """``value`` computed where it stands; expressions that name the task's partition are never inlined."""
    return F.when(F.spark_partition_id() >= 0, value)


def _hash(words: Column | str, at: Column, k: int) -> Column:
    """The hash of the k words from place ``at``."""
    words = F.col(words) if isinstance(words, str) else words
    return F.xxhash64(*[words[at + i] for i in range(k)])


def template_windows(spark: SparkSession, templates: tuple[Template, ...], band_share: float = 0.1, least: float = 0.8) -> DataFrame:
    """A row per window: template, label, base, k, place, hash, gram, words, band, least."""
    literals = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.text).alias("text")) for i, t in enumerate(templates)])
    literals = literals.cast("array<struct<template:int,label:string,base:boolean,text:string>>")
    df = spark.range(1).select(F.explode(literals).alias("t")).select("t.template", "t.label", "t.base", word_list(F.col("t.text")).alias("__words"))
    n = F.size("__words")
    long = n >= LONG
    df = df.withColumns({"words": n, "k": F.when(long, LONG).otherwise(SHORT)})
    df = df.withColumns({"band": F.when(n < WHOLE, 0).otherwise(F.floor(n * band_share)).cast("int"), "least": F.when(n < WHOLE, 1.0).otherwise(float(least))})
    df = df.where(n >= SHORT).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("k"))))
    gram = F.array_join(F.slice("__words", F.col("place") + 1, F.col("k")), " ")
    hashed = F.when(F.col("k") == LONG, _hash("__words", F.col("place"), LONG)).otherwise(_hash("__words", F.col("place"), SHORT))
    return df.select("template", "label", "base", "k", "place", hashed.alias("hash"), gram.alias("gram"), "words", "band", "least")


def _known_windows(k: int, hashes: list[int]) -> Column:
    """(at, k, hash, gram) of the k-word windows of ``__words`` with one of these hashes."""
    starts = F.when(F.size("__words") >= k, F.sequence(F.lit(0), F.size("__words") - k)).otherwise(F.array().cast("array<int>"))
    some = F.filter(starts, lambda i: _hash("__words", i, k).isin(hashes))
    gram = lambda i: F.array_join(F.slice("__words", i + 1, F.lit(k)), " ")
    return F.transform(some, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), _hash("__words", i, k).alias("hash"), gram(i).alias("gram")))


def windows(docs: DataFrame, text: str, known: dict[int, list[int]]) -> DataFrame:
    """``docs`` without the text, with n_words and __hits: (place, k, hash, gram) of the windows whose hash is ``known``."""
    df = docs.withColumn("__words", _once(word_list(F.col(text)))).drop(text)
    hits = [_known_windows(k, hashes) for k, hashes in known.items() if hashes]
    empty = F.array().cast("array<struct<at:int,k:int,hash:bigint,gram:string>>")
    df = df.withColumn("__hits", _once(F.concat(*hits) if hits else empty)).withColumn("n_words", _once(F.size("__words").cast("long")))
    return df.drop("__words")


def places(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """Kept places (row, template, label, base, first, last, similarity) from ``hits`` (row, at, k, hash, gram).

    ``first`` and ``last`` are the first and the last word that a match covers.  A template's windows in a place are at
    most its own, so no group grows with the text; the merge of diagonals orders those of one document and template.
    """
    t = templates.withColumnsRenamed({"hash": "__hash", "k": "__k", "gram": "__gram"})
    met = hits.join(F.broadcast(t), (F.col("hash") == F.col("__hash")) & (F.col("k") == F.col("__k")) & (F.col("gram") == F.col("__gram")))
    of = ["row", "template", "label", "base", "k", "words", "band", "least"]
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    voted = met.groupBy(*of, diagonal).agg(F.collect_set("place").alias("votes"), F.min("at").alias("first"), (F.max("at") + F.col("k") - 1).alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    begins = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.col("band"), 0).otherwise(1)
    merged = voted.withColumn("__begins", begins).withColumn("island", F.sum("__begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*of, "island").agg(F.array_distinct(F.flatten(F.collect_set("votes"))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    return merged.withColumn("similarity", covered / F.col("words")).where("similarity >= least").select("row", "template", "label", "base", "first", "last", "similarity")


ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, band_share: float = 0.1, least: float = 0.8) -> DataFrame:
    """``docs`` without the text, with n_words, n_base, first_word and last_word (starts of base places), base_labels, labels, score.

    ``score`` is the largest share of a template's words that a kept place has, 0 without any.  ``templates`` is a parameter
    of the caller's, so its windows, some tens of bytes each, go to all tasks.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "licenses")
    table = written(template_windows(spark, templates, band_share, least), f"{folder}/templates")
    known = {k: [] for k in (SHORT, LONG)}
    for r in table.select("k", "hash").distinct().orderBy("k", "hash").collect():
        known[r.k].append(r.hash)
    own = docs.select(*[c for c in docs.columns if c == text or c not in ADDED]).withColumn("__row", F.monotonically_increasing_id())
    rows = written(windows(own, text, known), f"{folder}/rows")
    hits = rows.where(F.size("__hits") > 0).select(F.col("__row").alias("row"), F.explode("__hits").alias("h")).select("row", "h.*")
    base = F.col("base")
    found = places(hits, table).groupBy(F.col("row").alias("__of")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("similarity").alias("score"),
    )
    nothing = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    joined = rows.join(found, F.col("__row") == F.col("__of"), "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in nothing.items()})
    return joined.select(*[c for c in own.columns if c not in (text, "__row")], *ADDED)
