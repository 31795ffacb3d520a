"""License scans by diagonal voting, with DataFrame functions only.

All rolling 2-word grams of a document are joined by hash to the places they have in license templates; a template
set is a constant of this module or a list given by the caller, so that it is broadcast whatever the corpus. Grams that no
template has are passed over where they are made, so that a document is read once and only hits go on. Hits are
gathered by template and diagonal, which is the document's place less the template's. A base phrase stands wherever
one diagonal holds every gram of it. For the longer texts each diagonal is merged with those up to ``DRIFT`` words behind
it, so that an inserted or a lost word doesn't break a span. A span is verified on its words: the join compares the
grams themselves besides their hashes, each place of the template counts once however often it is met, and enough of
them must be there; a diagonal's words lie within the template's length, so that they stand together and in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage

GRAM = 2
#: Words by which neighbouring diagonals may differ.
DRIFT = 3
#: Least share of a template's grams in a span; one of fewer words than SHORT needs all of them.
COVERED = 0.6
SHORT = 10

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Well-known wordings of licenses and of the lines that name them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _templates(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, base, size, place, gram) of all grams."""
    rows = []
    for number, (label, text, base) in enumerate([(label, t, True) for t, label in phrases.items()] + [(label, t, False) for label, t in templates]):
        own = text.split()
        rows += [(number, label, base, len(own), place, " ".join(own[place : place + GRAM])) for place in range(len(own) - GRAM + 1)]
    return rows


def _values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    def told(x: object) -> str:
        return str(x).lower() if isinstance(x, bool | int) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"

    listed = ", ".join(f"({', '.join(map(told, r))})" for r in rows)
    return spark.sql(f"SELECT *, xxhash64(gram) AS h FROM VALUES {listed} AS t(template, label, base, size, place, gram)")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words, no labels (empty strings) and score 0; without a base phrase first_word and
    last_word are null. A repeated row is a row of its own. Score is the best span's share of a template's grams.
    """
    rows = _templates(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    grams = sorted({r[-1] for r in rows})
    begins = sorted({g.split()[0] for g in grams})
    own = df.select(F.col(key), words(F.col(text)).alias("words"))
    rolling = F.transform("words", lambda w, i: F.when(w.isin(begins), F.struct(i.alias("at"), F.concat_ws(" ", w, F.get(F.col("words"), i + 1)).alias("gram"))))
    read = own.select(key, F.size("words").cast("long").alias("n_words"), F.filter(rolling, lambda g: g["gram"].isin(grams)).alias("held"), F.monotonically_increasing_id().alias("row"))
    read = cut_lineage(read)
    hits = read.select("row", F.inline("held")).withColumn("h", F.xxhash64("gram")).join(F.broadcast(_values(df.sparkSession, rows)), ["h", "gram"])
    votes = hits.groupBy("row", "template", "label", "base", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    merged = F.when(F.col("base"), F.col("places")).otherwise(F.array_distinct(F.flatten(F.collect_list("places").over(near))))
    spans = votes.select("row", "label", "base", "size", "diagonal", (F.size(merged) / (F.col("size") - (GRAM - 1))).alias("share"))
    sound = F.col("share") >= F.when(F.col("base") | (F.col("size") < SHORT), 1.0).otherwise(COVERED)
    start = F.when(F.col("base"), F.col("diagonal").cast("long"))
    found = spans.where(sound).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return read.drop("held").join(found, "row", "left").select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
