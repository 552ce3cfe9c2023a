"""License scan by diagonal voting, in DataFrame functions only.

Template texts are cut into rolling word k-grams with their positions. Every k-gram of every document is joined by
its hash (and its words, so a hash never decides) to template positions; a match votes for the diagonal, the
difference of the two positions. A full diagonal is a place where a template stands word for word. Neighbouring
diagonals are merged, which lets words be dropped or put in, and a merged span counts if it covers enough of the
template and is not much longer than it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Phrases that must stand word for word. Label, phrase.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Passages of public license notices that may stand with small changes. Label, passage.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most so far apart are neighbours; least share of a template's k-grams; most words beyond its length.
NEAR, COVER, SLACK = 4, 0.8, 8


def template_rows(k: int = K, phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, exact, n_words, n_grams, at, words...) for each k-gram of each template."""
    out = []
    every = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in notices]
    for t, (label, text, exact) in enumerate(every):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        out += [(t, label, exact, len(words), len(words) - k + 1, i, *words[i:i + k]) for i in range(len(words) - k + 1)]
    return out


def templates(spark: SparkSession, k: int = K, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    schema = "template int, label string, exact boolean, t_words int, t_grams int, at int"
    schema += "".join(f", t{i} string" for i in range(k))
    return spark.createDataFrame(template_rows(k, phrases, notices), schema)


def words(text):
    """Column: words of a text column with A-Z lower-cased; none for null."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, NOT_WORD), "")


def scan(docs: DataFrame, k: int = K, phrases=PHRASES, notices=NOTICES, near: int = NEAR, cover: float = COVER,
         slack: int = SLACK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base (places of phrases), first_word and last_word (their
    smallest and largest start, from 0, else null), base_labels and labels (of phrases; of all findings; distinct,
    sorted, comma-joined, empty if none), score (largest share of a template's k-grams among the findings, else of
    the merged spans that were too weak; 0 without a match), spans (label, first, last word, share; by place).

    A null text counts as empty. Repeated rows get equal rows; the ids may be null; extra columns are ignored. Only
    matched k-grams (and one row for each document) are shuffled, by document, so a line that stands in every
    document is spread as the documents are."""
    t = templates(docs.sparkSession, k, phrases, notices)  # as large as the templates, whatever the corpus
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    # row 0 has a null word and no match: it stands for the document; row i has the k-gram from word i - 1
    lead = F.concat(F.array(F.lit(None).cast("string")), "w")
    cols = [lead, *(F.slice("w", i, F.greatest(F.size("w"), F.lit(1))) if i > 1 else F.col("w") for i in range(1, k))]
    zipped = F.arrays_zip(*(c.alias(f"g{i}") for i, c in enumerate(cols)))
    grams = w.select("doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"), F.posexplode(zipped)).select(
        "doc_id", "text_hash", "n_words", "pos", "col.*")
    t = t.withColumn("t_hash", F.xxhash64(*(f"t{i}" for i in range(k))))
    same = F.xxhash64(*(f"g{i}" for i in range(k))) == F.col("t_hash")
    for i in range(k):
        same &= F.col(f"g{i}") == F.col(f"t{i}")
    votes = (grams.join(F.broadcast(t), same, "left").where("template is not null or pos = 0")
             .select("doc_id", "text_hash", "n_words", "template", "label", "exact", "t_words", "t_grams", "at",
                     (F.col("pos") - 1 - F.col("at")).alias("diagonal")))
    doc = ["doc_id", "text_hash", "n_words"]
    template = ["template", "label", "exact", "t_words", "t_grams"]
    # everything below is grouped inside a document: one shuffle
    per = (votes.repartition(*doc).groupBy(*doc, *template, "diagonal")
           .agg(F.collect_set("at").alias("at"), F.count("*").alias("n")))
    order = Window.partitionBy(*doc, *template).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = per.withColumn("cut", F.coalesce(F.when(gap <= F.when(F.col("exact"), 0).otherwise(near), 0), F.lit(1)))
    merged = merged.withColumn("cluster", F.sum("cut").over(order)).groupBy(*doc, *template, "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("at") + (k - 1)).alias("last"), F.sum("n").alias("n"))
    share = F.col("votes") / F.col("t_grams")
    long = F.col("last") - F.col("first") + 1
    found = merged.withColumn("share", share).withColumn("ok", F.when(
        F.col("exact"), F.col("votes") == F.col("t_grams")).otherwise(
        (F.col("share") >= cover) & (long <= F.col("t_words") + slack)))
    base = F.col("ok") & F.col("exact")
    each = found.groupBy(*doc).agg(
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"), F.collect_set(F.when(F.col("ok"), F.col("label"))).alias("all"),
        F.max(F.when(F.col("ok"), F.col("share"))).alias("sure"),
        F.max(F.when(~F.col("ok"), F.col("share"))).alias("weak"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct(
            "first", "last", "label", "share")))).alias("spans"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return each.select(
        "doc_id", "n_words", "n_base", F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"), joined("base").alias("base_labels"),
        joined("all").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("sure", F.col("weak") * 0.5, F.lit(0.0))).alias("score"), "spans",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")).drop("_copy")
