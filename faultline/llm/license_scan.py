"""License scan by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a document's words is hashed and joined to the positions of the same k-gram in the
templates; a hit votes for the diagonal ``document position - template position``. Votes are counted per
document, template and diagonal; diagonals at most ``NEIGHBOUR`` apart, which inserted or missing words part,
are merged; a merged span is verified by the share of the template's k-grams that it holds. The template side
is the constant list below, so its broadcast has a fixed size; nothing of a document is shuffled but its hits.

Phrases count where all their k-grams fall on one diagonal, which is where their words stand consecutively.

Defined results: a null or empty text has no words and no labels; rows with the same or a null id are scanned
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.llm.frames import whole_text

K = 3
NEIGHBOUR = 2
#: Share of a template's k-grams that a span must hold.
VERIFIED = 0.8

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of common licence notices, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "under the gnu general public license": "gpl",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "under the cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "all rights reserved": "all-rights-reserved",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_words(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII; only A to Z are lower-cased."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: str, k: int = K) -> Column:
    """Hash of the k words that begin at each place."""
    column = F.col(words)
    starts = F.slice(column, F.lit(1), F.greatest(F.size(column) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda word, at: F.xxhash64(word, *(F.get(column, at + n) for n in range(1, k))))


def templates(spark) -> DataFrame:
    """(template, label, phrase, grams, place, gram): one row for each k-gram of each template."""
    rows = [(n, label, text in PHRASES, text.split()) for n, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()])]
    kind = T.StructType.fromDDL("template int, label string, phrase boolean, template_words array<string>")
    listed = spark.createDataFrame(rows, kind).withColumn("hashes", gram_hashes("template_words"))
    return listed.select("template", "label", "phrase", F.size("hashes").alias("grams"), F.posexplode("hashes").alias("place", "gram"))


def votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, template, label, phrase, grams, diagonal, places): hits by diagonal, and one row
    with a null template for every document, so that documents without hits stay."""
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), scan_words(whole_text(text)).alias("scanned")
    )
    # Hashed below the explode, so that a row for a place carries ids and a count, never the text's words.
    hashed = words.select("row", "doc_id", F.size("scanned").alias("n_words"), gram_hashes("scanned").alias("hashes"))
    grams = hashed.select("row", "doc_id", "n_words", F.posexplode_outer("hashes").alias("at", "gram"))
    known = F.broadcast(templates(docs.sparkSession))
    hits = grams.join(known, "gram", "left").where(F.col("template").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
    diagonal = F.col("at") - F.col("place")
    keys = ["row", "doc_id", "n_words", "template", "label", "phrase", "grams"]
    return hits.groupBy(*keys, diagonal.alias("diagonal")).agg(F.collect_set("place").alias("places"))


def spans(voted: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals: (row, template, label, phrase, start, coverage, whole) beside the document's columns."""
    keys = ["row", "doc_id", "n_words", "template", "label", "phrase", "grams"]
    ordered = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(ordered) > NEIGHBOUR, F.lit(True))
    # A phrase stands on one diagonal; its neighbours are other places.
    parted = voted.withColumn("new", (F.col("phrase") | new).cast("int")).withColumn("span", F.sum("new").over(ordered))
    merged = parted.groupBy(*keys, "span").agg(
        F.min("diagonal").cast("long").alias("start"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
    )
    return merged.withColumn("coverage", F.least(F.col("held") / F.col("grams"), F.lit(1.0)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` lists the verified spans as (label, start, coverage); ``score`` is the best coverage.
    """
    found = spans(votes(docs, doc_id, text))
    base = F.col("phrase") & (F.col("held") == F.col("grams"))
    verified = base | ~F.col("phrase") & (F.col("coverage") >= VERIFIED)

    def listed(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    one = F.struct("label", "start", "coverage")
    by_row = found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(verified).alias("labels"),
        F.round(F.coalesce(F.max(F.when(verified, F.col("coverage"))), F.lit(0.0)), 6).alias("score"),
        F.sort_array(F.collect_list(F.when(verified, one))).alias("found"),
    )
    return by_row.withColumn("n_words", F.col("n_words").cast("long")).drop("row")
