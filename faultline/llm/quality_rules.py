"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed word unigrams and bigrams are counted: one over all documents, one over trusted
documents. A document's score is the mean over its n-grams of log(trusted / corpus); it passes if the score
reaches a threshold that is fixed beforehand from the scores of the trusted documents (mean less ``SPREAD``
standard deviations, rounded). The trusted documents are all that a label calls good and not toxic; the corpus
counts cover every document. Both models are ``BUCKETS`` numbers, whatever the size of the corpus.

Defined results: a null or empty text has no words, counts 0, fails the base rules and scores 0; rows with the
same or a null id are judged each for itself; an empty table gives no rows; without trusted documents nothing
is dropped beyond the base rules; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import stage, whole_text

BUCKETS = 1 << 14
SPREAD = 6.0
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Added to every bucket's count in both models.
SMOOTHING = 1.0

SPACE = r"[ \x09-\x0D]+"


def rule_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _following(words: Column, n: int) -> Column:
    """Hash of the n words from each place on, from the words' hashes."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda word, at: F.xxhash64(word, *(F.get(words, at + k) for k in range(1, n))))


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``word_hashes``: one 64-bit hash for each word."""
    split = docs.withColumn("word_list", rule_words(F.col(text)))
    return split.withColumn("word_hashes", F.transform("word_list", lambda w: F.xxhash64(w)))


def buckets(words: str = "word_hashes") -> Column:
    """The buckets of all unigrams and bigrams."""
    both = F.concat(F.col(words), _following(F.col(words), 2))
    return F.transform(both, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The ids of all documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(doc_id).alias("trusted_id")).where("trusted_id is not null").distinct()


def trusted_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are trusted, stored: texts move to their labels once, and ids, which grow with the labels, are not broadcast."""
    return stage(docs.join(trusted_ids(labels).hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi"))


def bucket_counts(docs: DataFrame) -> list[int]:
    counts = [0] * BUCKETS
    for row in hashed(docs).select(F.explode(buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted / corpus) of each bucket, rounded; ``trusted`` holds the rows of ``docs`` that are trusted."""
    raw, good = bucket_counts(docs), bucket_counts(trusted)
    all_raw, all_good = sum(raw) + SMOOTHING * BUCKETS, sum(good) + SMOOTHING * BUCKETS
    if not sum(good):
        return [0.0] * BUCKETS
    return [round(math.log((g + SMOOTHING) / all_good) - math.log((r + SMOOTHING) / all_raw), 4) for g, r in zip(good, raw, strict=True)]


def ratio(table: list[float], words: str = "word_hashes") -> Column:
    """Mean weight of a document's n-grams; 0 without any."""
    held = F.lit(np.array(table))
    grams = buckets(words)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, bucket: acc + F.get(held, bucket))
    return F.round(F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(0.0), 6)


def threshold(trusted: DataFrame, table: list[float]) -> float:
    """The score that a document must reach, from the trusted documents alone."""
    scored = hashed(trusted).where(F.size("word_hashes") >= LEAST_WORDS).select(ratio(table).alias("ratio"))
    row = scored.agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd")).first()
    return round(row.mean - SPREAD * row.sd, 3) if row.mean is not None else -math.inf


def repeat_pairs(windows: Column) -> Column:
    """(h, at) of all windows in order of their hashes; empty if no window repeats."""
    pairs = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def repeated_words(pairs: Column) -> Column:
    """Words covered by the windows that stand twice or more, from a column of ``repeat_pairs``."""

    def twice(pair: Column, n: Column) -> Column:
        last = F.when(n > 0, F.get(pairs, n - 1)["h"])
        return F.coalesce(pair["h"] == F.get(pairs, n + 1)["h"], F.lit(False)) | F.coalesce(pair["h"] == last, F.lit(False))

    places = F.sort_array(F.transform(F.filter(pairs, twice), lambda pair: pair["at"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(at - acc["last"], F.lit(WINDOW))).alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, counts, ratio, base_failed and kept."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    trusted = trusted_docs(chosen, labels)
    table = weights(chosen, trusted)
    least = threshold(trusted, table)
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0)
    counted = hashed(chosen).select(
        "doc_id",
        "word_hashes",
        F.size("word_list").cast("long").alias("n_words"),
        F.length(F.array_join("word_list", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("held_lines"),
    )
    windowed = counted.withColumn("windows", _following(F.col("word_hashes"), WINDOW))
    # A column of its own, so that the functions below don't sort it anew for every element.
    paired = windowed.withColumn("pairs", repeat_pairs(F.col("windows")))
    measured = paired.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("held_lines") - F.size(F.array_distinct("held_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("pairs")).cast("long").alias("n_repeat_words"),
        ratio(table).alias("ratio"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(least)))
