"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before kept, whole, and returns the columns of ``documents`` (the last one returns
packed pieces). Stages that change a text change ``n_chars`` with it.

1. ``language_id`` rejects documents whose language can't be told: without text or letters.
2. ``ngram_join`` keeps the smallest id of every group of near copies.
3. ``suffix_dedup`` cuts byte strings that a smaller id holds too; a character that is cut in two goes whole, and a
   document of which nothing is left goes.
4. ``pii`` replaces personal data by the name of its kind.
5. ``packing`` fills windows of 2048 tokens.

Rows with a null id can't be compared by id: near copies among them stay, and nothing is cut from them. Rows that
repeat an id live and go together in stage 2, and are cut each for itself in stage 3.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import language_id, ngram_join, packing, pii, suffix_dedup
from faultline.llm.frames import short_batches
from faultline.llm.queries import tokenizer_file
from faultline.session import new_stage, ship_package, stage_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the mixture is learnt from the labelled part of the given documents."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.train(docs))
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    gone = ngram_join.join(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a smaller id holds too; documents that lost nothing stay, null as empty."""
    cut = suffix_dedup.cut(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), with_text=True)
    changed = F.size("removed") > 0
    left = cut.where(~changed | (F.length("kept_text") > 0))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    found = pii.find(docs.select(*COLUMNS), pii.train(docs))
    hidden = pii.redact(found)
    touched = F.size("spans") > 0
    return hidden.select("doc_id", "text", "lang", "source", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    packed = packing.pack(docs, tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _shipped(step):
    """A stage that first lets the workers import this package, as the queries do."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        short_batches(spark)
        return step(spark, docs, sf_dir)

    return run_step


STAGES = [
    ("language_id", _shipped(identify_language)),
    ("ngram_join", _shipped(drop_near_copies)),
    ("suffix_dedup", _shipped(cut_repeats)),
    ("pii", _shipped(hide_personal_data)),
    ("packing", _shipped(pack_sequences)),
]

#: Learning, message passing and tokenizing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, step in STAGES[:-1]:
        path = new_stage(spark)
        with stage_scope(spark):  # what a step stored for itself goes when its result is written
            kept = step(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
