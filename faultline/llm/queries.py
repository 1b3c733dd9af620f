"""One query for each operator, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import ann_forest, bpe, fill_middle, gnat_negatives, language_id, license_scan, ngram_join, packing, pii, quality_rules, stable_dups, suffix_dedup, weak_quality
from faultline.llm.frames import short_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file() -> str:
    """The vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = bpe.compile_lexicon(bpe.frequent_words(docs, path), path)
    decoded = bpe.encode_and_decode(docs, path, lexicon)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.sha256_of_ids("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_ngram_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("found")


@query
def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_forest.usable(table(spark, sf_dir, "embeddings"))
    return ann_forest.search(vectors.where("vec_id % 100 = 0"), vectors)


@query
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query
def op5_rare_first_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return cut.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_quality.judge(docs, weak_quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op11_wavelet_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents"), unit="line", rate=100, spm=50, seed=7)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restore(), 256).alias("restored_sha256")
    )


ORACLES["op11_wavelet_fill_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || doc_id) AS h
  FROM documents
), placed AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || substr(h, 25, 8))::BIGINT AS h4,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b
  FROM drawn
), parted AS (
  SELECT doc_id, t, n, h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain,
         coalesce(array_to_string(units[1:least(a, b)], ''), '') AS p,
         coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS s
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parted
"""


@query
def op12_stable_hash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_dups.link(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op12_stable_hash_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), smallest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT e.vec_id, coalesce(counted.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(smallest.b, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(smallest.b, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted ON counted.a = e.vec_id LEFT JOIN smallest ON smallest.a = e.vec_id
"""


@query
def op13_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gnat_negatives.quantised(table(spark, sf_dir, "embeddings"), steps=256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


ORACLES["op13_gnat_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
