"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document; people's labels, for at most ``ANNOTATED``
documents, are one more labeller. Expectation-maximisation over the counts of all documents' vote patterns, a
table of at most 3 to the number of labellers, estimates how accurate each labeller is, without trusting any.
The posterior labels of ``TRAINED`` documents, one row an id (the smallest text hash), train a linear scorer over hashed words and word shapes, and the
scorer judges every document. A second scorer, trained the same way on votes about insults, marks toxic texts.

Defined results: a null or empty text, or one without words, scores 0 and is not kept; rows are judged each for
itself, whatever their ids; without labels the heuristics alone decide; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import blocks
from faultline.llm.frames import stage, whole_text
from faultline.llm.shingles import word_hashes

ANNOTATED = 20_000
TRAINED = 6_000
BUCKETS = 1 << 16
EPOCHS = 120
DECAY = 1e-4
ROUNDS = 50
NONE, GOOD, BAD = 0, 1, 2

# Common English insults.
INSULTS = frozenset("idiot moron stupid pathetic worthless trash scum loser disgusting dumb imbecile filthy garbage fool vermin".split())

QUALITY_LABELLERS = ("symbols", "variety", "stutter", "capitals", "shouting", "lines", "length", "plain")
_SYMBOLS = frozenset("#*$%&|<>")
_SHAPE = bytes(
    b if b in b" \t\n\v\f\r" else ord("u") if 65 <= b <= 90 else ord("l") if 97 <= b <= 122 or b >= 128 else ord("d") if 48 <= b <= 57 else b
    for b in range(256)
)


def votes(text: str) -> list[int]:
    """One vote for each of ``QUALITY_LABELLERS`` and one about insults.

    A defect votes bad or nothing, since a text without one defect may have another; length and plainness vote good.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [NONE] * (len(QUALITY_LABELLERS) + 1)
    upper, lower = sum(map(str.isupper, words)), sum(map(str.islower, words))
    lines = [line for line in text.split("\n") if line.strip()]
    insulted = sum(w.strip(".,!?").lower() in INSULTS for w in words)
    measured = (
        (sum(text.count(s) for s in _SYMBOLS) / n, 0.02, 0.2),
        (1 - len(set(words)) / n if n >= 30 else 0.0, 0.6, 0.75),
        (sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 0.05, 0.2),
        (upper / max(1, upper + lower), 0.2, 0.5),
        (text.count("!!") / n, 0.0, 0.2),
        (1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0, 0.1, 0.3),
    )
    defects = [BAD if value >= bad else NONE for value, _, bad in measured]
    plain = all(value <= good for value, good, _ in measured)
    return [*defects, GOOD if n >= 40 else NONE, GOOD if plain else NONE, BAD if insulted >= 2 else GOOD if not insulted else NONE]


def shaped(text: str) -> str:
    """A text with every run of characters of one class inside a word cut to one."""
    data = np.frombuffer(text.encode().translate(_SHAPE), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | (data[1:] <= 32)
    return data[keep].tobytes().decode("latin-1")


def features(texts: list[str]) -> list[np.ndarray]:
    """Distinct buckets of each text's words and of their shapes, and one for the tenth of its words that are new,
    and one if it stutters."""
    words, sizes = word_hashes(texts)
    shapes, _ = word_hashes([shaped(t) for t in texts])
    half = np.uint64(BUCKETS // 2 - 1)
    word, shape = (words & half).astype(np.int64), (shapes & half).astype(np.int64) + BUCKETS // 2
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    out, at = [], 0
    for n in sizes.tolist():
        new = np.unique(word[at : at + n])
        extra = [1 + 10 * len(new) // n] if n >= 30 else []
        extra += [0] if n > 1 and again[at + 1 : at + n].mean() > 0.1 else []
        out.append(np.unique(np.concatenate([new, shape[at : at + n], np.array(extra, np.int64)])))
        at += n
    return out


class LabelModel:
    """Votes of labellers on two classes; the accuracies and the posterior of class good."""

    def __init__(self, labellers: int) -> None:
        self.prior = 0.5
        self.table = np.full((labellers, 2, 3), 1 / 3)

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Expectation-maximisation over distinct vote patterns (rows) and how many documents have them."""
        # A bad vote weighs double at the start, as defects are voted on one by one.
        good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
        share = (good + 0.5) / (good + 2 * bad + 1.0)
        for _ in range(ROUNDS):
            weight = np.stack([counts * share, counts * (1 - share)])
            self.prior = float((weight[0].sum() + 1) / (counts.sum() + 2))
            for k in range(patterns.shape[1]):
                for vote in range(3):
                    self.table[k, :, vote] = weight[:, patterns[:, k] == vote].sum(axis=1) + 0.5
            self.table /= self.table.sum(axis=2, keepdims=True)
            share = self.posterior(patterns)
        return self

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(np.array([self.prior, 1 - self.prior]))[:, None] + sum(np.log(self.table[k][:, patterns[:, k]]) for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))


def fit_linear(rows: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """Weights of logistic regression on soft targets; the last one is the bias."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat, owner = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    weights, gathered = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    # Both classes weigh the same, so that the rarer one is learnt.
    share = np.clip(targets.mean(), 0.02, 0.98) if len(targets) else 0.5
    balance = targets / share + (1 - targets) / (1 - share)
    for _ in range(EPOCHS if len(rows) else 0):
        value = np.bincount(owner, weights[flat], len(rows)) * scale + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(value, -50, 50))) - targets) / len(rows)
        slope = np.append(np.bincount(flat, (error * scale)[owner], BUCKETS), error.sum()) + DECAY * weights
        gathered += slope**2
        weights -= 0.5 * slope / np.sqrt(gathered)
    return weights


def linear_scores(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    value = np.array([weights[r].sum() / np.sqrt(len(r)) if len(r) else -50.0 for r in rows]) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(value, -50, 50)))


def voted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``votes``: the heuristics' votes on each text."""

    @F.arrow_udf("array<int>")
    def cast(texts: pa.Array) -> pa.Array:
        return pa.array([votes(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn("votes", cast(F.col(text)))


def annotations(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(labelled_id, quality_vote, toxic_vote) of at most ``ANNOTATED`` documents, the smallest hashed ids; one row an id."""

    def vote(bad: Column, known: Column) -> Column:
        return F.when(known, F.when(bad, F.lit(BAD)).otherwise(F.lit(GOOD))).otherwise(F.lit(NONE))

    chosen = labels.select(
        F.col(doc_id).alias("labelled_id"),
        vote(F.col("quality") == 0, F.col("quality").isNotNull()).alias("quality_vote"),
        vote(F.col("toxic") == 1, F.col("toxic").isNotNull()).alias("toxic_vote"),
    ).where("labelled_id is not null")
    one = chosen.groupBy("labelled_id").agg(F.max("quality_vote").alias("quality_vote"), F.max("toxic_vote").alias("toxic_vote"))
    return one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(ANNOTATED)


class Scorer:
    def __init__(self, quality: LabelModel, toxic: LabelModel, quality_weights: np.ndarray, toxic_weights: np.ndarray) -> None:
        self.quality, self.toxic, self.quality_weights, self.toxic_weights = quality, toxic, quality_weights, toxic_weights


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """Estimate the labellers from all documents and train the scorers on a bounded sample of documents."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    said = annotations(labels)
    marked = chosen.join(F.broadcast(said), F.col("doc_id") == F.col("labelled_id"), "left")
    known = voted(marked).select(
        "doc_id", F.xxhash64("text").alias("hash"), F.concat("votes", F.array(F.coalesce("quality_vote", F.lit(NONE)), F.coalesce("toxic_vote", F.lit(NONE)))).alias("votes"), "labelled_id"
    )
    known = stage(known)
    counted = known.groupBy("votes").count().collect()  # at most 3 to the number of labellers
    labellers = len(QUALITY_LABELLERS)
    patterns = np.array([r.votes for r in counted], np.int64).reshape(-1, labellers + 3)
    counts = np.array([r["count"] for r in counted], float)
    about_quality, about_toxic = [*range(labellers), labellers + 1], [labellers, labellers + 2]
    quality = LabelModel(len(about_quality)).fit(patterns[:, about_quality], counts)
    toxic = LabelModel(len(about_toxic)).fit(patterns[:, about_toxic], counts)
    # Labelled documents first, then others; hashed ids make the choice the same at every run.
    order = [F.col("labelled_id").isNull(), F.xxhash64("doc_id"), F.col("doc_id")]
    row = F.min(F.struct("hash", "votes")).alias("row")
    one = known.where("doc_id is not null").groupBy("doc_id").agg(row, F.max("labelled_id").alias("labelled_id"))
    sample = one.orderBy(*order).limit(TRAINED).select(F.col("doc_id").alias("sample_id"), "row.hash", "row.votes")
    texts = chosen.join(F.broadcast(sample), (F.col("doc_id") == F.col("sample_id")) & (F.xxhash64("text") == F.col("hash")))
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "votes")).alias("row")).select("doc_id", "row.text", "row.votes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), batch.column(2).slice(at, len(block)), pa.array([f.tolist() for f in features(block)], pa.list_(pa.int32()))], ["doc_id", "votes", "buckets"])
                at += len(block)

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = texts.select("doc_id", "text", "votes").mapInArrow(hashed, f"doc_id {kind}, votes array<int>, buckets array<int>").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.buckets))
    given = np.array([r.votes for r in rows], np.int64).reshape(-1, labellers + 3)
    buckets = [np.array(r.buckets, np.int64) for r in rows]
    good = fit_linear(buckets, quality.posterior(given[:, about_quality]) if len(rows) else np.zeros(0))
    bad = fit_linear(buckets, 1 - toxic.posterior(given[:, about_toxic]) if len(rows) else np.zeros(0))
    return Scorer(quality, toxic, good, bad)


def judge(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, toxic_score, kept) of every document."""
    held = docs.sparkSession.sparkContext.broadcast((scorer.quality_weights.astype(np.float32), scorer.toxic_weights.astype(np.float32)))

    @F.arrow_udf("struct<score: double, toxic_score: double>")
    def scored(texts: pa.Array) -> pa.Array:
        good, bad = [np.zeros(0)], [np.zeros(0)]
        for block in blocks(texts.to_pylist()):
            rows = features(block)
            good.append(linear_scores(rows, held.value[0]))
            bad.append(linear_scores(rows, held.value[1]))
        return pa.StructArray.from_arrays([pa.array(np.round(np.concatenate(x), 6)) for x in (good, bad)], ["score", "toxic_score"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), scored(whole_text(text)).alias("scored"))
    kept = (F.col("scored.score") >= 0.5) & (F.col("scored.toxic_score") < 0.5)
    return chosen.select("doc_id", "scored.score", "scored.toxic_score", kept.alias("kept"))
