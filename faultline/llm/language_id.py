"""Language identification by mixture inference over n-gram likelihoods.

Training counts the byte trigrams inside words, hashed to ``BUCKETS``, for every language of the labelled
documents, with Spark; the model is one row of smoothed log-probabilities a language. For a document the
likelihood of each word under each language is summed from its trigrams, and expectation-maximisation over
the words estimates the shares of the languages. The set of languages is chosen by penalised likelihood:
the largest shares are admitted one after another while the log-likelihood, re-estimated within the set,
grows by more than ``PENALTY`` times the logarithm of the number of words.

The prediction is the largest share in the chosen set; the score is that share. Defined results: a null text, a
text without a letter, or a model without languages gives ``und`` with score 0 and no languages; case does not
matter; rows are judged each for itself, whatever their ids; an empty table gives no rows; a training row with a
null language or a null text teaches nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import blocks

BUCKETS = 1 << 15
SMOOTHING = 0.2
ROUNDS = 8
PENALTY = 2.0
#: Numbers of (trigram, language) held at once.
CELLS = 2_400_000
UNKNOWN = "und"

#: Letters stay, everything else of ASCII parts words.
_BYTES = np.where(np.array([b >= 128 or chr(b).isalpha() for b in range(256)]), np.arange(256), 32).astype(np.uint8)
_letter = regex.compile(r"\p{L}").search


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams inside words, the first trigram of each word, and each text's number of words."""
    parts = [t.lower().encode() for t in texts]
    data = _BYTES[np.frombuffer(b" " + b"".join(p + b"  " for p in parts) + b" ", np.uint8)].astype(np.uint32)
    middle = data[1:-1] != 32
    mixed = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    first = (middle & (data[:-2] == 32))[middle]
    bounds = np.cumsum([0, *(len(p) + 2 for p in parts)])
    starts = np.flatnonzero(middle & (data[:-2] == 32))
    return (mixed[middle] >> np.uint32(17)).astype(np.int64), np.flatnonzero(first), np.diff(np.searchsorted(starts, bounds))


def count(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all labelled documents; counted in every task before the shuffle."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                held = np.zeros(BUCKETS, np.int64)
                for block in blocks(t for t, l in zip(texts, langs, strict=True) if l == name):
                    held += np.bincount(trigrams(block)[0], minlength=BUCKETS)
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(held[at])})

    chosen = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    return chosen.mapInArrow(in_task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and log-probabilities (bucket, language); its size is languages times ``BUCKETS``."""

    def __init__(self, langs: list[str], log_p: np.ndarray) -> None:
        self.langs, self.log_p = langs, log_p

    @classmethod
    def of(cls, counted: DataFrame) -> Model:
        rows = counted.toPandas()
        langs = sorted(rows["lang"].unique())
        n = np.full((BUCKETS, len(langs)), SMOOTHING)
        np.add.at(n, (rows["bucket"].to_numpy(), rows["lang"].map({name: k for k, name in enumerate(langs)}).to_numpy(int)), rows["n"].to_numpy(float))
        return cls(langs, np.log(n / n.sum(axis=0)).astype(np.float32) if langs else n)

    def mix(self, like: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after some rounds of expectation-maximisation, and the log-likelihood beyond the words' best."""
        for last in range(rounds + 1):
            joint = like * np.repeat(share, sizes, axis=0)
            total = joint.sum(axis=1)
            if last == rounds:
                return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts)
            share = np.add.reduceat(joint / np.maximum(total, 1e-30)[:, None], starts, axis=0) / sizes[:, None]
        raise AssertionError

    def infer(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        """The chosen languages of each text with their shares, largest first."""
        bucket, first, words = trigrams(texts)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        held = np.flatnonzero(words)
        if not len(held) or not self.langs:
            return out
        sizes = words[held]
        starts = np.cumsum(sizes) - sizes
        log_like = np.add.reduceat(self.log_p[bucket], first, axis=0)
        like = np.exp(log_like - log_like.max(axis=1, keepdims=True))
        even = np.full((len(held), len(self.langs)), 1 / len(self.langs), np.float32)
        share, _ = self.mix(like, starts, sizes, even, ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        chosen, best, active = np.zeros_like(share), np.full(len(held), -np.inf), np.arange(len(held))
        for size in range(1, len(self.langs) + 1):
            # Only documents whose last language paid for itself try one more.
            inside = np.zeros_like(share)
            np.put_along_axis(inside, order[:, :size], 1, axis=1)
            some = np.isin(np.repeat(np.arange(len(held)), sizes), active)
            n = sizes[active]
            begin = (share * inside)[active] + 1e-12 * inside[active]
            tried, fit = self.mix(like[some], np.cumsum(n) - n, n, (begin / begin.sum(axis=1, keepdims=True)).astype(np.float32), 3 if size > 1 else 0)
            fit = fit - PENALTY * (size - 1) * np.log(n + 1.0)
            better = fit > best[active]
            chosen[active[better]], best[active[better]] = tried[better], fit[better]
            active = active[better]
            if not len(active):
                break
        for n, row in zip(held, chosen, strict=True):
            at = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
            out[n] = [(self.langs[k], float(row[k])) for k in at]
        return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``languages`` (language and share) to every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))
    kind = "struct<lang_pred: string, score: double, languages: array<struct<lang: string, share: double>>>"

    @F.arrow_udf(kind)
    def predicted(texts: pa.Array) -> pa.Array:
        worker, rows = Model(*held.value), []
        for block in blocks(texts.to_pylist(), max(20_000, CELLS // max(1, len(worker.langs)))):
            for value, found in zip(block, worker.infer(block), strict=True):
                if not found or not _letter(value):
                    rows.append({"lang_pred": UNKNOWN, "score": 0.0, "languages": []})
                    continue
                rows.append({"lang_pred": found[0][0], "score": min(1.0, round(found[0][1], 6)), "languages": [{"lang": name, "share": round(s, 6)} for name, s in found]})
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]))

    done = docs.withColumn("identified", predicted(F.col(text).cast("string")))
    return done.withColumns({name: F.col(f"identified.{name}") for name in ("lang_pred", "score", "languages")}).drop("identified")


def held_out(doc_id: str = "doc_id"):
    """Documents that teach nothing: the checksum of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return Model.of(count(docs.where(~held_out(doc_id)), text, lang))
