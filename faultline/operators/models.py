"""Model surface: what an embedding or text model is, and calling it from executors."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM_PROMPT = (
    "Diagnose the incident from the given context only. Choose one action out of "
    "monitor, throttle_load, reroute_load, dispatch_crew, isolate; prefer the least "
    "disruptive one that removes the hazard, and reroute only if tie assets are listed. "
    "Without enough context choose dispatch_crew. Answer as one JSON object with the keys "
    "root_cause, recommended_action, rationale, confidence, citation."
)


@dataclass(frozen=True)
class EmbeddingModel:
    """``call`` takes a batch of texts and returns one vector of ``dim`` numbers for each."""

    name: str
    dim: int
    call: Callable[[list[str]], Sequence[Sequence[float]]]
    batch_size: int = 256
    retries: int = 2


@dataclass(frozen=True)
class TextModel:
    """``call`` takes (system prompt, batch of prompts) and returns one answer for each."""

    name: str
    call: Callable[[str, list[str]], Sequence[str | None]]
    system_prompt: str = SYSTEM_PROMPT
    batch_size: int = 32
    retries: int = 2


def _with_retries(call: Callable, attempts: int):
    for attempt in range(attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(0.1 * 2**attempt)


def _map_batches(df: DataFrame, column: str, output: T.StructField, batch_size: int, answer: Callable) -> DataFrame:
    """Append ``answer(list of texts)`` as a column, NULL for a NULL text."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size].copy()
                asked = part[column].dropna()
                answers = answer(asked.tolist()) if len(asked) else []
                filled = pd.Series([None] * len(part), index=part.index, dtype=object)
                for at, value in zip(asked.index, answers, strict=True):
                    filled.at[at] = value
                part[output.name] = filled
                yield part

    return df.mapInPandas(apply, T.StructType([*df.schema.fields, output]))


def embed(df: DataFrame, text: str, model: EmbeddingModel, output: str = "embedding") -> DataFrame:
    """Add the embedding of ``text``; a vector of the wrong length fails the job.

    Rows with a NULL text are dropped: a lateral function that returns nothing joins nothing.
    """

    def answer(texts: list[str]) -> list[Sequence[float]]:
        vectors = list(_with_retries(lambda: model.call(texts), model.retries))
        if len(vectors) != len(texts):
            raise ValueError(f"{model.name} returned {len(vectors)} vectors for {len(texts)} texts")
        wrong = {len(v) for v in vectors} - {model.dim}
        if wrong:
            raise ValueError(f"{model.name} returned dimension {sorted(wrong)}, expected {model.dim}")
        return vectors

    field = T.StructField(output, T.ArrayType(T.FloatType()))
    return _map_batches(df.filter(F.col(text).isNotNull()), text, field, model.batch_size, answer)


def predict(df: DataFrame, prompt: str, model: TextModel, output: str = "output") -> DataFrame:
    """Add the model's answer to ``prompt``, one call item per row.

    A NULL prompt is not sent and answers NULL, so the incident is not lost. Neither is it
    when the provider fails on every try: its batch answers NULL, which the parser sends a crew for.
    """

    def answer(prompts: list[str]) -> list[str | None]:
        try:
            answers = list(_with_retries(lambda: model.call(model.system_prompt, prompts), model.retries))
        except Exception as error:
            logging.getLogger(__name__).warning("%s failed on %d prompts: %s", model.name, len(prompts), error)
            return [None] * len(prompts)
        if len(answers) != len(prompts):
            raise ValueError(f"{model.name} returned {len(answers)} answers for {len(prompts)} prompts")
        return answers

    return _map_batches(df, prompt, T.StructField(output, T.StringType()), model.batch_size, answer)
