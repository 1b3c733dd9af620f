"""Batch composition of the operators, stage by stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.functions.hashing import sparse_hash_vector
from faultline.operators import diagnosis, incidents, planning, recovery, scoring
from faultline.operators.anomaly import rolling_zscore, rolling_zscore_with_versions
from faultline.operators.asof import VersionTable, asof_join, asof_join_all, asof_strategies
from faultline.operators.models import TextModel
from faultline.operators.slicing import Slices, hot_slices
from faultline.session import materialize

CHUNK_ID = "chunk_id"


Strategies = tuple[str, str]  # of the spec and the registry join


def _kinds(specs: DataFrame, registry: DataFrame) -> tuple[VersionTable, VersionTable]:
    return VersionTable(specs, scoring.SPEC_COLUMNS), VersionTable(registry, ["tie_assets"])


def _broadcast_versions(rows: DataFrame, kinds: Sequence[VersionTable]) -> DataFrame:
    for kind in kinds:
        rows = asof_join(rows, kind.rows, payload=kind.payload, strategy="interval")
    return rows


def with_versions(
    telemetry: DataFrame,
    specs: DataFrame,
    registry: DataFrame,
    *,
    slices: Slices | None = None,
    strategies: Strategies | None = None,
) -> DataFrame:
    """Telemetry with the spec and tie assets valid at each reading.

    Version tables too large to broadcast are merged with telemetry, all of them in one sort.
    """
    kinds = _kinds(specs, registry)
    chosen = strategies or asof_strategies([specs, registry])
    merged = [kind for kind, how in zip(kinds, chosen, strict=True) if how == "merge"]
    rows = asof_join_all(telemetry, merged, slices=slices) if merged else telemetry
    return _broadcast_versions(rows, [kind for kind, how in zip(kinds, chosen, strict=True) if how != "merge"])


def score(
    telemetry: DataFrame,
    specs: DataFrame,
    registry: DataFrame,
    *,
    order: tuple[str, ...] = ("ts", "event_id"),
    slices: Slices | None = None,
    strategies: Strategies | None = None,
) -> DataFrame:
    """Readings with z-score, envelope, features, fault score and severity.

    Telemetry is exchanged and sorted once, whether versions are broadcast or merged.
    """
    kinds = _kinds(specs, registry)
    chosen = strategies or asof_strategies([specs, registry])
    merged = [kind for kind, how in zip(kinds, chosen, strict=True) if how == "merge"]
    if merged:
        rows = rolling_zscore_with_versions(telemetry, merged, order=order, slices=slices)
    else:
        rows = rolling_zscore(telemetry, order=order, slices=slices)
    return grade(_broadcast_versions(rows, [kind for kind, how in zip(kinds, chosen, strict=True) if how != "merge"]))


def grade(versioned: DataFrame) -> DataFrame:
    """The row-by-row part of scoring: envelope, features, score, severity."""
    features = scoring.normalise_features(scoring.apply_envelope(versioned))
    return scoring.grade_severity(scoring.fault_score(features))


def index_corpus(chunks: DataFrame, dim: int = K.EMBEDDING_DIM) -> DataFrame:
    """Corpus rows with a sortable id and their offline embedding."""
    chunk_id = F.concat(F.col("source"), F.lit("#"), F.lpad(F.col("chunk").cast("string"), 6, "0"))
    return chunks.withColumns({CHUNK_ID: chunk_id, "embedding": sparse_hash_vector(F.col("text"), dim)})


@dataclass(frozen=True)
class Decisions:
    incidents: DataFrame
    diagnosed: DataFrame
    planned: DataFrame
    executed: DataFrame
    control: DataFrame
    work_orders: DataFrame
    resolved: DataFrame


def diagnose(
    raised: DataFrame, corpus: DataFrame, *, dim: int = K.EMBEDDING_DIM,
    model: TextModel | None = None, as_of: Column | None = None,
) -> DataFrame:
    retrieved = diagnosis.retrieve(raised, corpus, chunk_id=CHUNK_ID, dim=dim)
    return diagnosis.diagnose(raised, diagnosis.with_context(retrieved), model, as_of)


def plan(
    diagnosed: DataFrame, registry: DataFrame, crews: DataFrame, *,
    slices: Slices | None = None, registry_strategy: str = "auto",
) -> DataFrame:
    """Plans from diagnosed incidents and crews.

    Choosing crews reads the plan base several times, and the base may have model calls
    or a merge behind it, so it is written out first: each incident is computed, and each
    model asked, once.
    """
    found = asof_strategies([registry])[0] if registry_strategy == "auto" else registry_strategy
    base = materialize(planning.plan_base(diagnosed, registry, slices=slices, strategy=found))
    return planning.build_plans(planning.choose_crews(base, crews), as_of=F.col("decided_ts"))


def decide(
    telemetry: DataFrame,
    specs: DataFrame,
    registry: DataFrame,
    pings: DataFrame,
    corpus: DataFrame,
    *,
    order: tuple[str, ...] = ("ts", "event_id"),
    crew_order: tuple[str, ...] = ("ts",),
    model: TextModel | None = None,
    recovery_seconds: int = K.RECOVERY_WINDOW_SECONDS,
    rows_per_slice: int | None = None,
) -> Decisions:
    """The whole chain. Decisions take the incident's own time, so a rerun reproduces them.

    Stages read more than once (scores, incidents, plans) and the one that pays for
    model calls are written out between jobs.
    """
    slices = hot_slices(telemetry, rows_per_slice=rows_per_slice)
    strategies = asof_strategies([specs, registry])
    scored = materialize(score(telemetry, specs, registry, order=order, slices=slices, strategies=strategies))
    raised = materialize(incidents.build_incidents(scored))
    diagnosed = materialize(diagnose(raised, corpus, model=model, as_of=F.col("ts")))
    crews = materialize(planning.crew_latest(pings, crew_order))
    planned = materialize(plan(diagnosed, registry, crews, slices=slices, registry_strategy=strategies[1]))
    at = F.col("ts")
    executed = planning.executed_actions(planned, at)
    recovered = recovery.first_recovery(
        executed, incidents.enriched(scored), window_seconds=recovery_seconds, slices=slices
    )
    return Decisions(
        raised, diagnosed, planned, executed,
        planning.control_commands(planned, at), planning.work_orders(planned, at), recovery.resolve(recovered),
    )
