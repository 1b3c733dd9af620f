"""Micro-batch forms: tables kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from faultline import constants as K
from faultline.operators import incidents, planning, recovery, scoring
from faultline.plans import pipeline
from faultline.session import materialize, stage_scope
from faultline.sources.sinks import KeyedTable, fan_out, upsert_stream
from faultline.streaming.asof import asof_join_table
from faultline.streaming.ordered import LATE
from faultline.streaming.recovery import recovery_chain
from faultline.streaming.rolling import rolling_zscore_stream
from faultline.streaming.scoring import spec_and_registry, versioned_score_stream


def watermark_policy(spark: SparkSession, idle_sources_stall: bool = True) -> None:
    """With several sources, follow the slowest one, or the fastest so that an idle one stalls nothing."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min" if idle_sources_stall else "max")


def score_stream(telemetry: DataFrame, specs: DataFrame, registry: DataFrame, *, delay: str, **options) -> DataFrame:
    """Graded readings. Specs and registry are streams of versions, or both tables that stay as they are.

    Streams meet telemetry in one stateful operator, so versions may change while the query runs.
    Tables are broadcast, and must be proven small.
    """
    if specs.isStreaming and registry.isStreaming:
        return pipeline.grade(versioned_score_stream(telemetry, spec_and_registry(specs, registry), delay=delay, **options))
    scored = rolling_zscore_stream(telemetry, delay=delay, **options)
    scored = asof_join_table(scored, specs, payload=list(pipeline.scoring.SPEC_COLUMNS))
    return pipeline.grade(asof_join_table(scored, registry, payload=["tie_assets"]))


def resolve_stream(
    telemetry: DataFrame,
    specs: DataFrame,
    registry: DataFrame,
    actions: DataFrame,
    resolved: KeyedTable,
    checkpoint: str,
    *,
    delay: str,
    window_seconds: int = K.RECOVERY_WINDOW_SECONDS,
) -> DataStreamWriter:
    """Resolutions kept in a table, from four streams in one query.

    Scoring is the first stateful operator; its event time goes on to the second, which waits for
    the first healthy reading after each action. A resolution's row follows from its action and
    reading alone, so a replayed batch writes it again unchanged.
    """
    versions = spec_and_registry(specs, registry)
    telemetry = telemetry.select("asset_id", "event_id", "ts", *scoring.READING_COLUMNS)
    graded = pipeline.grade(versioned_score_stream(telemetry, versions, delay=delay, chained=True))
    found = recovery_chain(actions, graded, delay=delay, window_seconds=window_seconds)
    return upsert_stream(recovery.resolve(found), resolved, checkpoint)


def detect(graded: DataFrame, base: str, checkpoint: str) -> DataStreamWriter:
    """Enriched readings and incidents from one pass over the graded stream."""
    outputs = {"enriched": incidents.enriched, "incidents": incidents.build_incidents}
    return fan_out(graded, outputs, base, checkpoint)


def unique_incidents(stream: DataFrame, delay: str) -> DataFrame:
    """Each incident once, however often it is sent again within ``delay``."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["incident_id"])


def plan_stream(
    diagnosed: DataFrame,
    registry: DataFrame | KeyedTable,
    crews: KeyedTable,
    tables: dict[str, KeyedTable],
    checkpoint: str,
    compact_every: int = 100,
) -> DataStreamWriter:
    """Plans and what follows from them, per batch, against the crew table of that moment.

    ``registry`` as a keyed table (one row a version) is also read anew in each batch; a plain
    table stays as the query found it. A batch removes the stages that it made. A plan is frozen when made: a crew that moves later does not revise it. All ids
    derive from the incident, so a replayed batch rewrites the same rows. ``tables``
    may hold planned, executed, control and work_orders.
    """
    views = {
        "planned": lambda plans: plans,
        "executed": lambda plans: planning.executed_actions(plans, F.col("ts")),
        "control": lambda plans: planning.control_commands(plans, F.col("ts")),
        "work_orders": lambda plans: planning.work_orders(plans, F.col("ts")),
    }

    def write(batch: DataFrame, batch_id: int) -> None:
        # Stored, so that crews are merged and plans made once, however many tables read them.
        with stage_scope(batch.sparkSession):
            roster = materialize(crews.read(batch.sparkSession))
            versions = registry.read(batch.sparkSession) if isinstance(registry, KeyedTable) else registry
            plans = materialize(pipeline.plan(batch, versions, roster))
            for name, table in tables.items():
                table.apply(views[name](plans), batch_id)
                if batch_id % compact_every == compact_every - 1:
                    table.compact(batch.sparkSession)

    return diagnosed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def split_late(flagged: DataFrame, base: str, checkpoint: str) -> DataStreamWriter:
    """Route an operator's output into ``on_time`` and ``late`` folders, by its own mark (``late_rows=True``).

    The operator that keeps the order decides what is late, from the watermark that it works with,
    so the two folders hold exactly what it used and what it had to leave.
    """
    outputs = {"on_time": lambda rows: rows.filter(~F.col(LATE)).drop(LATE), "late": lambda rows: rows.filter(LATE).drop(LATE)}
    return fan_out(flagged, outputs, base, checkpoint)
