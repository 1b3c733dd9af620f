"""Operator-facing reports over the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.functions.scalar import lookup, round_exact
from faultline.operators.latest import last_n_per_key


def fleet_status(state: DataFrame) -> DataFrame:
    """Fleet table, worst first."""
    rank = lookup(F.col("severity"), {"critical": 0, "warning": 1}, 2)
    return state.orderBy(rank, "asset_id").select(
        F.col("asset_id").alias("asset"),
        F.col("asset_type").alias("type"),
        "region",
        "severity",
        round_exact(F.col("temp_c"), 1).alias("temp_c"),
        round_exact(F.col("load_pct"), 0).alias("load_pct"),
        round_exact(F.col("fault_score"), 2).alias("fault"),
    )


def needs_attention(state: DataFrame) -> DataFrame:
    return state.filter(F.col("severity").isin("warning", "critical")).select("asset_id", "severity", "lat", "lon")


def history(enriched: DataFrame, n: int = K.HISTORY_ROWS, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last ``n`` readings of every asset."""
    columns = dict.fromkeys(["asset_id", *order, "temp_c", "load_pct", "fault_score"])
    return last_n_per_key(enriched.select(*columns), "asset_id", n, order)


def citation_sources(citations: Column) -> Column:
    """Distinct sorted sources, comma-joined; a source that is NULL shows as empty."""
    sources = F.transform(citations, lambda c: F.coalesce(c.source, F.lit("")))
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(sources)), ", "), F.lit(""))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _fixed(name: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_exact(F.coalesce(F.col(name), F.lit(0.0)), digits))


def activity_feed(
    incidents: DataFrame, diagnosed: DataFrame, planned: DataFrame, executed: DataFrame, resolved: DataFrame
) -> DataFrame:
    """``(ts, stage, text)`` lines of all five stages."""
    c = F.col
    cites = citation_sources(c("dx_citations"))
    # Line wording.
    detect = F.concat(
        F.upper("severity"), F.lit(" on "), c("asset_id"), F.lit(" ("), c("signal"), F.lit("="), _fixed("value", 1),
        F.lit(", score="), _fixed("fault_score", 2), F.lit(")"),
    )
    reason = F.concat(
        c("asset_id"), F.lit(": "), F.substring(F.coalesce("dx_root_cause", F.lit("")), 1, 80), F.lit(" -> "),
        _shown("dx_recommended_action"), F.lit(" "),
        F.when(cites != "", F.concat(F.lit("[cites: "), cites, F.lit("]"))).otherwise(""),
    )
    plan = F.concat(
        c("asset_id"), F.lit(": "), c("action_type"), F.lit(" crew="), _shown("crew_id"), F.lit(" "), c("priority")
    )
    act = F.concat(c("asset_id"), F.lit(": EXECUTED "), c("action_type"))
    verify = F.concat(c("asset_id"), F.lit(": RESOLVED in "), _shown("recovery_seconds"), F.lit("s"))
    stages = [
        (incidents, "ts", "DETECT", detect),
        (diagnosed, "diagnosed_ts", "DIAGNOSE", reason),
        (planned, "ts", "PLAN", plan),
        (executed, "ts", "ACT", act),
        (resolved.filter(c("status") == "resolved"), "resolved_ts", "VERIFY", verify),
    ]
    lines = [df.select(c(ts).alias("ts"), F.lit(stage).alias("stage"), text.alias("text")) for df, ts, stage, text in stages]
    return reduce(DataFrame.unionByName, lines)


def newest(df: DataFrame, n: int, ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` newest rows: a top-n per task, merged, never a full sort."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).asc() for c in tie]).limit(n)


def newest_feed(feed: DataFrame, n: int = K.FEED_SHOWN) -> DataFrame:
    return newest(feed, n, "ts", ("stage", "text"))


def recent_work_orders(orders: DataFrame, n: int = K.WORK_ORDERS_SHOWN) -> DataFrame:
    return newest(orders, n, "ts", ("work_order_id", "incident_id")).select(
        F.col("work_order_id").alias("id"),
        F.col("asset_id").alias("asset"),
        "priority",
        F.col("crew_id").alias("crew"),
        F.col("sla_hours").alias("sla_h"),
        "status",
    )


def recent_incidents(incidents: DataFrame, n: int = K.RECENT_KEPT) -> DataFrame:
    return newest(incidents, n, "ts", ("incident_id",))


def recent_resolutions(resolved: DataFrame, n: int = K.RECENT_KEPT) -> DataFrame:
    return newest(resolved.filter(F.col("status") == "resolved"), n, "resolved_ts", ("incident_id",))
