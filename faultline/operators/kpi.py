"""Fleet counters and ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.operators.latest import latest_per_key

STATE_COLUMNS = ("severity", "temp_c", "load_pct", "fault_score")


def latest_state(enriched: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Newest severity, temperature, load and score per asset."""
    needed = enriched.select(*dict.fromkeys(["asset_id", *order, *STATE_COLUMNS]))
    return latest_per_key(needed, "asset_id", order).select("asset_id", *STATE_COLUMNS)


def fleet_state(fleet: DataFrame, enriched: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Every asset of the fleet with its latest state; one never heard of counts as info, score 0."""
    return fleet.join(latest_state(enriched, order), "asset_id", "left").withColumns(
        {"severity": F.coalesce("severity", F.lit("info")), "fault_score": F.coalesce("fault_score", F.lit(0.0))}
    )


def severity_counts(state: DataFrame) -> DataFrame:
    """Assets per level, all three levels present."""
    levels = state.sparkSession.createDataFrame([(s,) for s in K.SEVERITIES], "severity string")
    counts = state.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def kpis(incidents: DataFrame, executed: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of counters. Each table is reduced on its own and the partial rows are added."""
    counters = ("incidents", "actions", "resolved", "outages_avoided")

    def counted(df: DataFrame, **columns) -> DataFrame:
        return df.agg(*[columns.get(c, F.lit(0).cast("long")).alias(c) for c in counters])

    done = F.col("status") == "resolved"
    avoided = done & F.col("action_type").isin(*K.OUTAGE_AVOIDING_ACTIONS)
    parts = [
        counted(incidents, incidents=F.count(F.lit(1))),
        counted(executed, actions=F.count(F.lit(1))),
        counted(resolved, resolved=F.count_if(done), outages_avoided=F.count_if(avoided)),
    ]
    totals = reduce(DataFrame.unionByName, parts).agg(*[F.sum(c).alias(c) for c in counters])
    share = F.col("resolved") / F.greatest(F.lit(1), F.col("incidents"))
    return totals.withColumns(
        {
            "cost_avoided": F.col("outages_avoided") * K.OUTAGE_COST,
            "resolved_ratio": F.least(F.lit(1.0), share),
        }
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table with an emptiness flag."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("is_empty", F.col("n") == 0)
