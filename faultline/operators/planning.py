"""Crew choice and the plan, action, control and work-order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import schemas
from faultline.functions.scalar import lookup
from faultline.operators.asof import asof_join
from faultline.operators.latest import latest_per_key
from faultline.operators.nearest import is_position, nearest
from faultline.operators.slicing import Slices

CREW_COLUMNS = ("crew_id", "region", "lat", "lon", "status", "skills")
SITE = ("req_skill", "region", "asset_lat", "asset_lon")


def crew_latest(pings: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return latest_per_key(pings.select(*dict.fromkeys([*CREW_COLUMNS, *order])), "crew_id", order).select(*CREW_COLUMNS)


def plan_base(
    diagnosed: DataFrame,
    registry: DataFrame,
    *,
    decision_ts: str = "diagnosed_ts",
    slices: Slices | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Allowed action, required skill and the asset's position as of the decision."""
    located = asof_join(
        diagnosed,
        registry.withColumnsRenamed({"lat": "asset_lat", "lon": "asset_lon"}),
        payload=["asset_lat", "asset_lon"],
        left_ts=decision_ts,
        slices=slices,
        strategy=strategy,
    )
    recommended = F.col("dx_recommended_action")
    action = F.when(recommended.isin(*K.ACTIONS), recommended).otherwise("monitor")
    return located.select(
        "incident_id", "asset_id", "asset_type", "region", "severity", "tie_assets",
        "dx_root_cause", "dx_rationale", "dx_confidence",
        F.col(decision_ts).alias("decided_ts"),
        action.alias("action_type"),
        lookup(F.col("asset_type"), K.REQUIRED_SKILL, K.FALLBACK_SKILL).alias("req_skill"),
        "asset_lat", "asset_lon",
    )


def serving_crews(crews: DataFrame) -> DataFrame:
    """Available crews, one row per required skill they may serve.

    A ``general`` crew serves every skill, which turns the OR of two containment
    tests into an equality on ``req_skill``.
    """
    known = F.array(*[F.lit(s) for s in K.SKILLS])
    serves = F.when(F.array_contains("skills", K.FALLBACK_SKILL), known).otherwise(
        F.array_intersect(F.col("skills"), known)
    )
    return crews.filter(F.col("status") == "available").select(
        "crew_id", F.col("region").alias("crew_region"), "lat", "lon", F.explode(serves).alias("req_skill")
    )


def choose_crews(base: DataFrame, crews: DataFrame) -> DataFrame:
    """Best available crew per plan: same region first, then squared distance, then crew id.

    The choice depends on a plan only through skill, region and position, so it is
    made once per distinct site, however many incidents an asset raises. A NULL
    distance ranks before any other; a position that is NULL, NaN or infinite gives one. Plans without a qualified crew stay, at 1e18.
    ``crews`` is read several times: pass a stored table, not a long computation.
    """
    serving = serving_crews(crews)
    sites = base.select(*SITE).distinct()
    located = sites.filter(is_position("asset_lat", "asset_lon"))
    positioned = serving.filter(is_position("lat", "lon"))
    at, of = ("asset_lat", "asset_lon"), ("lat", "lon")

    regional = nearest(
        located,
        positioned.withColumnRenamed("crew_region", "region"),
        group=["req_skill", "region"], site_position=at, position=of, identity="crew_id",
    )
    anywhere = nearest(
        located.select("req_skill", *at).distinct(),
        positioned, group=["req_skill"], site_position=at, position=of, identity="crew_id",
    )

    # Where the distance is NULL (asset or crew without a position) only the id decides.
    unplaced = F.when(~is_position("lat", "lon"), F.col("crew_id"))
    regional_ids = serving.groupBy("req_skill", F.col("crew_region").alias("region")).agg(
        F.min("crew_id").alias("_any_r"), F.min(unplaced).alias("_null_r")
    )
    anywhere_ids = serving.groupBy("req_skill").agg(
        F.min("crew_id").alias("_any_a"), F.min(unplaced).alias("_null_a")
    )

    has_position = is_position("asset_lat", "asset_lon")
    null_r = F.when(has_position, F.col("_null_r")).otherwise(F.col("_any_r"))
    null_a = F.when(has_position, F.col("_null_a")).otherwise(F.col("_any_a"))
    ranked = F.array(
        _option(null_r, 1, F.lit(None).cast("double")),
        _option(F.col("_near_r"), 1, F.col("_dist_r")),
        _option(null_a, 0, F.lit(None).cast("double")),
        _option(F.col("_near_a"), 0, F.col("_dist_a")),
    )
    chosen = F.get(F.filter(ranked, lambda o: o.crew_id.isNotNull()), F.lit(0))
    best = (
        sites.join(regional.withColumnsRenamed({"crew_id": "_near_r", "dist": "_dist_r"}), list(SITE), "left")
        .join(
            anywhere.withColumnsRenamed({"crew_id": "_near_a", "dist": "_dist_a"}),
            ["req_skill", *at],
            "left",
        )
        .join(regional_ids, ["req_skill", "region"], "left")
        .join(anywhere_ids, "req_skill", "left")
        .select(*[F.col(c).alias(f"_s_{c}") for c in SITE], chosen.alias("_crew"))
    )
    same_site = F.lit(True)
    for c in SITE:
        same_site = same_site & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    none = F.col("_crew").isNull()
    return base.join(best, same_site, "left").select(
        *[F.col(c) for c in base.columns],
        F.col("_crew.crew_id").alias("cand_crew_id"),
        F.coalesce("_crew.region_match", F.lit(0)).alias("region_match"),
        F.when(none, F.lit(K.NO_CREW_DISTANCE)).otherwise(F.col("_crew.dist")).alias("dist"),
    )


def _option(crew_id: Column, region_match: int, dist: Column) -> Column:
    return F.struct(crew_id.alias("crew_id"), F.lit(region_match).alias("region_match"), dist.alias("dist"))


def build_plans(ranked: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Plan rows; ``as_of`` is the plan time, by default now."""
    severity, action = F.col("severity"), F.col("action_type")
    need_crew = action.isin(*K.CREW_ACTIONS) | (severity == "critical")
    return ranked.select(
        "incident_id",
        "asset_id",
        F.concat(F.lit("PLAN-"), F.substring("incident_id", 1, 8)).alias("plan_id"),
        "asset_type",
        "region",
        (F.current_timestamp() if as_of is None else as_of).alias("ts"),
        "action_type",
        F.when(action == "throttle_load", K.THROTTLE_TARGET_PCT).otherwise("").alias("target_load_pct"),
        "tie_assets",
        need_crew.alias("need_crew"),
        F.when(need_crew, F.col("cand_crew_id")).alias("crew_id"),
        (action != "monitor").alias("need_work_order"),
        lookup(severity, K.PRIORITY, K.LOWEST_PRIORITY).alias("priority"),
        lookup(severity, K.SLA_HOURS, K.LOWEST_SLA_HOURS).alias("sla_hours"),
        "severity",
        F.col("dx_root_cause").alias("root_cause"),
        F.col("dx_rationale").alias("rationale"),
        F.col("dx_confidence").alias("confidence"),
    )


def _derived_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring("incident_id", 1, 8))


def executed_actions(planned: DataFrame, as_of: Column | None = None) -> DataFrame:
    status = F.when(F.col("action_type") == "monitor", "completed").otherwise("issued")
    return planned.select(
        "incident_id",
        "asset_id",
        _derived_id("ACT-").alias("action_id"),
        (F.current_timestamp() if as_of is None else as_of).alias("ts"),
        "action_type",
        "rationale",
        status.alias("status"),
        F.lit(K.ISSUED_BY).alias("issued_by"),
    )


def control_commands(planned: DataFrame, as_of: Column | None = None) -> DataFrame:
    return planned.filter(F.col("action_type").isin(*K.PHYSICAL_ACTIONS)).select(
        "incident_id",
        "asset_id",
        _derived_id("CTL-").alias("action_id"),
        (F.current_timestamp() if as_of is None else as_of).alias("ts"),
        "action_type",
    )


def work_orders(planned: DataFrame, as_of: Column | None = None) -> DataFrame:
    description = F.concat(
        F.col("action_type"), F.lit(" on "), F.col("asset_id"),
        F.lit(". Root cause: "), F.coalesce("root_cause", F.lit("")),
    )
    return planned.filter(F.col("need_work_order")).select(
        "incident_id",
        _derived_id("WO-").alias("work_order_id"),
        "asset_id",
        (F.current_timestamp() if as_of is None else as_of).alias("ts"),
        "priority",
        "crew_id",
        "sla_hours",
        F.substring(description, 1, K.DESCRIPTION_CHARS).alias("description"),
        F.lit("open").alias("status"),
    ).select(*schemas.WORK_ORDERS.names)
