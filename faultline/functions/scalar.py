"""Scalar expressions whose null, rounding or id rules differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def floor_at_zero(value: Column) -> Column:
    """``max(0, value)`` that stays NULL for a NULL value (Spark's greatest skips NULLs)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an ANSI error, on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def lookup(column: Column, table: dict, default) -> Column:
    """Fixed-table lookup as a CASE expression; anything unknown or NULL gets the default."""
    out = F
    for key, value in table.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def stable_uuid(*parts: Column) -> Column:
    """Replay-safe id in UUID layout, derived from the identifying columns."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def event_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def round_exact(value: Column, digits: int) -> Column:
    """Round half-even on the exact binary value, as printf does.

    ``bround`` rounds the printed decimal instead, so 95.65 (stored a little
    above) would come out as 95.6. The scaled product's rounding error, from
    Dekker's exact multiplication, tells a true tie from an apparent one.
    """
    scale = F.lit(float(10**digits))
    scaled = value * scale
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    error = (high * scale - scaled) + (value - high) * scale
    below = F.floor(scaled).cast("double")
    tie = (scaled - below) == 0.5
    return (
        F.when(tie & (error > 0), below + 1.0)
        .when(tie & (error < 0), below)
        .otherwise(F.rint(scaled))
        / scale
    )
