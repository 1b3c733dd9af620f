"""Data-quality rules, contract conformance and tagged columns."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as K

VIOLATIONS, ROUTE = "violations", "route"
CLEAN, DLQ, ERROR = "clean", "dlq", "error"


def check_rules(df: DataFrame, dataset: str, rules=K.QUALITY_RULES) -> DataFrame:
    """Add the names of violated rules and the route; a NULL operand is a violation.

    All rules of a dataset run in one pass. An ``error`` rule outranks a ``dlq`` one.
    """
    own = [(name, predicate, severity) for owner, name, predicate, severity in rules if owner == dataset]

    def violated(predicate: str) -> Column:
        return ~F.coalesce(F.expr(predicate), F.lit(False))

    failed = F.array_compact(F.array(*[F.when(violated(p), F.lit(name)) for name, p, _ in own]))
    route = F
    for severity in (ERROR, DLQ):
        for _, predicate, rule_severity in own:
            if rule_severity == severity:
                route = route.when(violated(predicate), severity)
    route = route.otherwise(CLEAN) if own else F.lit(CLEAN)
    names = failed if own else F.array().cast("array<string>")
    return df.withColumns({VIOLATIONS: names, ROUTE: route})


def split_routes(checked: DataFrame) -> dict[str, DataFrame]:
    return {route: checked.filter(F.col(ROUTE) == route) for route in (CLEAN, DLQ, ERROR)}


def violation_summary(checked: dict[str, DataFrame]) -> DataFrame:
    """Violations per dataset and rule; counted per task before the shuffle."""
    parts = [
        df.select(F.lit(name).alias("dataset"), F.explode(VIOLATIONS).alias("rule")) for name, df in checked.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("dataset", "rule").agg(F.count(F.lit(1)).alias("n"))


# What a parsed JSON value of each declared type may look like. Timestamps are epoch milliseconds.
_NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)"
_ACCEPTED = {
    "string": "STRING",
    "double": _NUMBER,
    "int": "BIGINT",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "timestamp": "BIGINT",
    "array<string>": "ARRAY<(STRING|VOID)>",
    "array<float>": f"ARRAY<({_NUMBER}|VOID)>",
}


def check_contract(df: DataFrame, payload: str, contract: T.StructType) -> DataFrame:
    """Parse a JSON payload; ``reason`` is NULL for a conforming one.

    ``malformed`` for unreadable JSON, else the first offending field in contract
    order as ``missing:<field>`` or ``type:<field>``.
    """
    fields = F.from_json(payload, "map<string,variant>")
    kinds = F.transform_values(fields, lambda _, value: F.schema_of_variant(value))
    # Generated, one row for one: a filter on the reason that is moved below a projection would parse the payload anew for each field.
    parsed = df.withColumn("_kinds", F.explode(F.array(kinds)))
    reason = F.when(F.col(payload).isNotNull() & F.col("_kinds").isNull(), "malformed")
    for field in contract.fields:
        kind = F.coalesce(F.try_element_at("_kinds", F.lit(field.name)), F.lit("VOID"))
        if not field.nullable:
            reason = reason.when(kind == "VOID", f"missing:{field.name}")
        accepted = f"^({_ACCEPTED[field.dataType.simpleString()]}|VOID)$"
        reason = reason.when(~kind.rlike(accepted), f"type:{field.name}")
    return parsed.withColumn("reason", reason).drop("_kinds")


def decode_fields(df: DataFrame, payload: str, contract: T.StructType) -> DataFrame:
    """Typed columns of conforming payloads; timestamps arrive as epoch milliseconds."""
    wire = T.StructType(
        [
            T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
            for f in contract.fields
        ]
    )
    parsed = df.withColumn("_record", F.from_json(payload, wire))
    columns = []
    for field in contract.fields:
        value = F.col("_record").getField(field.name)
        if isinstance(field.dataType, T.TimestampType):
            value = F.timestamp_millis(value)
        columns.append(value.alias(field.name))
    return parsed.select(*[c for c in df.columns if c != payload], *columns)


def restricted_view(
    df: DataFrame,
    dataset: str,
    *,
    tag: str = "PII",
    keep_hashed: Collection[str] = (),
    secret: Column | None = None,
    tags=K.COLUMN_TAGS,
) -> DataFrame:
    """Drop columns carrying ``tag``; those in ``keep_hashed`` stay joinable as SHA-256.

    ``secret`` is prepended before hashing, so ids cannot be guessed from the digest.
    """
    tagged = [name for name, own in tags.get(dataset, {}).items() if tag in own]
    hashed, dropped = [c for c in tagged if c in keep_hashed], [c for c in tagged if c not in keep_hashed]
    salt = F.lit("") if secret is None else secret
    return df.drop(*dropped).withColumns({c: F.sha2(F.concat(salt, F.col(c).cast("string")), 256) for c in hashed})
