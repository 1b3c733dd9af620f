"""Message payloads to typed rows and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.quality import check_contract, decode_fields

AVRO_MAGIC = b"\x00"  # fixed value: first byte of registry-framed Avro
UNSUPPORTED_AVRO = "avro: no decoder"


def decode(messages: DataFrame, contract: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of binary messages; a null message is a tombstone and yields neither.

    JSON payloads become typed rows if they meet the contract, else rejects with a
    ``reason``. Registry-framed Avro is rejected with its own reason: decode it
    upstream with the public Avro package, whose function needs the writer schema.
    """
    present = messages.filter(F.col(value).isNotNull())
    framed = F.substring(F.col(value), 1, 1) == F.lit(AVRO_MAGIC)
    text = F.when(~framed, F.decode(F.col(value), "UTF-8"))
    checked = check_contract(present.withColumns({"_framed": framed, "_text": text}), "_text", contract)
    reason = F.when(F.col("_framed"), UNSUPPORTED_AVRO).otherwise(F.col("reason"))
    checked = checked.withColumn("reason", reason)
    rejects = checked.filter(F.col("reason").isNotNull()).drop("_framed", "_text")
    good = checked.filter(F.col("reason").isNull()).drop("_framed", "reason", value)
    return decode_fields(good, "_text", contract), rejects


def encode(rows: DataFrame, contract: T.StructType) -> DataFrame:
    """Rows as the JSON text :func:`decode` reads; timestamps become epoch milliseconds."""
    fields = [
        F.unix_millis(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in contract.fields
    ]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))
