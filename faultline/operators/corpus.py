"""Retrieval corpus: manual chunks and spec-sheet narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import schemas
from faultline.functions.scalar import lookup
from faultline.functions.text import packed_chunks

CORPUS_COLUMNS = ("text", "source", "chunk", "asset_id", "asset_type")


def chunk_texts(df: DataFrame, text: str = "text", max_chars: int = K.CHUNK_CHARS) -> DataFrame:
    """Replace each whole text by its chunks, numbered from 0. Map-only."""
    others = [c for c in df.columns if c != text]
    chunks = F.posexplode(packed_chunks(F.col(text), max_chars)).alias("chunk", text)
    return df.select(*others, chunks)


def manual_chunks(manuals: DataFrame, max_chars: int = K.CHUNK_CHARS) -> DataFrame:
    """Chunks of ``(source, text)`` manuals, scoped to an asset type by file name."""
    scope = lookup(F.col("source"), K.MANUAL_SCOPE, K.ANY_SCOPE)
    return chunk_texts(manuals.select("source", "text"), "text", max_chars).select(
        "text", "source", "chunk", F.lit("").alias("asset_id"), scope.alias("asset_type")
    )


def reference_guide() -> Column:
    return lookup(F.col("asset_type"), K.REFERENCE_GUIDE, K.FALLBACK_GUIDE)


def _sentence(condition: Column, *parts) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.when(condition, text)


def spec_narrative() -> Column:
    """Readable spec sheet; a sentence appears only if its leading value is set."""
    c = F.col

    def given(name: str) -> Column:
        return F.coalesce(c(name) != 0, F.lit(False))

    ties = F.coalesce(F.size("tie_assets") > 0, F.lit(False))
    # Sentence wording is the text that gets embedded and cited.
    return F.concat_ws(
        " ",
        _sentence(
            F.lit(True),
            "Spec sheet for ", c("asset_id"), " (", c("name"), "), a ", c("asset_type"), " in the ",
            c("region"), " region, substation ", c("substation"), ". Voltage class ", c("voltage_kv"),
            " kV, criticality ", c("criticality"), ", installed ", c("install_year"), ".",
        ),
        _sentence(
            given("rated_load_mw"),
            "Rated load: ", c("rated_load_mw"),
            " MW. Sustained operation above 100% rated load is an overload condition.",
        ),
        _sentence(
            given("warning_temp_c"),
            "Temperature thresholds: nominal ", c("nominal_temp_c"), " C, warning ", c("warning_temp_c"),
            " C, critical ", c("critical_temp_c"),
            " C. Above the critical limit, reduce load immediately and isolate if it does not recover.",
        ),
        _sentence(
            given("warning_vibration_mm_s"),
            "Vibration thresholds (RMS velocity): nominal ", c("nominal_vibration_mm_s"),
            " mm/s, warning ", c("warning_vibration_mm_s"),
            " mm/s; above warning indicates bearing wear and needs a crew inspection.",
        ),
        _sentence(
            given("nominal_oil_pressure_kpa"),
            "Nominal pressure ", c("nominal_oil_pressure_kpa"),
            " kPa; a drop greater than 30% indicates a leak or cavitation.",
        ),
        _sentence(
            ties, "Tie routes available for load transfer: ", F.array_join("tie_assets", ", "), "."
        ),
        _sentence(
            F.lit(True), "Refer to the ", reference_guide(), " for the full response procedure."
        ),
    )


def spec_documents(assets: DataFrame) -> DataFrame:
    return assets.withColumns({"reference_guide": reference_guide(), "spec_text": spec_narrative()}).select(
        *schemas.ASSET_SPECS.names
    )


def spec_chunks(specs: DataFrame) -> DataFrame:
    """One corpus row per spec sheet."""
    return specs.select(
        F.col("spec_text").alias("text"),
        F.concat(F.lit("spec:"), F.col("spec_sheet_id")).alias("source"),
        F.lit(0).alias("chunk"),
        "asset_id",
        "asset_type",
    )


def build_corpus(manuals: DataFrame, specs: DataFrame, max_chars: int = K.CHUNK_CHARS) -> DataFrame:
    return manual_chunks(manuals, max_chars).unionByName(spec_chunks(specs))
