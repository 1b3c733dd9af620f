"""Diagnosis: query text, retrieved context, prompt, model answer, and the gated branch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import schemas
from faultline.functions.hashing import sparse_hash_vector
from faultline.operators.incidents import gated_in, gated_out
from faultline.operators.models import TextModel, predict
from faultline.operators.retrieval import gather_hits, vector_search
from faultline.session import materialize

#: Query texts whose hits, at most k chunks each, are broadcast to the incidents.
BROADCAST_TEXTS = 4096

CARRIED = (
    "incident_id", "asset_id", "asset_type", "region", "severity", "signal", "value", "fault_score",
    "zscore", "tie_assets", "warning_temp_c", "critical_temp_c", "rated_load_mw", "ts",
)


def query_text() -> Column:
    """NULL if any part is, so such an incident retrieves nothing."""
    return F.concat(
        F.col("asset_type"), F.lit(" "), F.col("signal"), F.lit(" anomaly (severity "), F.col("severity"),
        F.lit("). Root cause and recommended response action."),
    )


def retrieve(
    incidents: DataFrame,
    corpus: DataFrame,
    *,
    chunk_id: str,
    k: int = K.RETRIEVAL_K,
    dim: int = K.EMBEDDING_DIM,
    embedding: Callable[[Column], Column] | None = None,
    vector: str = "embedding",
) -> DataFrame:
    """Gated incidents with the array of their top-k corpus hits; without a hit a row is dropped.

    Incidents share few distinct query texts (type x signal x severity), so texts are
    deduplicated, embedded and searched once each and the hits joined back.
    """
    embed_text = embedding or (lambda text: sparse_hash_vector(text, dim))
    gated = gated_in(incidents).withColumn("query_text", query_text())
    # Stored: the search looks at the texts more than once, and their number decides the join below.
    texts = materialize(gated.select("query_text").filter(F.col("query_text").isNotNull()).distinct())
    queries = texts.withColumn("qvec", embed_text(F.col("query_text")))
    shown = ["text", "source"]
    hits = vector_search(
        queries, corpus, query_id="query_text", corpus_id=chunk_id, k=k, dim=dim, vector=vector, carried=shown
    )
    gathered = gather_hits(hits, query_id="query_text", columns=shown)
    if texts.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        gathered = F.broadcast(gathered)  # at most k chunks for each text, so no incident moves
    return gated.join(gathered, "query_text").select(*CARRIED, "hits")


def with_context(retrieved: DataFrame) -> DataFrame:
    """Texts and sources of up to three hits, joined in rank order; NULL if any text is NULL."""

    def joined(field: str, separator: str) -> Column:
        parts = F.transform(F.slice("hits", 1, K.RETRIEVAL_K), lambda h: h[field])
        missing = F.exists(parts, lambda p: p.isNull())
        return F.when(~missing, F.array_join(parts, separator))

    return retrieved.withColumns(
        {"context_text": joined("text", K.CONTEXT_SEPARATOR), "context_source": joined("source", ", ")}
    ).drop("hits")


def prompt() -> Column:
    def shown(name: str) -> Column:
        return F.col(name).cast("string")

    # Prompt wording.
    return F.concat(
        F.lit("INCIDENT: asset="), F.col("asset_id"),
        F.lit(" type="), F.col("asset_type"),
        F.lit(" signal="), F.col("signal"),
        F.lit(" value="), shown("value"),
        F.lit(" severity="), F.col("severity"),
        F.lit(" fault_score="), shown("fault_score"),
        F.lit(" tie_assets=["), F.col("tie_assets"),
        F.lit("]  ENVELOPE: warning_temp_c="), shown("warning_temp_c"),
        F.lit(" critical_temp_c="), shown("critical_temp_c"),
        F.lit(" rated_load_mw="), shown("rated_load_mw"),
        F.lit("  CONTEXT ("), F.col("context_source"),
        F.lit("): "), F.col("context_text"),
    )


RULE_MODEL_NAME = "rules"


def rule_answer() -> Column:
    """Offline stand-in for a language model: the operating procedure as a decision list.

    Emits the same JSON keys a model must answer with, so parsing is exercised too.
    """
    signal, severity = F.col("signal"), F.col("severity")
    mechanical = signal.isin("vibration_mm_s", "oil_pressure_kpa")
    action = (
        F.when((signal == "vibration_mm_s") & (severity == "critical"), "isolate")
        .when(mechanical, "dispatch_crew")
        .when((severity == "warning") & (F.col("fault_score") < K.GATE_FAULT_SCORE), "monitor")
        .when(F.col("tie_assets") != "", "reroute_load")
        .otherwise("throttle_load")
    )
    cause = F.concat(
        F.when(mechanical, "Mechanical fault").otherwise("Thermal or load excursion"),
        F.lit(" on "), F.col("asset_type"), F.lit(" indicated by "), signal,
    )
    rationale = F.concat(F.lit("Severity "), severity, F.lit("; see "), F.col("context_source"))
    answer = F.struct(
        cause.alias("root_cause"),
        action.alias("recommended_action"),
        rationale.alias("rationale"),
        F.round(0.5 + F.coalesce("fault_score", F.lit(0.0)) * 0.45, 4).alias("confidence"),
        F.col("context_source").alias("citation"),
    )
    return F.to_json(answer)


def _json_scalar(parsed: Column, key: str) -> Column:
    """A top-level scalar as text; NULL for objects, arrays, JSON null and missing keys."""
    value = F.try_element_at(parsed, F.lit(key))
    kind = F.schema_of_variant(value)
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), value.cast("string"))


def parse_answer(answered: DataFrame, method: str, output: str = "output") -> DataFrame:
    """Diagnosed rows from the model's JSON. Unreadable answers leave NULLs and call a crew."""
    parsed = answered.withColumn("_answer", F.from_json(output, "map<string,variant>"))
    answer = F.col("_answer")
    citation = F.struct(
        F.col("context_source").alias("source"),
        F.substring("context_text", 1, K.SNIPPET_CHARS).alias("snippet"),
    )
    return parsed.withColumns(
        {
            "dx_root_cause": _json_scalar(answer, "root_cause"),
            "dx_recommended_action": F.coalesce(_json_scalar(answer, "recommended_action"), F.lit(K.MISSING_ACTION)),
            "dx_rationale": _json_scalar(answer, "rationale"),
            "dx_confidence": _json_scalar(answer, "confidence").try_cast("double"),
            "dx_citations": F.array(citation),
            "dx_method": F.lit(method),
        }
    ).drop("_answer")


def _diagnosed_columns(df: DataFrame, as_of: Column | None) -> DataFrame:
    when = F.current_timestamp() if as_of is None else as_of
    return df.withColumn("diagnosed_ts", when).select(*schemas.DIAGNOSED.names)


def gated_skip(incidents: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Constant diagnosis for incidents the gate keeps from the model."""
    constant = {
        "dx_root_cause": F.lit(K.GATED_ROOT_CAUSE),
        "dx_recommended_action": F.lit("monitor"),
        "dx_rationale": F.lit(K.GATED_RATIONALE),
        "dx_confidence": F.lit(K.GATED_CONFIDENCE),
        "dx_citations": F.lit(None).cast(schemas.CITATIONS_TYPE),
        "dx_method": F.lit(K.GATED_METHOD),
    }
    return _diagnosed_columns(gated_out(incidents).withColumns(constant), as_of)


def reasoned(contextual: DataFrame, model: TextModel | None = None, as_of: Column | None = None) -> DataFrame:
    """Diagnosis of incidents with context, by ``model`` or else by the offline rules.

    An incident whose prompt is NULL (say, without a score) gets no model call; like
    any incident without a usable answer it is sent a crew.
    """
    prompted = contextual.withColumn("prompt", prompt())
    if model is None:
        answered = prompted.withColumn("output", F.when(F.col("prompt").isNotNull(), rule_answer()))
        name = RULE_MODEL_NAME
    else:
        answered, name = predict(prompted, "prompt", model), model.name
    return _diagnosed_columns(parse_answer(answered, name + K.RAG_METHOD_SUFFIX), as_of)


def diagnose(
    incidents: DataFrame,
    contextual: DataFrame,
    model: TextModel | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Both branches of the gate as one table."""
    return reasoned(contextual, model, as_of).unionByName(gated_skip(incidents, as_of))
