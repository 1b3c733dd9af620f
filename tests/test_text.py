"""Corpus, embedding, retrieval, diagnosis parsing and models."""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.functions import hashing, vectors
from faultline.functions.text import pack_paragraphs
from faultline.operators import corpus, diagnosis, retrieval
from faultline.operators.models import EmbeddingModel, TextModel, embed, predict
from faultline.plans import registry
from faultline.plans.registry import hash_model
from faultline.sources.readers import read_manuals


def test_chunk_boundary():
    a, b = "a" * 373, "b" * 375
    assert pack_paragraphs(f"{a}\n\n{b}", 750) == [f"{a}\n\n{b}"]
    assert pack_paragraphs(f"{a}\n\n{b}b", 750) == [a, b + "b"]
    big = "x" * 900
    assert pack_paragraphs(f" {a} \n\n\n\n{big}\n\n\t\n\n{b}", 750) == [a, big, b]
    assert pack_paragraphs("y" * 749, 750) == ["y" * 749]
    assert pack_paragraphs(" para \n\n 　 ", 750) == ["para"]
    assert pack_paragraphs("", 750) == []


def test_manual_files_whole_and_scoped(spark, tmp_path):
    (tmp_path / "pump_vibration_maintenance.md").write_bytes(b"one\r\n\r\ntwo")
    (tmp_path / "other.md").write_text("three")
    (tmp_path / "skip.txt").write_text("no")
    rows = corpus.manual_chunks(read_manuals(spark, str(tmp_path)), max_chars=6).orderBy("source", "chunk").collect()
    assert [(r.source, r.chunk, r.text, r.asset_id, r.asset_type) for r in rows] == [
        ("other.md", 0, "three", "", "all"),
        ("pump_vibration_maintenance.md", 0, "one", "", "water_pump"),
        ("pump_vibration_maintenance.md", 1, "two", "", "water_pump"),
    ]


def plain_embedding(text, dim):
    out = [0.0] * dim
    for token in re.findall("[a-z0-9]+", text.lower()):
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        out[h % dim] += 1.0 if (h >> 8) % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


@pytest.mark.parametrize("dim", [7, 64, 3072])
def test_hash_embedding_equals_the_definition(spark, dim):
    texts = ["Transformer temp_c anomaly", "a a b A", "", "!!", "été 5µm Ünïcode", " ".join(f"w{i}" for i in range(500)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", hashing.hash_embedding(F.col("t"), dim).alias("v")).orderBy("i").collect()
    for row, text in zip(rows, texts, strict=True):
        assert row.v == pytest.approx(plain_embedding(text or "", dim), abs=1e-6)


def test_embedding_model_batches_checks_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma")], "i int, t string")
    rows = embed(df, "t", hash_model(32)).orderBy("i").collect()
    assert [r.i for r in rows] == [1, 3]
    assert rows[0].embedding == pytest.approx(plain_embedding("alpha beta", 32), abs=1e-6)
    wrong = EmbeddingModel("wrong", 8, lambda texts: [[0.0] * 7 for _ in texts], retries=0)
    with pytest.raises(Exception, match="dimension"):
        embed(df, "t", wrong).collect()


def test_cosine_edge_cases(spark):
    pairs = [([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0, 0.0], [0.0, 1.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    got = [r.c for r in df.select("i", vectors.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.0, 0.0, 0.0])


def brute_top(queries, rows, k):
    out = set()
    for q, qv in queries:
        scored = []
        for i, v in rows:
            n = (np.linalg.norm(qv) or 1.0) * (np.linalg.norm(v) or 1.0)
            scored.append((-round(float(np.dot(qv, v)) / n, 9), i))
        out |= {(q, rank + 1, i) for rank, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("limits", [{}, {"block_rows": 7}, {"broadcast_values": 1, "block_rows": 16}])
def test_vector_search_equals_brute_force(spark, limits):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).astype(float)) for i in range(60)]
    queries = [(f"q{i}", rng.integers(-2, 3, 6).astype(float)) for i in range(9)]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "q string, qvec array<double>")
    got = retrieval.vector_search(q, c, query_id="q", corpus_id="id", k=3, dim=6, **limits)
    assert {(r.q, r.rank, r.id) for r in got.collect()} == brute_top(queries, rows, 3)


def test_vector_search_sparse_equals_dense(spark):
    texts = [(f"t{i}", " ".join(f"w{i * j % 11}" for j in range(1, 5))) for i in range(20)] + [("empty", "")]
    df = spark.createDataFrame(texts, "id string, t string").withColumns(
        {"s": hashing.sparse_hash_vector(F.col("t"), 50), "d": hashing.hash_embedding(F.col("t"), 50)}
    )
    q = df.select(F.col("id").alias("q"), F.col("s").alias("sq"), F.col("d").alias("dq"))
    found = [
        {(r.q, r.rank, r.id) for r in retrieval.vector_search(
            q, df, query_id="q", corpus_id="id", k=3, dim=50, query_vector=qv, vector=v).collect()}
        for qv, v in (("sq", "s"), ("dq", "d"))
    ]
    assert found[0] == found[1]


def test_many_queries_are_asked_in_rounds_that_copy_no_vector(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 30, rng.integers(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, t string").select("id", hashing.sparse_hash_vector(F.col("t"), 40).alias("s"))
    q = df.filter("id < 60").select(F.col("id").alias("q"), F.col("s").alias("sq"))
    options = {"query_id": "q", "corpus_id": "id", "k": 4, "dim": 40, "query_vector": "sq", "vector": "s"}
    many = retrieval.vector_search(q, df, broadcast_values=300, block_rows=8, **options)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "Generate" not in plan and "CoGroup" not in plan
    dense = np.zeros((150, 40))
    for row in df.collect():
        dense[row.id, row.s.at] = row.s.w
    pairs = list(enumerate(dense))
    assert {(r.q, r.rank, r.id) for r in many.collect()} == brute_top(pairs[:60], pairs, 4)


def test_rows_that_cannot_beat_the_best_are_not_ranked(monkeypatch):
    rng = np.random.default_rng(9)
    rows = rng.integers(-2, 3, (4000, 5)).astype(float)
    ranked, first = [], retrieval._first
    monkeypatch.setattr(retrieval, "_first", lambda scores, k: ranked.append(scores.size) or first(scores, k))
    queries = np.concatenate([rng.integers(-2, 3, (40, 5)).astype(float), rng.normal(size=(40, 5))])
    best = retrieval._Best(retrieval._Asked(pd.DataFrame({"_query": range(80), "_at": None, "_values": list(queries)}), 5), 3, 5, [])
    ids = rng.permutation(4000)
    for start in range(0, 4000, 100):
        part = slice(start, start + 100)
        nothing = pa.nulls(100, pa.list_(pa.int32()))
        best.add(pa.RecordBatch.from_pydict({"_id": pa.array(ids[part]), "_at": nothing, "_values": pa.array(rows[part].tolist())}))
    best.merge()
    got = best.held.to_pandas()
    got["rank"] = got.groupby("_at").cumcount() + 1
    assert sum(ranked) < 80 * 4000 / 4
    assert {(q, r, i) for q, r, i in zip(got["_at"], got["rank"], got["_id"], strict=True)} == brute_top(list(enumerate(queries)), list(zip(ids, rows, strict=True)), 3)


def test_vector_search_of_nothing(spark):
    c = spark.createDataFrame([(1, [1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([], "q string, qvec array<float>")
    assert retrieval.vector_search(q, c, query_id="q", corpus_id="id", k=3, dim=1).count() == 0
    with pytest.raises(Exception, match="length"):
        wrong = spark.createDataFrame([("q", [1.0, 2.0])], "q string, qvec array<float>")
        retrieval.vector_search(wrong, c, query_id="q", corpus_id="id", k=3, dim=1).collect()


def test_a_block_is_ranked_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(3)
    queries, rows = rng.integers(-1, 2, (300, 4)).astype(float), rng.integers(-1, 2, (500, 4)).astype(float)
    held = []
    first = retrieval._first
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", 4000)
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 4 * 90)
    monkeypatch.setattr(retrieval, "_first", lambda scores, k: held.append(scores.size) or first(scores, k))
    frame = pd.DataFrame({"_id": rng.permutation(500), "_at": None, "_values": list(rows)})
    found = retrieval._best_in_blocks((np.arange(300), queries, retrieval._norms(queries)), frame, 3, 4)
    assert max(held) <= 4000
    ranked = found.groupby("_query").cumcount() + 1
    got = {(q, r, i) for q, r, i in zip(found["_query"], ranked, found["_id"], strict=True)}
    assert got == brute_top(list(enumerate(queries)), list(zip(frame["_id"], rows, strict=True)), 3)


def test_lsh_finds_most_true_neighbours_and_ranks_exactly(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 16))
    rows = [(i, (centres[i % 10] + 0.05 * rng.standard_normal(16))) for i in range(300)]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id int, embedding array<double>")
    q = c.limit(30).select(F.col("id").alias("q"), F.col("embedding").alias("qvec"))
    options = {"query_id": "q", "corpus_id": "id", "k": 3, "dim": 16}
    exact = {(r.q, r.id) for r in retrieval.vector_search(q, c, **options).collect()}
    found = {(r.q, r.id) for r in retrieval.vector_search_lsh(q, c, tables=8, planes=4, **options).collect()}
    assert len(found & exact) / len(exact) > 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_lsh_finds_nine_tenths_of_the_other_neighbours(spark, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    length = np.linalg.norm(matrix, axis=1)
    scores = np.round(matrix @ matrix.T / np.outer(length, length), 9)
    best = {ids[n]: ids[np.lexsort((ids, -scores[n]))[:3]] for n in range(len(ids))}
    exact = {(q, i) for q, found in best.items() for i in found if i != q}
    given = {(r.query_id, r.vec_id) for r in registry.vector_top3_lsh(spark, folder).collect()}
    assert len(given & exact) >= 0.9 * len(exact)
    reported = registry.vector_lsh_recall(spark, folder).first()
    assert (reported.neighbours, reported.found) == (len(exact), len(given & exact))


def contextual(spark, **change):
    row = {
        "incident_id": "i1", "asset_id": "A", "asset_type": "transformer", "region": "North", "severity": "critical",
        "signal": "temp_c", "value": 102.0, "fault_score": 0.9, "zscore": 1.0, "tie_assets": "", "warning_temp_c": 85.0,
        "critical_temp_c": 95.0, "rated_load_mw": 100.0, "context_text": "c" * 300, "context_source": "m1, m2", **change,
    }
    types = ", ".join(f"{c} {'double' if c in ('value', 'fault_score', 'zscore', 'warning_temp_c', 'critical_temp_c', 'rated_load_mw') else 'string'}" for c in row)
    return spark.createDataFrame([tuple(row.values())], types)


def test_prompt_text(spark):
    got = contextual(spark, context_text="ctx").select(diagnosis.prompt().alias("p")).first().p
    assert got == (
        "INCIDENT: asset=A type=transformer signal=temp_c value=102.0 severity=critical fault_score=0.9 tie_assets=[]"
        "  ENVELOPE: warning_temp_c=85.0 critical_temp_c=95.0 rated_load_mw=100.0  CONTEXT (m1, m2): ctx"
    )


@pytest.mark.parametrize(
    "answer, cause, action, confidence",
    [
        ('{"root_cause":"r","recommended_action":"isolate","rationale":"y","confidence":0.75}', "r", "isolate", 0.75),
        ('{"root_cause":{"a":1},"recommended_action":["isolate"],"confidence":"0.5"}', None, "dispatch_crew", 0.5),
        ('{"root_cause":7,"recommended_action":null,"confidence":"high"}', "7", "dispatch_crew", None),
        ('{"root_cause":"{not json}","recommended_action":"explode"}', "{not json}", "explode", None),
        ("no json at all", None, "dispatch_crew", None),
        (None, None, "dispatch_crew", None),
    ],
)
def test_answers_are_parsed_strictly(spark, answer, cause, action, confidence):
    model = TextModel("fake", lambda system, prompts: [answer for _ in prompts])
    row = diagnosis.reasoned(contextual(spark), model).first()
    assert (row.dx_root_cause, row.dx_recommended_action, row.dx_confidence) == (cause, action, confidence)
    assert row.dx_method == "fake+vector-rag"
    assert (row.dx_citations[0].source, len(row.dx_citations[0].snippet)) == ("m1, m2", 200)


def test_unscored_incident_gets_no_call_but_a_crew(spark):
    def refuse(system, prompts):
        raise AssertionError("called")

    row = diagnosis.reasoned(contextual(spark, fault_score=None), TextModel("fake", refuse, retries=0)).first()
    assert (row.incident_id, row.dx_root_cause, row.dx_recommended_action) == ("i1", None, "dispatch_crew")


def test_model_is_called_once_per_row_in_batches(spark):
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(10)], "prompt string").coalesce(1)
    model = TextModel("echo", lambda system, batch: [json.dumps([len(batch), p]) for p in batch], batch_size=4)
    got = [json.loads(r.output) for r in predict(prompts, "prompt", model).collect()]
    assert sorted(p for _, p in got) == sorted(f"p{i}" for i in range(10))
    assert max(n for n, _ in got) == 4


@pytest.mark.parametrize(
    "change, action",
    [
        ({"signal": "vibration_mm_s"}, "isolate"),
        ({"signal": "vibration_mm_s", "severity": "warning"}, "dispatch_crew"),
        ({"signal": "oil_pressure_kpa"}, "dispatch_crew"),
        ({"tie_assets": "B"}, "reroute_load"),
        ({}, "throttle_load"),
        ({"severity": "warning", "fault_score": 0.2}, "monitor"),
    ],
)
def test_rule_model(spark, change, action):
    assert diagnosis.reasoned(contextual(spark, **change)).first().dx_recommended_action == action


def test_context_joins_up_to_three_hits(spark):
    hit = "struct<rank:int,text:string,source:string,score:double>"
    df = spark.createDataFrame(
        [(1, [(1, "a", "s1", 0.9), (2, "b", "s2", 0.8), (3, "c", "s3", 0.7)]), (2, [(1, "a", "s1", 0.9)]), (3, [(1, "a", "s1", 0.9), (2, None, "s2", 0.8)])],
        f"i int, hits array<{hit}>",
    )
    got = {r.i: (r.context_text, r.context_source) for r in diagnosis.with_context(df).collect()}
    assert got == {1: ("a --- b --- c", "s1, s2, s3"), 2: ("a", "s1"), 3: (None, "s1, s2")}


def test_spec_sheet_leaves_out_zero_values(spark):
    values = {
        "asset_id": "P", "name": "Pump", "asset_type": "water_pump", "region": "North", "substation": "S", "voltage_kv": 11,
        "criticality": "high", "install_year": 2010, "rated_load_mw": 0.0, "nominal_temp_c": 50.0, "warning_temp_c": 0.0,
        "critical_temp_c": 92.0, "nominal_vibration_mm_s": 1.8, "warning_vibration_mm_s": 7.1, "nominal_oil_pressure_kpa": 320.0,
        "tie_assets": ["X", "Y"], "spec_sheet_id": "spec-P",
    }
    schema = "asset_id string, name string, asset_type string, region string, substation string, voltage_kv int, criticality string, install_year int, rated_load_mw double, nominal_temp_c double, warning_temp_c double, critical_temp_c double, nominal_vibration_mm_s double, warning_vibration_mm_s double, nominal_oil_pressure_kpa double, tie_assets array<string>, spec_sheet_id string"
    row = corpus.spec_documents(spark.createDataFrame([tuple(values.values())], schema)).first()
    assert "Rated load" not in row.spec_text and "Temperature" not in row.spec_text
    assert "nominal 1.8 mm/s, warning 7.1 mm/s" in row.spec_text
    assert "transfer: X, Y." in row.spec_text
    assert row.spec_text.endswith(f"{K.REFERENCE_GUIDE['water_pump']} for the full response procedure.")
