from __future__ import annotations

import numpy as np
import pytest

from faultline.llm import ann_forest, language_id, queries, weak_quality

from .conftest import NASTY, table


def exact(ids, points, query_id, k):
    at = ids.index(query_id)
    others = [n for n in range(len(ids)) if ids[n] != query_id]
    distance = np.sqrt(((points[others] - points[at]) ** 2).sum(axis=1))
    return [(ids[others[n]], distance[n]) for n in np.lexsort((np.array(ids)[others], distance))[:k]]


def test_forest_recall_and_distances(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    ids, points = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got: dict[int, list] = {}
    for r in queries.QUERIES["op9_hash_prefix_forest"](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == {n for n in ids if n % 100 == 0}
    hits = 0
    for query_id, found in got.items():
        want = exact(ids, points, query_id, 10)
        assert [r.rank for r in found] == list(range(1, 11))
        hits += len({r.vec_id for r in found} & {n for n, _ in want})
        for r in found:
            assert r.score == pytest.approx(np.sqrt(((points[ids.index(r.vec_id)] - points[ids.index(query_id)]) ** 2).sum()), abs=1e-12)
    assert hits >= 0.9 * 10 * len(got)


def test_forest_leaves_unusable_vectors_out_and_breaks_ties(spark):
    rows = [(n * 100, [1.0, 0.0]) for n in range(15)] + [(7, [0.0, 1.0]), (8, None), (9, [0.0, 0.0]), (10, [None, 1.0]), (11, [float("nan"), 1.0]), (12, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    usable = ann_forest.usable(vectors)
    found = ann_forest.search(usable.where("vec_id % 100 = 0"), usable).orderBy("query_id", "rank").collect()
    first = [(r.vec_id, r.score) for r in found if r.query_id == 1400]
    assert first == [(n * 100, 0.0) for n in range(10)]
    assert {r.vec_id for r in found} <= {n * 100 for n in range(11)}
    none = ann_forest.usable(vectors.where("vec_id = 8"))
    assert ann_forest.search(none, none).count() == 0
    few = ann_forest.usable(vectors.where("vec_id in (0, 7)"))
    assert [(r.query_id, r.vec_id) for r in ann_forest.search(few.where("vec_id = 0"), few).collect()] == [(0, 7)]


def test_shared_prefix():
    a = np.array([0, 1, 1 << 63, (1 << 64) - 1, 0b1010], np.uint64)
    want = [64 - (int(x) ^ 0b1011).bit_length() for x in a]
    assert ann_forest.shared_prefix(a, np.uint64(0b1011)).tolist() == want


def test_language_of_nasty_texts(spark, tmp_path):
    texts = [*NASTY, "... 123 !!", "the cat sat on the mat " * 30, "der hund und die katze sind nicht hier " * 30] * 3
    langs = [None if (t or "").startswith(("İ", "日")) else "de" if "hund" in (t or "") else "en" for t in texts]
    table(spark, texts, lang=langs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op6_language_mixture"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            assert (rows[n].lang_pred, rows[n].score) == ("und", 0.0)
        else:
            assert rows[n].lang_pred in {"en", "de"} and 0 < rows[n].score <= 1
        if text and "hund" in text:
            assert rows[n].lang_pred == "de"


def test_mixture_finds_both_languages(spark):
    english, german = "the cat sat on the mat and then it went away from here ", "der hund und die katze schlafen nicht weil es regnet heute "
    docs = table(spark, [english * 20, german * 20, english * 10 + german * 10], lang=["en", "de", "en"])
    model = language_id.Model.of(language_id.count(docs.where("doc_id < 2")))
    rows = language_id.identify(docs, model).orderBy("doc_id").collect()
    assert [[x.lang for x in r.languages] for r in rows[:2]] == [["en"], ["de"]]
    assert {x.lang for x in rows[2].languages} == {"en", "de"} and abs(rows[2].score - 0.5) < 0.1
    empty = language_id.Model.of(language_id.count(docs.limit(0)))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    accuracy = [0.9, 0.8, 0.65, 0.55]
    votes = np.array([[weak_quality.GOOD if (rng.random() < a) == t else weak_quality.BAD for a in accuracy] for t in truth])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.LabelModel(4).fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.08
    assert [model.table[k, 0, weak_quality.GOOD] for k in range(4)] == pytest.approx(accuracy, abs=0.08)


def test_quality_on_documents_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "ANNOTATED", 2000)
    monkeypatch.setattr(weak_quality, "TRAINED", 2000)
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    used = {r.labelled_id for r in weak_quality.annotations(labels).collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op8_weak_label_quality"](spark, folder).collect()}
    rest = [r for r in labels.collect() if r.doc_id not in used]
    good = [rows[r.doc_id] for r in rest if r.quality == 1]
    bad = [rows[r.doc_id] for r in rest if r.quality == 0]
    assert sum(r.score >= 0.5 for r in good) >= 0.93 * len(good)
    assert sum(r.score < 0.5 for r in bad) >= 0.9 * len(bad)


def test_one_id_with_many_rows_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "TRAINED", 10)
    seen = []
    fit = weak_quality.fit_linear
    monkeypatch.setattr(weak_quality, "fit_linear", lambda buckets, target: seen.append([b.tolist() for b in buckets]) or fit(buckets, target))
    rows = [(1, f"text {n} of the hot id") for n in range(40)] + [(1, "the hot id")] * 40 + [(n, f"document number {n} alone") for n in range(2, 30)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (rows, rows[::-1]):
        weak_quality.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    own = [weak_quality.features([t])[0].tolist() for n, t in rows if n != 1]
    assert len(seen[0]) == 10 and sum(b in own for b in seen[0]) == 9
    assert seen[0] == seen[1] == seen[2] == seen[3]


def test_quality_of_nasty_texts(spark, tmp_path):
    table(spark, NASTY).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op8_weak_label_quality"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(NASTY) and not any(rows[n].kept for n, t in enumerate(NASTY) if not (t or "").strip())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = table(spark, [])
    assert weak_quality.judge(empty, weak_quality.train(empty, labels)).count() == 0
