from __future__ import annotations

import regex

import corpus_pipeline
from faultline.llm import language_id, pii

from .conftest import NASTY
from .test_ngram_join import brute as near_copies
from .test_packing import check


def documents(spark, texts):
    rows = [(n, t, ("en", "de")[n % 2], f"src{n % 3}", len(t or ""), "x") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def brute_cut(rows):
    """Texts without the bytes of windows that a smaller id holds."""
    least: dict[bytes, int] = {}
    for n, text in rows.items():
        raw = text.encode()
        for at in range(len(raw) - 49):
            least[raw[at : at + 50]] = min(n, least.get(raw[at : at + 50], n))
    out = {}
    for n, text in rows.items():
        raw = text.encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - 49):
            if least[raw[at : at + 50]] < n:
                gone[at : at + 50] = [True] * 50
        kept, run = "", b""
        for byte, g in [*zip(raw, gone, strict=True), (0, True)]:
            if g:
                kept, run = kept + run.decode("utf-8", "ignore"), b""
            else:
                run += bytes([byte])
        if not any(gone) or kept:
            out[n] = kept
    return out


def test_stages_match_plain_versions(spark, sample):
    texts = [*NASTY, *(t for _, t in sorted(sample)[:110])]
    docs = documents(spark, texts)
    first = corpus_pipeline.identify_language(spark, docs, "")
    assert first.columns == list(corpus_pipeline.COLUMNS)
    kept = {n: t for n, t in enumerate(texts) if t and regex.search(r"\p{L}", t)}
    assert rows_of(first) == kept
    second = corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "")
    alone = {n for n, (_, c) in near_copies(list(enumerate(texts))).items() if c == n}
    assert rows_of(second).keys() == alone
    third = corpus_pipeline.cut_repeats(spark, docs, "")
    assert third.columns == list(corpus_pipeline.COLUMNS)
    assert rows_of(third) == brute_cut({n: t or "" for n, t in enumerate(texts)})
    hidden = corpus_pipeline.hide_personal_data(spark, docs, "").collect()
    for row in hidden:
        assert not pii.base_spans(row.text or "")
        if not pii.base_spans(texts[row.doc_id] or ""):
            assert row.text == texts[row.doc_id]
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert check(packed, texts)[0] < 2048


def test_run_over_the_smallest_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id"} <= set(rows[0].asDict())
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, "").count() == 0


def test_language_is_learnt_from_the_training_part(spark, sample):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(table, language_id.train(table)).where(language_id.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 and abs(sum(x.share for x in r.languages) - 1) < 0.01 for r in found if r.languages)
