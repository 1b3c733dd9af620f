from __future__ import annotations

import random
import re
from collections import Counter

from faultline.llm import license_scan, quality_rules, queries

from .conftest import NASTY, table


def rules(text):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words by hand."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[n : n + 5]) for n in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {at + k for at, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words)


def check_rules(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        chars, symbols, dup, repeat, n = rules(texts[row.doc_id])
        assert (row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.n_words) == (chars, symbols, dup, repeat, n)
        assert row.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (row.kept and row.base_failed)


def test_rules_by_hand(spark, tmp_path):
    rng = random.Random(9)
    texts = [*NASTY, *(" ".join(rng.choices(["a", "b", "c|", "#d", "\n", "é"], k=rng.randrange(60))) for _ in range(80)), "one two three four five six " * 800]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0, "x"), (None, None, None, None)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    check_rules(queries.QUERIES["op3_ngram_likelihood_ratio"](spark, str(tmp_path)).collect(), texts)


def test_verdict_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op3_ngram_likelihood_ratio"](spark, folder).collect()}
    check_rules(list(rows.values()), {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()})
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_every_trusted_document_is_counted(spark):
    n = 20_100
    docs = spark.range(n).selectExpr("id AS doc_id", "'a b' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "cast(null AS int) AS toxic")
    trusted = quality_rules.trusted_docs(docs, labels.unionByName(labels.limit(5)))
    assert trusted.count() == quality_rules.trusted_ids(labels).count() == n
    # All documents are trusted, so that both models are the same.
    assert set(quality_rules.weights(docs, trusted)) == {0.0}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(table(spark, []), labels).count() == 0
    assert quality_rules.judge(table(spark, ["a b"] * 3), labels).count() == 3
    assert license_scan.scan(table(spark, [])).count() == 0


def places(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in license_scan.PHRASES.items():
        want = phrase.split()
        found += [(n, label) for n in range(len(words)) if words[n : n + len(want)] == want]
    return len(words), found


def test_license_places_by_hand(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["under", "the", "MIT", "license", "apache", "License,", "Version", "2", "cc", "by-nc", "CC", "BY", "nc", "é", "K", "gnu general public license"]
    texts = [*NASTY, "under the MIT License", "cc by nc cc by nc", *(" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(200)), "All rights reserved.", "cc-by-nc " * 500]
    docs = table(spark, texts)
    docs.unionByName(docs.where("doc_id = 11")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op4_diagonal_voting"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        n, found = places(texts[row.doc_id])
        starts = [at for at, _ in found]
        assert (row.n_words, row.n_base) == (n, len(found)), texts[row.doc_id]
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in found})
        assert row.base_labels == ",".join(base)
        labels = [x for x in row.labels.split(",") if x]
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= row.score <= 1
    assert next(r.labels for r in rows if texts[r.doc_id] == "All rights reserved.") == "all-rights-reserved"


def test_a_span_with_an_inserted_word_is_found(spark):
    notice = "redistribution and use in source and also binary forms with or without modification are permitted provided that"
    rows = license_scan.scan(table(spark, [notice, "gnu general public license version 3"])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["bsd", "gpl-3"] or rows[0].labels == "bsd" and "gpl-3" in rows[1].labels and "gpl-2" not in rows[1].labels


def test_license_scan_carries_no_words_beside_a_place(spark):
    text = "word " * 150_000 + "under the mit license " + "word " * 150_000
    docs = table(spark, [text, "short", None])
    voted = license_scan.votes(docs)
    plan = voted._jdf.queryExecution().optimizedPlan().toString()
    explode = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "scanned" not in explode and "Generate posexplode(hashes" in explode
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.base_labels) for r in license_scan.scan(docs).collect()}
    assert found == {0: (300_004, 1, 150_000, "mit"), 1: (1, 0, None, ""), 2: (0, 0, None, "")}
