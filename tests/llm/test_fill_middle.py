from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from faultline.llm import fill_middle
from tests.llm.conftest import NASTY, table

LINE = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = [*NASTY, "a\nb", "a\nb\n", "\n", "x <P> y\nz", "<M>", "<\n<S\n", "𝒳 y\n z\x85w", "  lead and\ttail  \n", "one\r\ntwo\r\n"]


def plain(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    """The same by the definition, a text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * n : 8 * n + 8], 16) for n in range(4)]
    units = words(text) if unit == "word" else LINE.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def words(text):
    """Words with the white space after them, the first one also with that before it."""
    starts = [n for n, c in enumerate(text) if not c.isspace() and (n == 0 or text[n - 1].isspace())]
    if not starts:
        return [text] if text else []
    return [text[a:b] for a, b in zip([0, *starts[1:]], [*starts[1:], len(text)], strict=True)]


@pytest.mark.parametrize("unit", ["line", "word"])
def test_equals_the_definition_and_restores(spark, sample, unit):
    rows = [*sample, *((10**6 + n, t) for n, t in enumerate(TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = fill_middle.transform(docs, unit=unit).withColumn("again", fill_middle.restore()).collect()
    assert {r.doc_id: tuple(r[:6]) for r in done} == {i: plain(i, t, unit) for i, t in rows}
    assert {r.doc_id: r.again for r in done} == {i: t or "" for i, t in rows}


def test_rates_take_effect(spark, sample):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    done = fill_middle.transform(docs, rate=40, spm=25, seed=3).collect()
    assert {tuple(r) for r in done} == {plain(i, t, rate=40, spm=25, seed=3) for i, t in sample}
    assert {"plain", "psm", "spm"} == {r.form for r in done}


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, "a\nb\n", 1, "x"), (None, None, 2, "y"), (5, "a\nb\n", 3, "z"), (5, "a\nb\n", 3, "z"), (5, "c\n", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 int, form string")
    got = sorted((tuple(r) for r in fill_middle.transform(docs).collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t, *_ in rows), key=repr)
    assert fill_middle.transform(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fill_middle.transform(docs, unit="page")


def test_very_long_texts_beside_short_ones(spark):
    texts = ["line of words\n" * 200_000, "x" * 3_000_000, "\n" * 500_000, "short\ntext", ""]
    docs = table(spark, texts)
    assert sorted(tuple(r) for r in fill_middle.transform(docs).collect()) == sorted(plain(n, t) for n, t in enumerate(texts))


def test_wavelet_ranks_and_places():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for symbol in range(8):
            counted = np.concatenate([[0], np.cumsum(symbols == symbol)])
            assert (matrix.rank(symbol, at) == counted).all()
            wanted = np.arange(1, counted[-1] + 1)
            found = matrix.reach((symbol,), wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), size))
            assert (found == np.flatnonzero(symbols == symbol) + 1).all()
