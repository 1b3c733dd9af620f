from __future__ import annotations

import pytest

NASTY = [
    None, "", " ", "\n\n", "a", "a" * 3000, "İstanbul ΣΑΣ Σ. é café <|endoftext|> it's <|startoftext|>x <|ENDOFTEXT|>",
    "日本語 テスト 12３ ''s \"'s 'sand 'tis i'm we're they've 'll 'd", "\x00\x1c\x1d a\x00 b", "ﬁ ǅ ß ẞ K Å x̂y été", "one two one two one two",
]


def table(spark, texts, **columns):
    """Documents with the given texts; ids count from 0, and a column ``words`` clashes with internal names."""
    rows = [(n, t, "noise", -1, *(v[n] for v in columns.values())) for n, t in enumerate(texts)]
    kinds = {int: "long", str: "string", float: "double"}
    extra = "".join(f", {k} {kinds[type(next(x for x in v if x is not None))]}" for k, v in columns.items())
    return spark.createDataFrame(rows, f"doc_id long, text string, words string, length long{extra}")


@pytest.fixture(scope="session")
def sample(spark):
    """The texts of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
