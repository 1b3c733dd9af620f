from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from faultline.llm import pii, queries

from .conftest import NASTY, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    pieces = ["a@b.co", "@", ".", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", " ", "-", "x", "é", "12", "@@", "a.b@c-d.e.f@g.h"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(12)))
        assert pii.base_spans(text) == brute(text), text


def test_repeated_value_in_another_form_is_added():
    field = pii.Potentials.of([], [])
    text = "call +1 (555) 123-4567 now, again 5551234567 there; order 8881234567 stays. 5551234567"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field)
    assert [text[a:b] for _, a, b in added] == ["5551234567", "5551234567"]
    assert {k for k, _, _ in added} == {"phone"}
    assert pii.added_spans("order 8881234567 and 8881234567", [], field) == []


def test_repeated_value_in_parted_groups_is_added():
    field = pii.Potentials.of([], [])
    base = "call +1 (555) 123-4567 now, "
    forms = ["(555) 123-4567", "555 123 4567", "555-123 4567", "1 555 123 4567", "555 1234567", "[555] 123 - 4567", "555\n123\u20134567", "5551234567"]
    for form in forms:
        for text in (f"{base}or {form}", f"{base}or tel:{form}, thanks", f"{base}row 7: {form} 2024 12", f"{base}12 {form};{form} end"):
            added = pii.added_spans(text, pii.base_spans(text), field)
            assert len(added) == text[len(base) :].count(form), text
            assert {k for k, _, _ in added} == {"phone"}
            assert {text[a:b].removeprefix("tel:") for _, a, b in added} == {form}, text
    for text in (f"{base}or 555 123 4568", f"{base}or 555 123", f"{base}or 555, 123, 4567", f"{base}or 9555 123 45670"):
        assert pii.added_spans(text, pii.base_spans(text), field) == [], text


def test_digit_groups_of_one_number_are_one_node():
    def parts(text):
        return [text[a:b] for a, b, _ in pii.value_nodes(text, [])]

    assert parts("ask 555 123-4567 or (555) 987 6543.") == ["555 123-4567", "(555) 987 6543"]
    assert parts("in 2024 12 pages, 8881234567 12 and v1 2") == ["2024", "12", "8881234567", "12", "v1", "2"]


def test_every_shape_counts(spark):
    token, phone = "888/1234567", pii.KINDS.index("phone")
    frequent = " x ".join(f"{'1' * a}/{'2' * b}:{'3' * c}" for a in range(1, 19) for b in range(1, 17) for c in range(1, 17))
    few, many = (pii.train(table(spark, texts)) for texts in ([token, "a@b.c"], [token, frequent, frequent]))
    want = -pii.PASSED_OVER - np.log(2)
    assert few.unary(token, pii.OTHER)[phone] == pytest.approx(want)
    assert many.unary(token, pii.OTHER)[phone] == pytest.approx(want)
    # A shape that was never counted has the average of its class.
    assert few.unary("8881/234567", pii.OTHER)[phone] == pytest.approx(want)
    assert pii.Potentials.of([], []).unary(token, pii.OTHER)[phone] == -pii.PASSED_OVER


def test_query(spark, sample, tmp_path):
    texts = [*NASTY, *(t for _, t in sample[:80]), "mail a.b@c.de, A.B@C.DE? call +1 (555) 123-4567 or 5551234567", "9" * 5000, "a" * 50_000 + "@"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op2_skip_chain_pii"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute(texts[row.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PATTERNS]
        assert {x for x in joined.split(",") if x} <= set(row.spans.split(","))


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op2_skip_chain_pii"](spark, str(tmp_path)).count() == 0


def test_redact(spark):
    docs = table(spark, ["mail a@b.co or +1 (555) 123-4567.", None, "plain"])
    done = pii.redact(pii.find(docs, pii.Potentials.of([], []))).orderBy("doc_id").collect()
    assert [r.text for r in done] == ["mail <EMAIL> or <PHONE>.", None, "plain"]
