"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. The field lets the rest of a document learn from them: its nodes are the
tokens that hold a digit or an at sign, its labels the kinds and ``other``. Chain edges join neighbouring
nodes, skip edges join a node with the last earlier node of the same key, where the key keeps only what
identifies a value (the digits of a number, a lower-cased address), so that distant repetitions written in
another way share potentials. Groups of digits that blanks, brackets or dashes part are one node where they repeat
the digits of a base span, or where together they may be a number. Loopy sum-product passing runs a fixed number of rounds over all edges of a
document, forwards and backwards, and a token outside the base spans is added where a kind is more likely
than not. Nodes inside base spans are evidence.

Potentials are trained here by counting on base spans over all documents: how often a token of a shape bears
each label, and how often one label follows another. Every shape counts, in a table of ``SHAPES`` hashed counters,
where shapes that meet add up; a shape without a count has the average of its class, the kinds that its characters
allow. Skip edges agree with weight ``SKIP``; a token that the patterns passed over
starts with log-odds ``PASSED_OVER`` against every kind, so it needs support from elsewhere in the document.

Memory follows one document at a time. Defined results: a null text has no spans; overlapping base spans of
different kinds all stay; added spans never overlap base spans; rows are judged each for itself, whatever their
ids; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
OTHER = len(KINDS)
SHAPES = 1 << 18
#: Classes follow the shapes' counters: one for each set of kinds.
CLASSES = 1 << OTHER
SKIP = 5.0
PASSED_OVER = 3.0
ROUNDS = 6
LEAST_KEY = 7
#: The most digits of a number, and the digits from which a token is a number by itself.
MOST_DIGITS = 19
WHOLE_DIGITS = 9

Span = tuple[str, int, int]

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# Runs of digits are matched as a whole, so that no long run is tried again from each of its digits.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_marks = re.compile(r"[0-9@]").search
_node = re.compile(r"[0-9@]\S*").finditer
_group = re.compile(r"[0-9]+").finditer
# What may part the digit groups of a repeated value, and the tokens of one number that is not known from elsewhere.
_between = re.compile(r"[\s().\[\]\u2010-\u2015-]+").fullmatch
_beside = re.compile(r"[\x20\t\xa0()\[\]\u2010-\u2015-]+").fullmatch
_bare = re.compile(r"[0-9()\[\]\u2010-\u2015-]+").fullmatch


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if n % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (domain := _domain(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns, by start and then kind."""
    if not _marks(text):
        return []
    found = list(_emails(text))
    found += [("ip", *m.span()) for m in _ip(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _card(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _phone(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the field ----------------------------------------------------------------


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without punctuation at their ends."""
    found, end = [], 0
    for m in _node(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] == "+"):
            start += 1
        if start < end:
            found.append((start, end))
        end = m.end()
    return found


def shape(token: str) -> str:
    """Classes of characters, runs shortened and their lengths in steps."""
    runs = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 20)}", token[:64]))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", runs)[:48]


def allowed(token: str) -> list[bool]:
    """Which kinds the token's characters allow."""
    digits = sum(c in "0123456789" for c in token)
    return ["@" in token, token.count(".") >= 3 and digits >= 4, 12 <= digits <= 19, 7 <= digits <= 15]


def counter(name: str) -> int:
    """The place of a shape's counter."""
    return zlib.crc32(name.encode()) % SHAPES


def class_counter(token: str) -> int:
    return SHAPES + sum(can << k for k, can in enumerate(allowed(token)))


def key(token: str) -> str | None:
    """What tokens of one value share: an address in lower case, or at least ``LEAST_KEY`` digits."""
    if "@" in token:
        return token.lower()
    digits = "".join(c for c in token if c in "0123456789")
    if len(digits) >= LEAST_KEY:
        return digits.zfill(16)[-10:] if len(digits) < 12 else digits
    return None


def apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ascending intervals those that overlap none of ``taken``, which ascend by their starts."""
    kept, n, reach = [], 0, 0
    for start, end in found:
        while n < len(taken) and taken[n][0] < end:
            reach = max(reach, taken[n][1])
            n += 1
        if reach <= start:
            kept.append((start, end))
    return kept


def opened(text: str, start: int, end: int) -> tuple[int, int]:
    """The interval, from an opening bracket on that is closed inside."""
    closing = {"(": ")", "[": "]"}.get(text[start - 1]) if start else None
    return (start - 1, end) if closing and closing in text[start:end] else (start, end)


def repeats(text: str, taken: list[tuple[int, int]], known: dict[str, list[str]]) -> list[tuple[int, int]]:
    """Neighbouring digit groups outside ``taken`` that together have one of the known keys, as many as can be.

    ``known`` gives the digits of every key's values: a first group that neither belongs to them nor is needed is left out.
    """
    groups = apart([m.span() for m in _group(text)], taken)
    joins = [_between(text, x[1], y[0]) is not None for x, y in zip(groups, groups[1:], strict=False)]
    found, at = [], 0
    while at < len(groups):
        digits, last, value = "", None, ""
        for n in range(at, len(groups)):
            start, end = groups[n]
            if len(digits) + end - start > MOST_DIGITS:
                break
            digits += text[start:end]
            if key(digits) in known:
                last, value = n, digits
            if n < len(joins) and not joins[n]:
                break
        if last is not None and last > at and not any(whole.endswith(value) for whole in known[key(value)]):
            if key(value[groups[at][1] - groups[at][0] :]) == key(value):
                last = None
        if last is None:
            at += 1
            continue
        found.append(opened(text, groups[at][0], groups[last][1]))
        at = last + 1
    return found


def joined(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens, with neighbours of few digits as one where together they have the digits of a number."""
    sizes = [sum(c in "0123456789" for c in text[a:b]) if b - a < 2 * MOST_DIGITS and _bare(text, a, b) else 0 for a, b in tokens]
    found, at = [], 0
    while at < len(tokens):
        end, total = at + 1, sizes[at]
        while 0 < sizes[end - 1] < WHOLE_DIGITS and end < len(tokens) and 0 < sizes[end] < WHOLE_DIGITS and _beside(text, tokens[end - 1][1], tokens[end][0]):
            total += sizes[end]
            end += 1
        if LEAST_KEY <= total <= MOST_DIGITS:
            found.append(tokens[at] if end == at + 1 else opened(text, tokens[at][0], tokens[end - 1][1]))
        else:
            found += tokens[at:end]
        at = end
    return found


def value_nodes(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label): every base span as one node, and outside the spans the repeated values and the tokens."""
    taken = [(a, b) for _, a, b in spans]
    tokens = apart(nodes(text), taken)
    known: dict[str, list[str]] = {}
    for a, b in taken:
        if (name := key(text[a:b])) is not None and "@" not in name:
            known.setdefault(name, []).append("".join(c for c in text[a:b] if c in "0123456789"))
    # A token that has a known key by itself stays as it is.
    whole = [(a, b) for a, b in tokens if key(text[a:b]) in known]
    found = repeats(text, sorted([*taken, *whole]), known) if known else []
    rest = [*found, *whole, *joined(text, apart(tokens, sorted([*found, *whole])))]
    kept: list[tuple[int, int, int]] = []
    for kind, a, b in spans:
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, KINDS.index(kind)))
    return sorted([*kept, *((a, b, OTHER) for a, b in rest)])


class Potentials:
    """Log-potentials: of labels by shape, as how far each leans from ``other`` (NaN without a count), and of neighbouring labels."""

    def __init__(self, by_shape: np.ndarray, chain: np.ndarray) -> None:
        self.by_shape, self.chain = by_shape, chain
        skip = np.full((len(LABELS), len(LABELS)), 0.0)
        skip[np.diag_indices(OTHER)] = SKIP
        skip[OTHER, OTHER] = SKIP / 2
        self.skip = skip

    @classmethod
    def of(cls, shapes: list[tuple[int, int, int]], chain: list[tuple[int, int, int]]) -> Potentials:
        """From (counter, label, n) and (label, following label, n)."""
        table = np.zeros((SHAPES + CLASSES, len(LABELS)))
        for place, label, n in shapes:
            table[place, label] += n
        held = table.any(axis=1, keepdims=True)
        by_shape = np.where(held, np.clip(np.log1p(table) - np.log1p(table[:, [OTHER]]), -1.0, 1.0), np.nan).astype(np.float32)
        pairs = np.ones((len(LABELS), len(LABELS)))
        for a, b, n in chain:
            pairs[a, b] += n
        # Neighbours inform, but only by how far they lean beyond the labels' own frequencies.
        joint = pairs / pairs.sum()
        lean = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
        return cls(by_shape, np.clip(lean, -1.0, 1.0))

    def unary(self, token: str, label: int) -> np.ndarray:
        if label != OTHER:
            out = np.full(len(LABELS), -30.0)
            out[label] = 0.0
            return out
        # A passed-over token may still be any kind that its characters allow.
        out = np.full(len(LABELS), -PASSED_OVER)
        out[OTHER] = 0.0
        out[:OTHER][~np.array(allowed(token))] = -30.0
        for place in (counter(shape(token)), class_counter(token)):
            if not np.isnan(self.by_shape[place, OTHER]):
                return out + self.by_shape[place]
        return out


def added_spans(text: str, base: list[Span], potentials: Potentials) -> list[Span]:
    """Spans that message passing adds to the base spans of one document."""
    if not base:
        return []  # without evidence no kind is ever more likely than not
    held = value_nodes(text, base)
    n = len(held)
    if n == len(base) or all(label != OTHER for _, _, label in held):
        return []
    unary = np.array([potentials.unary(text[a:b], label) for a, b, label in held])
    edges = [(i - 1, i, potentials.chain) for i in range(1, n)]
    last: dict[str, int] = {}
    for i, (a, b, _) in enumerate(held):
        if (name := key(text[a:b])) is not None:
            if name in last:
                edges.append((last[name], i, potentials.skip))
            last[name] = i
    left, right = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)
    pair = np.array([e[2] for e in edges]).reshape(-1, len(LABELS), len(LABELS))
    forth, back = np.zeros((2, len(edges), len(LABELS)))

    def belief() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, right, forth)
        np.add.at(total, left, back)
        return total

    def normal(message: np.ndarray) -> np.ndarray:
        return message - message.max(axis=1, keepdims=True)

    for _ in range(ROUNDS if len(edges) else 0):
        total = belief()
        new_forth = np.logaddexp.reduce((total[left] - back)[:, :, None] + pair, axis=1)
        new_back = np.logaddexp.reduce((total[right] - forth)[:, None, :] + pair, axis=2)
        forth, back = normal(new_forth), normal(new_back)
    total = belief()
    share = np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
    return [(KINDS[int(p[:OTHER].argmax())], a, b) for (a, b, label), p in zip(held, share, strict=True) if label == OTHER and p[:OTHER].max() > 0.5]


# --- Spark --------------------------------------------------------------------


def train(docs: DataFrame, text: str = "text") -> Potentials:
    """Count shapes by label and neighbouring labels over all documents; the driver gets the tables, whose size is fixed."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[int, int, int]] = Counter()
            for value in batch.column(0).to_pylist():
                if not value or not _marks(value):
                    continue
                spans = base_spans(value)
                held = value_nodes(value, spans)
                for a, b, label in held:
                    counts[counter(shape(value[a:b])), label, -1] += 1
                    counts[class_counter(value[a:b]), label, -1] += 1
                counts.update((-1, x[2], y[2]) for x, y in zip(held, held[1:], strict=False))
            rows = np.array(list(counts), np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T.copy()), pa.array(list(counts.values()), pa.int64())], ["place", "label", "following", "n"])

    counted = docs.select(whole_text(text)).mapInArrow(in_task, "place int, label int, following int, n long")
    rows = counted.groupBy("place", "label", "following").agg(F.sum("n").alias("n")).toArrow()
    places, labels, followings, n = (rows.column(c).to_pylist() for c in ("place", "label", "following", "n"))
    shapes = [(p, a, c) for p, a, c in zip(places, labels, n, strict=True) if p >= 0]
    return Potentials.of(shapes, [(a, b, c) for p, a, b, c in zip(places, labels, followings, n, strict=True) if p < 0])


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, potentials: Potentials, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans`` (base and added), as arrays of (kind, start, end) in code points."""
    held = docs.sparkSession.sparkContext.broadcast((potentials.by_shape, potentials.chain))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"struct<base: {SPANS}, every: {SPANS}>")
    def spans(texts: pa.Array) -> pa.Array:
        field = Potentials(*held.value)
        base, every = [], []
        for scalar in texts:
            value = scalar.as_py()
            found = base_spans(value)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            more = added_spans(value, found, field)
            every.append(base[-1] if not more else [{"kind": k, "start": a, "end": b} for k, a, b in in_order(found + more)])
        return pa.StructArray.from_arrays([pa.array(base, item), pa.array(every, item)], ["base", "every"])

    done = docs.withColumn("found_spans", spans(whole_text(text)))
    return done.withColumns({"base_spans": F.col("found_spans.base"), "spans": F.col("found_spans.every")}).drop("found_spans")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span of the text by its kind in angle brackets; overlapping spans become one. Null stays null."""

    @F.arrow_udf("string")
    def hidden(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for scalar, found in zip(texts, lists.to_pylist(), strict=True):
            value = scalar.as_py()
            if not found:
                out.append(value)
                continue
            parts, at = [], 0
            for span in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if span["start"] >= at:
                    parts += [value[at : span["start"]], f"<{span['kind'].upper()}>"]
                at = max(at, span["end"])
            out.append("".join([*parts, value[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text, hidden(F.col(text), F.col(spans)))
