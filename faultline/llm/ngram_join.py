"""Similarity join of documents on the Jaccard index of their word shingles.

Equal sets are one class from the start; the join runs between classes.

1. ``counters`` counts every shingle of every document in a table of ``COUNTERS`` hashed counters. It orders
   shingles rare first; any order that is the same everywhere gives right results, so its size is fixed.
2. Each class sends its prefix, the rarest ``n - ceil(t n) + 1`` shingles, to the shingle's partition. There the
   sorted classes of a shingle are streamed: each is paired with the first that passes the length and positional
   filters, and shingles of three or more classes report the members that others can reach. Frequent shingles are
   dealt over ``PARTS`` salted parts, whose members are reported too.
3. Pairs whose sketches don't part them (a suffix filter: parities of a set's hashes, from which two sets differ in
   at least so many shingles as the sketches in bits) are verified once on whole sets. Members of a group meet by
   their sketches alone, block against block in one task each, and send no rows but two pairs for a member: with the
   nearest that the sketch admits, and with the smallest. Links give preliminary components.
4. Only groups whose members still lie in different components meet again, and give all pairs that the sketches
   admit between components. Pairs inside a component can't change the result and are never formed; pairs that differ
   by far more than linked ones may are compared as sketches only, whatever the size of a group.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a
text of fewer than five words has its whole sequence as its only shingle; rows with the same id and different
texts are one node, and keep the number of shingles of each row; null ids are kept, linked with nothing (their
component is null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import blocks
from faultline.llm.components import components
from faultline.llm.frames import stage, whole_text
from faultline.llm.runs import whole_runs
from faultline.llm.shingles import mixed, shingle_sets

#: Similarity in hundredths.
PERCENT = 80
COUNTERS = 1 << 22
CHUNK = 1 << 14
#: Shingles counted so much more often than twice the mean counter are dealt over so many parts.
FREQUENT, PARTS = 2000, 64
#: Members reported under a common name, so that shingles with the same members are one group.
NAMED = 4096
#: Pairs and groups that a task remembers so as not to say them twice; they are made distinct later anyway.
REMEMBERED = 200_000
FAN = 64
#: Least and most bits of the sketch that bounds from below in how many shingles two sets differ.
SKETCH, SKETCH_MOST = 512, 1 << 18
#: Members of a group go to blocks of at least so many, at most ``MOST_BLOCKS`` of them unless their sketches take more bytes each.
BLOCK_ROWS, MOST_BLOCKS, BLOCK_BYTES = 512, 32, 8 << 20
#: Words of sketches that are compared at a time.
TILE = 1 << 20


def class_of(shingles: np.ndarray) -> int:
    """One number for a set, whatever the order of its members."""
    h = mixed(shingles)
    folded = mixed(np.array([h.sum(), np.bitwise_xor.reduce(mixed(h + np.uint64(1))), len(h)], np.uint64))
    return int(mixed(folded[:1] * np.uint64(0x9E3779B97F4A7C15) + folded[1:2] * np.uint64(0xC2B2AE3D27D4EB4F) + folded[2:])[0].view(np.int64))


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        ids, at = batch.column(0), 0
        for block in blocks(batch.column(1).to_pylist()):
            yield ids.slice(at, len(block)), shingle_sets(block)
            at += len(block)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, class, sketch) of every document, and rows (chunk, counters) of each task's counters.

    ``mark`` tells the texts of rows that share an id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            id_type, at = batch.column(0).type, 0
            for block in blocks(batch.column(1).to_pylist()):
                sets = shingle_sets(block)
                seen = np.concatenate([np.zeros(0, np.uint64), *sets])
                counts += np.bincount((seen & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                size = pa.array([len(s) for s in sets], pa.int64())
                classes = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                sketches = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
                ids, marks = (batch.column(k).slice(at, len(sets)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, marks, size, classes, sketches, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
                at += len(sets)
        if id_type is not None:
            n, task = COUNTERS // CHUNK, TaskContext.get().partitionId()
            packed = [zstandard.compress(part.tobytes(), 1) for part in counts.reshape(n, CHUNK)]
            absent = [pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*absent, pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "mark", "n", "class", "sketch", "chunk", "task", "counters"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return stage(rows.mapInArrow(in_task, f"doc_id {kind}, mark long, n long, class long, sketch binary, chunk int, task int, counters binary"))


def counters(profiled: DataFrame) -> np.ndarray:
    """The counters of all documents; added up in groups of ``FAN`` tasks and then over the groups."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint32)
        for packed in table.column("counters").to_pylist():
            total += np.frombuffer(zstandard.decompress(packed), np.uint32)
        return pa.table({"chunk": table.column("chunk")[:1], "counters": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    rows = profiled.where("chunk is not null").select("chunk", F.floor(F.col("task") / FAN).alias("fan"), "counters")
    first = rows.groupBy("chunk", "fan").applyInArrow(add, "chunk int, counters binary")
    both = first.groupBy("chunk").applyInArrow(add, "chunk int, counters binary")
    total = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint32)
    for row in both.collect():  # a table of fixed size
        total[row.chunk] = np.frombuffer(zstandard.decompress(row.counters), np.uint32)
    return total.reshape(-1)


def prefixes(docs: DataFrame, order, percent: int) -> DataFrame:
    """(token, part, class, n, pos): the rarest shingles of each class, frequent ones dealt over parts."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sent = order.value, set()
        frequent = FREQUENT + 2 * counts.mean()
        for _, sets in shingle_batches(batches):
            tokens, parts, classes, sizes, places = [], [], [], [], []
            for shingles in sets:
                n = len(shingles)
                if not n or (name := class_of(shingles)) in sent:
                    continue
                sent.add(name)
                often = counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((shingles, often))[: n - -(-percent * n // 100) + 1]
                tokens.append(shingles[first])
                parts.append(np.where(often[first] >= frequent, 1 + name % PARTS, 0))
                classes.append(np.full(len(first), name))
                sizes.append(np.full(len(first), n))
                places.append(np.arange(len(first)))
            if tokens:
                columns = (np.concatenate(tokens).view(np.int64), np.concatenate(parts), np.concatenate(classes), np.concatenate(sizes), np.concatenate(places))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], ["token", "part", "class", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(in_task, "token long, part int, class long, n int, pos int")


def reach_of(n, pos, percent: int = PERCENT):
    """The largest partner that a set of size n may have if its first common shingle stands at pos of its order.

    Two sets pass the positional filter at a shingle exactly if each is within the other's reach there.
    """
    return (n - pos) * (100 + percent) // percent - n


class Groups:
    """Members of shingles of one task, shingles with the same members under one name with the longest reach."""

    def __init__(self) -> None:
        self.held: dict[int, list[np.ndarray]] = {}
        self.size = 0

    def add(self, name: int, members: np.ndarray) -> None:
        """``members`` has columns class, n, reach, in order of class."""
        if name in self.held and len(self.held[name]) == len(members):
            self.held[name][:, 2] = np.maximum(self.held[name][:, 2], members[:, 2])
        else:
            self.held[name] = members
            self.size += len(members)

    def drained(self) -> np.ndarray:
        """Rows (class, n, reach, group) of everything held."""
        rows = [np.column_stack([m, np.full(len(m), name)]) for name, m in self.held.items()]
        self.held, self.size = {}, 0
        return np.concatenate([np.zeros((0, 4), np.int64), *rows])


def meet(sorted_rows: DataFrame, percent: int) -> DataFrame:
    """Streams the classes of each token in order of size: rows (a, b) of pairs, and (b, n, reach, group) of members."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int]] = set()
        groups = Groups()
        pairs: list[tuple[int, int]] = []
        open_members: list[np.ndarray] = []
        held = None  # the last token so far: (token, part), hub, rows of its members, whether they go by the token

        def say(a: int, b: int) -> None:
            pair = (min(a, b), max(a, b))
            if pair not in said:
                if len(said) > REMEMBERED:
                    said.clear()
                said.add(pair)
                pairs.append(pair)

        def finish() -> None:
            (token, part), _, rows, by_token = held
            if not rows:
                return
            members = np.concatenate(rows)
            if by_token or part:
                open_members.append(np.column_stack([members, np.full(len(members), token)]))
                return
            while len(members) > 1 and not (fits := members[:, 2] >= members[:, 1].min()).all():
                members = members[fits]  # nobody here is within their reach
            if len(members) == 2:
                say(int(members[0, 0]), int(members[1, 0]))
            elif len(members) > 2:
                members = members[np.argsort(members[:, 0], kind="stable")]
                groups.add(class_of(members[:, 0].view(np.uint64)), members)

        def shipped() -> pa.RecordBatch:
            rows = np.concatenate([np.zeros((0, 4), np.int64), *open_members])
            if groups.size > REMEMBERED:
                rows = np.concatenate([rows, groups.drained()])
            out = _met(pairs, rows)
            pairs.clear()
            open_members.clear()
            return out

        for batch in batches:
            token, part, name, n, pos = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
            reach = reach_of(n, pos, percent)
            edge = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
            for start, end in zip(edge.tolist(), [*edge[1:].tolist(), len(token)], strict=True):
                at = (int(token[start]), int(part[start]))
                if held is None or held[0] != at:
                    if held is not None:
                        finish()
                    if end - start == 1 and end < len(token) and not at[1]:
                        held = None  # a token of one class
                        continue
                    held = [at, (int(name[start]), int(n[start]), int(reach[start])), [], False]
                hub, hub_n, hub_reach = held[1]
                fits = (n[start:end] <= hub_reach) & (hub_n <= reach[start:end]) & (name[start:end] != hub)
                for other in name[start:end][fits].tolist():
                    say(hub, other)
                # The next hub is the last class that the first can't reach.
                far = np.flatnonzero(100 * hub_n < percent * n[start:end])
                if len(far):
                    last = start + int(far[-1])
                    held[1] = (int(name[last]), int(n[last]), int(reach[last]))
                held[2].append(np.column_stack([name[start:end], n[start:end], reach[start:end]]))
                if held[3] or sum(map(len, held[2])) > NAMED:  # too many to name together: the token itself is the group
                    open_members.append(np.column_stack([np.concatenate(held[2]), np.full(sum(map(len, held[2])), at[0])]))
                    held[2], held[3] = [], True
            yield shipped()
        if held is not None:
            finish()
        yield shipped()
        yield _met([], groups.drained())

    return sorted_rows.mapInArrow(in_task, "a long, b long, n long, reach long, group long")


def _met(pairs: list[tuple[int, int]], members: np.ndarray) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    none = pa.nulls(len(both), pa.int64())

    def column(first, rest) -> pa.Array:
        return pa.concat_arrays([first, rest])

    return pa.RecordBatch.from_arrays(
        [
            column(pa.array(both[:, 0]), pa.nulls(len(members), pa.int64())),
            column(pa.array(both[:, 1]), pa.array(members[:, 0])),
            *(column(none, pa.array(members[:, k])) for k in (1, 2, 3)),
        ],
        ["a", "b", "n", "reach", "group"],
    )


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes by their low bits, so many that few of them clash: two sets differ in no fewer members
    than their sketches in bits. The larger of two sketches ``folded`` to the size of the other is the one of that size."""
    bits = min(max(SKETCH, 1 << (4 * len(shingles)).bit_length()), SKETCH_MOST)
    odd = np.bincount((mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches brought down to so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def within(apart, sizes, percent: int = PERCENT):
    """Whether sets of together ``sizes`` members, of which ``apart`` are in one of them only, link."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def profiles_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, doc_id, mark, n, sketch) of the given classes, each by one of its documents."""
    chosen = members.where("class is not null and doc_id is not null").join(classes, "class", "left_semi")
    return chosen.groupBy("class").agg(F.min(F.struct("doc_id", "mark", "n", "sketch")).alias("held")).select("class", "held.*")


def texts_of(docs: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, text) of the classes of pairs."""
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = held.select("class", "doc_id", "mark").join(asked, "class")
    texts = docs.where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    return texts.join(wanted, ["doc_id", "mark"]).dropDuplicates(["class"]).select("class", "text")


def plausible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that length and sketches admit."""
    sides = [held.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for row, both in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64)[None] for v in both)
                words = min(x.shape[1], y.shape[1])
                apart[row] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(within(apart, sizes, percent)))

    return sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(in_task, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, on whole sets, once for each pair."""
    whole = texts.select("class", "text")
    with_b = pairs.join(whole.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(whole.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep: list[bool] = []
            last, sets = None, None
            for block in blocks(batch.column(3).to_pylist()):
                for other in shingle_sets(block):
                    row = len(keep)
                    if a[row] != last:
                        last, sets = a[row], shingle_sets([batch.column(2)[row].as_py()])[0]
                    overlap = len(np.intersect1d(sets, other, assume_unique=True))
                    keep.append(100 * overlap >= percent * (len(sets) + len(other) - overlap))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(pa.array(keep, pa.bool_()))

    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def unsettled(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(centre, class, component) of the centres whose members lie in different components."""
    placed = placed.drop("component").join(found, F.col("class") == F.col("node"), "left").select("centre", "class", F.coalesce("component", "class").alias("component"))
    split = placed.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(split.select("centre"), "centre", "left_semi")


def centred(groups: DataFrame) -> DataFrame:
    """(centre, class, component), each class a component: groups of the same smallest class, their centre, are one."""
    centres = groups.groupBy("group").agg(F.min("class").alias("centre"), F.max("class").alias("high")).where("centre < high")
    return groups.join(centres.select("group", "centre"), "group").select("centre", "class").distinct().withColumn("component", F.col("class"))


def in_blocks(placed: DataFrame, held: DataFrame) -> DataFrame:
    """(centre, low, high, block, class, component, n, sketch): members for each pair (low, high) of a centre's blocks."""
    rows = placed.join(held.select("class", "n", "sketch"), "class")
    sizes = rows.groupBy("centre").agg(F.count("*").alias("m"), F.sum(F.length("sketch").cast("long")).alias("size"))
    blocks_of = F.greatest(F.least(F.ceil(F.col("m") / BLOCK_ROWS), F.lit(MOST_BLOCKS)), F.ceil(F.col("size") / BLOCK_BYTES))
    dealt = rows.join(sizes.select("centre", blocks_of.alias("blocks")), "centre").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "component", "n", "sketch")


class Members:
    """Members of one block in order of size, their sketches by width."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("n", "ascending"), ("class", "ascending")])
        self.name, self.component, self.n = (table.column(k).to_numpy() for k in ("class", "component", "n"))
        sketches = table.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in sketches], np.int64)
        edge = [0, *(np.flatnonzero(words[1:] != words[:-1]) + 1).tolist(), len(words)]
        #: (first row, matrix of sketches) of each width; larger sets have wider ones.
        self.runs = [(i, np.frombuffer(b"".join(sketches[i:j]), np.uint64).reshape(j - i, -1)) for i, j in zip(edge[:-1], edge[1:], strict=True) if i < j]


def admitted(left: Members, right: Members, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of left and right in different components that length and sketches admit, and the share that parts them."""
    for first, sketches in left.runs:
        at = 0
        while at < len(sketches):
            low = -(-percent * int(left.n[first + at]) // 100)
            start = int(np.searchsorted(right.n, low))
            rows = max(1, min(TILE // max(1, (len(right.n) - start) * sketches.shape[1]), 256, len(sketches) - at))
            end = int(np.searchsorted(right.n, 100 * int(left.n[first + at + rows - 1]) // percent, "right"))
            for other, matrix in right.runs:
                i, j = max(start - other, 0), min(end - other, len(matrix))
                if i >= j:
                    continue
                words = min(matrix.shape[1], sketches.shape[1])
                x, y = folded(sketches[at : at + rows], words), folded(matrix[i:j], words)
                mine, its = np.arange(first + at, first + at + rows), np.arange(other + i, other + j)
                step = max(1, TILE // (rows * words))
                for k in range(0, len(y), step):
                    part = its[k : k + step]
                    apart = np.bitwise_count(x[:, None] ^ y[None, k : k + step]).sum(axis=2, dtype=np.int64)
                    sizes = left.n[mine][:, None] + right.n[part][None]
                    fits = within(apart, sizes, percent) & (left.component[mine][:, None] != right.component[part][None])
                    fits &= 100 * np.minimum(left.n[mine][:, None], right.n[part][None]) >= percent * np.maximum(left.n[mine][:, None], right.n[part][None])
                    r, c = np.nonzero(fits)
                    if len(r):
                        yield mine[r], part[c], apart[r, c] / sizes[r, c]
            at += rows


class Choice:
    """Of each member the nearest partner so far, and the one of the smallest class."""

    def __init__(self, members: Members, others: np.ndarray) -> None:
        n = len(members.name)
        self.members, self.other = members, others
        self.share, self.nearest, self.smallest = np.full(n, 9.0), np.full(n, -1), np.full(n, -1)

    def add(self, rows: np.ndarray, partners: np.ndarray, names: np.ndarray, share: np.ndarray) -> None:
        order = np.lexsort((names, share, rows))
        at = order[np.unique(rows[order], return_index=True)[1]]
        better = at[share[at] < self.share[rows[at]]]
        self.share[rows[better]], self.nearest[rows[better]] = share[better], partners[better]
        order = np.lexsort((names, rows))
        at = order[np.unique(rows[order], return_index=True)[1]]
        held = self.smallest[rows[at]]
        better = at[(held < 0) | (names[at] < self.other[held])]
        self.smallest[rows[better]] = partners[better]

    def pairs(self) -> np.ndarray:
        out = [np.column_stack([self.members.name[has], self.other[held[has]]]) for held in (self.nearest, self.smallest) if len(has := np.flatnonzero(held >= 0))]
        return np.concatenate([np.zeros((0, 2), np.int64), *out])


def meet_blocks(placed: DataFrame, held: DataFrame, percent: int, chosen: bool) -> DataFrame:
    """Pairs (a, b) of members of one centre in different components that length and sketches admit.

    With ``chosen`` each member has at most two in a pair of blocks. No pair is made into a row before.
    """
    keys = ["centre", "low", "high"]
    rows = in_blocks(placed, held).repartition(*keys).sortWithinPartitions(*keys)

    def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, low, high = (table.column(k).to_numpy() for k in ("block", "low", "high"))
        left = Members(table.filter(pa.array(block == low)))
        right = left if low[0] == high[0] else Members(table.filter(pa.array(block != low)))
        best = [Choice(left, right.name), Choice(right, left.name)]
        for x, y, share in admitted(left, right, percent):
            if chosen:
                best[0].add(x, y, right.name[y], share)
                best[1].add(y, x, left.name[x], share)
            else:
                yield batch_of(np.column_stack([left.name[x], right.name[y]]))
        if chosen:
            yield batch_of(np.concatenate([b.pairs() for b in best]))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, keys):
            for start, end in zip(bounds[:-1].tolist(), [*bounds[1:-1].tolist(), table.num_rows], strict=True):
                if end - start > 1:
                    yield from compared(table.slice(start, end - start))

    return rows.mapInArrow(in_task, "a long, b long").distinct()


def settle(docs: DataFrame, first: DataFrame, groups: DataFrame, held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of classes, and the components that they form.

    A round verifies the pairs of hubs and those that members of groups choose; the next one all pairs that are still
    between components. Length and sketches rule out only pairs that don't link, so no link between components is lost.
    """
    placed = stage(centred(groups))
    pairs = plausible(first, held, percent).unionByName(meet_blocks(placed, held, percent, chosen=True))
    tried = stage(pairs.distinct())
    links = stage(verify(tried, texts_of(docs, held, tried), percent))
    found = components(links)
    more = stage(meet_blocks(unsettled(placed, found), held, percent, chosen=False).join(tried, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return links, found
    added = stage(verify(more, texts_of(docs, held, more), percent))
    links = links.unionByName(added)
    return links, found if added.isEmpty() else components(links)


def join(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, links) of every document; ``links`` counts the links found at its class.

    It is no degree: pairs inside a component are never formed, and so not counted.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    profiled = profile(chosen)
    members = profiled.where("chunk is null")
    order = spark.sparkContext.broadcast(counters(profiled))
    rows = prefixes(chosen, order, percent).repartition("token", "part").sortWithinPartitions("token", "part", "n", "class")
    met = stage(meet(rows, percent))
    groups = met.where("group is not null").select("group", F.col("b").alias("class")).distinct()
    first = met.where("group is null").select("a", "b").distinct()
    classes = met.select(F.col("b").alias("class")).unionByName(met.where("a is not null").select(F.col("a").alias("class"))).distinct()
    held = stage(profiles_of(members, classes))
    return labelled(members.select("doc_id", "n", "class"), *settle(chosen, first, groups, held, percent))


def labelled(members: DataFrame, links: DataFrame, placed: DataFrame) -> DataFrame:
    """Components of documents from those of classes: a class joins its documents, and an id its classes."""
    ids = members.where("class is not null and doc_id is not null")
    by_class = ids.join(placed, ids["class"] == placed.node, "left").select("doc_id", F.coalesce("component", "class").alias("root"))
    smallest = by_class.groupBy("root").agg(F.min("doc_id").alias("least"))
    # Rows that repeat an id with other texts tie their components; the smallest id is found through such ties too.
    rooted = by_class.distinct()
    first = rooted.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("last")).where("a != last").select("doc_id", "a")
    tied = rooted.join(first, "doc_id").where("root != a").select("a", F.col("root").alias("b"))
    again = components(tied)
    named = smallest.join(again, smallest.root == again.node, "left").select("root", F.coalesce("component", "root").alias("top"), "least")
    final = named.join(named.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("root", "component_id")
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    whole = members.join(placed.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("component", "class"))
    whole = whole.join(final, "root", "left").join(degree.withColumnRenamed("node", "class"), "class", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
