"""Exact removal of repeated strings by distributed merges of front-coded sorted suffix runs.

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a document of smaller
doc_id, or earlier in its own. Every window holds an anchor that its bytes alone determine, so equal
windows meet at equal anchors. Anchors whose hash occurs twice in the corpus give suffixes: the anchor
with the bytes after it and those before it. Tasks sort theirs, code each by what it adds to the one
before, and exchange these runs; loser trees merge them and give, with the order, the prefixes that
neighbours share, from which the repeated windows around an anchor follow. Texts move once.

Anchors that occur over HOT times are exchanged as single windows instead, of which a task keeps one
each, so that no group of suffixes is unbounded.

Defined results: a null text counts as empty; rows that agree in doc_id and text are one document and
get equal results; of different texts with one doc_id the one of the smaller hash is earlier; null
doc_ids come before all others; other columns are read only where they are to be kept; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions
from .suffixes import ANCHOR, NORMAL, SPREAD, WIDTH, WINDOW, anchors, common, contexts, front_coded, hot_windows, join, merge, planes, rows, split, unplanes

HOT = 500_000
#: Suffixes that are sorted together, and contexts of one anchor that are compared pair by pair.
RUN = 400_000
PAIRS = 24
NULL_ID = -(1 << 63)

MESSAGE = "t bigint, source bigint, payload binary"
MESSAGE_ARROW = pa.schema([("t", pa.int64()), ("source", pa.int64()), ("payload", pa.binary())])


def messages(made: list[tuple[int, int, bytes]]) -> pa.Table:
    t, source, payload = zip(*made, strict=True) if made else ((), (), ())
    return pa.table([pa.array(t, pa.int64()), pa.array(source, pa.int64()), pa.array(payload, pa.binary())], schema=MESSAGE_ARROW)


def task_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions a number that falls into it, so that tasks can be addressed evenly."""
    found = spark.range(0, 64 * n + 1024).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r["p"]: r["id"] for r in found}
    return [keys.get(p, p) for p in range(n)]


class Documents:
    """The different documents of one task in their order, whatever order they came in."""

    def __init__(self, table: pa.Table):
        ids = [NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        marks = table.column("dk").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i], texts[i]))
        self.ids: list[int] = []
        self.marks: list[int] = []
        self.texts: list[bytes] = []
        self.number = [0] * len(ids)
        for i in self.order:
            if not self.texts or (ids[i], marks[i], texts[i]) != (self.ids[-1], self.marks[-1], self.texts[-1]):
                self.ids.append(ids[i])
                self.marks.append(marks[i])
                self.texts.append(texts[i])
            self.number[i] = len(self.texts) - 1


def anchor_sets(keys: list[int]):
    """From a task's texts, to each task its share of the distinct anchor hashes with their counts."""
    n = len(keys)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [anchors(x)[1] for x in table.column("text").cast(pa.binary()).to_pylist()]
        h, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        made = []
        share = (h % np.uint64(n)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        ends = np.searchsorted(share[order], np.arange(n + 1))
        for p in range(n):
            mine = order[ends[p] : ends[p + 1]]
            if len(mine):
                steps = np.diff(h[mine], prepend=np.uint64(0))
                made.append((keys[p], key[0].as_py(), join(planes(steps), planes(counts[mine].astype("<u4")))))
        return messages(made)

    return run


def repeated_anchors(hot: int):
    """From all tasks' sets of hashes, to each task those of its own that occur twice or more."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sources = table.column("source").to_pylist()
        sets, counts = [], []
        for payload in table.column("payload").to_pylist():
            steps, many = split(payload)
            sets.append(np.cumsum(unplanes(steps, "<u8"), dtype=np.uint64))
            counts.append(unplanes(many, "<u4"))
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts))
        made, at = [], 0
        for source, own in zip(sources, sets, strict=True):
            count = total[place[at : at + len(own)]]
            at += len(own)
            if (count >= 2).any():
                kept = own[count >= 2]
                made.append((source, key[0].as_py(), join(planes(np.diff(kept, prepend=np.uint64(0))), planes((count[count >= 2] > hot).astype(np.uint8)))))
        return messages(made)

    return run


def spans_message(t: int, source: int, number, start, end) -> tuple[int, int, bytes]:
    """Intervals of bytes to remove, for the task that holds the documents."""
    return t, source, join(b"spans", np.asarray(number, "<u4").tobytes(), np.asarray(start, "<i8").tobytes(), np.asarray(end, "<i8").tobytes())


def sorted_runs(keys: list[int]):
    """From a task's texts and its repeated anchors: sorted front-coded runs of suffixes for each task."""
    n = len(keys)

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, news: pa.Table) -> pa.Table:
        if not texts.num_rows or not news.num_rows:
            return messages([])
        t = key[0].as_py()
        hashes, hots = [], []
        for payload in news.column("payload").to_pylist():
            steps, flags = split(payload)
            hashes.append(np.cumsum(unplanes(steps, "<u8"), dtype=np.uint64))
            hots.append(unplanes(flags, "u1"))
        known = np.concatenate(hashes)
        order = np.argsort(known)
        known, is_hot = known[order], np.concatenate(hots)[order] > 0
        docs, made = Documents(texts), []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        waiting = 0
        for number, data in enumerate(docs.texts):
            at, h = anchors(data)
            spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            twice = known[spot] == h
            hot = twice & is_hot[spot]
            normal = at[twice & ~hot]
            if len(normal):
                held.append((number, contexts(data, normal), normal))
                waiting += len(normal)
            if hot.any():
                k, starts = hot_windows(data, at[hot])
                held.append((number, k, starts))
                waiting += len(starts)
            if waiting >= RUN:
                made += encode_runs(held, docs, t, keys, n)
                held, waiting = [], 0
        if held:
            made += encode_runs(held, docs, t, keys, n)
        return messages(made)

    return run


def full_span(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What all windows around these suffixes cover; ok is false where there is none."""
    before, after = keys[:, -2].astype(np.int64) - 1, keys[:, -1].astype(np.int64) - 1
    hot = keys[:, 0] != NORMAL
    least = np.maximum(0, SPREAD - after)
    start = np.where(hot, at, at - before)
    end = np.where(hot, at + WINDOW, at - least + WINDOW)
    return start, end, hot | (least <= before)


def encode_runs(held: list, docs: Documents, t: int, keys: list[int], n: int) -> list[tuple[int, int, bytes]]:
    """Sorts suffixes; of equal ones the first goes on and the others are repeated as a whole."""
    k = np.concatenate([x[1] for x in held])
    number = np.concatenate([np.full(len(x[2]), x[0]) for x in held])
    at = np.concatenate([x[2] for x in held])
    order = np.argsort(k.view(f"S{WIDTH}").ravel(), kind="stable")  # documents and places came in order
    k, number, at = k[order], number[order], at[order]
    again = np.concatenate([[False], (k[1:] == k[:-1]).all(axis=1)])
    made = []
    if again.any():
        start, end, ok = full_span(k[again], at[again])
        made.append(spans_message(t, t, number[again][ok], start[ok], end[ok]))
    k, number, at = k[~again], number[~again], at[~again]
    # suffixes of one anchor go to one task; single windows go by all of their bytes
    hashed = np.where(k[:, 0] == NORMAL, by_bytes(k[:, 1 : 1 + ANCHOR]), by_bytes(k[:, 1 : 1 + WINDOW]))
    share = (hashed % np.uint64(n)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    ends = np.searchsorted(share[order], np.arange(n + 1))
    ids, marks = np.array(docs.ids, "<i8"), np.array(docs.marks, "<i8")
    for p in range(n):
        mine = order[ends[p] : ends[p + 1]]
        if len(mine):
            shared, rest = front_coded(k[mine])
            own = number[mine]
            made.append((keys[p], t, join(b"run", shared.tobytes(), zlib.compress(rest, 1), ids[own].tobytes(), marks[own].tobytes(), own.astype("<u4").tobytes(), at[mine].astype("<i8").tobytes())))
    return made


def by_bytes(k: np.ndarray) -> np.ndarray:
    h = np.zeros(len(k), np.uint64)
    for column in k.T:
        h = h * np.uint64(0x100000001B3) + column.astype(np.uint64) + np.uint64(1)
    return h ^ h >> np.uint64(31)


def merged_runs(pairs: int = PAIRS):
    """From all tasks' runs: merges them and sends the intervals that are repeated to the documents' tasks."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, made, streams, metas = key[0].as_py(), [], [], []
        for source, payload in zip(table.column("source").to_pylist(), table.column("payload").to_pylist(), strict=True):
            kind, *parts = split(payload)
            if kind == b"spans":
                made.append((source, t, payload))
                continue
            shared, rest, ids, marks, number, at = parts
            streams.append(rows(np.frombuffer(shared, np.uint8), zlib.decompress(rest)))
            metas.append((source, *(np.frombuffer(x, kind).tolist() for x, kind in ((ids, "<i8"), (marks, "<i8"), (number, "<u4"), (at, "<i8")))))
        out = Spans()
        cursor = [0] * len(streams)
        group: list[Suffix] = []
        for shared, k, r in merge(streams):
            i = cursor[r]
            cursor[r] += 1
            source, ids, marks, number, at = metas[r]
            item = ((ids[i], marks[i], at[i]), source, number[i], k, shared)
            if shared >= (1 + ANCHOR if k[0] == NORMAL else 1 + WINDOW):
                group.append(item)
                continue
            if len(group) > 1:
                resolve(group, out, pairs)
            group = [item]
        if len(group) > 1:
            resolve(group, out, pairs)
        return messages([*made, *(spans_message(source, t, *columns) for source, columns in out.by_task.items())])

    return run


#: (order, task of the document, its number there, key, prefix shared with the one before)
Suffix = tuple[tuple[int, int, int], int, int, bytes, int]


class Spans:
    def __init__(self):
        self.by_task: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def add(self, item: Suffix, start: int, end: int) -> None:
        number, starts, ends = self.by_task.setdefault(item[1], ([], [], []))
        number.append(item[2])
        starts.append(start)
        ends.append(end)


def resolve(group: list[Suffix], out: Spans, pairs: int) -> None:
    """Suffixes of one anchor in sorted order: which windows around each stand earlier elsewhere."""
    # equal keys: the earliest stands for all, the others are repeated as a whole
    distinct: list[Suffix] = []
    for item in group:
        if distinct and item[4] >= WIDTH:
            first = distinct[-1]
            if item[0] < first[0]:
                distinct[-1] = (*item[:4], first[4])
                item = first
            if item[0] != distinct[-1][0]:
                whole(item, out)
        else:
            distinct.append(item)
    if len(distinct) < 2:
        return
    if len(distinct) > pairs:
        by_ranks(distinct, out)
        return
    for i, a in enumerate(distinct):
        left, before, after, right = a[3][1 + WINDOW : -2], a[3][-2] - 1, a[3][-1] - 1, SPREAD
        for b in distinct[i + 1 :]:
            right = min(right, b[4] - 1 - ANCHOR)
            most = min(before, b[3][-2] - 1)
            least = SPREAD - min(right, after, b[3][-1] - 1)
            if least <= most:
                most = min(most, common(left, b[3][1 + WINDOW : -2], 0))
                if least <= most:
                    late = b if a[0] < b[0] else a
                    out.add(late, late[0][2] - most, late[0][2] - least + WINDOW)


def whole(item: Suffix, out: Spans) -> None:
    k, at = item[3], item[0][2]
    if k[0] != NORMAL:
        out.add(item, at, at + WINDOW)
        return
    before, least = k[-2] - 1, max(0, SPREAD - (k[-1] - 1))
    if least <= before:
        out.add(item, at - before, at - least + WINDOW)


def by_ranks(distinct: list[Suffix], out: Spans) -> None:
    """Large groups: classes of equal bytes before and after an anchor, from shared prefixes in both orders."""
    distinct = sorted(distinct, key=lambda x: x[3])
    k = np.frombuffer(b"".join(x[3] for x in distinct), np.uint8).reshape(-1, WIDTH)
    after_shared = front_coded(k)[0].astype(np.int64) - 1 - ANCHOR
    left = np.ascontiguousarray(k[:, 1 + WINDOW : -2])
    by_left = np.argsort(np.concatenate([left, np.ones((len(left), 1), np.uint8)], axis=1).view(f"S{SPREAD + 1}").ravel(), kind="stable")
    before_shared = front_coded(left[by_left])[0].astype(np.int64)
    before, after = k[:, -2].astype(np.int64) - 1, k[:, -1].astype(np.int64) - 1
    place = np.empty(len(k), np.int64)
    place[sorted(range(len(k)), key=lambda i: distinct[i][0])] = np.arange(len(k))
    for j in range(SPREAD + 1):
        new_after = after_shared < SPREAD - j
        new_after[0] = True
        new_before = before_shared < j
        new_before[0] = True
        class_before = np.empty(len(k), np.int64)
        class_before[by_left] = np.cumsum(new_before)
        pair = class_before * (len(k) + 1) + np.cumsum(new_after)
        valid = np.flatnonzero((before >= j) & (after >= SPREAD - j))
        order = valid[np.argsort(place[valid])]
        _, first = np.unique(pair[order], return_index=True)
        late = np.ones(len(order), bool)
        late[first] = False
        for i in order[late].tolist():
            at = distinct[i][0][2]
            out.add(distinct[i], at - j, at - j + WINDOW)


def removed(docs: Documents, news: pa.Table) -> list[np.ndarray]:
    """For each document of a task, which of its bytes go."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for payload in news.column("payload").to_pylist() if news.num_rows else ():
        _, number, start, end = split(payload)
        for part, x, kind in zip(parts, (number, start, end), ("<u4", "<i8", "<i8"), strict=True):
            part.append(np.frombuffer(x, kind).astype(np.int64))
    number, start, end = (np.concatenate([np.empty(0, np.int64), *p]) for p in parts)
    order = np.argsort(number, kind="stable")
    number, start, end = number[order], start[order], end[order]
    bounds = np.searchsorted(number, np.arange(len(docs.texts) + 1))
    out = []
    for i, text in enumerate(docs.texts):
        a, b = bounds[i], bounds[i + 1]
        steps = np.zeros(len(text) + 1, np.int64)
        np.add.at(steps, start[a:b], 1)
        np.add.at(steps, end[a:b], -1)
        out.append(np.cumsum(steps[:-1]) > 0)
    return out


REPORT = "doc_id bigint, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dealt(df: DataFrame, id_col: str, text_col: str, keep: list[str], keys: list[int]) -> DataFrame:
    """Texts by task: t addresses it, dk tells texts of one doc_id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("bigint")
    rest = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("struct<x:int>")
    docs = df.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("dk"), text.alias("text"), rest.alias("rest"))
    task = F.pmod(F.hash("doc_id", "dk"), F.lit(len(keys)))
    address = F.element_at(F.array(*map(F.lit, keys)).cast("array<bigint>"), task + 1)
    return docs.select(address.alias("t"), "*").repartition(len(keys), "t")


def spans_by_task(docs: DataFrame, keys: list[int], hot: int, pairs: int) -> DataFrame:
    """Messages with the intervals to remove, addressed to the tasks that hold the documents."""
    n = len(keys)
    sets = docs.groupBy("t").applyInArrow(anchor_sets(keys), MESSAGE)
    repeated = sets.repartition(n, "t").groupBy("t").applyInArrow(repeated_anchors(hot), MESSAGE)
    runs = docs.groupBy("t").cogroup(repeated.repartition(n, "t").groupBy("t")).applyInArrow(sorted_runs(keys), MESSAGE)
    return runs.repartition(n, "t").groupBy("t").applyInArrow(merged_runs(pairs), MESSAGE)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, pairs: int = PAIRS) -> DataFrame:
    """Per document its bytes, the removed ones and their runs, and a digest of what is kept."""
    keys = task_keys(df.sparkSession, partitions(df.sparkSession))
    docs = dealt(df, id_col, text_col, [], keys)

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, news: pa.Table) -> pa.Table:
        found = Documents(texts)
        results = []
        for data, gone in zip(found.texts, removed(found, news), strict=True):
            edges = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            results.append((len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*(results[i] for i in found.number), strict=True)) or [(), (), (), ()]
        return pa.table([texts.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    news = spans_by_task(docs, keys, hot, pairs).repartition(len(keys), "t")
    return docs.groupBy("t").cogroup(news.groupBy("t")).applyInArrow(run, REPORT)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The same rows and columns with the repeated bytes taken out of the texts; parts of a letter left by a cut go too."""
    columns = df.columns
    keys = task_keys(df.sparkSession, partitions(df.sparkSession))
    docs = dealt(df, id_col, text_col, columns, keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, news: pa.Table) -> pa.Table:
        found = Documents(texts)
        kept = [np.frombuffer(d, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for d, g in zip(found.texts, removed(found, news), strict=True)]
        rest = texts.column("rest").combine_chunks()
        own = pa.array([kept[i] for i in found.number], pa.string())
        return pa.table([own if c == text_col else rest.field(i) for i, c in enumerate(columns)], names=columns)

    news = spans_by_task(docs, keys, hot, PAIRS).repartition(len(keys), "t")
    return docs.groupBy("t").cogroup(news.groupBy("t")).applyInArrow(run, fields)
