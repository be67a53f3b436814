"""Rules with a memory over keys of any size: a segmented scan.

A key's events are cut into chunks of time. Each chunk is summed up, in parallel, as a transfer function:
what state comes out for each state that may go in. The functions of a key, far fewer rows than its
events, are applied one after another to find what goes into each chunk; then all chunks are run, again
in parallel, each from its own entry state. So one key with all events is spread over as many tasks as it
has chunks, and results are those of a fold over the whole key.

A machine is either awake, in one of finitely many states, or asleep until a time: events before that time
leave it as it is, and the first event from then on finds it in the state `woken`. Of states asleep only
those matter that end within a chunk's first stretch of the longest sleep, so with chunks of many sleeps
the functions stay short. Rows with a null time or key have no place in an order and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import written

#: Chunks are this many times as long as the longest sleep.
SLEEPS = 64


@dataclass(frozen=True)
class Machine:
    """States awake (the first is that before all events), the one found on waking, and a step.

    step(state, at, event, sleep) gives the next state and, if it falls asleep, until when (else None).
    """

    states: tuple[Hashable, ...]
    woken: Hashable
    step: Callable[[Hashable, int, object, int], tuple[Hashable, int | None]]


def run_of(machine: Machine, entry: tuple[int | None, int | None]) -> Callable[[int, object, int], tuple[Hashable, Hashable | None, int | None]]:
    """A fold from an entry (number of a state awake, or None and the end of sleep): each event gives (state before or None if asleep, state after, end of sleep)."""
    state, until = (None, entry[1]) if entry[0] is None else (machine.states[entry[0]], None)

    def on(at: int, event, sleep: int):
        nonlocal state, until
        if until is not None and at >= until:
            state, until = machine.woken, None
        before = state if until is None else None
        if until is None:
            state, until = machine.step(state, at, event, sleep)
        return before, state, until

    return on


class Transfer:
    """Runs all entries of a chunk at once; entries that meet in one state go on as one."""

    def __init__(self, machine: Machine, low: int, sleep: int):
        self.machine, self.wakes_before, self.sleep = machine, low + sleep, sleep
        self.parent = list(range(len(machine.states)))
        self.awake: dict[Hashable, int] = {s: i for i, s in enumerate(machine.states)}
        self.asleep: list[tuple[int, int]] = []
        self.pieces: list[tuple[int, int]] = []  # (end of sleep at most, run)

    def root(self, n: int) -> int:
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def joins(self, live: dict, state: Hashable, n: int) -> None:
        if state in live:
            self.parent[n] = live[state]
        else:
            live[state] = n

    def on(self, at: int, event) -> None:
        woken = self.machine.woken
        while self.asleep and self.asleep[0][0] <= at:
            self.joins(self.awake, woken, heappop(self.asleep)[1])
        # every sleep from before the chunk is over by `wakes_before`, so the first event from then on is the last that ends one
        if not self.pieces or self.pieces[-1][0] < min(at, self.wakes_before):
            if woken not in self.awake:
                self.parent.append(len(self.parent))
                self.awake[woken] = self.parent[-1]
            self.pieces.append((at, self.awake[woken]))
        live: dict[Hashable, int] = {}
        ends: dict[int, int] = {}
        for state, n in self.awake.items():
            after, until = self.machine.step(state, at, event, self.sleep)
            if until is None:
                self.joins(live, after, n)
            elif until in ends:
                self.parent[n] = ends[until]
            else:
                ends[until] = n
                heappush(self.asleep, (until, n))
        self.awake = live

    def rows(self) -> Iterator[tuple[int | None, int | None, int | None, int | None]]:
        """(entry state, or entry end of sleep at most; exit state, or exit end of sleep)."""
        number = {s: i for i, s in enumerate(self.machine.states)}
        out: dict[int, tuple[int | None, int | None]] = {n: (number[s], None) for s, n in self.awake.items()} | {n: (None, until) for until, n in self.asleep}
        for i in range(len(self.machine.states)):
            yield (i, None, *out[self.root(i)])
        last: tuple | None = None
        for upto, n in self.pieces:
            now = out[self.root(n)]
            if last and last[1] != now:
                yield (None, last[0], *last[1])
            last = (upto, now)
        if last:
            yield (None, last[0], *last[1])


FUNCTION = "key string, chunk long, entry int, upto long, state int, until long"
TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
ENTRIES = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("state", pa.int32()), ("until", pa.int64())])


def functions(events: DataFrame, machine: Machine) -> DataFrame:
    """The transfer function of each chunk."""
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("entry", pa.int32()), ("upto", pa.int64()), ("state", pa.int32()), ("until", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, transfer = None, None

        def given() -> Iterator[pa.RecordBatch]:
            if transfer:
                rows = [(*own, *r) for r in transfer.rows()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for key, chunk, at, event, sleep, span in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "at", "event", "sleep", "span")), strict=True):
                if (key, chunk) != own:
                    yield from given()
                    own, transfer = (key, chunk), Transfer(machine, chunk * span, sleep)
                transfer.on(at, event)
        yield from given()

    return events.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "at", "place").mapInArrow(run, FUNCTION)


def entries(functions_of: DataFrame) -> DataFrame:
    """What goes into each chunk: a pass over the functions of a key, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk_now = None
        state: tuple[int | None, int | None] = (0, None)
        after = state  # what comes out of the chunk, once its piece is met
        met = False
        for batch in batches:
            found = []
            for key, chunk, entry, upto, out, until in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != own:
                    own, chunk_now, after = key, None, (0, None)
                if chunk != chunk_now:
                    chunk_now, state, met = chunk, after, False
                    found.append((key, chunk, *state))
                if not met and (entry == state[0] if entry is not None else state[1] is not None and upto >= state[1]):
                    after, met = (out, until), True
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), ENTRIES, strict=True)], schema=ENTRIES)

    columns = ["key", "chunk", "entry", "upto", "state", "until"]
    return functions_of.select(*columns).repartition("key").sortWithinPartitions("key", "chunk", "entry", "upto").mapInArrow(run, "key string, chunk long, state int, until long")


def scan(df: DataFrame, machine: Machine, key: Column, at: Column, place: Column, event: Column, sleep: Column, out: Callable[[Hashable | None, Hashable, int | None], tuple], columns: str, sleeps: int = SLEEPS) -> DataFrame:
    """Runs a machine over the events of every key in the order of (at, place); at and sleep (the longest, the same for all of a key) count in the same unit.

    out(state before or None if asleep, state after, end of sleep) gives the values of `columns` (string, boolean or
    long) for an event; rows come back as (key, place, at) and these.
    """
    rows = df.select(key.cast("string").alias("key"), at.cast("bigint").alias("at"), place.alias("place"), event.alias("event"), F.greatest(sleep.cast("bigint"), F.lit(1)).alias("sleep"))
    rows = rows.where("key is not null and at is not null").withColumn("span", F.col("sleep") * sleeps).withColumn("chunk", F.floor(F.col("at") / F.col("span")).cast("bigint"))
    rows = written(rows)
    goes_in = written(entries(functions(rows, machine)))
    given = [c.split() for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = None
        for batch in batches:
            found: list[tuple] = []
            for k, at_, place_, event_, sleep_, first, state, until in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "place", "event", "sleep", "first", "state", "until")), strict=True):
                if first:
                    on = run_of(machine, (state, until))
                else:
                    found.append((k, place_, at_, *out(*on(at_, event_, sleep_))))
            if found:
                schema = pa.schema([("key", pa.string()), ("place", batch.schema.field("place").type), ("at", pa.int64()), *((name, TYPES[kind]) for name, kind in given)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    none = lambda kind: F.lit(None).cast(kind)
    kind, order = rows.schema["event"].dataType, rows.schema["place"].dataType
    heads = goes_in.select("key", "chunk", none("bigint").alias("at"), none(order).alias("place"), none(kind).alias("event"), none("bigint").alias("sleep"), F.lit(True).alias("first"), "state", "until")
    every = rows.select("key", "chunk", "at", "place", "event", "sleep", F.lit(False).alias("first"), none("int").alias("state"), none("bigint").alias("until")).unionByName(heads)
    # an entry has no time, so it comes first
    return every.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.col("at").asc_nulls_first(), "place").mapInArrow(run, f"key string, place {order.simpleString()}, at long, {columns}")


def before(df: DataFrame, key: Column, at: Column, place: Column, value: Column, span: Column, name: str = "before") -> DataFrame:
    """Adds the last value that is not null of the rows of the same key before a row, in the order of (at, place).

    Windows run over chunks of `span`; what a chunk takes over from those before it comes from one row a
    chunk, so no window holds the rows of a key.
    """
    own = df.withColumn("__key", key.cast("string")).withColumn("__at", at.cast("bigint")).withColumn("__place", place).withColumn("__value", value).withColumn("__chunk", F.floor(F.col("__at") / span).cast("bigint"))
    order = F.struct("__at", "__place")
    lasts = own.where("__value is not null").groupBy("__key", "__chunk").agg(F.max_by("__value", order).alias("__last"))
    chunks = own.select("__key", "__chunk").distinct().join(lasts, ["__key", "__chunk"], "left")
    carried = chunks.withColumn("__carried", F.last("__last", ignorenulls=True).over(W.partitionBy("__key").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))).drop("__last")
    within = F.last("__value", ignorenulls=True).over(W.partitionBy("__key", "__chunk").orderBy("__at", "__place").rowsBetween(W.unboundedPreceding, -1))
    return own.withColumn("__within", within).join(carried, ["__key", "__chunk"]).withColumn(name, F.coalesce("__within", "__carried")).select(*df.columns, name)


def cooldown() -> Machine:
    """Fires on the first event that finds it awake, then sleeps."""
    return Machine(("ready",), "ready", lambda state, at, event, sleep: ("ready", at + sleep))


def breaker(failures: int, successes: int) -> Machine:
    """Closed with the failures in a row, or half open with the successes; it sleeps while open. An event is whether a call went well."""
    closed, half = [("closed", i) for i in range(failures)], [("half_open", i) for i in range(successes)]

    def step(state, at, ok, sleep):
        name, n = state
        if name == "closed":
            return (closed[0], None) if ok else (closed[n + 1], None) if n + 1 < failures else (half[0], at + sleep)
        if not ok:
            return half[0], at + sleep
        return (half[n + 1], None) if n + 1 < successes else (closed[0], None)

    return Machine((*closed, *half), half[0], step)


#: What can happen to a notification, and its states.
SENT, DELIVERED, READ, FAILED, PENDING = "sent", "delivered", "read", "failed", "pending"


def delivery(retries: int = 3) -> Machine:
    """Pending with the failed attempts so far, sent, delivered, read, or failed after so many attempts.

    An event is `ok` or `error` (an attempt), `delivered` or `read`. Attempts count while a notification is
    pending; it can be read without a receipt, and nothing leads out of read or failed.
    """
    pending = [(PENDING, i) for i in range(retries)]
    sent, failed = [[(name, i) for i in range(retries + 1)] for name in (SENT, FAILED)]
    delivered, read = [[(name, i) for i in range(retries)] for name in (DELIVERED, READ)]

    def step(state, at, event, sleep):
        name, n = state
        if name == PENDING and event == "ok":
            return sent[n], None
        if name == PENDING and event == "error":
            return (pending[n + 1] if n + 1 < retries else failed[retries]), None
        if name == SENT and event == "delivered":
            return delivered[n], None
        if name in (SENT, DELIVERED) and event == "read":
            return read[n], None
        return state, None

    return Machine((*pending, *sent[:retries], *delivered, *read, failed[retries]), pending[0], step)
