"""Nearest neighbours by an int8 block matrix join, exact after recomputation.

Queries and candidates are cut into blocks, and every pair of a query block and a candidate block is one
cell of work. A cell holds its candidates in tiles of near ones, and queries pass by in tiles. Where the ball around
a tile of candidates is farther than the k-th distance that a query knows, the two don't meet. The others
are multiplied as int8; the product and
the norms give distances, the norms of what quantisation dropped give bounds of their errors. Pairs whose
lower bound is within the k-th distance known so far are computed again in double precision and kept
in a heap; the heaps of all cells of a query are merged.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors are compared with those of their own length; a vec_id null takes no part; rows that repeat a vec_id
count once as candidates, with their nearest vector, and a query's own vec_id never counts; of rows
that repeat a query's vec_id the least vector is the query; ties go to the smaller vec_id; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, partitions

K = 10
#: Queries that pass by a block of candidates in one cell; they are streamed and not held.
QUERY_BLOCK = 1 << 20
#: Components of the candidates that a cell holds: 32 MB in double precision.
COMPONENTS = 1 << 22
TILE = 2048
#: Relative slack for rounding in the bounds themselves, and an absolute one for squares that vanish.
SLACK = 1e-9
LEAST = 1e-150

CELL_SCHEMA = "query_id bigint, ids array<bigint>, scores array<double>"


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    )


class Quantised:
    """int8 values, their scale, the norm of what they stand for, of what they miss and of the vectors.

    All but the values are in units of 2**power, the vectors' largest component, so that no square overflows.
    """

    def __init__(self, x: np.ndarray):
        self.power = int(np.frexp(np.abs(x).max())[1])
        unit = np.ldexp(x, -self.power)
        self.scale = np.abs(unit).max(axis=1) / 127
        self.scale[self.scale == 0] = np.finfo(np.float64).tiny
        self.q = np.rint(unit / self.scale[:, None]).clip(-127, 127).astype(np.int8)
        stands = self.q * self.scale[:, None]
        self.norm, self.miss, self.whole = (np.sqrt((a**2).sum(axis=1)) for a in (stands, unit - stands, unit))

    def at(self, power: int) -> tuple[np.ndarray, ...]:
        """scale, norm, miss and whole in units of a larger 2**power."""
        return tuple(np.ldexp(a, self.power - power) for a in (self.scale, self.norm, self.miss, self.whole))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of 1024 of them at a time are whole numbers in float32."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed from the first component on; of far rows in larger units."""
    with np.errstate(over="ignore"):
        found = np.sqrt(np.add.accumulate((a - b) ** 2, axis=1)[:, -1])
        far = np.isinf(found)
        if far.any():
            found[far] = np.ldexp(np.sqrt((np.ldexp(np.ldexp(a[far], -2) - np.ldexp(b[far], -2), -1022) ** 2).sum(axis=1)), 1024)
    return found


class Tile:
    """Candidates that are multiplied at once, and the ball that holds them in units of 2**power."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.quantised = ids, x, Quantised(x)
        self.distinct = len(np.unique(ids)) == len(ids)
        unit = np.ldexp(x, -self.quantised.power)
        self.centre = unit.mean(axis=0)
        self.radius = np.sqrt(((unit - self.centre) ** 2).sum(axis=1).max())

    def least(self, x: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows, which are in units of 2**power, to the centre and the least they can have to a candidate."""
        more = self.quantised.power - power
        away, radius = np.sqrt(((x - np.ldexp(self.centre, more)) ** 2).sum(axis=1)), np.ldexp(self.radius, more)
        return away, away - radius - SLACK * (away + radius) - LEAST


def tiles_of(ids: np.ndarray, x: np.ndarray) -> list[Tile]:
    """A block's candidates as tiles of rows that are nearest to the same one of its rows, one in TILE of which is asked."""
    unit = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype(np.float32)
    pivots = unit[::TILE]
    half = (pivots**2).sum(axis=1) / 2
    nearest = np.concatenate([np.argmax(unit[at : at + TILE] @ pivots.T - half, axis=1) for at in range(0, len(x), TILE)])
    found = []
    for pivot in range(len(pivots)):
        rows = np.nonzero(nearest == pivot)[0]
        found.extend(Tile(ids[part], x[part]) for part in (rows[at : at + TILE] for at in range(0, len(rows), TILE)))
    return found


class Cell:
    """The k nearest candidates that each of some queries has met, in heaps with the farthest on top."""

    def __init__(self, ids: list[int], queries: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, queries, k
        self.quantised = Quantised(queries)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.best: list[dict[int, float]] = [{} for _ in ids]
        self.limit = np.full(len(ids), np.inf)  # distances, in units of one
        self.id_array = np.array(ids)

    def search(self, tiles: list[Tile]) -> None:
        """Every query meets the tile with the nearest centre first, then those whose ball reaches into its limit."""
        power = max(self.quantised.power, *(t.quantised.power for t in tiles))
        unit = np.ldexp(self.x, -power)
        bounds = [t.least(unit, power) for t in tiles]
        first = np.argmin([away for away, _ in bounds], axis=0)
        for i, tile in enumerate(tiles):
            self.meet(tile, np.nonzero(first == i)[0])
        for i, tile in enumerate(tiles):
            reached = bounds[i][1] <= np.ldexp(self.limit, -power) * (1 + SLACK)
            self.meet(tile, np.nonzero(reached & (first != i))[0])

    def meet(self, tile: Tile, asked: np.ndarray) -> None:
        """The queries of these numbers against the tile."""
        if not len(asked):
            return
        ids = tile.ids
        power = max(self.quantised.power, tile.quantised.power)
        own_scale, own_norm, own_miss, own_whole = (a[asked] for a in self.quantised.at(power))
        scale, norm, miss, whole = tile.quantised.at(power)
        dot = product(self.quantised.q[asked], tile.quantised.q) * own_scale[:, None] * scale[None, :]
        error = own_miss[:, None] * (norm + miss)[None, :] + own_norm[:, None] * miss[None, :]
        total = (own_whole**2)[:, None] + (whole**2)[None, :]
        error = 2 * error + SLACK * total
        approx = total - 2 * dot
        other = self.id_array[asked][:, None] != ids[None, :]
        limit = np.ldexp(self.limit[asked], -power) ** 2 * (1 + SLACK)
        if tile.distinct and len(ids) > self.k:  # k candidates of the tile are nearer than this
            upper = np.where(other, approx + error, np.inf)
            limit = np.minimum(limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((approx - error <= limit[:, None]) & other)
        rows = asked[rows]
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            for i, d, key in zip(r.tolist(), distances(self.x[r], tile.x[c]).tolist(), ids[c].tolist(), strict=True):
                self.push(i, d, key)
        for i in asked.tolist():
            if len(self.best[i]) == self.k:
                self.limit[i] = -self.heaps[i][0][0]

    def push(self, i: int, d: float, key: int) -> None:
        best, heap = self.best[i], self.heaps[i]
        known = best.get(key)
        if known is not None:
            if d < known:  # the id again, nearer
                heap.remove((-known, -key))
                heapq.heapify(heap)
                heapq.heappush(heap, (-d, -key))
                best[key] = d
        elif len(heap) < self.k:
            heapq.heappush(heap, (-d, -key))
            best[key] = d
        elif (-d, -key) > heap[0]:
            _, gone = heapq.heapreplace(heap, (-d, -key))
            del best[-gone]
            best[key] = d

    def rows(self) -> pa.RecordBatch:
        found = [sorted((-d, -key) for d, key in h) for h in self.heaps]
        return pa.RecordBatch.from_pydict({"query_id": self.ids, "ids": [[key for _, key in f] for f in found], "scores": [[d for d, _ in f] for f in found]}, schema=CELL_ARROW)


CELL_ARROW = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
RESULT_ARROW = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int | None = None) -> DataFrame:
    """The k nearest rows of each query: query_id, rank, vec_id, score. is_query is over column vec_id.

    Counts and the longest vector size the grid. A cell holds one block of candidates and streams a block
    of queries past it: each query is copied to every candidate block, each candidate to every one of the far larger
    query blocks (one up to a million queries), and no side is broadcast.
    """
    spark = df.sparkSession
    rows = vectors(df, id_col, vector_col)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m, dim = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v"))).first()
    shuffle = partitions(spark)
    block = candidate_block or max(TILE, COMPONENTS // (dim or 1))
    down, across = max(1, -(-m // query_block)), max(1, -(-n // block), min(shuffle, n // TILE))
    key = F.xxhash64("vec_id")
    c = rows.select("vec_id", "v", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("qb"), F.pmod(key, F.lit(across)).alias("cb"))
    q = asked.select("vec_id", "v", F.lit(1).alias("side"), F.pmod(key, F.lit(down)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("cb"))
    cells = c.unionByName(q).withColumn("dim", F.size("v"))
    place = ["dim", "qb", "cb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], []
        for (*cell, side), part in tiles(batches, [*place, "side"]):
            if cell != at:
                at, parts, held = cell, [], []
            if side == 0:
                parts.append(part)
                continue
            if parts:
                table = pa.Table.from_batches(parts)
                parts, held = [], tiles_of(table.column("vec_id").to_numpy(), matrix(table.column("v")))
            if held:
                table = pa.Table.from_batches([part])
                found = Cell(table.column("vec_id").to_pylist(), matrix(table.column("v")), k)
                found.search(held)
                yield found.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query,), table in groups(batches, ["query_id"]):
            lists = [list(zip(s, i, strict=True)) for s, i in zip(table.column("scores").to_pylist(), table.column("ids").to_pylist(), strict=True)]
            top, seen = [], set()
            for d, key in heapq.merge(*lists):
                if key not in seen:
                    seen.add(key)
                    top.append((d, key))
                    if len(top) == k:
                        break
            if top:
                yield pa.RecordBatch.from_pydict({"query_id": [query] * len(top), "rank": list(range(1, len(top) + 1)), "vec_id": [key for _, key in top], "score": [d for d, _ in top]}, schema=RESULT_ARROW)

    found = cells.repartition(shuffle, *place).sortWithinPartitions(*place, "side").mapInArrow(run, CELL_SCHEMA)
    return found.repartition(shuffle, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal keys, at most TILE rows at a time, in the order they come."""
    for batch in batches:
        marks = list(zip(*(batch.column(key).to_pylist() for key in keys), strict=True))
        at = 0
        while at < len(marks):
            to = at + 1
            while to < len(marks) and to - at < TILE and marks[to] == marks[at]:
                to += 1
            yield marks[at], batch.slice(at, to - at)
            at = to
