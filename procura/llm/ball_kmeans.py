"""Centroid clustering by ball k-means: Lloyd's rounds, exact, with few distances.

A cluster is a ball: its centroid, and a radius that no member lies beyond. A round moves centroids, so
the driver first bounds each new radius by the old one plus the move, and lists as neighbours of a cluster
the centroids that are at most two radii away; no other centroid can be nearer to a member. Inside a task
a member's distance to its own new centroid places it: closer than half the way to the nearest neighbour
it lies in the stable core and stays; beyond, in the annulus that has passed half the way to j neighbours,
it is compared with just those j. All comparisons are made in whole numbers, so bounds lose nothing.

A vector's component x counts as floor(scale * x). A round reads the table of vectors and labels, writes
it anew (the older one is deleted), and brings k sums to the driver; vectors are not shuffled.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no
part; ties go to the smaller number; a centroid without members stays; fewer vectors than k make as many
clusters; a null vec_id is chosen as a first centroid only after all others; repeated rows are separate
vectors; other columns are not read; an empty table gives an empty table. Distances and inertias that no
long holds are null. Sums are exact while components stay under 10 ** 17; larger ones are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, written_at

#: The contract's: number of clusters, rounds, components, seed and scale.
CLUSTERS = 8
ROUNDS = 10
COMPONENTS = 64
SEED = 3
SCALE = 1024
#: Largest magnitudes of components at which float64 (with whole numbers under 2 ** 53) and int64 are exact for up to 2 ** 8 components.
FLOAT_EXACT = 1 << 21
INT_EXACT = 1 << 26
LONG = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of float64 values as whole numbers: float64 where exact, int64, or Python's."""
    with np.errstate(over="ignore"):
        scaled = vectors * scale
    top = np.abs(scaled).max(initial=0)
    if top < INT_EXACT - 1 and scale & (scale - 1) == 0:
        floor = np.floor(scaled)
        return floor if top < FLOAT_EXACT - 1 else floor.astype(np.int64)
    exact = [[(n * scale) // d for n, d in (x.as_integer_ratio() for x in row)] for row in vectors.tolist()]
    if any(abs(x) >= 10**17 for row in exact for x in row):
        raise ValueError("a component is too large: sums would not be exact")
    return np.array(exact, object).reshape(vectors.shape)


def centroid_array(centroids: list[list[int]]) -> np.ndarray:
    top = max((abs(x) for c in centroids for x in c), default=0)
    return np.array(centroids, np.float64 if top < FLOAT_EXACT else np.int64 if top < INT_EXACT else object)


def squares(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, in the wider kind of number of the two."""
    kind = object if object in (rows.dtype, centre.dtype) else np.int64 if np.int64 in (rows.dtype, centre.dtype) else np.float64
    apart = rows.astype(kind, copy=False) - centre.astype(kind, copy=False)
    return (apart * apart).sum(axis=1)


def between(centroids: list[list[int]]) -> list[list[int]]:
    """Squared distances of centroids."""
    return [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centroids] for a in centroids]


def neighbours(centroids: list[list[int]], radii: list[int] | None) -> list[list[tuple[int, int]]]:
    """Per cluster (squared distance, number) of the centroids that its ball can reach, nearest first."""
    apart = between(centroids)
    return [sorted((d, j) for j, d in enumerate(row) if j != i and (radii is None or d <= (2 * radii[i]) ** 2)) for i, row in enumerate(apart)]


def assign(rows: np.ndarray, labels: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row, and how many distances that took."""
    labels = labels.copy()
    best = np.zeros(len(rows), object if object in (rows.dtype, centroids.dtype) else np.int64 if np.int64 in (rows.dtype, centroids.dtype) else np.float64)
    took = len(rows)
    for i in np.unique(labels).tolist():
        members = np.flatnonzero(labels == i)
        own = squares(rows[members], centroids[i])
        least, number = own.copy(), np.full(len(members), i, labels.dtype)
        active = np.arange(len(members))
        for apart, j in near[i]:
            # who is closer than half the way to this neighbour is so to all after it
            active = active[4 * own[active] >= apart]
            if not len(active):
                break
            d = squares(rows[members[active]], centroids[j])
            took += len(active)
            wins = (d < least[active]) | ((d == least[active]) & (j < number[active]))
            least[active[wins]], number[active[wins]] = d[wins], j
        best[members], labels[members] = least, number
    return labels, best, took


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str, components: int) -> DataFrame:
    """vec_id and vector of the vectors that take part, with label 0."""
    good = (F.size(vector_col) == components) & ~F.exists(F.col(vector_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    return df.where(F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.lit(0).alias("label"))


def labelled(points: DataFrame, centroids: list[list[int]], radii: list[int] | None, scale: int) -> DataFrame:
    """Points with new labels; own distances follow from them. Rows stay in their tasks."""
    centres, near = centroid_array(centroids), neighbours(centroids, radii)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = whole(matrix(part.column("vector")), scale)
                labels, best, _ = assign(rows, part.column("label").to_numpy(), centres, near)
                top = [str(int(d)) for d in best.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(labels, pa.int32()), pa.array(top)], names=["vec_id", "vector", "label", "squared"])

    kind = points.schema["vector"].dataType.simpleString()
    return points.mapInArrow(run, f"vec_id bigint, vector {kind}, label int, squared string")


def totals(points: DataFrame, k: int, scale: int) -> list[dict]:
    """Per cluster the sums of its components and its number of vectors: k x components rows, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        for batch in batches:
            for part in slices(batch):
                rows, labels = whole(matrix(part.column("vector")), scale), part.column("label").to_numpy()
                if sums is None:
                    sums = np.zeros((k, rows.shape[1] + 1), object)
                for i in np.unique(labels).tolist():
                    own = rows[labels == i]
                    sums[i, :-1] += own.sum(axis=0) if own.dtype == object else own.astype(np.int64).sum(axis=0).astype(object)
                    sums[i, -1] += len(own)
        if sums is not None:
            i, at = np.nonzero(np.broadcast_to(sums[:, -1:] > 0, sums.shape))
            values = pa.array([Decimal(int(x)) for x in sums[i, at]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), values], names=["label", "at", "total"])

    parts = points.select("vector", "label").mapInArrow(run, "label int, at int, total decimal(38,0)")
    return parts.groupBy("label", "at").agg(F.sum("total").alias("total")).collect()


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Per vector its cluster, squared distance, inertia of the cluster and of all, and a digest of its final centroid."""
    spark = df.sparkSession
    points, path = written_at(usable(df, id_col, vector_col, components))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(order.isNull(), order, F.col("vector").cast("array<double>")).limit(k).select(F.col("vector").cast("array<double>").alias("vector")).collect()
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = [[int(x) for x in row] for row in whole(np.array([r["vector"] for r in first], np.float64), scale).tolist()]
    radii: list[int] | None = None
    for turn in range(rounds + 1):
        older = path
        points, path = written_at(labelled(points, centroids, radii, scale))
        remove(spark, older)
        if turn == rounds:
            break
        sums: dict[int, dict[int, int]] = {}
        for row in totals(points, len(centroids), scale):
            sums.setdefault(row["label"], {})[row["at"]] = int(row["total"])
        moved = [[sums[i][a] // sums[i][components] for a in range(components)] if i in sums else c for i, c in enumerate(centroids)]
        far = {r["label"]: int(r["far"]) for r in points.groupBy("label").agg(F.max(F.col("squared").cast("decimal(38,0)")).alias("far")).collect()}
        shift = [math.isqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) + 1 for a, b in zip(centroids, moved, strict=True)]
        radii = [(math.isqrt(far[i]) + 1 if i in far else 0) + shift[i] for i in range(len(centroids))]
        centroids = moved
    d = F.col("squared").cast("decimal(38,0)")
    inertia = {r["label"]: r["s"] for r in points.groupBy("label").agg(F.try_sum(d).alias("s")).collect()}
    total = None if None in inertia.values() else sum(map(int, inertia.values()))
    fits = lambda v: int(v) if v is not None and v <= LONG else None
    named = [(i, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in inertia.items()]
    table = spark.createDataFrame(named, "label int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows
    return points.join(F.broadcast(table), "label").select("vec_id", F.col("label").alias("cluster"), F.when(d <= LONG, d).cast("bigint").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
