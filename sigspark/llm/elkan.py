"""Exact k-means of integer vectors, with Elkan's bounds to skip distances.

Each vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to each centroid. After
the centroids move, bounds change by how far they moved. A centroid is skipped where the upper bound is strictly below its
lower bound, or strictly below half of the distance between it and the vector's own centroid; it is then farther for sure,
so ties are never skipped. Bounds are rounded outwards to single precision; what is compared in the end are squared
distances in integers, which are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir

UP, DOWN = np.float32(np.inf), np.float32(-np.inf)


def above(squared: np.ndarray) -> np.ndarray:
    """A single-precision bound of the root from above."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), UP)


def below(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), DOWN), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two int64 matrices, or of a matrix and a vector."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def largest_component(dim: int) -> int:
    """The largest magnitude at which any squared distance of ``dim`` components fits a signed 64-bit integer."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


class Centroids:
    """Integer centroids, with half of the distances between them rounded down, and how far each moved, rounded up."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.points = np.array(points, np.int64).reshape(len(points), -1)
        k = len(points)
        between = np.stack([squared(self.points, p) for p in self.points]) if k else np.zeros((0, 0), np.int64)
        self.half = np.nextafter(below(between) / np.float32(2), DOWN)
        np.fill_diagonal(self.half, np.float32(np.inf))
        self.least = self.half.min(axis=1) if k else np.zeros(0, np.float32)
        self.moved = above(squared(self.points, np.array(before, np.int64))) if before else None

    def assign(self, x: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray) -> int:
        """Moves the bounds, then ``own`` to the nearest centroid (of equal ones the smallest number) and the bounds with
        it, in place. Returns the number of distances computed."""
        rows = np.arange(len(x))
        if self.moved is not None:
            up[:] = np.nextafter(up + self.moved[own], UP)
            low[:] = np.maximum(np.nextafter(low - self.moved, DOWN), np.float32(0))
        exact = np.full(len(x), -1, np.int64)  # the distance to the own centroid, once computed
        open_rows = rows[up >= self.least[own]] if len(self.points) > 1 else rows[:0]
        made = 0
        for j, c in enumerate(self.points):
            near = lambda r: r[(own[r] != j) & (up[r] >= low[r, j]) & (up[r] >= self.half[own[r], j])]  # noqa: B023, E731
            r = near(open_rows)
            loose = r[exact[r] < 0]
            if len(loose):
                exact[loose] = d = squared(x[loose], self.points[own[loose]])
                made += len(loose)
                up[loose], low[loose, own[loose]] = above(d), below(d)
                r = near(r)
            if not len(r):
                continue
            d = squared(x[r], c)
            made += len(r)
            low[r, j] = below(d)
            better = (d < exact[r]) | ((d == exact[r]) & (j < own[r]))
            won = r[better]
            own[won], exact[won], up[won] = j, d[better], above(d[better])
        return made


def kept_vectors(df: DataFrame, id_col: str, vector: str, dim: int, scale: float) -> DataFrame:
    """``id`` and ``v``: floor(scale * component) as integers, of the vectors with ``dim`` finite components."""
    limit = largest_component(dim)
    c = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    whole = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-limit)), F.lit(limit)).cast("int")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), c.alias("v")).where((F.size("v") == dim) & F.forall("v", finite))
    return rows.select("id", F.transform("v", whole).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``salt:id``; of equal ids the smaller vector first. Fewer rows, fewer centroids."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    got = rows.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in got]


def assigned(rows: DataFrame, centroids: Centroids, dim: int, first: bool, last: bool) -> DataFrame:
    """A pass over all vectors: id, v, cluster and the bounds; of the last pass id, cluster and the exact distance."""
    k, kind = len(centroids.points), rows.schema["id"].dataType
    names = ["id", "cluster", "distance"] if last else ["id", "v", "cluster", "up", "low"]

    def floats(a: pa.Array, width: int) -> np.ndarray:
        return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = floats(b.column(1), dim).astype(np.int64)
            if first:
                own, low = np.zeros(n, np.int64), np.zeros((n, k), np.float32)
                d = squared(x, centroids.points[0])
                up, low[:, 0] = above(d), below(d)
            else:
                own, up, low = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy(), floats(b.column(4), k).copy()
            centroids.assign(x, own, up, low)
            cluster = pa.array(own.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), cluster, pa.array(squared(x, centroids.points[own]))], names=names)
            else:
                lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(low.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cluster, pa.array(up), lists], names=names)

    schema = f"id {kind.simpleString()}, " + ("cluster int, distance bigint" if last else "v array<int>, cluster int, up float, low array<float>")
    return rows.mapInArrow(run, schema)


def means(state: DataFrame, dim: int, before: list[list[int]]) -> list[list[int]]:
    """Floors of the componentwise means of each cluster; an empty one stays where it was.

    Sums are partial in each task; one row of ``dim`` sums for each cluster reaches the driver.
    """
    got = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]).collect()
    new = [list(p) for p in before]
    for r in got:
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return new


def digest(point: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, point)).encode()).hexdigest()


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: float = 256.0, salt: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector after ``rounds`` rounds and a last assignment, and the centroids.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component becomes floor(scale * x). A
    component whose magnitude would let a squared distance leave 64 bits is held at that bound (2^27 for 64 components).
    Rows that repeat an id count as vectors of their own; a null id is written ``null`` for the choice of the first
    centroids. Fewer than ``k`` vectors give fewer centroids, none give an empty result.

    Vectors with their bounds are written as Parquet in the shared folder after each round, where a lost executor's part is
    read again, and the round before is deleted. A round is a map over them and one aggregate of partial sums, so the size
    of a cluster does not matter. Only the centroids (k times dim integers) stand on the driver.
    """
    spark = df.sparkSession
    folder, kind = shared_dir(spark), df.schema[id_col].dataType.simpleString()
    rows = kept_vectors(df, id_col, vector, dim, scale)
    points = first_centroids(rows, k, salt)
    if not points:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance bigint"), []
    state, path, before = rows, None, None
    for i in range(rounds):
        new = f"{folder}/round-{i}"
        assigned(state, Centroids(points, before), dim, before is None, False).write.parquet(new)
        if path:
            remove(spark, path)
        state, path, before = spark.read.parquet(new), new, points
        points = means(state, dim, points)
    assigned(state, Centroids(points, before), dim, before is None, True).write.parquet(f"{folder}/last")
    if path:
        remove(spark, path)
    return spark.read.parquet(f"{folder}/last"), points


def with_cluster_values(found: DataFrame, points: list[list[int]], id_col: str) -> DataFrame:
    """Adds each cluster's inertia, the inertia of all and the digest of the centroid; there is a row a cluster to look up."""
    spark = found.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(j, sums.get(j, 0), sum(sums.values()), digest(p)) for j, p in enumerate(points)]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    named: Column = F.col("id").alias(id_col)
    return found.join(F.broadcast(known), "cluster").select(named, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
