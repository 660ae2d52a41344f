"""Centroid clustering of whole-number vectors with geometrically tightened bounds."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove_folders, shared_folder
from .support import stage

SCALE = 1_024          # steps to one unit of a component
LARGEST = 1 << 27      # components below this keep every squared distance of 64 of them within 64 bits
SLACK = 1e-9           # relative room for rounding in the bounds; what falls into it is scanned exactly
ROWS = 4_096           # vectors compared at once
STATE = "vec_id long, x array<long>, cluster int, upper double, lower double"


def whole(vec: Column, dimensions: int, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector is kept, and its components as whole numbers."""
    fits = (F.size(vec) == dimensions) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    too_large = F.raise_error(F.lit(f"a component is {LARGEST // scale} or more: squared distances would not fit"))

    def step(x: Column) -> Column:
        y = F.floor(x * float(scale))
        return F.when((y < LARGEST) & (y > -LARGEST), y).otherwise(too_large.cast("long"))

    return vec.isNotNull() & fits, F.transform(vec, step)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector (row) to each centroid (column)."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = x - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def drift_bounds(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer another moved centroid can have come to any of its vectors.

    The vectors of cluster i lie in a sphere around its old centroid. Another
    centroid moves from a to b, by p. By symmetry the worst vector lies in the
    plane of a, b and the sphere's centre. There the points whose distance
    falls by at least g, from a to b, lie behind a branch of a hyperbola with
    foci a and b, and so in the cone around the direction of the move whose
    apex is midway and whose half angle has the cosine g / p. Let phi be the
    smallest angle under which the sphere stands from the apex. No vector's
    distance then falls by more than p cos(phi), nor at all if phi is beyond a
    right angle. Only a sphere that meets the axis ahead costs the full p.
    """
    k = len(old)
    old, new = old.astype(float), new.astype(float)
    move = new - old
    p = np.sqrt((move * move).sum(axis=1))
    fall = np.zeros((k, k))
    for j in np.flatnonzero(p):
        ahead = move[j] / p[j]
        to_centre = old - (old[j] + new[j]) / 2
        far = np.sqrt((to_centre * to_centre).sum(axis=1))
        along = to_centre @ ahead
        across = np.sqrt(((to_centre - along[:, None] * ahead) ** 2).sum(axis=1))
        apart = far > radius * (1 + 1e-6)
        half = np.where(apart, np.arcsin(np.where(apart, radius, 0) / np.where(apart, far, 1)), np.pi)
        angle = np.arctan2(across, along) - half - SLACK
        fall[:, j] = np.where(angle <= 0, p[j], p[j] * np.maximum(np.cos(np.minimum(angle, np.pi)), 0))
    np.fill_diagonal(fall, 0)
    return fall.max(axis=1) * (1 + SLACK) if k else np.zeros(0)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, fall: np.ndarray) -> DataFrame:
    """The state under new centroids.

    ``upper`` is at least the distance to the own centroid, ``lower`` at most
    that to any other. Both are loosened; a vector whose upper bound stays
    below its lower one, or below half the way to the nearest other centroid,
    keeps its cluster unseen. Else the distance to its own centroid is taken,
    and if that does not decide, all are, in whole numbers.
    """
    k = len(centroids)
    c = centroids.astype(float)
    gaps = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)) if k <= 64 else np.array(
        [np.sqrt(((c - row) ** 2).sum(axis=1)) for row in c]
    )
    np.fill_diagonal(gaps, np.inf)
    alone = gaps.min(axis=1) / 2 * (1 - SLACK)
    context = state.sparkSession.sparkContext
    shared = context.broadcast((centroids, moved, fall, alone))      # k vectors and three numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, moved, fall, alone = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = matrix(batch.column("x"))
                cluster = np.array(batch.column("cluster"), np.int64)
                upper = np.array(batch.column("upper")) + moved[cluster] * (1 + SLACK)
                lower = np.array(batch.column("lower")) - fall[cluster]
                safe = np.maximum(lower, alone[cluster])
                open_ = np.flatnonzero(~(upper < safe))
                own = x[open_] - centroids[cluster[open_]]
                upper[open_] = np.sqrt(np.einsum("ij,ij->i", own, own).astype(float)) * (1 + SLACK)
                open_ = open_[~(upper[open_] < safe[open_])]
                found = squared(x[open_], centroids)
                if len(open_):
                    best = found.argmin(axis=1)          # the first of equal ones
                    cluster[open_] = best
                    rows = np.arange(len(open_))
                    upper[open_] = np.sqrt(found[rows, best].astype(float)) * (1 + SLACK)
                    found[rows, best] = np.iinfo(np.int64).max
                    lower[open_] = np.sqrt(found.min(axis=1).astype(float)) * (1 - SLACK)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)],
                    names=["vec_id", "x", "cluster", "upper", "lower"],
                )

    return state.mapInArrow(run, STATE)


def summed(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, component sums and radius of each cluster. A task sends one row a cluster, whatever their sizes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, radius = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), np.zeros(k)
        for batch in batches:
            x, cluster = matrix(batch.column(0)), np.asarray(batch.column(1), np.int64)
            for j in np.unique(cluster):
                mine = cluster == j
                n[j] += mine.sum()
                total[j] += x[mine].sum(axis=0)
                radius[j] = max(radius[j], np.asarray(batch.column(2))[mine].max())
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64())), pa.array(radius[used])],
            names=["cluster", "n", "total", "radius"],
        )

    parts = state.select("x", "cluster", "upper").mapInArrow(add, "cluster int, n long, total array<long>, radius double")
    out = np.zeros(k, object), np.zeros((k, dimensions), object), np.zeros(k)
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *sums).collect():
        out[0][r.cluster], out[2][r.cluster] = r.n, r.radius
        out[1][r.cluster] = [r[f"s{i}"] for i in range(dimensions)]
    return out


def sha(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(
    embeddings: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: str = "3",
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Components become floor(1024 x). The ``k`` kept vectors with the smallest
    SHA-256 of "seed:id" are the first centroids. Each round assigns every
    vector to the nearest centroid, by exact squared distance, equal ones to
    the smaller number, and moves each centroid that has vectors to the floors
    of their means; vectors are assigned once more at the end. Bounds only
    spare comparisons: the result is that of comparing all.

    Vectors that are null, of another length, or hold null or non-finite
    components take no part, nor do rows without an id. Repeated rows are
    vectors of their own. First centroids of equal hash (rows of one id) stand
    in order of their components. With fewer than ``k`` vectors there are as
    many centroids as vectors. A component of 2^17 or more is an error, as squared
    distances would leave the 64 bits. Other columns, whatever their names, are
    not read. An empty table gives an empty result.

    The driver holds ``k`` centroids and their sums, and k x k distances. Each
    round's state is written to the shared folder and the one before removed.
    """
    spark = embeddings.sparkSession
    kept, x = whole(F.col(vec_col).cast("array<double>"), dimensions)
    vectors = embeddings.where(F.col(id_col).isNotNull() & kept).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    start = vectors.withColumns({"cluster": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"

    def stored(df: DataFrame, turn: int) -> DataFrame:
        df.write.parquet(f"{folder}/{turn}")
        if turn:
            remove_folders(spark, [f"{folder}/{turn - 1}"])
        return spark.read.schema(STATE).parquet(f"{folder}/{turn}")

    state = stored(start, 0)
    # k rows, by their hashes.
    first = state.select("vec_id", "x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    chosen = first.orderBy("h", "x").limit(k).collect()
    centroids = np.array([r.x for r in chosen], np.int64).reshape(len(chosen), dimensions)
    k = len(centroids)
    moved, fall = np.zeros(k), np.zeros(k)
    for turn in range(rounds + 1 if k else 0):
        state = stored(assign(state, centroids, moved, fall), turn + 1)
        if turn == rounds:
            break
        n, total, radius = summed(state, k, dimensions)
        new = centroids.copy()
        for j in range(k):
            if n[j]:
                new[j] = [s // n[j] for s in total[j]]      # whole numbers of any size; // floors
        moved = np.sqrt(((new - centroids).astype(float) ** 2).sum(axis=1))
        fall = drift_bounds(centroids, new, radius)
        centroids = new

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.asarray(batch.column(2), np.int64)
            gap = matrix(batch.column(1)) - centroids[mine] if batch.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", gap, gap))], names=["vec_id", "cluster", "distance"]
            )

    told = stage(state.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    sizes = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(
        [(j, sha(c)) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string"
    )
    whole_sum = told.select(F.sum("distance")).scalar()
    by_cluster = sizes.join(named, "cluster").withColumn("inertia", whole_sum)
    # k rows.
    return told.join(F.broadcast(by_cluster), "cluster").select(
        F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
