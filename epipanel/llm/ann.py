"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import stage

TREES = 16
SAMPLE = 20_000        # vectors that the trees are fitted on, at most
LEAF_SAMPLE = 64       # of them in a leaf, at least
SHARE = 1.0            # rows that a query reads in leaves, repeats counted, as a share of all
BLOCK = 4_096          # rows of a leaf, or queries at a leaf, that meet in one task


@dataclass(frozen=True)
class Forest:
    """Complete binary trees; the node after ``i`` is 2i + 1 on the low side, 2i + 2 on the other."""

    normals: np.ndarray    # tree, inner node, dimension
    limits: np.ndarray     # tree, inner node
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector (row) in each tree (column), numbered over all trees."""
        out = np.empty((len(unit), len(self.normals)), np.int64)
        for t, (normals, limits) in enumerate(zip(self.normals, self.limits)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                high = np.einsum("ij,ij->i", unit, normals[node]) > limits[node]
                node = 2 * node + 1 + high
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def search(self, unit: np.ndarray, sizes: np.ndarray, rows: float) -> list[int]:
        """Leaves to read for one vector, the most promising of all trees first.

        One queue holds the open nodes of every tree by the least margin on the
        way to them; it is read until the leaves hold ``rows`` rows.
        """
        inner = self.leaves - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        found, read = [], 0
        while queue and read < rows:
            margin, t, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner + t * self.leaves
                if sizes[leaf]:
                    found.append(leaf)
                    read += sizes[leaf]
                continue
            side = float(unit @ self.normals[t, node] - self.limits[t, node])
            heapq.heappush(queue, (max(margin, side), t, 2 * node + 1))
            heapq.heappush(queue, (max(margin, -side), t, 2 * node + 2))
        return found


def fit_forest(unit: np.ndarray, trees: int, leaf_sample: int, seed: int = 7) -> Forest:
    """Split each node by the hyperplane between two of its vectors, at the median."""
    depth = max(0, int(np.log2(max(1, len(unit)) / leaf_sample))) if len(unit) >= 2 * leaf_sample else 0
    inner = (1 << depth) - 1
    rng = np.random.default_rng(seed)
    normals = np.zeros((trees, inner, unit.shape[1]))
    limits = np.zeros((trees, inner))
    for t in range(trees):
        members = [np.arange(len(unit))]
        for node in range(inner):
            at = members[node]
            a, b = unit[rng.choice(at, 2, replace=len(at) < 2)] if len(at) else unit[:2]
            normals[t, node] = a - b
            side = unit[at] @ normals[t, node]
            limits[t, node] = np.median(side) if len(at) else 0.0
            low = side <= limits[t, node]
            members += [at[low], at[~low]]
    return Forest(normals, limits, depth)


def vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the lists of each length."""
    sizes = np.asarray(pa.compute.list_value_length(column), np.int64)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, vectors(column.take(pa.array(rows)))


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that squares neither vanish nor overflow."""
    _, exponent = np.frexp(np.abs(matrix).max(axis=1, keepdims=True))
    return np.ldexp(matrix, -exponent)


def units(matrix: np.ndarray) -> np.ndarray:
    even = scaled(matrix)
    return even / np.linalg.norm(even, axis=1, keepdims=True)


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf_sample: int = LEAF_SAMPLE,
    share: float = SHARE,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each query.

    ``is_query`` tells the queries by ``vec_id``. Nearness is the cosine in
    double precision; ties go to the smaller id. The trees are fitted on at
    most ``sample`` vectors, chosen by a hash; every row is indexed. A query
    reads leaves until they hold ``share`` times the number of rows, repeats
    among trees counted. On vectors without any structure that much is needed
    for a recall over 0.9; on clustered ones a small share does.

    Equal vectors are one class, which keeps its ``k + 1`` smallest ids, as no
    query needs more of them. So a frequent vector is indexed and searched once.
    Leaves are read in blocks of bounded size on both sides, however many rows
    or queries a leaf has; each block passes on its ``k + 1`` best classes a
    query.

    Rows without an id, and vectors that are null, zero, empty or not finite,
    take no part. Vectors of different lengths are never compared: each length
    has trees of its own, or one leaf where the sample has none of it. Repeated
    rows count once. With fewer than ``k`` candidates, all are returned. Other
    columns, whatever their names, are not read. An empty table gives an empty
    result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))

    # One row for each distinct vector, with its smallest ids. The rank is
    # limited in each task before the vectors of a class meet.
    order = Window.partitionBy("vec").orderBy("vec_id")
    smallest = rows.groupBy("vec", "vec_id").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = stage(
        smallest.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("cid"), "vec", "ids")
    )
    asked = stage(
        rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec").distinct()
        .join(classes.select("cid", F.col("vec").alias("v")), F.col("vec") == F.col("v"))
        .select("query_id", "cid")
    )

    chosen = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").toArrow()
    column = chosen.column("vec").combine_chunks()
    forests = {d: fit_forest(units(x), trees, leaf_sample) for d, _, x in by_length(column)} if len(column) else {}
    shared = spark.sparkContext.broadcast(forests)     # at most 2 * trees * sample / leaf_sample vectors

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_length(batch.column(1)):
                forest = shared.value.get(d)
                leaf = forest.place(units(x)) if forest else np.zeros((len(rows), 1), np.int64)
                at = pa.array(np.repeat(rows, leaf.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), d, np.int32)), pa.array(leaf.reshape(-1)), batch.column(0).take(at), batch.column(1).take(at)],
                    names=["d", "leaf", "cid", "vec"],
                )

    leaf_schema = "d int, leaf long, cid long, vec array<double>"
    indexed = classes.select("cid", "vec").mapInArrow(index, leaf_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves are told from vectors in little time; storing each vector once a tree would take more."""
        for batch in index(batches):
            leaf, n = np.unique(np.asarray(batch.column(1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, len(n)), pa.array(leaf), pa.array(n)], names=["d", "leaf", "n"])

    def collected(table: DataFrame) -> dict[tuple[int, int], int]:
        """Rows of each leaf that has any: a row for each leaf of the forests, and for each length without one."""
        return {(r.d, r.leaf): r.n for r in table.groupBy("d", "leaf").agg(F.sum("n").alias("n")).collect()}

    counted = collected(classes.select("cid", "vec").mapInArrow(count, "d int, leaf long, n long"))
    sizes = {d: np.array([counted.get((d, i), 0) for i in range(trees * f.leaves)], np.int64) for d, f in forests.items()}
    wanted = {d: share * n[: forests[d].leaves].sum() for d, n in sizes.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_length(batch.column(1)):
                forest = shared.value.get(d)
                found = [forest.search(u, sizes[d], wanted[d]) if forest else [0] for u in units(x)]
                at = pa.array(np.repeat(rows, [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), d, np.int32)), pa.array([x for f in found for x in f], pa.int64()),
                     batch.column(0).take(at), batch.column(1).take(at)],
                    names=["d", "leaf", "cid", "vec"],
                )

    askers = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "vec")
    visits = stage(askers.mapInArrow(search, leaf_schema))
    visitors = collected(visits.withColumn("n", F.lit(1)))

    def blocks(n: dict[tuple[int, int], int]) -> Column:
        """Blocks of a leaf; only leaves of more than one are listed."""
        out = F.lit(1)
        large = {key: -(-m // block) for key, m in n.items() if m > block}
        if large:
            listed = F.create_map(*[x for (d, i), m in large.items() for x in (F.lit(f"{d}:{i}"), F.lit(m))])
            out = F.coalesce(F.try_element_at(listed, F.concat_ws(":", "d", "leaf")), out)
        return out

    def spread(df: DataFrame, mine: Column, theirs: Column, own: str, other: str) -> DataFrame:
        """Deal rows to their side's blocks, once for each block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("cid"), mine)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), (theirs - 1).cast("long")))
        )

    n_rows, n_queries = blocks(counted), blocks(visitors)
    left = spread(indexed, n_rows, n_queries, "row_block", "query_block")
    right = spread(visits, n_queries, n_rows, "query_block", "row_block")

    def rerank(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(one) and len(two):
            ids, queries = (np.asarray(x.column("cid").combine_chunks()) for x in (one, two))
            a, b = (vectors(x.column("vec").combine_chunks()) for x in (one, two))
            ua, ub = units(a), units(b)
            a, b = scaled(a), scaled(b)
            na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
            for start in range(0, len(queries), 256):
                near = ub[start : start + 256] @ ua.T
                if len(ids) > k + 1:
                    # Products differ in their last digits; all that may tie with the last are scored.
                    last = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)]
                    q, r = np.nonzero(near >= last[:, None] - 1e-9)
                else:
                    q, r = np.nonzero(np.ones_like(near, bool))
                q += start
                score = np.einsum("ij,ij->i", b[q], a[r]) / (nb[q] * na[r])
                out.append((queries[q], ids[r], score))
        q, c, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(q, pa.int64()), "cid": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ["d", "leaf", "row_block", "query_block"]
    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "query long, cid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = (
        scored.groupBy("query", "cid").agg(F.max("score").alias("score"))
        .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    )
    # At most k + 1 classes of k + 1 ids for each class that is asked for.
    answers = (
        top.join(classes.select(F.col("cid").alias("c"), "ids"), F.col("cid") == F.col("c"))
        .select("query", F.explode("ids").alias("vec_id"), "score")
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    )
    told = asked.join(answers, F.col("cid") == F.col("query")).select(
        "query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found")
    )
    return told.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.far")).alias("score")
    )
