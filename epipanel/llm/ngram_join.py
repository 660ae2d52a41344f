"""Exact n-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import ascii_lower, components, released, small_batches, stage, text_of

SKETCH_BITS = 23           # counters of the frequency sketch, as a power of two
PIECE_BITS = 16            # counters of one piece of it
SLICE_WORDS = 1 << 18      # words whose shingles are made together, or those of one text
GROUP = 64                 # documents of a group, about
BLANKS = r"[\x20\x09-\x0D]+"
U64 = np.uint64


# ------------------------------------------------------------ shingle sets

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    last = max(0, len(words) - n + 1)
    out = mixed(words[:last])
    for j in range(1, n):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[j : last + j])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingles of each list of word hashes, some lists at a time."""
    sizes = np.asarray(pa.compute.list_value_length(column), np.int64)
    piece = np.cumsum(sizes) // SLICE_WORDS
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:]):
        words = np.asarray(column.slice(a, b - a).flatten(), np.int64).view(U64)
        ends = np.concatenate([[0], np.cumsum(sizes[a:b])])
        runs, out = chained(words, n), []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if end - start >= n:
                out.append(np.unique(runs[start : end - n + 1]))
            else:
                out.append(chained(words[start:end], end - start) if end > start else np.zeros(0, U64))
        yield out


def word_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.array_remove(F.split(ascii_lower(text_of(text_col)), BLANKS, -1), "")
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def identity(tokens: np.ndarray, seed: int) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()


def parity(tokens: np.ndarray) -> bytes:
    """Bits that every token flips; bits that differ are at most the tokens that do.

    There are at least as many as tokens. A wider map folds onto a narrower one.
    """
    width = 1 << int(np.clip(len(tokens) * 1.5, 64, 4096) - 1).bit_length()
    return np.packbits(np.bincount((tokens & U64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """A row per document, and in the same pass pieces of the frequency sketch."""
    shift = U64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in released(batches):
            keys, sizes, bits = [], [], []
            for sets in shingle_sets(batch.column(1), n):
                for tokens in sets:
                    keys.append(identity(tokens, seed))
                    sizes.append(len(tokens))
                    bits.append(parity(tokens))
                    at = (tokens >> shift).astype(np.int64)
                    np.add.at(counts, at, 1)
            none = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "key", "n", "bits", "piece", "counts"],
            )
        pieces = counts.reshape(-1, 1 << PIECE_BITS)
        used = [i for i in range(len(pieces)) if pieces[i].any()]
        packed = [zlib.compress(np.minimum(pieces[i], 65_535).astype("<u2").tobytes(), 1) for i in used]
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int32()), none.cast(pa.binary()),
             pa.array(used, pa.int32()), pa.array(packed, pa.binary())],
            names=["doc_id", "key", "n", "bits", "piece", "counts"],
        )

    schema = "doc_id long, key binary, n int, bits binary, piece int, counts binary"
    return word_rows(docs, id_col, text_col).mapInArrow(run, schema)


def frequency_levels(pieces: DataFrame) -> np.ndarray:
    """Level of each counter: four to a doubling of its sum over all tasks."""

    def add(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PIECE_BITS, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(counts.as_py()), "<u2")
        levels = np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["piece", "levels"])

    out = np.zeros((1 << (SKETCH_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint8)
    # The sketch has a fixed size: one byte a counter.
    for r in pieces.select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, levels binary").collect():
        out[r.piece] = np.frombuffer(r.levels, np.uint8)
    return out.reshape(-1)


# ---------------------------------------------------------------- the join

class Join:
    """One similarity join: 100 * overlap >= percent * union, on shingles of n words."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.docs, self.n, self.percent, self.id_col, self.text_col = docs, n, percent, id_col, text_col
        self.spark = docs.sparkSession
        for seed in range(16):
            self.seed = seed
            both = stage(signatures(docs, n, id_col, text_col, seed))
            self.rows = both.where("piece is null").select(
                "doc_id", "n", "bits", "key", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("sid")
            )
            # A class is one set; rows without an id or words are in none.
            self.classes = stage(
                self.rows.where("n > 0 and doc_id is not null").groupBy("key", "sid", "n", "bits").agg(F.min("doc_id").alias("rep"))
                .drop("key")
            )
            # Two sets of one short id are rare beyond reckoning; new ids are dealt then.
            if self.classes.groupBy("sid").count().where("count > 1").isEmpty():
                break
        self.levels = self.spark.sparkContext.broadcast(frequency_levels(both.where("piece is not null")))

    def postings(self) -> DataFrame:
        """(token, sid, n, pos): the indexed tokens of each set, the rarest first.

        Two sets that are similar enough share an indexed token, whatever the
        order of tokens, if it is the same for all sets. Once per task and set.
        """
        n, percent, seed, levels = self.n, self.percent, self.seed, self.levels
        shift = U64(64 - SKETCH_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in released(batches):
                sets, ids, sizes = [], [], []
                for tokens in (t for some in shingle_sets(batch.column(1), n) for t in some):
                    sid = int.from_bytes(identity(tokens, seed)[:8], "big", signed=True)
                    if not len(tokens) or sid in seen:
                        continue
                    seen.add(sid)
                    order = levels.value[(tokens >> shift).astype(np.int64)].argsort(kind="stable")
                    indexed = len(tokens) - -(-percent * len(tokens) // 100) + 1
                    sets.append(tokens[order[:indexed]])
                    ids.append(sid)
                    sizes.append(len(tokens))
                if sets:
                    times = [len(s) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), times)),
                         pa.array(np.repeat(np.array(sizes, np.int32), times)),
                         pa.array(np.concatenate([np.arange(t, dtype=np.int32) for t in times]))],
                        names=["token", "sid", "n", "pos"],
                    )

        rows = word_rows(self.docs.where(F.col(self.id_col).isNotNull()), self.id_col, self.text_col)
        return rows.mapInArrow(run, "token long, sid long, n int, pos int")

    def least_overlap(self, total):
        """Overlap that two sets need, by the sum of their sizes."""
        return F.ceil(total * self.percent / (100 + self.percent))

    def shared(self) -> DataFrame:
        """Postings of the tokens that several sets have, with the token's hub.

        The hub is the set in which the token comes first: one with few tokens
        of its own, as the original of many near copies has.
        """
        dealt = self.postings().repartition("token")
        several = (
            dealt.groupBy("token")
            .agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min(F.struct("pos", "sid", "n")).alias("hub"))
            .where("lo <> hi").select("token", F.col("hub.sid").alias("hub"))
        )
        return stage(dealt.join(several, "token").distinct())

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that are similar enough; written to the shared folder.

        Sizes and parity bits rule most others out without an error. What is
        left is compared whole: the sets are made again from their texts.
        """
        percent, n, seed = self.percent, self.n, self.seed

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for n1, n2, x, y in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "x", "y"))):
                    u, v = (np.frombuffer(b, np.uint8) for b in (x, y))
                    size = min(len(u), len(v))
                    u, v = (np.bitwise_xor.reduce(b.reshape(-1, size), axis=0) for b in (u, v))
                    differ = int(np.bitwise_count(u ^ v).sum())
                    # overlap >= p (n1 + n2) / (100 + p), so at most the rest of both differs.
                    keep.append(differ <= n1 + n2 - 2 * -(-percent * (n1 + n2) // (100 + percent)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = self.classes.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x"))
        two = self.classes.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y"))
        sized = pairs.join(one, "a").join(two, "b").where(
            (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
        )
        left = stage(sized.mapInArrow(near, "a long, b long"))

        needed = (
            left.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
            .join(self.classes.select("sid", "rep"), "sid")
        )
        # Stored, so that Spark sees its size and broadcasts it only if that is small.
        ids = stage(needed.select(F.col("rep").alias("__rep__")).distinct())
        texts = self.docs.join(ids, F.col(self.id_col).cast("long") == F.col("__rep__"), "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                for found in shingle_sets(batch.column(1), n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int.from_bytes(identity(t, seed)[:8], "big", signed=True) for t in found], pa.int64()),
                         pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))],
                        names=["sid", "tokens"],
                    )

        made = word_rows(texts, self.id_col, self.text_col).mapInArrow(sets, "sid long, tokens array<long>")
        whole = stage(made.join(needed.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))
        full = left.join(whole.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(
            whole.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b"
        )
        overlap = F.size(F.array_intersect("x", "y"))
        return stage(
            full.where(overlap * 100 >= (F.size("x") + F.size("y") - overlap) * percent).select("a", "b")
        )

    def links(self) -> DataFrame:
        """Links that join up all sets that links of any kind would.

        1. Sets are grouped by the hub that most of their shared tokens have,
           about ``GROUP`` to a group, and compared with their hub.
        2. The token-group matrix has the union of each group's indexed tokens,
           with its extremes of size and position. A set that is not in the
           main component of a token is a query there: the matrix tells the
           groups whose union shares a token with it, and the bounds on the
           overlap rule out groups that no member of can qualify. Groups of the
           query's own component are not looked at, as they add nothing.
        3. Only the groups that are left are opened: of their members those that
           have the shared token, at a place from which they can qualify, are
           compared.
        """
        shared = self.shared()
        votes = shared.groupBy("sid", "n", "hub").agg(F.count("*").alias("votes"))
        assigned = stage(
            votes.groupBy("sid", "n").agg(F.max(F.struct("votes", F.col("hub"))).alias("v")).select("sid", "n", F.col("v.hub").alias("hub"))
        )
        first = self.similar(assigned.where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")))
        found = components(first)

        many = assigned.groupBy("hub").agg(F.count("*").alias("m"))
        labelled = assigned.join(found.withColumnRenamed("id", "sid"), "sid", "left").select(
            "sid", "n", "hub", F.coalesce("component", "sid").alias("component")
        )
        # Labels of a group are only a way to deal sets out: equal ones do no harm.
        grouped = stage(
            labelled.join(many, "hub").select(
                "sid", "n", "component", F.xxhash64("hub", F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / GROUP))).alias("gid")
            )
        )
        told = shared.select("token", "sid", "pos").join(grouped, "sid")
        sides = told.groupBy("token", "component").agg(F.count("*").alias("m"))
        main = sides.groupBy("token").agg(
            F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("components")
        ).where("components > 1").select("token", F.col("main.component").alias("main"))
        open_ = stage(told.join(main, "token"))
        queries = open_.where("component <> main").select(
            "token", F.col("sid").alias("a"), F.col("n").alias("qn"), F.col("pos").alias("qpos"), F.col("component").alias("qc")
        )
        matrix = open_.groupBy("token", "gid").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"),
            F.min("component").alias("c1"), F.max("component").alias("c2"),
        )
        def fits(least, most, pos):
            """Whether sets of such sizes can qualify if this is the first token that both have.

            All tokens that they share then stand at or behind it in both.
            """
            smallest = F.greatest(least, F.ceil(F.col("qn") * self.percent / 100))
            rest = F.least(F.col("qn") - F.col("qpos"), most - pos)
            return (
                (most * 100 >= F.col("qn") * self.percent) & (F.col("qn") * 100 >= least * self.percent)
                & (rest >= self.least_overlap(F.col("qn") + smallest))
            )

        candidates = queries.join(matrix, "token").where(
            ((F.col("c1") != F.col("qc")) | (F.col("c2") != F.col("qc"))) & fits(F.col("lo"), F.col("hi"), F.col("pos"))
        ).select("token", "gid", "a", "qn", "qpos", "qc")
        members = open_.select("token", "gid", F.col("sid").alias("b"), "n", "pos", "component")
        pairs = candidates.join(members, ["token", "gid"]).where(
            (F.col("component") != F.col("qc")) & fits(F.col("n"), F.col("n"), F.col("pos"))
        ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return first.union(self.similar(pairs))


def jaccard_components(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A
    set holds the distinct shingles of ``words`` words as 64-bit hashes; fewer
    words make one shingle. Two documents link when 100 * overlap >= percent *
    union. component_id is the smallest id reachable over links. The join is
    exact: frequency sketch, groups and bounds only save comparisons. Equal
    sets are compared once, and links inside a component are not all found, as
    one way to reach a set is enough.

    Null and empty texts have no shingles and link with nothing: their
    component is their own id. Rows without an id link with nothing and have no
    component. Rows of equal id are one document to component_id. Other
    columns, whatever their names, are not read. An empty table gives an empty
    result.
    """
    join = Join(docs, words, percent, id_col, text_col)
    found = components(join.links())
    named = found.join(join.classes.select(F.col("sid").alias("id"), "rep"), "id")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    label = stage(named.join(least, "component").select(F.col("id").alias("sid"), "least"))
    # Sets that link with no other have at least their own copies.
    own = join.classes.select("sid", "rep").join(label, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"))
    told = join.rows.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sid")).alias("sid")
    )
    # Rows without a set are spread by their ids, which match none.
    spread = told.withColumn("match", F.coalesce("sid", F.xxhash64("doc_id")))
    return spread.join(own.withColumnRenamed("sid", "match"), "match", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles",
        F.when(F.col("sid").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay when of each component only the smallest id does, with the input's columns.

    Null and empty texts and rows without an id are in no component and stay.
    Rows that repeat the id that stays all do. Texts of any length are compared
    whole. Clashing column names are kept as they are; an empty table gives an
    empty result.
    """
    kept = jaccard_components(docs, words, percent, id_col, text_col).where(
        F.col(id_col).eqNullSafe(F.col("component_id"))
    ).select(F.col(id_col).alias("__kept__")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__kept__")), "left_semi")
