"""Resampling documents to a target distribution by importance weights and quickselect."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_positions
from .support import released, small_batches, stage, text_parts

BUCKETS = 10_000       # hashed features are counted in so many buckets
SCALE = 1_000          # gains and noise are whole thousandths
PIVOTS = 16            # pivot keys of a round of the quickselect
PART_BYTES = 4_000_000   # texts taken apart at once
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KEY = "low long, id long, n_features long"     # smaller keys are drawn first


def hashed(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``longest`` words, with each text's number of runs and words.

    The checksum of a run goes on from that of the run without its last word,
    so no run is put together.
    """
    runs: list[int] = []
    sizes, words_of = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        before, words_of[i] = len(runs), len(words)
        last = list(map(crc32, words))
        runs += last
        for n in range(1, longest):
            last = list(map(crc32, [b" " + w for w in words[n:]], last))
            runs += last
        sizes[i] = len(runs) - before
    return np.array(runs, np.int64), sizes, words_of


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks send sums, so at most ``buckets`` rows each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in released(batches):
            for texts in text_parts(batch.column(0), PART_BYTES):
                total += np.bincount(hashed(texts, longest)[0] % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    told = small_batches(docs).select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in told.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds: the log ratio of smoothed shares, in whole thousandths, floored."""
    buckets = len(raw)
    over, under = float(raw.sum() + buckets), float(target.sum() + buckets)
    ratio = ((target + 1).astype(float) * over) / ((raw + 1).astype(float) * under)
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean of its features' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            told = []
            for texts in text_parts(batch.column(1), PART_BYTES):
                runs, sizes, words = hashed(texts, longest)
                upto = np.concatenate([[0], np.cumsum(gain[runs % len(gain)])])
                ends = np.cumsum(sizes)
                told.append((words, sizes, (upto[ends] - upto[ends - sizes]) // np.maximum(sizes, 1)))
            words, sizes, weight = (np.concatenate(x) for x in zip(*told)) if told else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(sizes), pa.array(weight)], names=["id", "n_words", "n_features", "weight"]
            )

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise of an id, in whole thousandths: the same in every run and on every executor."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def key_of(values: tuple[int, ...]) -> Column:
    names = ("low", "id", "n_features")
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, values)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, ...]:
    """The ``k``-th smallest (low, id, n_features) of ``rows``, from 1; there must be as many.

    Each round takes random keys of the open range as pivots and counts, in one
    pass that combines map-side, the rows below, at and between them. The range
    that holds the k-th key stays open; when it is a pivot, that is the answer.
    The driver sees the pivots and 2 * pivots + 1 counts a round, and the range
    shrinks by a factor of about ``pivots``. Every round removes its pivots at
    least, so equal keys in any number end it as well.
    """
    key, low, high, turn = F.struct("low", "id", "n_features"), None, None, 0
    while True:
        turn += 1
        open_ = rows
        if low is not None:      # the plain column's bound reaches the scan
            open_ = open_.where((F.col("low") >= low[0]) & (key > key_of(low)))
        if high is not None:
            open_ = open_.where((F.col("low") <= high[0]) & (key < key_of(high)))
        drawn = open_.orderBy(F.xxhash64("low", "id", "n_features", F.lit(turn))).limit(pivots)
        cuts = sorted({tuple(r) for r in drawn.select("low", "id", "n_features").collect()})
        cell = F.lit(0)
        for cut in cuts:
            cell = cell + (key >= key_of(cut)).cast("int") + (key > key_of(cut)).cast("int")
        counts = {r.cell: r["count"] for r in open_.groupBy(cell.alias("cell")).count().collect()}
        at = 0
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
        if at % 2:
            return cuts[at // 2]
        low = cuts[at // 2 - 1] if at else low
        high = cuts[at // 2] if at // 2 < len(cuts) else high


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    *, percent: int = 10, longest: int = 1, least_words: int = 20, buckets: int = BUCKETS, seed: str = "2024", pivots: int = PIVOTS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; those drawn have a rank.

    Words are runs of digits, letters (A-Z in lower case) and characters
    beyond ASCII. Features are runs of 1 to ``longest`` words, hashed into
    ``buckets``. A row's weight is the mean gain of its features toward the
    texts of ``target``, its score the weight with Gumbel noise of its id. Of
    the rows with at least ``least_words`` words, ``percent`` in a hundred with
    the largest scores are drawn, without replacement.

    1. Counts of both tables: one row per task and bucket moves.
    2. Weights by an array of gains; the scores are written to the shared folder.
    3. A distributed quickselect finds the key of the last row that is drawn.
       Only the rows up to it are sorted, by ranges, and ranked.

    Ties go to the smaller id, then to fewer features; rows that are equal in
    all of these are drawn one by one and tell the same. Null and empty texts
    have no features, a weight of 0, and are not drawn. Rows without an id have
    a weight but no score and are not drawn nor counted. With no target texts
    the gains still follow from the smoothed counts. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    told = weighted(docs, gain, id_col, text_col, longest)
    scores = stage(
        told.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).select(
            "id", "n_features", "weight", "score", (-F.col("score")).alias("low"),
            ((F.col("n_words") >= least_words) & F.col("id").isNotNull()).alias("takes_part"),
        )
    )
    taking = scores.where("takes_part")
    k = percent * taking.count() // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    if not k:
        return scores.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = kth_key(taking, k, pivots)
    drawn = F.col("takes_part") & (F.struct("low", "id", "n_features") <= key_of(last))
    # Rows whose key equals the last one may be more than are wanted; they come last.
    first = range_positions(scores.where(drawn), ["low", "id", "n_features"], "place")
    ranked = first.withColumn("rank", F.when(F.col("place") <= k, F.col("place")))
    rest = scores.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The input's rows whose id is drawn, with the input's columns. See ``resample``.

    Rows that share an id stay together when one of them is drawn. Rows
    without an id go.
    """
    ids = resample(docs, target, id_col, **options).where("rank is not null").select(F.col(id_col).alias("__drawn__")).distinct()
    return docs.join(ids, F.col(id_col).cast("long") == F.col("__drawn__"), "left_semi")
