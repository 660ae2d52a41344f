"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import released, small_batches, stage, text_of

SAMPLE = 20_000        # labelled documents the model is fitted on, at most
LEAST_DOCS = 4         # sampled documents a feature must occur in
GRADES = 3             # 0 clean, 1 toxic, 2 toxic with more marks than half of the toxic documents
REJECT = 0.3           # chance of any toxicity from which a document is rejected
SLICE_BYTES = 1_000_000   # of texts unpacked at once
STEMS = (4, 5, 6)      # lengths of the beginnings of longer words that can be features
LEVELS = (1, 2, 3)     # a feature tells that a word or beginning occurs at least so often
WORD = re.compile(r"[^\W\d_]+")


def counts_of(text: str) -> Counter[str]:
    """How often a text has each word, in lower case, and each beginning of the longer ones."""
    words = Counter(WORD.findall(text.lower()))
    for w, n in list(words.items()):
        for k in STEMS:
            if len(w) > k:
                words["^" + w[:k]] += n
    return words


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, so that few texts (column ``text``) are unpacked at once: as many bytes or one text."""
    for batch in released(batches):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        piece = np.cumsum(np.asarray(sizes, np.int64)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = logistic(cuts[k] - weights . features); one set of weights for all cuts."""

    words: dict[str, dict[int, int]]    # word: {level: column}
    weights: np.ndarray
    cuts: np.ndarray

    def features(self, text: str) -> list[int]:
        """The model's features that occur in a text."""
        known, found = self.words, counts_of(text)
        return [i for w in known.keys() & found.keys() for level, i in known[w].items() if found[w] >= level]

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text (row) and cut (column)."""
        at = [self.features(t) for t in texts]
        score = np.array([self.weights[i].sum() for i in at])
        return 1 - logistic(self.cuts[None, :] - score[:, None])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int,
    *, ridge: float = 1e-5, steps: int = 600, rate: float = 0.3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of greatest penalised likelihood.

    ``rows`` and ``columns`` list the ones of the feature matrix. The cuts are
    the first one and the logarithms of the gaps, so they stay in order. Grades
    that no row has keep a gap of their own and do no harm. Weights are not
    negative: nothing else in a text makes up for a mark of toxicity, so long
    texts do not hide it.
    """
    n, k = len(grades), GRADES - 1
    weights = np.zeros(n_features)
    share = np.clip([(grades <= c).mean() if n else 0.5 for c in range(k)], 0.02, 0.98)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    moments = [np.zeros(n_features), np.zeros(n_features), np.zeros(k), np.zeros(k)]
    row = np.arange(n)
    for step in range(1, steps + 1) if n else ():
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(rows, weights[columns], n)
        below = np.ones((n, k + 2))
        below[:, 0] = 0
        below[:, 1:-1] = logistic(cuts[None, :] - score[:, None])
        high, low = below[row, grades + 1], below[row, grades]
        chance = np.maximum(high - low, 1e-12)
        slope = below * (1 - below)
        d_high, d_low = slope[row, grades + 1] / chance, slope[row, grades] / chance
        d_score = (d_high - d_low) / n                    # of minus the log likelihood
        d_weights = np.bincount(columns, d_score[rows], n_features) + ridge * weights
        d_cuts = np.zeros(k + 2)
        np.add.at(d_cuts, grades + 1, -d_high / n)
        np.add.at(d_cuts, grades, d_low / n)
        tail = np.cumsum(d_cuts[1:-1][::-1])[::-1]
        d_free = tail * np.concatenate([[1.0], np.exp(free[1:])])
        for value, slope_of, first, second in (
            (weights, d_weights, moments[0], moments[1]), (free, d_free, moments[2], moments[3])
        ):
            first += 0.1 * (slope_of - first)
            second += 0.01 * (slope_of**2 - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        np.maximum(weights, 0, out=weights)
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def graded(labels: DataFrame, id_col: str) -> DataFrame:
    """(_label, _toxic): one row per labelled id."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_label"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    )


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled documents.

    The sample is the labels with the smallest hashes of their ids, so it does
    not depend on how the table is stored. It has at most ``sample`` rows and
    may be broadcast. Labels without an id or a toxic flag take no part; of
    several labels of an id one is enough to call it toxic.
    """
    chosen = graded(labels, id_col).orderBy(F.xxhash64("_label"), "_label").limit(sample)
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label")).select(
        F.col("_text").alias("text"), F.col("_toxic").alias("toxic")
    )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    *, sample: int = SAMPLE, least_docs: int = LEAST_DOCS,
) -> OrdinalModel:
    """Fit the model on a bounded sample of labelled documents.

    Features are words and their beginnings that occur at least once, twice or
    three times: those that toxic documents have more often than chance allows.
    Of n sampled documents with a feature, t toxic, chance gives as many with a
    probability of at most exp(-n KL(t / n, share of toxic ones)), for any n.
    That must not exceed one in the number of candidates, so whatever the
    number of labels, about one feature comes in by chance. The fit weighs the
    features. Labels only tell toxic from clean; the severity of a toxic
    document is the number of features in it, in two grades parted at the
    median over the toxic part of the sample. Without labels every document gets grade 0.
    """
    known = labelled(docs, labels, sample, id_col, text_col)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [[(w, k) for w, n in counts_of(t.as_py()).items() for k in LEVELS if n >= k] for t in batch.column(0)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for f in found for w, _ in f], pa.string()), pa.array([k for f in found for _, k in f], pa.int32()),
                 batch.column(1).take(pa.array(np.repeat(np.arange(len(found)), sizes)))],
                names=["word", "level", "toxic"],
            )

    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = OrdinalModel({}, np.zeros(0), np.full(GRADES - 1, 40.0))
    if not n_toxic or n_toxic == n:
        return none if not n_toxic else OrdinalModel({}, np.zeros(0), np.array([-40.0, 40.0]))
    counted = stage(
        known.mapInArrow(words, "word string, level int, toxic int")
        .groupBy("word", "level").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
        .where(F.col("n") >= least_docs)
    )
    share, base = F.col("t") / F.col("n"), n_toxic / n
    clean = F.when(F.col("t") < F.col("n"), (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    marked = counted.where(share > base).withColumn("excess", F.col("n") * (share * F.log(share / base) + clean))
    chosen = marked.where(F.col("excess") >= float(np.log(max(counted.count(), 1)))).orderBy(F.desc("excess"), "word", "level")
    names: dict[str, dict[int, int]] = {}
    n_features = 0
    # All of them: their number follows from the sample, whose size is bounded.
    for n_features, r in enumerate(chosen.select("word", "level").collect(), 1):
        names.setdefault(r.word, {})[r.level] = n_features - 1
    blank = OrdinalModel(names, np.zeros(n_features), np.zeros(GRADES - 1))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [blank.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["at", "toxic"]
            )

    rows = known.mapInArrow(matrix, "at array<int>, toxic int").toArrow()
    at = rows.column("at").combine_chunks()
    columns = np.asarray(at.flatten(), np.int64)
    sizes = np.asarray(pa.compute.list_value_length(at), np.int64)
    toxic = np.asarray(rows.column("toxic"), np.int64)
    grades = toxic * (1 + (sizes > np.median(sizes[toxic == 1])))
    weights, cuts = fit_ordinal(np.repeat(np.arange(len(sizes)), sizes), columns, grades, n_features)
    return OrdinalModel(names, weights, cuts)


def score(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
    *, reject: float = REJECT, keep_rows: bool = False,
) -> DataFrame:
    """Expected severity of every whole text.

    Returns (id, expected_severity, grade, p_toxic, toxic); grade is the most
    likely one, the lower of equal ones. With ``keep_rows`` the rows of ``docs``
    that are not toxic come back instead, with their own columns.

    Null and empty texts have no features and get the grade that the cuts alone
    give. Rows are independent: repeated rows and ids repeat, an empty table
    gives an empty result, and other columns, whatever their names, are not
    read.
    """
    if keep_rows:
        place, schema = docs.columns.index(text_col), docs.schema

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, place):
                texts = [t.as_py() or "" for t in part.column(place)]
                yield part.filter(pa.array(model.above(texts)[:, 0] < reject, pa.bool_()))

        return small_batches(docs).mapInArrow(keep, schema)
    fields = [(id_col, T.LongType()), ("expected_severity", T.DoubleType()), ("grade", T.IntegerType()),
              ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            above = model.above([t.as_py() for t in batch.column(1)])
            chance = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(chance.argmax(axis=1).astype(np.int32)),
                 pa.array(above[:, 0]), pa.array(above[:, 0] >= reject)],
                names=[name for name, _ in fields],
            )

    rows = small_batches(docs).select(docs[id_col].cast("long").alias(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(told, T.StructType([T.StructField(*f) for f in fields]))


def held_out(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    *, folds: int = 5,
) -> DataFrame:
    """(lang, n_toxic, n_caught, n_clean, n_wrong): rejections among labelled documents that the fit did not see.

    Documents are dealt to the folds by their texts, so equal texts are held
    out together; near copies need not be. Each fold is scored by a model of
    the others.
    """
    fold, told = F.pmod(F.xxhash64(text_of(text_col)), F.lit(folds)), None
    texts = docs.select(
        F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"), F.col(lang_col).alias("lang"), fold.alias("_fold")
    )
    known = texts.join(graded(labels, id_col), F.col("_id") == F.col("_label"))
    for k in range(folds):
        part = known.where(F.col("_fold") == k)
        kept = score(part, fit(docs.where(fold != k), labels, id_col, text_col), "_id", "_text", keep_rows=True)
        rows = [d.select("lang", "_toxic", F.lit(v).alias("_kept")) for d, v in ((part, 0), (kept, 1))]
        told = rows[0].union(rows[1]) if told is None else told.union(rows[0]).union(rows[1])

    def number(toxic: int, kept: tuple[int, int]) -> Column:
        """Rows before (0) and after (1) rejection, times ``kept``."""
        return F.sum(F.when(F.col("_toxic") == toxic, F.when(F.col("_kept") == 0, kept[0]).otherwise(kept[1])).otherwise(0))

    return told.groupBy("lang").agg(
        number(1, (1, 0)).alias("n_toxic"), number(1, (1, -1)).alias("n_caught"),
        number(0, (1, 0)).alias("n_clean"), number(0, (1, -1)).alias("n_wrong"),
    )
