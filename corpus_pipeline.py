"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, folder) and works on all that the one before it
kept. Its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``, further ones among them.
Whole texts are read, however long; null counts as empty; an empty table gives
an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epipanel.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from epipanel.llm.queries import OTHER, TARGETS
from epipanel.llm.support import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it learns from the labels of ``docs``.

    Null and empty texts have no mark and stay, as do rows without an id.
    Equal texts share their fate. Without toxic labels all stay.
    """
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, keep_rows=True)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal. A row without an id stays only if its text
    has no other; rows that repeat id and text are one.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id.

    Texts without words and rows without an id are near none and stay. Rows of
    one id stay or go together.
    """
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, in files that follow the Pfair schedule of the sources.

    Sources without a target, null among them, share one. Empty texts count as
    one character; ids that are equal or null are ordered by text.
    """
    return mixing.in_order(mixing.mix(docs, TARGETS, OTHER))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, number of tokens, ids (little-endian, 32 bits each), the digests of ids and decoded text, and the place in the schedule.

    A row for each row, repeated ones too; a null or empty text has no tokens.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    place = mixing.place()
    told = bpe.encode_texts(docs, path, keep_ids=True, carry=place)
    return told.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", *place)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Fitting a model and byte-pair encoding cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in their order."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
