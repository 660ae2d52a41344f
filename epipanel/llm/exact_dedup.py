"""Exact deduplication by skew-safe combining of digest groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import ascii_lower, stage, text_of

SALTS = 32
HOT_SHARE = 1000       # a digest is hot when it holds over 1/1000 of all rows


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    salts: int = SALTS,
    hot_share: int = HOT_SHARE,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    row with the largest id stays.

    1. Each task merges its own copies (the partial aggregate below).
    2. Digest groups are merged. Those of a hot digest are spread over salts;
       at most ``hot_share`` digests can be hot, so their list is bounded and
       may be broadcast.
    3. The winners of a hot digest's salts are merged once more.

    All three group by the digest *and* the whole text, so two texts of one
    digest stay apart. The text moves once; only the few winners of hot
    digests move again. Rows then find their winner by the digest alone,
    except under digests that hold several texts, which are matched by text.

    Null and empty texts are one group. Rows of equal id and text are all kept
    or all dropped; a null id ranks below every other. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    content = ascii_lower(text_of(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), content.alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "sha": sha256(F.col("content"))})

    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    total = docs.count()
    hot = stage(counts.where(F.col("n") * hot_share > total).select("digest", F.lit(True).alias("hot")))

    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    )
    merged = salted.groupBy("digest", "hot", "salt", "content").agg(
        F.max("row_id").alias("top"), F.count("*").alias("n"), F.first("sha").alias("sha")
    )
    # A cold group is complete: it needs no text for the last step, and its
    # winner stands for it.
    last = merged.select(
        "digest", "sha", "top", "n",
        F.when(F.col("hot"), F.col("content")).alias("content"),
        F.when(F.col("hot").isNull(), F.struct("sha", "top")).alias("own"),
    )
    classes = stage(
        last.groupBy("digest", "content", "own")
        .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.first("sha").alias("sha"))
        .select("digest", "sha", "keep_id", "group_size")
    )
    mixed = stage(classes.groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest"))

    light = rows.select("row_id", "digest", "sha")
    plain = light.join(mixed, "digest", "left_anti").join(classes.drop("sha"), "digest")
    within = rows.join(mixed, "digest", "left_semi")
    by_text = within.groupBy("digest", "content").agg(
        F.max("row_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    told = within.join(by_text, ["digest", "content"])
    columns = ("row_id", "keep_id", "group_size", "sha")
    return (
        plain.select(*columns).unionByName(told.select(*columns))
        .select(
            F.col("row_id").alias(id_col), "keep_id", "group_size",
            F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, with the input's columns.

    Rows that repeat both the id and the text of the winner are cut to one.
    Null and empty texts are one group; a row without an id stays only where
    its group has no other. Texts of any length are compared whole. Clashing
    column names are kept as they are; an empty table gives an empty result.
    """
    told = stage(exact_dedup(docs, id_col, text_col).where("kept").select(id_col, "text_sha256"))
    winners = told.select(F.col(id_col).alias("__id__"), F.col("text_sha256").alias("__sha__"))
    marked = docs.withColumns(
        {"__own_id__": F.col(id_col).cast("long"), "__own_sha__": sha256(ascii_lower(text_of(text_col)))}
    )
    kept = marked.join(
        winners, F.col("__own_id__").eqNullSafe(F.col("__id__")) & (F.col("__own_sha__") == F.col("__sha__")), "left_semi"
    )
    repeated = winners.groupBy("__id__", "__sha__").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["__own_id__", "__own_sha__"])
    return kept.drop("__own_id__", "__own_sha__")
