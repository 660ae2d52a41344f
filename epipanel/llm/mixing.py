"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import text_of

BLOCK_SIZE = 16_384    # characters of a block
MAX_PARTS = 5_000      # slots of a period, at most
BUCKETS = 4_096        # pieces that each source is numbered in


def period(spark: SparkSession, parts: list[int]) -> DataFrame:
    """One period of the schedule: (share, occurrence, at), a row per slot.

    A share of p of P parts releases its block j at slot floor(j P / p) and must
    have it served before slot ceil((j + 1) P / p). Every slot serves the
    released block with the earliest deadline, ties to the earlier share. The
    parts fill the period, so each slot has a released block, every deadline is
    met, and after any number n of slots a share has been served less than one
    block more or less than n p / P. All counts are back where they began after
    P slots, so the schedule repeats.
    """
    total = sum(parts)
    if not parts or min(parts) < 1 or total > MAX_PARTS:
        raise ValueError(f"targets must be positive parts, {MAX_PARTS} in all at most")
    shares = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(parts)])

    def serve(state: Column, slot: Column) -> Column:
        def window(share: Column) -> Column:
            done = F.element_at(state["done"], share["i"] + 1)
            released = F.floor(done * total / share["p"]) <= slot
            deadline = F.ceil((done + 1) * total / share["p"])
            return F.when(released, F.struct(deadline.alias("deadline"), share["i"].alias("i")))

        pick = F.array_min(F.filter(F.transform(shares, window), lambda w: w.isNotNull()))["i"]
        return F.struct(
            F.transform(state["done"], lambda n, i: n + (i == pick).cast("int")).alias("done"),
            F.concat(
                state["out"],
                F.array(F.struct(pick.alias("share"), F.element_at(state["done"], pick + 1).alias("occurrence"))),
            ).alias("out"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(parts)).alias("done"),
        F.expr("cast(array() as array<struct<share:int,occurrence:int>>)").alias("out"),
    )
    # The slots come from a row, so that the fold runs in a task and not while planning.
    slots = spark.range(1).select(F.sequence(F.col("id").cast("int"), F.lit(total - 1)).alias("slots"))
    served = slots.select(F.aggregate("slots", start, serve, lambda s: s["out"]).alias("out"))
    return served.select(F.posexplode("out").alias("at", "s")).select("at", "s.share", "s.occurrence")


def mix(
    docs: DataFrame,
    targets: dict[str, int],
    other: int = 0,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """The input's rows with the slot in which they are served, all of them once.

    ``targets`` gives each source its share in parts; the rows of sources that
    it does not name, null among them, form one more share of ``other`` parts.
    A share's rows stand in order of a hash of their ids and are cut into
    blocks of ``block_size`` characters; a row belongs to the block in which it
    begins, and a row longer than a block leaves the blocks it spans to itself.
    Blocks take the slots of the Pfair schedule. When a share has no blocks
    left, its slots stay empty and the others go on in their proportions.

    Adds _share (position in ``targets``), _before (characters of the share
    before the row), _block and _slot. In order of (_slot, _before) the rows
    are mixed to the targets. Clashing columns of the input are replaced. Null
    and empty texts count as one character. Rows of equal id are ordered by
    text. Without ``other``, a source that is not named is an error. An empty
    table gives an empty result.
    """
    names = list(targets)
    parts = [*targets.values(), *([other] if other else [])]
    total = sum(parts)
    share = F.lit(len(names)) if other else F.raise_error(
        F.concat(F.lit("no target for source "), F.coalesce(F.col(source_col), F.lit("null")))
    ).cast("int")
    for i, name in enumerate(names):
        share = F.when(F.col(source_col) == name, i).otherwise(share)
    rows = docs.withColumns(
        {
            "_share": share,
            "_size": F.greatest(F.length(text_of(text_col)), F.lit(1)).cast("long"),
            "_key": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))),
        }
    ).withColumn("_bucket", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * BUCKETS / 2**32).cast("int"))

    # A hot source is numbered in many buckets of its order. Only their totals
    # meet in one place: BUCKETS rows a share.
    totals = rows.groupBy("_share", "_bucket").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy("_share").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_share").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
    )
    ahead = (
        Window.partitionBy("_share", "_bucket")
        .orderBy("_key", id_col, F.xxhash64(text_of(text_col)))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    schedule = period(docs.sparkSession, parts).select(
        F.col("share").alias("_ps"), F.col("occurrence").alias("_po"), F.col("at").alias("_at")
    )
    part = F.element_at(F.array(*map(F.lit, parts)), F.col("_share") + 1)
    placed = inside.join(
        offsets, (F.col("_share") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("_before", F.col("_offset") + F.col("_inside"))
    placed = placed.withColumn("_block", F.floor(F.col("_before") / block_size)).withColumn(
        "_turn", (F.col("_block") % part).cast("int")
    )
    # The schedule has one row per part: at most MAX_PARTS.
    return (
        placed.join(F.broadcast(schedule), (F.col("_ps") == F.col("_share")) & (F.col("_po") == F.col("_turn")))
        .withColumn("_slot", F.floor(F.col("_block") / part) * total + F.col("_at"))
        .withColumn("_name", F.element_at(F.array(*map(F.lit, [*names, None])), F.col("_share") + 1))
        .select(*docs.columns, "_share", "_name", "_before", "_block", "_slot")
    )


def told(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return mixed.select(
        F.col(id_col), F.col("_name").alias("share"), F.col("_before").alias("before"),
        F.col("_block").alias("block"), F.col("_slot").alias("slot"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows with their own columns, in files that follow the schedule.

    No row is added or lost, whatever its values; rows that share a slot and a
    place stand in any order. An empty table gives an empty result.
    """
    ordered = mixed.repartitionByRange("_slot", "_before").sortWithinPartitions("_slot", "_before")
    return ordered.drop("_share", "_name", "_before", "_block", "_slot")


def place() -> dict[str, Column]:
    """Where a row of the stored ``in_order`` stands: order of (mixed_file, mixed_row) is the schedule.

    Spark packs stored files by size when it reads them, so the order in which
    rows arrive says nothing. Files are numbered by the task that wrote them,
    then by their turn in it; the numbers have gaps where a task wrote none.
    """
    name = F.col("_metadata.file_name")
    part, turn = (F.regexp_extract(name, rule, 1).cast("long") for rule in (r"^part-(\d+)-", r"-c(\d+)\."))
    return {"mixed_file": part * 1_000_000 + turn, "mixed_row": F.col("_metadata.row_index")}
