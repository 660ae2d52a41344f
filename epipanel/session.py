"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A table already partitioned by draw keeps that layout in a join on
    # (draw, week).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


TASK_BYTES = 128 * 1024 * 1024


def tune(
    builder: SparkSession.Builder, shuffle_bytes: int | None = None
) -> SparkSession.Builder:
    """Apply the engine's settings to a session builder.

    ``shuffle_bytes`` is the size of the largest shuffle expected, about that
    of the draws as long rows. It sets how many tasks a shuffle starts with;
    adaptive execution merges the small ones.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_bytes is not None:
        tasks = max(200, -(-shuffle_bytes // TASK_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(tasks))
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on a local master (a test) may name none and gets a scratch
    folder; on a cluster the executors would not share it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="epipanel-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write a stage's result to the shared folder and read it back.

    Later stages scan the stored columns they need instead of repeating the
    work, and a lost executor costs one stage. The planner also sees the true
    size of the table: a small one is broadcast and a large one is not, where
    the estimate of an unstored join would shuffle the facts in either case.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    for opened in _jobs:
        opened.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_jobs: list[list[str]] = []


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the stages written inside, once the results that rest on them are stored."""
    written: list[str] = []
    _jobs.append(written)
    try:
        yield
    finally:
        _jobs.remove(written)
        remove_folders(spark, written)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def together(*steps: Callable[[], object]) -> list:
    """Run steps that do not need each other at the same time.

    A small stage leaves most of a cluster idle; several of them share it.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(step) for step in steps]]
