"""Helpers shared by the operators: stages, size-checked broadcasts, word patterns."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize

__all__ = ["materialize", "WORD_GAP", "TRIM", "small_side", "release", "read"]

# white space between words: space and the ASCII controls 9..13 (fixed values)
WORD_GAP = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\f\r"

# a side is broadcast only when it was counted and has at most this many rows
BROADCAST_ROWS = 2_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``BROADCAST_ROWS`` rows.

    ``df`` must be a stage of narrow rows (reading it twice is cheap).  Beyond
    the limit no hint is set and the join is a shuffle join that AQE may split.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose result is written.

    They go when the driver collects the plans that made them, which it would
    do by itself only much later; the stages of a long operator would pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
