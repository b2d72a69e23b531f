"""Date dimension (J1) and the gap-free warehouse x day grid (J20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import lit_date

DEFAULT_DAYS = 1826  # five years


def build_calendar(spark: SparkSession, start, days: int = DEFAULT_DAYS) -> DataFrame:
    """One row per day from ``start`` for ``days`` days with the vendor's date parts.

    ``start`` is a date / 'YYYY-MM-DD' or a Column (e.g. a scalar subquery over
    the data).  Rows come from ``spark.range`` (distributed), not from an
    unpartitioned ``row_number`` window.  Day of week counts 0 = Sunday, as
    the vendor's default does; week of year is ISO.
    """
    d = F.date_add(lit_date(start), F.col("id").cast("int"))
    return (spark.range(days)
            .select(d.alias("usage_date"))
            .select(
                "usage_date",
                F.year("usage_date").cast("short").alias("year"),
                F.month("usage_date").cast("short").alias("month"),
                F.monthname("usage_date").alias("month_name"),
                F.dayofmonth("usage_date").cast("short").alias("day_of_mon"),
                (F.dayofweek("usage_date") - 1).cast("string").alias("day_of_week"),
                F.weekofyear("usage_date").cast("short").alias("week_of_year"),
                F.dayofyear("usage_date").cast("short").alias("day_of_year"),
            ))


def dense_grid(keys: DataFrame, key: str, first: Column, last: Column, date_col: str = "usage_date") -> DataFrame:
    """Every (key, day) with day in [first, last].

    Generated per key with ``sequence`` + ``explode`` (a generator, no join):
    the output is keys x days by definition, and each key's days are produced
    inside the task that holds the key.
    """
    return keys.select(key, F.explode(F.sequence(first, last)).alias(date_col))


def fill_days(df: DataFrame, key: str, date_col: str, first: Column, last: Column, *values: str) -> DataFrame:
    """Every day in [first, last] of every key, with 0 in every value where a day is missing.

    ``df`` has at most one row per key and day, and only days in [first, last];
    a row without a day stands for its key alone.  Each row emits itself and
    the missing days up to its successor, the first of a key also those before
    it: one window on the key and no row of the grid is shuffled.
    """
    w = Window.partitionBy(key).orderBy(F.col(date_col).asc_nulls_first())
    start = F.when(F.row_number().over(w) == 1, first).otherwise(F.col(date_col))
    end = F.coalesce(F.date_sub(F.lead(date_col).over(w), 1), last)
    spans = df.select(key, date_col, *values, start.alias("_start"), end.alias("_end")).where("_start <= _end")
    days = spans.select(key, date_col, *values, F.explode(F.sequence("_start", "_end")).alias("_d"))
    return days.select(key, F.col("_d").alias(date_col), *[
        F.when(F.col("_d") == F.col(date_col), F.col(v)).otherwise(F.lit(0).cast(df.schema[v].dataType)).alias(v) for v in values])


def date_bounds(df: DataFrame, col: str):
    """(first, last) value of ``col``: two scalars fetched in one small job.

    Used as literals, the bounds prune partitions and reach the Parquet scan
    as pushed filters, which a scalar subquery in a filter cannot.
    """
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["lo"], row["hi"]


def fill_daily_gaps(metering: DataFrame, value: str = "credits_used") -> DataFrame:
    """Warehouse x date grid between the global first and last day, zero filled.

    Rows without a warehouse name fall out (as the grouping of the notebook
    drops them) but still count for the date bounds.  Zero rows are unioned in
    and summed, so there is one partial + final aggregation and no join.
    """
    first, last = date_bounds(metering, "usage_date")
    if first is None:
        return metering.sparkSession.createDataFrame(
            [], "warehouse_name string, usage_date date, " + f"{value} {metering.schema[value].dataType.simpleString()}")
    first, last = lit_date(first), lit_date(last)
    named = metering.where(F.col("warehouse_name").isNotNull())
    keys = named.select("warehouse_name").distinct()
    zeros = dense_grid(keys, "warehouse_name", first, last).withColumn(
        value, F.lit(0).cast(metering.schema[value].dataType))
    rows = named.select("warehouse_name", "usage_date", value)
    return (zeros.unionByName(rows)
            .groupBy("warehouse_name", "usage_date")
            .agg(F.sum(value).alias(value)))
