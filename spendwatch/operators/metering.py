"""Metering jobs: daily load (J2), dense matrix with moving statistics (J4),
yearly pivot (J19) and weekly sums (J21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import dealt_by, in_day, lit_date, week_ending_sunday
from .calendar import date_bounds, fill_days

MEASURES = ("credits_used", "credits_used_compute", "credits_used_cloud_services")


def ingest_metering(src: DataFrame, account: str, ds=None) -> DataFrame:
    """One day (or, with ``ds=None``, every day) of credits per (account, service, day, warehouse).

    Pseudo-warehouses (id <= 0) are skipped.  The day of a row is the date of
    its ``end_time``, so an hour ending at midnight falls to the next day.
    With a ``ds`` the day filter is a half-open range on ``end_time`` which the
    Parquet scan can push down; without one the job is a backfill whose
    ``ds`` is the usage day itself.
    """
    rows = src.where((F.col("warehouse_id") > 0) & (F.col("account_name") == F.lit(account)))
    if ds is not None:
        rows = rows.where(in_day("end_time", ds))
    day = F.to_date("end_time").alias("usage_date")
    out = (rows.groupBy("account_name", "service_type", day, "warehouse_name")
           .agg(*[F.sum(m).alias(m) for m in MEASURES]))
    out = out.withColumn("ds", lit_date(ds) if ds is not None else F.col("usage_date"))
    return schemas.conform(out, schemas.RAW_METERING)


def metering_metrics(raw: DataFrame, calendar: DataFrame, ds) -> DataFrame:
    """Dense warehouse x day matrix up to ``ds``, zero filled, with 30-row SMA and STD.

    Plan: the first and last calendar day up to ``ds`` are fetched as two
    literals; the raw rows are summed by day (partial aggregation before the
    shuffle, so a warehouse with a third of the rows is pre-reduced map-side),
    those of other days to one row of 0 without a day, which keeps their
    warehouse.  Only these sums are shuffled: the missing days are generated
    after they are dealt by warehouse (``fill_days``), so no row of the grid
    moves.  The six moving statistics share one window spec.  Each window
    partition holds one warehouse's days, bounded by the calendar length.
    """
    lo, hi = date_bounds(calendar.where(F.col("usage_date") <= lit_date(ds)), "usage_date")
    lo, hi = lit_date(lo), lit_date(hi)
    named = raw.where(F.col("warehouse_name").isNotNull())
    within = F.col("usage_date").between(lo, hi)
    zero = F.lit(0).cast(schemas.CREDITS)
    sums = (named.groupBy("warehouse_name", F.when(within, F.col("usage_date")).alias("usage_date"))
            .agg(*[F.coalesce(F.sum(F.when(within, F.col(m))), zero).alias(m) for m in MEASURES]))
    daily = fill_days(dealt_by(sums, "warehouse_name"), "warehouse_name", "usage_date", lo, hi, *MEASURES)
    w = Window.partitionBy("warehouse_name").orderBy("usage_date").rowsBetween(-29, 0)
    stats = []
    for m in MEASURES:
        stats.append(F.avg(m).over(w).cast(schemas.SMA).alias(f"{m}_sma30"))
    for m in MEASURES:
        stats.append(F.stddev_samp(m).over(w).alias(f"{m}_std30"))
    return daily.select("warehouse_name", "usage_date", *MEASURES, *stats)


def usage_by_year_long(metering: DataFrame, value: str = "credits_used") -> DataFrame:
    """Year, warehouse and summed credits as rows: the form for any number of warehouses."""
    return (metering.where(F.col("warehouse_name").isNotNull())
            .groupBy(F.year("usage_date").alias("year"), "warehouse_name").agg(F.sum(value).alias(value)))


def usage_by_year(metering: DataFrame, warehouses: list[str], start=None, end=None,
                  value: str = "credits_used") -> DataFrame:
    """Year x warehouse matrix of summed credits in [start, end], 0 where a warehouse has none.

    The caller lists the warehouses (one column each), so no key is collected;
    ``usage_by_year_long`` has them as rows.
    """
    rows = metering if start is None else metering.where(F.col("usage_date") >= lit_date(start))
    rows = rows if end is None else rows.where(F.col("usage_date") <= lit_date(end))
    wide = (rows.where(F.col("warehouse_name").isNotNull()).groupBy(F.year("usage_date").alias("year"))
            .pivot("warehouse_name", list(warehouses)).agg(F.sum(value)))
    return wide.na.fill(0, subset=list(warehouses))


def weekly_usage(daily: DataFrame, value: str = "credits_used") -> DataFrame:
    """Weekly sums per warehouse; weeks end on Sunday and are labelled by that Sunday."""
    return (daily.groupBy("warehouse_name", week_ending_sunday(F.col("usage_date")).alias("usage_date"))
            .agg(F.sum(value).alias(value)))
