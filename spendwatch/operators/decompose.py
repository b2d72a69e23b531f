"""Additive seasonal decomposition per warehouse (J5, M1-M5), written with windows.

Classical decomposition with period ``p`` (odd):

1. ``trend0[i]`` = centred moving mean of ``x[i-h .. i+h]`` (``h = p // 2``), or the
   trailing mean of ``x[i-p+1 .. i]`` when one-sided; undefined near the ends.
2. The undefined ends are extrapolated with least-squares lines fitted on the
   first / last ``p`` defined points (half-open ranges, as the library does).
3. ``detrended = x - trend``; seasonal = mean of ``detrended`` per phase ``i % p``,
   centred so the ``p`` phase means sum to zero.
4. ``residual = x - trend - seasonal``.

A series shorter than two full periods cannot be decomposed and is skipped
(``skipped_series`` lists them).  Everything is one shuffle on the warehouse:
gap filling (``lead`` + ``sequence``), positions, moving means, line fits
(``regr_slope`` / ``regr_intercept`` over the whole series with a row filter)
and phase means are windows over that one partitioning.  A window partition is
one warehouse's days, bounded by the length of the history, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import lit_date


def fill_series_gaps(df: DataFrame, key: str, date_col: str, *values: str) -> DataFrame:
    """Insert zero rows (0 in every value) for missing days between a series' first and last day.

    Each row emits itself and the missing days up to its successor
    (``sequence(d, next - 1)``): one generator, no join, no union.
    """
    w = Window.partitionBy(key).orderBy(date_col)
    nxt = F.lead(date_col).over(w)
    last = F.coalesce(F.date_sub(nxt, 1), F.col(date_col))
    gen = (df.select(key, date_col, *values, last.alias("_last"))
           .select(key, date_col, *values, F.explode(F.sequence(F.col(date_col), F.col("_last"))).alias("_d")))
    return gen.select(
        key,
        F.col("_d").alias(date_col),
        *[F.when(F.col("_d") == F.col(date_col), F.col(v))
          .otherwise(F.lit(0).cast(df.schema[v].dataType)).alias(v) for v in values])


def seasonal_features(metrics: DataFrame, ds=None, period: int = 7, two_sided: bool = True,
                      key: str = "warehouse_name", date_col: str = "usage_date",
                      value: str = "credits_used") -> DataFrame:
    """Trend, seasonal and residual per day of every series with >= 2 periods."""
    if period % 2 == 0 or period < 3:
        raise ValueError("only odd periods >= 3 are supported")
    df = metrics.select(key, date_col, value)
    if ds is not None:
        df = df.where(F.col(date_col) <= lit_date(ds))
    df = fill_series_gaps(df, key, date_col, value)

    ordered = Window.partitionBy(key).orderBy(date_col)
    whole = Window.partitionBy(key)
    x = F.col(value).cast("double")
    df = df.select("*", (F.row_number().over(ordered) - 1).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"))
    df = df.where(F.col("_n") >= 2 * period)

    i, n = F.col("_i"), F.col("_n")
    h = period // 2
    if two_sided:
        front, back = F.lit(h), n - 1 - h
        trend0 = F.when((i >= front) & (i <= back), F.avg(x).over(ordered.rowsBetween(-h, h)))
    else:
        front, back = F.lit(period - 1), n - 1
        trend0 = F.when(i >= front, F.avg(x).over(ordered.rowsBetween(-(period - 1), 0)))
    df = df.withColumn("_t0", trend0).withColumn("_x", x)

    head = (i >= front) & (i < F.least(front + period, back))
    tail = (i >= F.greatest(front, back - period)) & (i < back)

    def line(mask):
        y_m, x_m = F.when(mask, F.col("_t0")), F.when(mask, i.cast("double"))
        return F.regr_slope(y_m, x_m).over(whole), F.regr_intercept(y_m, x_m).over(whole)

    hs, hi = line(head)
    ts, ti = line(tail)
    trend = (F.when(i < front, hs * i + hi)
             .when(i > back, ts * i + ti)
             .otherwise(F.col("_t0")))
    df = df.withColumn("trend", trend).withColumn("_det", F.col("_x") - F.col("trend"))

    phase = Window.partitionBy(key, (i % period))
    df = df.withColumn("_pm", F.avg("_det").over(phase)).withColumn("_pc", F.count(F.lit(1)).over(phase))
    centre = F.sum(F.col("_pm") / F.col("_pc")).over(whole) / period
    df = df.withColumn("seasonal", F.col("_pm") - centre)
    df = df.withColumn("residual", F.col("_det") - F.col("seasonal"))
    out = df.select(date_col, F.col(value).cast(schemas.CREDITS).alias(value), "trend", "seasonal", "residual", key)
    return out


def skipped_series(metrics: DataFrame, ds=None, period: int = 7, key: str = "warehouse_name",
                   date_col: str = "usage_date") -> DataFrame:
    """Series too short to decompose: fewer than two periods between first and last day."""
    df = metrics if ds is None else metrics.where(F.col(date_col) <= lit_date(ds))
    return (df.groupBy(key)
            .agg((F.datediff(F.max(date_col), F.min(date_col)) + 1).alias("days"))
            .where(F.col("days") < 2 * period))
