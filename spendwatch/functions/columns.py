"""Column-level helpers shared by the jobs (all built-in expressions, no UDFs)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the vendor's / library's for right results.
EULER_GAMMA = 0.5772156649015329
TB_BYTES = 1024 ** 4  # POWER(1024, 4)


def lit_date(d) -> Column:
    """A date literal from 'YYYY-MM-DD', a date, or a Column (returned as is)."""
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.strftime("%Y-%m-%d")
    return F.lit(d).cast("date")


def day_start(d) -> Column:
    """Start of day ``d`` as a timestamp without zone."""
    return lit_date(d).cast("timestamp_ntz")


def in_day(ts: str | Column, d) -> Column:
    """``to_date(ts) = d`` written as a half-open range so Parquet can push it down."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = day_start(d)
    return (ts >= start) & (ts < F.date_add(lit_date(d), 1).cast("timestamp_ntz"))


def json_text(tag: Column, key: str) -> Column:
    """``TRY_PARSE_JSON(tag):key::VARCHAR``: NULL for bad JSON, JSON null, or a missing key."""
    return F.try_variant_get(tag, f"$.{key}", "string")


def avg_path_length(n: Column) -> Column:
    """Average path length of an unsuccessful search in a binary tree of ``n`` points.

    c(n) = 2 (ln(n - 1) + gamma) - 2 (n - 1) / n, with c(2) = 1 and c(n <= 1) = 0.
    """
    n = n.cast("double")
    return (F.when(n <= 1, F.lit(0.0))
            .when(n == 2, F.lit(1.0))
            .otherwise(2.0 * (F.log(n - 1.0) + F.lit(EULER_GAMMA)) - 2.0 * (n - 1.0) / n))


def week_ending_sunday(d: Column) -> Column:
    """Label of the week (Monday..Sunday) containing ``d``: its closing Sunday."""
    return F.next_day(F.date_sub(d, 1), "Sun")


def round6(c: Column) -> Column:
    """Floats are compared at 6 decimals between engines."""
    return F.round(c.cast("double"), 6)


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to the session's shuffle partitions, which stay as they are.

    For work that is heavy per row: partitions coalesced by their bytes to a few tasks more than there are cores run
    in a second wave, while most cores wait.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
