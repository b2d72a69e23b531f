"""Data checks: completeness of the raw load (J3 / Q1) and the zero-row source probe (J26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import lit_date


class DataValidationFailed(Exception):
    """Raised when a data check fails (missing load days)."""


def count_missing_dates(raw: DataFrame, start, end) -> DataFrame:
    """One row: days loaded in [start, end], ``datediff(end, start)``, and their difference.

    Kept exactly as the reference computes it: ``BETWEEN`` counts both ends
    and ``DATEDIFF`` one, so a complete load gives -1 and a single missing day
    gives 0.  ``missing_dates_list`` gives the true list.
    """
    s, e = lit_date(start), lit_date(end)
    loaded = (raw.where(F.col("usage_date").between(s, e))
              .agg(F.count_distinct("usage_date").alias("loaded_dates")))
    total = F.datediff(e, s)
    return loaded.select("loaded_dates", total.alias("total_dates"),
                         (total - F.col("loaded_dates")).alias("missing_dates"))


def assert_complete(missing: DataFrame, table: str = "raw metering") -> int:
    """Driver-side gate on the one-row result of ``count_missing_dates``."""
    n = missing.select("missing_dates").first()[0]
    if n is not None and n > 0:
        raise DataValidationFailed(
            f"{n} missing dates found in table {table}. "
            "Load every day before running the preparation.")
    return n


def missing_dates_list(raw: DataFrame, start, end) -> DataFrame:
    """Days in [start, end] with no row in ``raw``.

    The raw side is reduced to its distinct days first (partial aggregation),
    then anti-joined; the expected days come from ``sequence``.
    """
    s, e = lit_date(start), lit_date(end)
    spark = raw.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(s, e)).alias("usage_date"))
    have = raw.where(F.col("usage_date").between(s, e)).select("usage_date").distinct()
    return days.join(have, ["usage_date"], "left_anti")


def check_source(spark: SparkSession, name: str, df: DataFrame, schema: T.StructType) -> DataFrame:
    """Probe a source with a zero-row read and compare its schema with the declared one.

    ``df.limit(0)`` is executed (it resolves the source and reads no rows);
    the result is one row per declared column with the type found.
    """
    df.limit(0).collect()
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(name, f.name, f.dataType.simpleString(), actual.get(f.name),
             f.name in actual, actual.get(f.name) == f.dataType.simpleString())
            for f in schema.fields]
    out_schema = T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("expected_type", T.StringType()),
        T.StructField("actual_type", T.StringType()),
        T.StructField("present", T.BooleanType()),
        T.StructField("type_ok", T.BooleanType()),
    ])
    return spark.createDataFrame(rows, out_schema)


def check_sources(sources: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """One row per declared column of each source: the type found in the source itself (not
    after a cast to the declared schema), whether it is as declared, the rows and the nulls."""
    out = None
    for name, (df, want) in sources.items():
        found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        counts = df.agg(F.count(F.lit(1)).alias("rows"),
                        *[F.count(F.col(c)).alias(c) if c in found else F.lit(None).cast("long").alias(c) for c in want])
        part = counts.select(F.explode(F.array(*[F.struct(
            F.lit(name).alias("source"), F.lit(c).alias("column_name"), F.lit(t).alias("expected_type"),
            F.lit(found.get(c)).alias("actual_type"), F.lit(c in found).alias("present"),
            F.lit(found.get(c) == t).alias("type_ok"), F.col("rows").alias("n_rows"),
            (F.col("rows") - F.col(c)).alias("n_null")) for c, t in want.items()])).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out
