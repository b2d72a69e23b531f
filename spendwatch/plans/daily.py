"""The scheduled runs as Spark jobs writing tables.

Each run takes the run date ``ds`` (or a training cut-off) and table
locations, reads its inputs, and writes its outputs with the writers of
``sources.tables``: the loads replace their day, the prepared tables are
replaced whole, a training publishes its model version in
one step, and a prediction replaces or appends its day.  Runs of different days
can run at the same time; a repeated run replaces what it wrote before, or adds
nothing where it appends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import anomalies, calendar, checks, costs, decompose, forest, metering
from ..sources import manifest, tables
from .views import view_sql

_TRAINING = T.StructType([
    T.StructField("usage_date", T.DateType()), T.StructField("credits_used", schemas.CREDITS),
    T.StructField("residual", T.DoubleType())])
# one row per warehouse and version (see ``operators.forest``)
MODEL_FORESTS = T.StructType([
    T.StructField("warehouse_name", T.StringType()), T.StructField("model_version", T.LongType()),
    T.StructField("n_trees", T.IntegerType()), T.StructField("psi", T.LongType()),
    T.StructField("c_psi", T.DoubleType()), T.StructField("score_mean", T.DoubleType()),
    T.StructField("score_std", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("max_samples", T.IntegerType()), T.StructField("seed", T.LongType()),
    T.StructField("depth", T.ArrayType(T.ByteType())), T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("training", T.ArrayType(_TRAINING)),
    T.StructField("score", T.ArrayType(T.DoubleType()))])

FORESTS = "forests"
PREDICTIONS = T.StructType([*schemas.MODEL_OUTPUT_ANOMALIES.fields, T.StructField("prediction_date", T.DateType())])


@dataclass
class Tables:
    """Locations of every table under one root on shared storage."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


@dataclass
class Placed:
    """Tables of two roots: the reporting loads under one, everything else under another."""

    reporting: Tables
    rest: Tables

    def __getattr__(self, name: str) -> str:
        return getattr(self.reporting if name.startswith("reporting_") else self.rest, name)


@dataclass
class Sources:
    """The vendor views the loads read."""

    metering: DataFrame        # metering by organization (also by account)
    query_history: DataFrame
    rates: DataFrame
    storage: DataFrame


TABLES = {
    "common_calendar": (schemas.CALENDAR, None),
    "raw_warehouse_metering_history": (schemas.RAW_METERING, "usage_date"),
    "metrics_warehouse_metering_history": (schemas.METERING_METRICS, None),
    "feature_metering_seasonal_decompose": (schemas.SEASONAL_FEATURES, None),
    "model_output_anomalies": (schemas.MODEL_OUTPUT_ANOMALIES, "prediction_date"),
    "reporting_query_history": (schemas.QUERY_HISTORY, "ds"),
    "reporting_warehouse_credits": (schemas.WAREHOUSE_CREDITS, "ds"),
    "reporting_database_storage_cost": (schemas.STORAGE_COST, "ds"),
}


def setup(spark: SparkSession, t: Tables, start, days: int = calendar.DEFAULT_DAYS) -> None:
    """Initial setup: the eight tables; the calendar is filled, the others are empty until their first load.

    A table that exists already is left as it is.
    """
    for name, (schema, key) in TABLES.items():
        path = getattr(t, name)
        if key:
            manifest.create(spark, path, schema, key)
        elif not tables.exists(spark, path):
            empty = spark.createDataFrame([], schema)
            (calendar.build_calendar(spark, start, days) if name == "common_calendar" else empty).write.parquet(path)


def table(spark: SparkSession, t: Tables, name: str) -> DataFrame:
    """One of the eight tables as it is now."""
    return tables.read_table(spark, getattr(t, name), TABLES[name][0])


def run_ingestion(src: Sources, t: Tables, account: str, ds) -> None:
    """Daily metering load: replaces ``usage_date = ds``."""
    raw = metering.ingest_metering(src.metering, account, ds)
    tables.load_partitions(raw, t.raw_warehouse_metering_history, schemas.RAW_METERING, "usage_date", [ds])


def run_reporting(src: Sources, t: Tables, account: str, ds) -> None:
    """Daily reporting loads: query history, warehouse credits, storage cost for ``ds``."""
    q = costs.load_query_history(src.query_history, ds)
    tables.load_partitions(q, t.reporting_query_history, schemas.QUERY_HISTORY, "ds", [ds])
    c = costs.load_warehouse_credits(src.query_history, src.metering, src.rates, account, ds)
    tables.load_partitions(c, t.reporting_warehouse_credits, schemas.WAREHOUSE_CREDITS, "ds", [ds])
    s = costs.load_storage_cost(src.storage, src.rates, account, ds)
    tables.load_partitions(s, t.reporting_database_storage_cost, schemas.STORAGE_COST, "ds", [ds])


def run_preparation(spark: SparkSession, t: Tables, start, ds) -> DataFrame:
    """Completeness gate, then the metrics matrix and the seasonal features (both replaced).

    Fails when the calendar does not reach ``ds``.  Returns the series that
    were too short to decompose.
    """
    raw = table(spark, t, "raw_warehouse_metering_history")
    checks.assert_complete(checks.count_missing_dates(raw, start, ds), t.raw_warehouse_metering_history)
    cal = table(spark, t, "common_calendar")
    end = cal.agg(F.max("usage_date").cast("string")).first()[0]
    if end is None or end < str(ds):
        raise checks.DataValidationFailed(f"the calendar ends on {end}, before {ds}: extend it first")
    tables.replace_table(metering.metering_metrics(raw, cal, ds), t.metrics_warehouse_metering_history,
                         schemas.METERING_METRICS)
    metrics = table(spark, t, "metrics_warehouse_metering_history")
    # if no series could be decomposed the feature table is left as it is
    tables.replace_table(decompose.seasonal_features(metrics, ds), t.feature_metering_seasonal_decompose,
                         schemas.SEASONAL_FEATURES, unless_empty=True)
    return decompose.skipped_series(metrics, ds)


def run_training(spark: SparkSession, t: Tables, before, version: int | None = None, seed: int = 0,
                 sigmas: float = 3.0) -> DataFrame:
    """Weekly training: one forest per warehouse, stored as a model version.

    The version is the next free one; a repeated run passes the version it
    repeats and replaces it.  Trees and thresholds are one row,
    so no reader ever joins those of two trainings.  Returns the training
    anomalies.
    """
    if version is None:
        version = tables.next_version(spark, t.model)
    rows = forest.training_rows(table(spark, t, "feature_metering_seasonal_decompose"), before)
    grown = forest.grow_models(rows, seed=seed, sigmas=sigmas)
    batch = manifest.write_batch({FORESTS: (grown.withColumn("model_version", F.lit(version).cast("long")), MODEL_FORESTS)},
                                 t.model, "model_version", [version])
    batch.commit()
    made = forests(spark, t).where(F.col("model_version") == F.lit(version))
    return forest.training_anomalies(forest.training_scores(made))


def forests(spark: SparkSession, t: Tables, at: manifest.Snapshot | None = None) -> DataFrame:
    """The stored models, one row per warehouse and version."""
    return manifest.read(spark, t.model, MODEL_FORESTS, FORESTS, at)


def models(spark: SparkSession, t: Tables, at: manifest.Snapshot | None = None) -> dict[str, DataFrame]:
    """The stored models as tables (leaves, segments, meta), all as of one commit."""
    found = forests(spark, t, at)
    return {"leaves": forest.leaves(found), "segments": forest.segments(found), "meta": forest.meta(found)}


def predict(spark: SparkSession, t: Tables, ds, at: manifest.Snapshot | None = None) -> DataFrame:
    """The anomalies of [ds - 7, ds] by the latest model of each warehouse, all of one commit of the models."""
    return forest.predicted_anomalies(forest.score_forest(table(spark, t, "feature_metering_seasonal_decompose"),
                                                          forests(spark, t, at), ds))


def run_prediction(spark: SparkSession, t: Tables, ds, append: bool = False) -> tuple[DataFrame, DataFrame]:
    """Daily prediction: stores the day's anomalies, returns (report, alert gate).

    A repeated prediction replaces its day, or with ``append`` adds nothing.
    The windows of different days overlap, and all their rows stay either way.
    """
    found = predict(spark, t, ds).withColumn("prediction_date", F.lit(str(ds)).cast("date"))
    write = tables.append_batch if append else tables.replace_partition
    write(found, t.model_output_anomalies, PREDICTIONS, "prediction_date", str(ds))
    todays = predictions_of(spark, t, ds)
    return anomalies.anomaly_report(table(spark, t, "raw_warehouse_metering_history"), todays), anomalies.alert_gate(todays)


def predictions_of(spark: SparkSession, t: Tables, ds) -> DataFrame:
    """The stored anomalies that the prediction of ``ds`` found; opens the files of that day only."""
    stored = manifest.read(spark, t.model_output_anomalies, PREDICTIONS)
    return stored.where(F.col("prediction_date") == F.lit(str(ds)).cast("date")).drop("prediction_date")


def last_costed_day(spark: SparkSession, t: Tables) -> str | None:
    """The last day with stored queries and credits, from the manifests: no data is read.

    Credits of a day exist only for warehouses that ran queries on it, so this
    is the last day that has costs.
    """
    return tables.last_value(spark, t.reporting_query_history, t.reporting_warehouse_credits)


def register_views(spark: SparkSession, t: Tables, prefix: str = "") -> list[str]:
    """Create or replace the five reporting views in the catalog, over the stored tables (see ``plans.views``).

    They are definitions of the catalog, not of the session; on a cluster with
    a metastore they stay until they are dropped.  A table must have been
    loaded once, so that its columns are known; a missing one is an error that
    names it.  ``prefix`` goes before the names of the views (``db.`` names a
    database).
    """
    views = view_sql(t, prefix)
    lost = sorted({n for needs, _ in views.values() for n in needs if not tables.is_loaded(spark, getattr(t, n))})
    if lost:
        raise ValueError(f"load these tables before registering the views: {', '.join(lost)}")
    for name, (_, sql) in views.items():
        spark.sql(f"create or replace view {prefix}{name} as {sql}")
    return sorted(prefix + name for name in views)
