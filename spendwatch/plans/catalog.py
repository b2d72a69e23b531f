"""The registered queries: each reads the driver tables of one scale-factor
folder through the adapters and runs one job (or a short chain of jobs).

Outputs keep the job's columns; floating and averaged columns are rounded to
6 places so that Spark and the DuckDB oracle can be compared exactly.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import round6
from ..operators import calendar as cal
from ..operators import checks, costs, metering
from ..sources import manifest, tables
from ..sources.adapters import DRIVER_COLUMNS, read_table, source
from . import daily

ACCOUNT = "ACME"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _round_floats(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[round6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _first_day(df: DataFrame, col: str = "usage_date"):
    return df.agg(F.min(col)).first()[0]


def _last_day(df: DataFrame, col: str = "usage_date"):
    return df.agg(F.max(col)).first()[0]


# ---------------------------------------------------------------- metering


@register("calendar")
def q_calendar(spark, sf):
    ev = source(spark, sf, "metering_sparse")
    return cal.build_calendar(spark, _first_day(ev))


def _raw(spark, sf) -> DataFrame:
    return metering.ingest_metering(source(spark, sf, "metering_src"), ACCOUNT)


@register("ingest_metering")
def q_ingest(spark, sf):
    return _raw(spark, sf)


@register("ingest_reload")
def q_ingest_reload(spark, sf):
    """Backfill every day twice, then reload the first day from an empty source."""
    src = source(spark, sf, "metering_src")
    raw = metering.ingest_metering(src, ACCOUNT)
    return _reload(spark, raw, metering.ingest_metering(src.limit(0), ACCOUNT, ds=_first_day(raw)),
                   schemas.RAW_METERING, "usage_date")


def _reload(spark, rows, nothing, schema, key) -> DataFrame:
    """Backfill every day, load the last day again, load the first day from an empty source, read back."""
    rows = tables.materialize(rows, "reload")
    first, last = cal.date_bounds(rows, key)
    path = tables.scratch_path(spark, "loaded")
    tables.backfill(rows, path, schema, key)
    tables.load_partitions(rows.where(F.col(key) == F.lit(last)), path, schema, key, [last])
    tables.load_partitions(nothing, path, schema, key, [first])
    return tables.read_table(spark, path, schema)


@register("missing_dates")
def q_missing_dates(spark, sf):
    raw = source(spark, sf, "metering_long")
    return checks.count_missing_dates(raw, *cal.date_bounds(raw, "usage_date"))


@register("missing_dates_list")
def q_missing_dates_list(spark, sf):
    raw = source(spark, sf, "metering_long")
    return checks.missing_dates_list(raw, *cal.date_bounds(raw, "usage_date"))


def _matrix(spark, raw) -> DataFrame:
    """Metrics up to the last day of the raw table, on a calendar that reaches it."""
    first, last = cal.date_bounds(raw, "usage_date")
    if first is None:
        return metering.metering_metrics(raw, cal.build_calendar(spark, "1970-01-01", 0), "1970-01-01")
    return metering.metering_metrics(raw, cal.build_calendar(spark, first, (last - first).days + 1), last)


def _metrics(spark, sf) -> DataFrame:
    """Raw table (written once, as the daily loads would have) -> calendar -> metrics."""
    return _matrix(spark, tables.materialize(source(spark, sf, "metering_sparse"), "raw_sparse"))


METRIC_FLOATS = [f"{m}_{s}" for s in ("sma30", "std30") for m in metering.MEASURES]


@register("metering_metrics")
def q_metering_metrics(spark, sf):
    return _round_floats(_metrics(spark, sf), METRIC_FLOATS)


@register("metering_metrics_long")
def q_metering_metrics_long(spark, sf):
    """The matrix over a history of more than five years, every day present."""
    return _round_to(_matrix(spark, tables.materialize(source(spark, sf, "metering_long"), "raw_long")), METRIC_FLOATS, 3)


# the warehouses of the long series: the order priorities of the source table (fixed values)
LONG_WAREHOUSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("usage_by_year")
def q_usage_by_year(spark, sf):
    return metering.usage_by_year(source(spark, sf, "metering_long"), LONG_WAREHOUSES)


@register("usage_by_year_long")
def q_usage_by_year_long(spark, sf):
    return metering.usage_by_year_long(source(spark, sf, "metering_long"))


@register("usage_by_year_range")
def q_usage_by_year_range(spark, sf):
    return metering.usage_by_year(source(spark, sf, "metering_long"), LONG_WAREHOUSES, "1996-03-01", "1999-02-28")


@register("fill_daily_gaps")
def q_fill_daily_gaps(spark, sf):
    return cal.fill_daily_gaps(source(spark, sf, "metering_long"))


@register("weekly_usage")
def q_weekly_usage(spark, sf):
    return metering.weekly_usage(cal.fill_daily_gaps(source(spark, sf, "metering_long")))


# ---------------------------------------------------------------- costs


def _queries(spark, sf, rank: str | None = "ranges") -> DataFrame:
    return costs.load_query_history(source(spark, sf, "query_src"), rank_strategy=rank)


def _credits(spark, sf) -> DataFrame:
    return costs.load_warehouse_credits(source(spark, sf, "query_src"), source(spark, sf, "metering_src"),
                                        source(spark, sf, "rates_src"), ACCOUNT)


def _delta(spark, sf, by_warehouse: bool = False) -> DataFrame:
    """Cost deltas of the last costed day.  The day comes from the credits, one row per
    warehouse-day and staged once; the ranks of the queries are not needed."""
    credits = tables.materialize(_credits(spark, sf), "credits")
    cost = costs.dag_cost(_queries(spark, sf, rank=None), credits)
    return costs.dag_cost_delta(cost, by_warehouse, last_day=_last_day(credits, "ds"))


@register("query_history")
def q_query_history(spark, sf):
    return _queries(spark, sf)


@register("warehouse_credits")
def q_warehouse_credits(spark, sf):
    return _credits(spark, sf)


@register("storage_cost")
def q_storage_cost(spark, sf):
    df = costs.load_storage_cost(source(spark, sf, "storage_src"), source(spark, sf, "storage_rates_src"), ACCOUNT)
    return _round_floats(df, ["database_bytes", "database_terabytes", "database_storage_cost"])


@register("credits_delta")
def q_credits_delta(spark, sf):
    return costs.warehouse_credits_delta(tables.materialize(_credits(spark, sf), "credits"))


@register("query_history_reload")
def q_query_history_reload(spark, sf):
    src = source(spark, sf, "query_src")
    rows = costs.load_query_history(src)
    return _reload(spark, rows, costs.load_query_history(src.limit(0), _first_day(rows, "ds")), schemas.QUERY_HISTORY, "ds")


@register("warehouse_credits_reload")
def q_warehouse_credits_reload(spark, sf):
    src, met, rates = (source(spark, sf, n) for n in ("query_src", "metering_src", "rates_src"))
    rows = costs.load_warehouse_credits(src, met, rates, ACCOUNT)
    none = costs.load_warehouse_credits(src.limit(0), met, rates, ACCOUNT, _first_day(rows, "ds"))
    return _reload(spark, rows, none, schemas.WAREHOUSE_CREDITS, "ds")


@register("storage_cost_reload")
def q_storage_cost_reload(spark, sf):
    src, rates = source(spark, sf, "storage_src"), source(spark, sf, "storage_rates_src")
    rows = costs.load_storage_cost(src, rates, ACCOUNT)
    none = costs.load_storage_cost(src.limit(0), rates, ACCOUNT, _first_day(rows, "ds"))
    out = _reload(spark, rows, none, schemas.STORAGE_COST, "ds")
    return _round_floats(out, ["database_bytes", "database_terabytes", "database_storage_cost"])


@register("dag_cost")
def q_dag_cost(spark, sf):
    return costs.dag_cost(_queries(spark, sf), tables.materialize(_credits(spark, sf), "credits"))


PCT = [f"{p}pct_change_{n}" for p in ("", "yesterday_warn_") for n in ("yesterday", "last_week", "last_month")]


@register("dag_cost_delta")
def q_dag_cost_delta(spark, sf):
    return _round_floats(_delta(spark, sf), PCT)


@register("dag_cost_delta_by_warehouse")
def q_dag_cost_delta_by_warehouse(spark, sf):
    return _round_floats(_delta(spark, sf, by_warehouse=True), PCT)


@register("dag_cost_warnings")
def q_dag_cost_warnings(spark, sf):
    df = costs.dag_cost_warnings(_delta(spark, sf))
    return _round_floats(df, [c for c in PCT if c in df.columns])


@register("cost_categories")
def q_cost_categories(spark, sf):
    return costs.cost_categories(source(spark, sf, "currency_src"), ACCOUNT)


@register("cost_categories_range")
def q_cost_categories_range(spark, sf):
    return costs.cost_categories(source(spark, sf, "currency_src"), ACCOUNT, "1996-03-01", "1997-02-28")


@register("cost_by_year")
def q_cost_by_year(spark, sf):
    return costs.cost_by_year(costs.cost_categories(source(spark, sf, "currency_src"), ACCOUNT))


@register("source_check")
def q_source_check(spark, sf):
    """Declared columns of the driver tables that the adapters read, as found in the files, with their row counts."""
    return checks.check_sources({t: (read_table(spark, sf, t), want) for t, want in DRIVER_COLUMNS.items()})


# ---------------------------------------------------------------- decomposition
from ..operators import decompose  # noqa: E402

COMPONENTS = ["trend", "seasonal", "residual"]


def _round_to(df: DataFrame, cols, digits: int) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _features(spark, sf) -> DataFrame:
    """Production path: raw -> metrics matrix -> two-sided decomposition up to the last day."""
    m = _metrics(spark, sf)
    return decompose.seasonal_features(m, ds=None, two_sided=True)


def _daily_long(spark, sf) -> DataFrame:
    return cal.fill_daily_gaps(source(spark, sf, "metering_long"))


def _features_one_sided(spark, sf) -> DataFrame:
    """Notebook path: gap-filled long series -> trailing-average decomposition."""
    return decompose.seasonal_features(_daily_long(spark, sf), two_sided=False)


@register("seasonal_two_sided")
def q_seasonal_two_sided(spark, sf):
    return _round_floats(_features(spark, sf), COMPONENTS)


@register("seasonal_one_sided")
def q_seasonal_one_sided(spark, sf):
    # daily sums of order prices are ~1e6: compare components at 1e-3
    return _round_to(_features_one_sided(spark, sf), COMPONENTS, 3)


# ---------------------------------------------------------------- forests and anomalies
from ..operators import anomalies, forest  # noqa: E402

SEED = 0
FOREST_FLOATS = ["lo", "hi", "path_len", "score", "score_mean", "score_std", "threshold", "residual",
                 "trend", "seasonal", "mean_path"]


@dataclass
class Stored:
    """What the weekly and daily runs leave behind for one folder of driver tables."""

    t: daily.Tables
    last: _dt.date
    training: DataFrame


_STORED: dict[tuple[str, str], Stored] = {}


def stored(spark, sf) -> Stored:
    """The scheduled runs over the sparse metering, once per session and folder.

    Two model versions are trained (cut-offs 14 and 7 days before the last
    day), the second one twice, and the last day is predicted twice, as a
    scheduler would after a lost answer.  The queries below read the tables.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        t = daily.Tables(tables.scratch_path(spark, "runs"))
        raw = source(spark, sf, "metering_sparse")
        first, last = cal.date_bounds(raw, "usage_date")
        daily.setup(spark, t, first, (last - first).days + 1)
        tables.backfill(raw, t.raw_warehouse_metering_history, schemas.RAW_METERING, "usage_date")
        daily.run_preparation(spark, t, first, last)
        daily.run_training(spark, t, last - _dt.timedelta(days=14), seed=SEED)
        cut = last - _dt.timedelta(days=7)
        daily.run_training(spark, t, cut, seed=SEED)
        training = daily.run_training(spark, t, cut, version=2, seed=SEED)
        for _ in range(2):
            daily.run_prediction(spark, t, last)
        _STORED[key] = Stored(t, last, training)
    return _STORED[key]


def _table(spark, sf, name: str) -> DataFrame:
    return daily.table(spark, stored(spark, sf).t, name)


@register("model_reload")
def q_model_reload(spark, sf):
    """The stored model versions: one row per warehouse and version, the repeated one once."""
    meta = daily.models(spark, stored(spark, sf).t)["meta"]
    return _round_floats(meta, ["c_psi", "score_mean", "score_std", "threshold"])


@register("prediction_reload")
def q_prediction_reload(spark, sf):
    """The stored anomalies after predicting the last day twice."""
    out = _table(spark, sf, "model_output_anomalies")
    return _round_floats(out, ["credits_used", "trend", "seasonal", "residual", "score"])


@register("forest_model")
def q_forest_model(spark, sf):
    latest = tables.latest(daily.forests(spark, stored(spark, sf).t), ["warehouse_name"], "model_version")
    return _round_floats(forest.leaves(latest), ["lo", "hi", "path_len"])


@register("forest_train_anomalies")
def q_forest_train_anomalies(spark, sf):
    out = stored(spark, sf).training
    return _round_floats(out, [c for c in FOREST_FLOATS if c in out.columns])


@register("forest_scores")
def q_forest_scores(spark, sf):
    return _scores(spark, sf, daily.forests(spark, stored(spark, sf).t))


def _scores(spark, sf, m) -> DataFrame:
    out = forest.score_forest(_table(spark, sf, "feature_metering_seasonal_decompose"), m, stored(spark, sf).last)
    return _round_floats(out, [c for c in FOREST_FLOATS if c in out.columns])


@register("model_snapshot")
def q_model_snapshot(spark, sf):
    """A prediction between the steps of a repeated training, whose tables are written but not yet published:
    it sees the version before, whole."""
    t = stored(spark, sf).t
    before = manifest.snapshot(spark, t.model)
    earlier = daily.forests(spark, t, before).where("model_version = 1").withColumn("model_version", F.lit(2).cast("long"))
    batch = manifest.write_batch({daily.FORESTS: (earlier, daily.MODEL_FORESTS)}, t.model, "model_version", [2])
    out = tables.materialize(_scores(spark, sf, daily.forests(spark, t)), "between")
    batch.discard()
    return out


@register("prediction_append")
def q_prediction_append(spark, sf):
    """Predictions of two days appended, the last one twice: the repeat adds nothing, the overlap of the windows stays."""
    s = stored(spark, sf)
    path = tables.scratch_path(spark, "appended")
    for day in (s.last - _dt.timedelta(days=1), s.last, s.last):
        found = daily.predict(spark, s.t, day).withColumn("prediction_date", F.lit(day))
        tables.append_batch(found, path, daily.PREDICTIONS, "prediction_date", str(day))
    out = tables.read_table(spark, path, schemas.MODEL_OUTPUT_ANOMALIES)
    return _round_floats(out, ["credits_used", "trend", "seasonal", "residual", "score"])


@register("forest_history")
def q_forest_history(spark, sf):
    """Notebook scan: one-sided residuals of the long series, every day scored,
    threshold at 2 sd, anomalies above the global mean of credits."""
    feats = tables.materialize(_features_one_sided(spark, sf).select(
        "warehouse_name", "usage_date", "credits_used", "residual"), "features_long")
    fit = forest.fit_forest(feats, seed=SEED, sigmas=2.0)
    out = forest.training_anomalies(fit.scores, global_mean=True)
    return _round_to(out, [c for c in FOREST_FLOATS if c in out.columns], 6)


@register("anomalies_view")
def q_anomalies_view(spark, sf):
    out = anomalies.anomalies_view(_table(spark, sf, "metrics_warehouse_metering_history"),
                                   _table(spark, sf, "model_output_anomalies"))
    return _round_floats(out, METRIC_FLOATS + [c for c in FOREST_FLOATS if c in out.columns])


def _report(spark, sf) -> DataFrame:
    s = stored(spark, sf)
    return anomalies.anomaly_report(_table(spark, sf, "raw_warehouse_metering_history"),
                                    daily.predictions_of(spark, s.t, s.last))


@register("anomaly_report")
def q_anomaly_report(spark, sf):
    return _round_floats(_report(spark, sf), ["score"])


@register("anomaly_report_text")
def q_anomaly_report_text(spark, sf):
    rows = _report(spark, sf)
    rows = rows.withColumn("score", F.when(F.col("score").isNotNull(), F.format_string("%.6f", F.round("score", 6))))
    return anomalies.report_text(rows)


@register("anomaly_message")
def q_anomaly_message(spark, sf):
    """The message that people read, in pages of 20 lines."""
    rows = _report(spark, sf)
    rows = rows.withColumn("score", F.when(F.col("score").isNotNull(), F.format_string("%.6f", F.round("score", 6))))
    return anomalies.report_pages(rows, page_lines=20)


@register("short_series")
def q_short_series(spark, sf):
    """Preparations over the first 13 and 14 days: the first skips every series and publishes nothing, the second
    one publishes.  One row per run and warehouse: days, whether it was skipped, rows in the feature table then."""
    t = daily.Tables(tables.scratch_path(spark, "short"))
    raw = source(spark, sf, "metering_sparse")
    first = _first_day(raw)
    daily.setup(spark, t, first, 30)
    if first is not None:
        tables.backfill(raw, t.raw_warehouse_metering_history, schemas.RAW_METERING, "usage_date")
    out = None
    for days in (13, 14):
        upto = (first or _dt.date(1970, 1, 1)) + _dt.timedelta(days=days - 1)
        skipped = daily.run_preparation(spark, t, first, upto)
        names = daily.table(spark, t, "metrics_warehouse_metering_history").select("warehouse_name").distinct()
        stored_rows = daily.table(spark, t, "feature_metering_seasonal_decompose").groupBy("warehouse_name").agg(
            F.count(F.lit(1)).alias("feature_rows"))
        run = (names.join(skipped.select("warehouse_name", F.lit(True).alias("skipped")), "warehouse_name", "left")
               .join(stored_rows, "warehouse_name", "left")
               .select(F.lit(days).alias("days"), "warehouse_name", F.coalesce("skipped", F.lit(False)).alias("skipped"),
                       F.coalesce("feature_rows", F.lit(0)).alias("feature_rows")))
        run = tables.materialize(run, "short_run")
        out = run if out is None else out.unionByName(run)
    return out


@register("warehouses")
def q_warehouses(spark, sf):
    return anomalies.list_warehouses(_table(spark, sf, "feature_metering_seasonal_decompose"))


@register("alert_gate")
def q_alert_gate(spark, sf):
    s = stored(spark, sf)
    return anomalies.alert_gate(daily.predictions_of(spark, s.t, s.last))


# ---------------------------------------------------------------- stored views
_VIEWS: dict[tuple[str, str], str] = {}


def _view(spark, sf, name: str) -> DataFrame:
    """A reporting view, made when every day but the last was loaded and read after the last day's load."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VIEWS:
        t = daily.Tables(tables.scratch_path(spark, "views"))
        runs = stored(spark, sf).t
        rows = {"reporting_query_history": (tables.materialize(_queries(spark, sf), "queries"), schemas.QUERY_HISTORY),
                "reporting_warehouse_credits": (tables.materialize(_credits(spark, sf), "credits"), schemas.WAREHOUSE_CREDITS)}
        last = _last_day(rows["reporting_warehouse_credits"][0], "ds")
        early = F.lit(True) if last is None else F.col("ds") < F.lit(last)
        for table, (df, schema) in rows.items():
            tables.backfill(df.where(early), getattr(t, table), schema, "ds")
        prefix = f"v{len(_VIEWS)}_"
        daily.register_views(spark, daily.Placed(t, runs), prefix)
        for table, (df, schema) in rows.items():
            tables.load_partitions(df.where(F.col("ds") == F.lit(last)), getattr(t, table), schema, "ds", [last])
        _VIEWS[key] = prefix
    return spark.table(f"{_VIEWS[key]}{name}")


@register("view_dag_cost")
def q_view_dag_cost(spark, sf):
    return _view(spark, sf, "view_reporting_dag_cost")


@register("view_dag_cost_delta")
def q_view_dag_cost_delta(spark, sf):
    return _round_floats(_view(spark, sf, "view_reporting_dag_cost_delta"), PCT)


@register("view_dag_cost_warnings")
def q_view_dag_cost_warnings(spark, sf):
    out = _view(spark, sf, "view_reporting_dag_cost_warnings")
    return _round_floats(out, [c for c in PCT if c in out.columns])


@register("view_credits_delta")
def q_view_credits_delta(spark, sf):
    return _view(spark, sf, "view_reporting_warehouse_credits_delta")


@register("view_anomalies")
def q_view_anomalies(spark, sf):
    out = _view(spark, sf, "view_reporting_anomalies")
    return _round_floats(out, METRIC_FLOATS + [c for c in FOREST_FLOATS if c in out.columns])


# ---------------------------------------------------------------- drift
from ..operators import drift  # noqa: E402


@register("daily_pivot")
def q_daily_pivot(spark, sf):
    return drift.daily_pivot(_daily_long(spark, sf), LONG_WAREHOUSES)


@register("usage_drift_stat")
def q_usage_drift_stat(spark, sf):
    """KS distance and asymptotic p-value per warehouse (SQL-checkable part)."""
    stat = drift.ks_statistic(_daily_long(spark, sf))
    return stat.withColumn("p_value_asymptotic", F.round(drift.asymptotic_p(), 6)).withColumn(
        "ks_d", F.round("ks_d", 9))


@register("usage_drift")
def q_usage_drift(spark, sf):
    """KS test per warehouse with the exact p-value (checked against path enumeration in tests)."""
    return _round_floats(drift.usage_drift(_daily_long(spark, sf)), ["ks_d", "p_value"])


@register("drift_share")
def q_drift_share(spark, sf):
    return drift.drift_share(drift.usage_drift(_daily_long(spark, sf)))
