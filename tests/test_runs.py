"""End-to-end: the scheduled runs writing tables, and the streaming load."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendwatch import schemas
from spendwatch.operators import checks, costs, metering
from spendwatch.plans import daily
from spendwatch.sources import tables
from spendwatch.sources.adapters import source
from spendwatch.streaming.ingest import start_metering_stream

from .conftest import SF

START = dt.date(2024, 1, 1)


def test_scheduled_runs(spark):
    t = daily.Tables(tables.scratch_path(spark, "runs"))
    src = daily.Sources(metering=source(spark, SF, "metering_src"), query_history=source(spark, SF, "query_src"),
                        rates=source(spark, SF, "rates_src"), storage=source(spark, SF, "storage_src"))
    daily.setup(spark, t, START, days=60)
    last = START + dt.timedelta(days=15)
    for i in range(16):
        daily.run_ingestion(src, t, "ACME", START + dt.timedelta(days=i))
    daily.run_ingestion(src, t, "ACME", last)  # a re-run replaces its day
    raw = tables.read_table(spark, t.raw_warehouse_metering_history, schemas.RAW_METERING)
    want = metering.ingest_metering(src.metering, "ACME").where(F.col("usage_date") <= F.lit(last))
    assert raw.count() == want.count()

    daily.run_reporting(src, t, "ACME", last)
    q = tables.read_table(spark, t.reporting_query_history, schemas.QUERY_HISTORY)
    assert q.count() > 0 and q.select("ds").distinct().count() == 1

    skipped = daily.run_preparation(spark, t, START, last)
    metrics = spark.read.parquet(t.metrics_warehouse_metering_history)
    n_wh = raw.where("warehouse_name is not null").select("warehouse_name").distinct().count()
    assert metrics.count() == n_wh * 16
    feats = spark.read.parquet(t.feature_metering_seasonal_decompose)
    assert feats.count() == metrics.count() - 16 * skipped.count()

    # M5: a preparation in which every series is too short leaves the feature table as it is
    n_feats, n_feat_wh = feats.count(), feats.select("warehouse_name").distinct().count()
    daily.run_preparation(spark, t, START, START + dt.timedelta(days=5))
    assert spark.read.parquet(t.feature_metering_seasonal_decompose).count() == n_feats
    daily.run_preparation(spark, t, START, last)
    metrics = spark.read.parquet(t.metrics_warehouse_metering_history)

    with pytest.raises(checks.DataValidationFailed, match="calendar"):
        daily.run_ingestion(src, t, "ACME", START + dt.timedelta(days=60))
        daily.run_preparation(spark, t, START + dt.timedelta(days=60), START + dt.timedelta(days=60))

    # a training whose answer was lost runs again as the same version; a prediction twice
    found = daily.run_training(spark, t, before=START + dt.timedelta(days=12))
    assert set(found.columns) >= {"warehouse_name", "usage_date", "score", "threshold"}
    daily.run_training(spark, t, before=START + dt.timedelta(days=12), version=1)
    assert daily.models(spark, t)["meta"].count() == n_feat_wh
    report, gate = daily.run_prediction(spark, t, last)
    once = (report.count(), gate.first())
    report, gate = daily.run_prediction(spark, t, last)
    assert (report.count(), gate.first()) == once
    g = gate.first()
    assert g.send_alert == (g.n_anomalies > 0)
    stored = tables.read_table(spark, t.model_output_anomalies, schemas.MODEL_OUTPUT_ANOMALIES).count()
    daily.run_prediction(spark, t, last, append=True)          # this day is there: nothing is added
    daily.run_prediction(spark, t, last - dt.timedelta(days=1), append=True)
    daily.run_prediction(spark, t, last - dt.timedelta(days=1), append=True)
    one = daily.predictions_of(spark, t, last - dt.timedelta(days=1))
    assert tables.read_table(spark, t.model_output_anomalies, schemas.MODEL_OUTPUT_ANOMALIES).count() == stored + one.count()
    for later in (last + dt.timedelta(days=1), last + dt.timedelta(days=2)):      # two days with a row, one of them read
        row = spark.sql(f"select 'W' as warehouse_name, date'{last}' as usage_date, 1D as credits_used, 0D as trend, 0D as seasonal, "
                        f"0D as residual, -1D as score, timestamp_ntz'{later} 00:00:00' as prediction_datetime, date'{later}' as prediction_date")
        tables.append_batch(row, t.model_output_anomalies, daily.PREDICTIONS, "prediction_date", later)
    read = daily.predictions_of(spark, t, later)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "prediction_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read.count() == 1 and all(f"prediction_date={later}" in f for f in read.select("_metadata.file_path").toPandas()["file_path"])
    for later in (last + dt.timedelta(days=1), last + dt.timedelta(days=2)):
        tables.load_partitions(row.where("false"), t.model_output_anomalies, daily.PREDICTIONS, "prediction_date", [later])

    names = daily.register_views(spark, t)
    assert len(names) == 5
    assert spark.sql("select count(*) as n from view_reporting_anomalies").first().n == metrics.count()
    # the views equal the jobs, and follow later loads by themselves
    for day in (last, last + dt.timedelta(days=1)):
        daily.run_reporting(src, t, "ACME", day)
        q, c = daily.table(spark, t, "reporting_query_history"), daily.table(spark, t, "reporting_warehouse_credits")
        cost = costs.dag_cost(q, c)
        delta = costs.dag_cost_delta(cost)
        wanted = {"view_reporting_dag_cost": cost, "view_reporting_dag_cost_delta": delta,
                  "view_reporting_dag_cost_warnings": costs.dag_cost_warnings(delta),
                  "view_reporting_warehouse_credits_delta": costs.warehouse_credits_delta(c)}
        for name, want in wanted.items():
            view = spark.table(name)
            assert sorted(view.columns) == sorted(want.columns), name
            view = view.select([F.col(x).cast(want.schema[x].dataType) for x in want.columns])
            assert view.count() == want.count() and view.exceptAll(want).count() == 0, name
        assert spark.sql("select max(ds) as d from view_reporting_dag_cost_delta").first().d == day
        assert daily.last_costed_day(spark, t) == str(day)
    # they belong to the catalog, not to the session, and find the last day and its folders without reading rows
    other = spark.newSession()
    assert other.table("view_reporting_dag_cost_delta").count() == spark.table("view_reporting_dag_cost_delta").count()
    plan = spark.table("view_reporting_dag_cost_delta")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan ")[1:] if "query_text" in x or "airflow_dag_id" in x.split("PartitionFilters")[0]]
    assert scans and all("ds" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


def test_views_name_what_is_missing(spark):
    t = daily.Tables(tables.scratch_path(spark, "empty"))
    daily.setup(spark, t, START, days=5)
    assert all(daily.table(spark, t, n).schema.fieldNames() == s.fieldNames() for n, (s, _) in daily.TABLES.items())
    assert daily.table(spark, t, "common_calendar").count() == 5
    with pytest.raises(ValueError, match="reporting_query_history"):
        daily.register_views(spark, t)


def test_streaming_reloads_touched_days(spark):
    landing = tables.scratch_path(spark, "landing")
    table = tables.scratch_path(spark, "raw_stream")
    ckpt = tables.scratch_path(spark, "stream_ckpt")
    src = source(spark, SF, "metering_src")
    early = src.where(F.col("end_time") < F.lit("2024-01-10").cast("timestamp_ntz"))
    late = src.where(F.col("end_time") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    early.write.mode("append").parquet(landing)
    q = start_metering_stream(spark, landing, "ACME", table, ckpt, available_now=True)
    q.awaitTermination(300)
    late.write.mode("append").parquet(landing)
    q = start_metering_stream(spark, landing, "ACME", table, ckpt, available_now=True)
    q.awaitTermination(300)
    got = tables.read_table(spark, table, schemas.RAW_METERING)
    want = metering.ingest_metering(src, "ACME")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_features_are_written_once_and_stay_if_none_are_made(spark):
    """The new files tell whether there are rows: nothing is staged, and an empty result leaves the table."""
    import glob
    from spendwatch.sources import tables
    path = tables.scratch_path(spark, "once")
    schema = spark.range(1).schema
    assert tables.replace_table(spark.range(3), path, schema, unless_empty=True)
    assert not tables.replace_table(spark.range(0), path, schema, unless_empty=True)
    assert spark.read.parquet(path).count() == 3
    assert glob.glob(f"{path.removeprefix('file:')}/*.zstd.parquet") and not glob.glob(f"{path.rpartition('/')[0].removeprefix('file:')}/_new-*-{path.rpartition('/')[2]}")
    assert tables.replace_table(spark.range(0), path, schema) and spark.read.parquet(path).count() == 0
