import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendwatch import schemas
from spendwatch.operators import anomalies, checks, drift
from spendwatch.sources import manifest, tables

D = dt.date


def test_create_replace_append_latest(spark):
    path = tables.scratch_path(spark, "wc")
    tables.create_table(spark, "reporting_warehouse_credits_t", schemas.WAREHOUSE_CREDITS, path, ("ds",))
    tables.create_table(spark, "reporting_warehouse_credits_t", schemas.WAREHOUSE_CREDITS, path, ("ds",))  # if not exists
    assert spark.table("reporting_warehouse_credits_t").schema.fieldNames()[-1] == "ds"

    rep = tables.scratch_path(spark, "metrics")
    df = spark.createDataFrame([("W", D(2024, 1, 1), 1.5)], "warehouse_name string, usage_date date, credits_used double")
    rest = tuple(c for c in schemas.METERING_METRICS.fieldNames() if c not in df.columns)
    with pytest.raises(ValueError, match="missing columns"):
        tables.replace_table(df, rep, schemas.METERING_METRICS)
    tables.replace_table(df, rep, schemas.METERING_METRICS, rest)
    tables.replace_table(df.union(df), rep, schemas.METERING_METRICS, rest)
    back = spark.read.parquet(rep)
    assert back.count() == 2 and back.schema == schemas.METERING_METRICS  # declared types survive a replace

    models = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2), ("B", 1, 0.3)],
                                   "warehouse_name string, model_version int, threshold double")
    got = sorted((r.warehouse_name, r.model_version) for r in tables.latest(models, ["warehouse_name"], "model_version").collect())
    assert got == [("A", 2), ("B", 1)]


def test_completeness_gate_raises(spark):
    raw = spark.createDataFrame([(D(2024, 1, i),) for i in (1, 2, 5)], "usage_date date")
    with pytest.raises(checks.DataValidationFailed):
        checks.assert_complete(checks.count_missing_dates(raw, "2024-01-01", "2024-01-05"))
    full = spark.createDataFrame([(D(2024, 1, i),) for i in range(1, 6)], "usage_date date")
    assert checks.assert_complete(checks.count_missing_dates(full, "2024-01-01", "2024-01-05")) == -1


def test_pivot_rejects_duplicates(spark):
    ok = spark.createDataFrame([(D(2024, 1, 1), "A", 1.0), (D(2024, 1, 1), "B", 2.0)],
                               "usage_date date, warehouse_name string, credits_used double")
    row = drift.daily_pivot(ok, ["A", "B"]).first()
    assert (row.A, row.B) == (1.0, 2.0)
    dup = ok.union(ok.limit(1))
    with pytest.raises(Exception):
        drift.daily_pivot(dup, ["A", "B"]).collect()


def test_report_lines(spark):
    raw = spark.createDataFrame([("W", D(2024, 1, i), 1.0, 1.0, 0.0) for i in range(1, 20)],
                                "warehouse_name string, usage_date date, credits_used double, "
                                "credits_used_compute double, credits_used_cloud_services double")
    found = spark.createDataFrame([("W", D(2024, 1, 10), -0.2)], "warehouse_name string, usage_date date, score double")
    rep = anomalies.anomaly_report(raw, found)
    assert rep.count() == 15  # day 3 .. day 17
    assert rep.where("is_anomaly").count() == 1
    lines = anomalies.report_text(rep).where(F.col("usage_date") == F.lit("2024-01-10").cast("date")).first().line
    assert lines == "W | 2024-01-10 | 1.0 | 1.0 | 0.0 | -0.2 | true"
    pages = sorted(anomalies.report_pages(rep, page_lines=4).collect())
    assert [(p.page, p.n_lines) for p in pages] == [(1, 4), (2, 4), (3, 4), (4, 3)]
    body = [p.body.split("\n") for p in pages]
    assert all(b[0].startswith("warehouse_name | usage_date") for b in body)
    text = [x for b in body for x in b[1:]]
    assert text == [r.line for r in anomalies.report_text(rep).orderBy("usage_date").collect()] and text[7] == lines
    assert anomalies.report_pages(rep.where("not is_anomaly")).count() == 0  # nothing to send without an anomaly
    assert anomalies.report_pages(rep.where("false")).count() == 0


def test_source_probe(spark):
    from pyspark.sql import types as T

    from spendwatch.plans.catalog import REGISTRY

    from .conftest import SF
    rows = REGISTRY["source_check"](spark, SF).collect()
    assert rows and all(r.present and r.type_ok and r.n_rows > 0 for r in rows)
    lost = spark.read.parquet(f"{SF}/events.parquet").drop("value").withColumn("user_id", F.lit("x"))
    got = {r.column_name: (r.present, r.type_ok) for r in
           checks.check_sources({"events": (lost, {"value": "double", "user_id": "bigint", "ts": "timestamp_ntz"})}).collect()}
    assert got == {"value": (False, False), "user_id": (True, False), "ts": (True, True)}
    bad = spark.createDataFrame([(1,)], "warehouse_name int")
    want = T.StructType([T.StructField("warehouse_name", T.StringType()), T.StructField("credits_used", T.DoubleType())])
    got = {r.column_name: (r.present, r.type_ok) for r in checks.check_source(spark, "x", bad, want).collect()}
    assert got == {"warehouse_name": (True, False), "credits_used": (False, False)}


def day_rows(spark, days):
    return spark.createDataFrame([(f"W{i}", D(2024, 1, d)) for i, d in enumerate(days)], "warehouse_name string, ds date").selectExpr(
        "warehouse_name", "cast(1 as decimal(38,9)) as warehouse_credits", "cast(1 as decimal(38,0)) as total_time_elapsed",
        "cast(2 as decimal(38,9)) as effective_rate", "ds")


def loaded(spark, path):
    return sorted((r.ds.day, r.warehouse_name) for r in tables.read_table(spark, path, schemas.WAREHOUSE_CREDITS).collect())


def test_a_row_of_another_day_fails_the_load(spark):
    path = tables.scratch_path(spark, "foreign")
    s = schemas.WAREHOUSE_CREDITS
    tables.load_partitions(day_rows(spark, [1, 1]), path, s, "ds", ["2024-01-01"])
    for days, want in (([1, 2], ["2024-01-01"]), ([1, 2, 3], ["2024-01-01", "2024-01-02"])):
        with pytest.raises(Exception, match="row"):
            tables.load_partitions(day_rows(spark, days), path, s, "ds", want)
    with pytest.raises(Exception, match="row"):
        tables.load_partitions(day_rows(spark, [1]).withColumn("ds", F.lit(None).cast("date")), path, s, "ds", ["2024-01-01"])
    assert loaded(spark, path) == [(1, "W0"), (1, "W1")]
    tables.load_partitions(day_rows(spark, []), path, s, "ds", ["2024-01-01"])
    assert loaded(spark, path) == []


def test_overlapping_loads_of_different_days(spark):
    """A slow load that fails half-way shows nothing, while other days load beside it."""
    from concurrent.futures import ThreadPoolExecutor
    path, s = tables.scratch_path(spark, "overlap"), schemas.WAREHOUSE_CREDITS
    slow = day_rows(spark, [1] * 4).repartition(4, "warehouse_name").withColumn("warehouse_credits", F.expr(
        "case when warehouse_name = 'W3' then cast(raise_error(concat('lost ', cast(reflect('java.lang.Thread', 'activeCount') as string))) as decimal(38,9)) else warehouse_credits end"))
    with ThreadPoolExecutor(5) as pool:
        bad = pool.submit(tables.load_partitions, slow, path, s, "ds", ["2024-01-01"])
        good = [pool.submit(tables.load_partitions, day_rows(spark, [d]), path, s, "ds", [f"2024-01-0{d}"]) for d in (2, 3, 4, 5)]
        [g.result() for g in good]
        with pytest.raises(Exception):
            bad.result()
    assert [d for d, _ in loaded(spark, path)] == [2, 3, 4, 5]


def test_backfill_equals_day_loads(spark):
    a, b, s = tables.scratch_path(spark, "bulk"), tables.scratch_path(spark, "days"), schemas.WAREHOUSE_CREDITS
    rows = day_rows(spark, [1, 2, 2, 3])
    tables.backfill(rows, a, s, "ds")
    tables.load_partitions(rows, b, s, "ds", ["2024-01-01", "2024-01-02", "2024-01-03"])
    assert loaded(spark, a) == loaded(spark, b) and len(loaded(spark, a)) == 4


def test_a_long_load_is_one_job_and_one_commit(spark):
    """400 days: one write, one new manifest, and nothing visible of a load that fails in between."""
    path, s = tables.scratch_path(spark, "long"), schemas.WAREHOUSE_CREDITS
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    df = spark.createDataFrame([(f"W{i % 3}", d) for i, d in enumerate(days)], "warehouse_name string, ds date").selectExpr(
        "warehouse_name", "cast(1 as decimal(38,9)) as warehouse_credits", "cast(1 as decimal(38,0)) as total_time_elapsed",
        "cast(2 as decimal(38,9)) as effective_rate", "ds")
    tables.load_partitions(df, path, s, "ds", days)
    snap = manifest.snapshot(spark, path)
    assert snap.version == 1 and len(snap.values()) == 400 and len(set(snap.batches.values())) == 1
    assert tables.read_table(spark, path, s).count() == 400

    # the process dies between the write and the commit: the files lie there, every day is as it was
    twice = df.unionAll(df)
    batch = manifest.write_batch({manifest.DATA: (twice, s)}, path, "ds", days)
    assert tables.read_table(spark, path, s).count() == 400 and manifest.snapshot(spark, path) == snap
    assert manifest.vacuum(spark, path, older_than_s=3_600) == 0      # too young: its load may still run
    assert manifest.vacuum(spark, path, older_than_s=-1) == 1
    assert tables.read_table(spark, path, s).count() == 400
    del batch

    # a commit that fails takes its files along and changes nothing
    before = manifest._create_version
    try:
        manifest._create_version = lambda *a: (_ for _ in ()).throw(OSError("store is gone"))
        with pytest.raises(OSError, match="store is gone"):
            tables.load_partitions(twice, path, s, "ds", days)
    finally:
        manifest._create_version = before
    assert tables.read_table(spark, path, s).count() == 400 and manifest.vacuum(spark, path, older_than_s=-1) == 0

    # a reader that holds a version still reads it after later loads
    tables.load_partitions(df.where("false"), path, s, "ds", days[:10])
    assert tables.read_table(spark, path, s).count() == 390
    assert tables.read_table(spark, path, s, at=snap).count() == 400
    assert tables.last_value(spark, path) == str(days[-1])


def test_two_loads_of_one_day_never_mix(spark):
    from concurrent.futures import ThreadPoolExecutor
    path, s = tables.scratch_path(spark, "race"), schemas.WAREHOUSE_CREDITS
    loads = [day_rows(spark, [1] * n).withColumn("warehouse_credits", F.lit(n).cast("decimal(38,9)")) for n in (2, 3, 4, 5)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: tables.load_partitions(df, path, s, "ds", ["2024-01-01"]), loads))
    rows = tables.read_table(spark, path, s).collect()
    assert len({r.warehouse_credits for r in rows}) == 1 and len(rows) == rows[0].warehouse_credits
    assert manifest.snapshot(spark, path).version == 4


def test_a_lost_race_for_a_version_is_retried(spark, monkeypatch):
    """Another writer takes the next version first: its days stay, ours are added to them."""
    path, s = tables.scratch_path(spark, "lost"), schemas.WAREHOUSE_CREDITS
    tables.load_partitions(day_rows(spark, [1]), path, s, "ds", ["2024-01-01"])
    real, first = manifest._create_version, []

    def raced(sp, p, snap):
        if not first:
            first.append(1)
            other = manifest.write_batch({manifest.DATA: (day_rows(spark, [2]), s)}, path, "ds", ["2024-01-02"])
            assert real(sp, p, manifest.Snapshot(snap.version, "ds", {**manifest.snapshot(sp, p).batches, **other.change},
                                                 {**manifest.snapshot(sp, p).sizes, other.change["2024-01-02"]: 1}))
        return real(sp, p, snap)

    monkeypatch.setattr(manifest, "_create_version", raced)
    tables.load_partitions(day_rows(spark, [3]), path, s, "ds", ["2024-01-03"])
    assert [d for d, _ in loaded(spark, path)] == [1, 2, 3] and manifest.snapshot(spark, path).version == 3


def test_a_repeated_append_adds_nothing(spark):
    path, s = tables.scratch_path(spark, "append"), schemas.WAREHOUSE_CREDITS
    assert tables.append_batch(day_rows(spark, [1, 1]), path, s, "ds", "2024-01-01")
    assert not tables.append_batch(day_rows(spark, [1, 1, 1]), path, s, "ds", "2024-01-01")
    assert tables.append_batch(day_rows(spark, [2]), path, s, "ds", "2024-01-02")
    assert loaded(spark, path) == [(1, "W0"), (1, "W1"), (2, "W0")]


def test_versions_are_replaced_not_repeated(spark):
    path, s = tables.scratch_path(spark, "versions"), schemas._s(("x", schemas.T.LongType()), ("model_version", schemas.T.LongType()))
    assert tables.next_version(spark, path) == 1
    one = spark.range(3).selectExpr("id as x")
    for v in (1, 2, 2):
        tables.replace_partition(one, path, s, "model_version", v)
    assert tables.next_version(spark, path) == 3
    back = tables.read_table(spark, path, s)
    assert sorted((r.model_version, r.x) for r in back.collect()) == [(v, i) for v in (1, 2) for i in range(3)]


def test_alert_gate(spark):
    none = spark.createDataFrame([], "warehouse_name string, usage_date date, score double")
    g = anomalies.alert_gate(none).first()
    assert (g.n_anomalies, g.send_alert) == (0, False)
    one = spark.createDataFrame([("W", D(2024, 1, 1), -0.3)], "warehouse_name string, usage_date date, score double")
    g = anomalies.alert_gate(one).first()
    assert (g.n_anomalies, g.send_alert) == (1, True)


def test_t14_report_keeps_service_type_rows(spark):
    raw = spark.createDataFrame([("W", D(2024, 1, 5), 1.0, 1.0, 0.0), ("W", D(2024, 1, 5), 2.0, 2.0, 0.0)],
                                "warehouse_name string, usage_date date, credits_used double, "
                                "credits_used_compute double, credits_used_cloud_services double")
    found = spark.createDataFrame([("W", D(2024, 1, 5), -0.2)], "warehouse_name string, usage_date date, score double")
    rep = anomalies.anomaly_report(raw, found).collect()
    assert len(rep) == 2 and all(r.is_anomaly for r in rep)
