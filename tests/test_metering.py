import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendwatch import schemas
from spendwatch.operators import calendar as cal
from spendwatch.operators import checks, metering
from spendwatch.sources import tables

D = dt.date


def _src(spark, rows):
    cols = ["account_name", "service_type", "start_time", "end_time", "warehouse_id", "warehouse_name",
            "credits_used", "credits_used_compute", "credits_used_cloud_services"]
    df = spark.createDataFrame(rows, cols)
    return schemas.conform(df, schemas.SRC_METERING, ("organization_name", "region", "account_locator"))


def test_calendar_parts(spark):
    c = cal.build_calendar(spark, "2024-01-01", days=10).collect()
    assert len(c) == 10
    r = {x.usage_date: x for x in c}
    assert r[D(2024, 1, 7)].day_of_week == "0"  # Sunday is 0
    assert r[D(2024, 1, 1)].day_of_week == "1"
    assert r[D(2024, 1, 1)].month_name == "Jan"
    assert r[D(2024, 1, 1)].week_of_year == 1
    assert r[D(2024, 1, 10)].day_of_year == 10


def test_t2_hour_ending_at_midnight(spark):
    """Ingestion puts the 23:00-24:00 hour on the next day; credits put it on no day."""
    hour = (dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 0))
    src = _src(spark, [("ACME", "WAREHOUSE_METERING", *hour, 5, "WH", Decimal("2"), Decimal("2"), Decimal("0"))])
    raw = metering.ingest_metering(src, "ACME").collect()
    assert [r.usage_date for r in raw] == [D(2024, 1, 2)]
    from spendwatch.operators import costs
    q = spark.createDataFrame([("WH", dt.datetime(2024, 1, 1, 10), 100)], "warehouse_name string, end_time timestamp_ntz, total_elapsed_time long")
    rates = spark.createDataFrame([(D(2024, 1, 1), "ACME", "compute", Decimal("2")),
                                   (D(2024, 1, 2), "ACME", "compute", Decimal("2"))],
                                  "date date, account_name string, usage_type string, effective_rate decimal(38,9)")
    for ds in ("2024-01-01", "2024-01-02"):
        assert costs.load_warehouse_credits(q, src, rates, "ACME", ds).count() == 0


def test_ingest_filters_pseudo_warehouses_and_account(spark):
    t = (dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 2))
    src = _src(spark, [
        ("ACME", "W", *t, 0, "CLOUD_SERVICES_ONLY", Decimal("1"), Decimal("1"), Decimal("0")),
        ("OTHER", "W", *t, 3, "WH", Decimal("1"), Decimal("1"), Decimal("0")),
        ("ACME", "W", *t, 3, "WH", Decimal("1.5"), Decimal("1"), Decimal("0.5")),
        ("ACME", "W", *t, 3, "WH", Decimal("2.5"), Decimal("2"), Decimal("0.5")),
    ])
    rows = metering.ingest_metering(src, "ACME", ds="2024-01-01").collect()
    assert len(rows) == 1 and rows[0].credits_used == Decimal("4.000000000") and rows[0].ds == D(2024, 1, 1)


def test_t1_reload_empties_day(spark):
    t = lambda d: (dt.datetime(2024, 1, d, 1), dt.datetime(2024, 1, d, 2))
    src = _src(spark, [("ACME", "W", *t(1), 3, "WH", Decimal("1"), Decimal("1"), Decimal("0")),
                       ("ACME", "W", *t(1), 4, "WH2", Decimal("1"), Decimal("1"), Decimal("0")),
                       ("ACME", "W", *t(2), 3, "WH", Decimal("1"), Decimal("1"), Decimal("0"))])
    path = tables.scratch_path(spark, "t1")
    raw = metering.ingest_metering(src, "ACME")
    for _ in range(2):  # load twice = load once
        tables.load_partitions(raw, path, schemas.RAW_METERING, "usage_date", ["2024-01-01", "2024-01-02"])
    assert tables.read_table(spark, path, schemas.RAW_METERING).count() == 3
    empty = metering.ingest_metering(src.limit(0), "ACME", ds="2024-01-01")
    tables.load_partitions(empty, path, schemas.RAW_METERING, "usage_date", ["2024-01-01"])
    back = tables.read_table(spark, path, schemas.RAW_METERING).collect()
    assert [r.usage_date for r in back] == [D(2024, 1, 2)]


def test_t3_missing_dates(spark):
    def raw(days):
        return spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=i),) for i in days], "usage_date date")
    got = [checks.count_missing_dates(raw(d), "2024-01-01", "2024-01-11").first().missing_dates
           for d in (range(11), [i for i in range(11) if i != 5], [i for i in range(11) if i not in (5, 6)])]
    assert got == [-1, 0, 1]
    lst = checks.missing_dates_list(raw([i for i in range(11) if i != 5]), "2024-01-01", "2024-01-11").collect()
    assert [r.usage_date for r in lst] == [D(2024, 1, 6)]


def test_metrics_grid_t13_w4(spark):
    rows = [("ACME", "W", D(2024, 1, 1) + dt.timedelta(days=i), "A", Decimal(i), Decimal(i), Decimal(0),
             D(2024, 1, 1)) for i in range(30)]
    rows += [("ACME", "W", D(2024, 1, 20) + dt.timedelta(days=i), "B", Decimal(1), Decimal(1), Decimal(0),
              D(2024, 1, 1)) for i in range(11)]
    raw = schemas.conform(spark.createDataFrame(rows, schemas.RAW_METERING.fieldNames()), schemas.RAW_METERING)
    c = cal.build_calendar(spark, "2024-01-01", 60)
    m = metering.metering_metrics(raw, c, "2024-01-30").orderBy("warehouse_name", "usage_date").collect()
    assert len(m) == 2 * 30  # warehouses x days
    b = [r for r in m if r.warehouse_name == "B"]
    assert all(r.credits_used == 0 for r in b[:19])  # 19 leading zeros
    assert m[0].credits_used_std30 is None  # one row: no sample std
    a = [r for r in m if r.warehouse_name == "A"]
    assert abs(float(a[29].credits_used_sma30) - sum(range(30)) / 30) < 1e-9


def test_weekly_labels_by_sunday(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 7), 1), ("A", D(2024, 1, 8), 2), ("A", D(2024, 1, 14), 3)],
                               "warehouse_name string, usage_date date, credits_used int")
    out = {r.usage_date: r.credits_used for r in metering.weekly_usage(df).collect()}
    assert out == {D(2024, 1, 7): 1, D(2024, 1, 14): 5}


def test_fill_daily_gaps(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("B", D(2024, 1, 3), 2), (None, D(2024, 1, 5), 9)],
                               "warehouse_name string, usage_date date, credits_used int")
    out = cal.fill_daily_gaps(df).collect()
    assert len(out) == 2 * 5
    assert sum(r.credits_used for r in out) == 3


def test_usage_by_year_pivot_fills_zero(spark):
    df = spark.createDataFrame([("A", D(2023, 5, 1), Decimal("2")), ("A", D(2024, 1, 1), Decimal("3")),
                                ("B", D(2024, 2, 1), Decimal("4")), (None, D(2024, 2, 1), Decimal("9"))],
                               "warehouse_name string, usage_date date, credits_used decimal(38,9)")
    out = {r.year: r for r in metering.usage_by_year(df, ["A", "B"]).collect()}
    assert sorted(out) == [2023, 2024] and set(metering.usage_by_year(df, ["A", "B"]).columns) == {"year", "A", "B"}
    assert out[2023].B == 0 and out[2024].A == 3 and out[2024].B == 4  # no row for B in 2023: 0, NULL name dropped


def test_backfill_equals_daily_loads(spark):
    from spendwatch.sources.adapters import source

    from .conftest import SF
    src = source(spark, SF, "metering_src")
    back = metering.ingest_metering(src, "ACME")
    for d in ("2024-01-01", "2024-01-15", "2024-01-31"):  # the 31st only holds hours ending at midnight
        one = metering.ingest_metering(src, "ACME", ds=d)
        part = back.where(F.col("usage_date") == F.lit(d).cast("date"))
        assert one.count() == part.count() and one.exceptAll(part).count() == 0, d


def test_calendar_default_span(spark):
    c = cal.build_calendar(spark, "2023-01-01")
    r = c.agg(F.count("*").alias("n"), F.min("usage_date").alias("a"), F.max("usage_date").alias("b")).first()
    assert (r.n, r.a, r.b) == (1826, D(2023, 1, 1), D(2023, 1, 1) + dt.timedelta(days=1825))


def test_only_days_with_rows_are_shuffled_for_the_matrix(spark):
    """The missing days are made after the shuffles, and a warehouse without a row up to the day is all zeros."""
    raw = spark.createDataFrame(
        [("A", D(2024, 1, 2), Decimal(2)), ("A", D(2024, 1, 2), Decimal(1)), ("A", D(2024, 1, 4), None), ("B", D(2024, 1, 1), Decimal(5)),
         ("C", D(2024, 1, 9), Decimal(7)), ("C", None, Decimal(7)), ("D", D(2023, 1, 1), Decimal(7)), ("D", D(2024, 1, 5), Decimal(4)),
         (None, D(2024, 1, 3), Decimal(9))], "warehouse_name string, usage_date date, credits_used decimal(38,9)")
    raw = raw.select("*", *[F.col("credits_used").alias(m) for m in metering.MEASURES[1:]])
    got = metering.metering_metrics(raw, cal.build_calendar(spark, "2024-01-01", 30), "2024-01-05")
    rows = {w: [int(r.credits_used) for r in sorted(got.collect(), key=lambda r: r.usage_date) if r.warehouse_name == w] for w in "ABCD"}
    assert rows == {"A": [0, 3, 0, 0, 0], "B": [5, 0, 0, 0, 0], "C": [0] * 5, "D": [0, 0, 0, 0, 4]} and got.count() == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and "Union" not in plan
    assert metering.metering_metrics(raw, cal.build_calendar(spark, "2024-01-01", 0), "2024-01-05").count() == 0
