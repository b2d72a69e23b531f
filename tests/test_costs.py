import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendwatch import schemas
from spendwatch.operators import costs

from .conftest import SF

D = dt.date


def _queries(spark, rows):
    cols = ["query_id", "warehouse_name", "end_time", "total_elapsed_time", "queued_overload_time", "query_tag"]
    df = spark.createDataFrame(rows, "query_id string, warehouse_name string, end_time timestamp_ntz, "
                                     "total_elapsed_time long, queued_overload_time long, query_tag string")
    return schemas.conform(df.select(*cols, F.col("end_time").alias("start_time")), schemas.SRC_QUERY_HISTORY,
                           tuple(c for c in schemas.SRC_QUERY_HISTORY.fieldNames() if c not in [*cols, "start_time"]))


def test_t4_rank_nulls_first_t5_zero_elapsed(spark):
    t = dt.datetime(2024, 1, 1, 12)
    q = _queries(spark, [("a", "W", t, None, 1, None), ("b", "W", t, 5, 1, None), ("c", "W", t, 9, 1, None),
                         ("d", "W", t, 0, 1, None)])
    out = {r.query_id: r for r in costs.load_query_history(q, "2024-01-01").collect()}
    assert [out[k].query_time_rank for k in "abcd"] == [1, 3, 2, 4]
    assert out["d"].queued_pct is None and out["a"].queued_pct is None
    assert out["b"].queued_pct == 0.2


def test_query_tag_parsing(spark):
    t = dt.datetime(2024, 1, 1, 12)
    tag = '{"dag_id": "d", "task_id": 7, "logical_date": "2024-01-01T00:00:00", "started": "bad"}'
    q = _queries(spark, [("a", "W", t, 1, 0, tag), ("b", "W", t, 1, 0, "not json"), ("c", "W", t, 1, 0, None)])
    out = {r.query_id: r for r in costs.load_query_history(q).collect()}
    assert out["a"].airflow_dag_id == "d" and out["a"].airflow_task_id == "7"
    assert out["a"].airflow_logical_date == dt.datetime(2024, 1, 1) and out["a"].airflow_started is None
    assert out["b"].airflow_dag_id is None and out["c"].airflow_dag_id is None


def _cost(spark, rows):
    return spark.createDataFrame(
        [(d, "dag", t, w, Decimal(c), Decimal(c)) for d, t, w, c in rows],
        "ds date, airflow_dag_id string, airflow_task_id string, warehouse_name string, "
        "task_dollar_cost decimal(38,6), task_credit_cost decimal(38,6)")


def test_t8_fan_out(spark):
    last = D(2024, 1, 30)
    y = last - dt.timedelta(days=1)
    c = _cost(spark, [(last, "t", "W1", 10), (last, "t", "W2", 10), (y, "t", "W1", 5), (y, "t", "W2", 5)])
    assert costs.dag_cost_delta(c).count() == 8
    assert costs.dag_cost_delta(c, by_warehouse=True).count() == 2


def test_t7_null_task_only_last_day(spark):
    last = D(2024, 1, 30)
    c = _cost(spark, [(last, None, "W1", 10), (last - dt.timedelta(days=1), None, "W1", 5),
                      (last, "t", "W1", 1)])
    out = costs.dag_cost_delta(c).collect()
    nulls = [r for r in out if r.airflow_task_id is None]
    assert len(nulls) == 1 and nulls[0].ds == last and nulls[0].task_dollar_cost_yesterday is None


def _warn(spark, a, b, c):
    last = D(2024, 1, 30)
    rows = [(last - dt.timedelta(days=2), "t", "W", a), (last - dt.timedelta(days=1), "t", "W", b), (last, "t", "W", c)]
    return costs.dag_cost_warnings(costs.dag_cost_delta(_cost(spark, rows))).collect()


def test_j16_warnings(spark):
    assert _warn(spark, 60, 30, 60) == []  # rebound after yesterday's drop: suppressed
    shown = _warn(spark, 30, 60, 120)  # two increases in a row: shown
    assert len(shown) == 1 and shown[0].trigger_period == "yesterday" and shown[0].change_type == "increase"
    assert shown[0].yesterday_warn_change_type == "increase"
    assert _warn(spark, 150, 150, 180) == []  # +30 dollars but +20 %: not listed


def test_cost_shares_sum_to_one(spark):
    from spendwatch.plans.catalog import q_dag_cost
    dc = q_dag_cost(spark, SF)
    sums = (dc.groupBy("warehouse_name", "ds")
            .agg(F.sum("warehouse_pct").alias("s"), F.count("*").alias("n"),
                 F.count("total_elapsed_time").alias("nn"))
            .where("n = nn").collect())
    assert sums
    for r in sums:
        assert abs(float(r.s) - 1.0) <= 1e-6 * r.n + 1e-9


def test_cost_categories_first_match(spark):
    df = spark.createDataFrame([(u,) for u in ("overage-storage", "compute", "snowpipe streaming",
                                               "priority support", "adjustment", "serverless tasks")],
                               "usage_type string")
    for c in schemas.SRC_CURRENCY.fieldNames():
        if c != "usage_type":
            df = df.withColumn(c, F.lit(None).cast(schemas.SRC_CURRENCY[c].dataType))
    out = {r.usage_type: (r.rating_type, r.resource_type) for r in costs.cost_categories(df).collect()}
    assert out["overage-storage"] == ("storage", "storage")
    assert out["compute"] == ("compute", "virtual warehouse")
    assert out["snowpipe streaming"] == ("compute", "serverless")
    assert out["priority support"] == ("other", "other")
    assert out["adjustment"] == ("", "")
    assert out["serverless tasks"] == ("compute", "serverless")


def test_n7_delta_null_after_missing_day(spark):
    c = spark.createDataFrame([("W", Decimal("5"), D(2024, 1, d)) for d in (1, 2, 4)] + [("W", Decimal("8"), D(2024, 1, 5))],
                              "warehouse_name string, warehouse_credits decimal(38,9), ds date")
    out = {r.ds.day: r.warehouse_credits_delta_yesterday for r in costs.warehouse_credits_delta(c).collect()}
    assert out[1] is None and out[2] == 0 and out[4] is None and out[5] == 3


def test_storage_cost_arithmetic_and_account(spark):
    st = spark.createDataFrame([(D(2024, 1, 1), 7, "DB", float(2 * 1024 ** 4))],
                               "usage_date date, database_id long, database_name string, average_database_bytes double")
    rates = spark.createDataFrame([(D(2024, 1, 1), "ACME", "storage", Decimal("23")),
                                   (D(2024, 1, 1), "OTHER", "storage", Decimal("40")),
                                   (D(2024, 1, 1), "ACME", "compute", Decimal("3"))],
                                  "date date, account_name string, usage_type string, effective_rate decimal(38,9)")
    r = costs.load_storage_cost(st, rates, "ACME", "2024-01-01").collect()
    assert len(r) == 1 and r[0].database_terabytes == 2.0 and r[0].database_storage_cost == 46.0
    assert costs.load_storage_cost(st, rates, "OTHER").first().database_storage_cost == 80.0
    assert costs.load_storage_cost(st, rates, "NOBODY").count() == 0  # the rate filter makes the join inner


def test_j14_chained_rounding(spark):
    t = dt.datetime(2024, 1, 1, 12)
    q = costs.load_query_history(_queries(spark, [("a", "W", t, 1, 0, None), ("b", "W", t, 2, 0, None)]))
    credits = spark.createDataFrame([("W", Decimal("10"), Decimal("3"), Decimal("2.5"), D(2024, 1, 1))],
                                    "warehouse_name string, warehouse_credits decimal(38,9), "
                                    "total_time_elapsed decimal(38,0), effective_rate decimal(38,9), ds date")
    out = {r.query_id: r for r in costs.dag_cost(q, credits).collect()}
    assert out["a"].warehouse_pct == Decimal("0.333333")
    assert out["a"].task_credit_cost == Decimal("3.333330")
    assert out["a"].task_dollar_cost == Decimal("8.333325")
    assert out["b"].warehouse_pct == Decimal("0.666667")  # half up


def test_j10_warehouse_credits(spark):
    t = dt.datetime(2024, 1, 1, 12)
    q = _queries(spark, [("a", "W", t, 100, 0, None), ("b", "W", t, 50, 0, None), ("c", "V", t, 7, 0, None)])
    h = lambda a, b: (dt.datetime(2024, 1, 1, a), dt.datetime(2024, 1, 1, b))
    met = spark.createDataFrame([("W", *h(1, 2), Decimal("1.5")), ("W", *h(3, 4), Decimal("2")),
                                 ("V", *h(5, 6), Decimal("4"))],
                                "warehouse_name string, start_time timestamp_ntz, end_time timestamp_ntz, "
                                "credits_used decimal(38,9)")
    rates = spark.createDataFrame([(D(2024, 1, 1), "ACME", "compute", Decimal("3"))],
                                  "date date, account_name string, usage_type string, effective_rate decimal(38,9)")
    out = {r.warehouse_name: r for r in costs.load_warehouse_credits(q, met, rates, "ACME", "2024-01-01").collect()}
    assert out["W"].warehouse_credits == Decimal("3.5") and out["W"].total_time_elapsed == 150
    assert out["V"].effective_rate == Decimal("3") and out["V"].ds == D(2024, 1, 1)
    assert costs.load_warehouse_credits(q, met, rates.limit(0), "ACME", "2024-01-01").count() == 0  # no rate row


def test_x22_zero_previous_cost_gives_null_pct(spark):
    last = D(2024, 1, 30)
    c = _cost(spark, [(last - dt.timedelta(days=1), "t", "W", 0), (last, "t", "W", 40)])
    r = costs.dag_cost_delta(c).first()
    assert r.pct_change_yesterday is None and r.dollar_delta_yesterday == 40
    assert costs.dag_cost_warnings(costs.dag_cost_delta(c)).count() == 0  # no percent, no warning


def test_t16_rate_change_alone_does_not_warn(spark):
    last = D(2024, 1, 30)
    rows = [(last - dt.timedelta(days=1), "dag", "t", "W", Decimal("50"), Decimal("10")),
            (last, "dag", "t", "W", Decimal("150"), Decimal("10"))]  # same credits, dollars tripled by the rate
    c = spark.createDataFrame(rows, "ds date, airflow_dag_id string, airflow_task_id string, warehouse_name string, "
                                    "task_dollar_cost decimal(38,6), task_credit_cost decimal(38,6)")
    d = costs.dag_cost_delta(c).first()
    assert d.dollar_delta_yesterday == 100 and d.pct_change_yesterday == 0.0
    assert costs.dag_cost_warnings(costs.dag_cost_delta(c)).count() == 0


def test_j17_account_and_date_range(spark):
    rows = [("ACME", D(2020, 5, 31)), ("ACME", D(2020, 6, 1)), ("ACME", D(2023, 12, 31)), ("OTHER", D(2021, 1, 1))]
    df = spark.createDataFrame([(a, d, "compute", Decimal("1.00")) for a, d in rows],
                               "account_name string, usage_date date, usage_type string, usage_in_currency decimal(38,2)")
    for c in schemas.SRC_CURRENCY.fieldNames():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(schemas.SRC_CURRENCY[c].dataType))
    got = costs.cost_categories(df, "ACME", "2020-06-01", "2023-12-31").collect()
    assert sorted(r.usage_date for r in got) == [D(2020, 6, 1), D(2023, 12, 31)]
