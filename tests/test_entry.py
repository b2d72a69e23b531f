import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402

from .conftest import SF  # noqa: E402

FAST = ["calendar", "ingest_metering", "metering_metrics", "query_history", "warehouse_credits", "dag_cost",
        "dag_cost_warnings", "storage_cost", "cost_by_year", "usage_by_year", "seasonal_two_sided",
        "usage_drift_stat", "usage_drift", "drift_share", "daily_pivot", "metering_metrics_long", "model_reload",
        "prediction_reload", "query_history_reload", "warehouse_credits_reload", "dag_cost_delta_by_warehouse",
        "source_check", "anomaly_report_text"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "credits_used_sma30" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_match_at_sf0001(spark):
    import check_oracle as C
    con = C.duck(SF)
    qs, orc = E.queries(), E.oracle_sql()
    for name in FAST:
        sdf = qs[name](spark, SF)
        con.execute(f"CREATE OR REPLACE VIEW o0 AS {orc[name]}")   # as a view: the text must stand alone
        rel = con.sql("SELECT * FROM o0")
        cols, dcols = sdf.columns, rel.columns
        assert sorted(cols) == sorted(dcols), name
        si = sorted(range(len(cols)), key=lambda i: cols[i])
        di = sorted(range(len(dcols)), key=lambda i: dcols[i])
        s_rows = [tuple(r[i] for i in si) for r in sdf.collect()]
        d_rows = [tuple(r[i] for i in di) for r in rel.fetchall()]
        assert C._digest(s_rows)[0] == C._digest(d_rows)[0], name
