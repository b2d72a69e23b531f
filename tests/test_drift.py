import datetime as dt
import itertools
import math

import numpy as np

from spendwatch.operators import drift

D = dt.date


def ks_d(a, b):
    vals = sorted(set(a) | set(b))
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in vals)


def brute_p(m, n, d):
    hits = total = 0
    for pos in itertools.combinations(range(m + n), m):
        s = set(pos)
        a = [i for i in range(m + n) if i in s]
        b = [i for i in range(m + n) if i not in s]
        total += 1
        hits += ks_d(a, b) >= d - 1e-12
    return hits / total


def exact(spark, cases):
    df = spark.createDataFrame(cases, "n_reference long, n_current long, ks_d double")
    return {(r.n_reference, r.n_current, r.ks_d): r.p_value for r in drift.exact_p(df).collect()}


def test_exact_p_against_enumeration(spark):
    assert abs(exact(spark, [(2, 2, 1.0)])[2, 2, 1.0] - 1 / 3) < 1e-12
    cases = [(m, n, d) for m, n in [(5, 3), (6, 4), (4, 4), (7, 2)]
             for d in sorted({round(abs(i / m - j / n), 12) for i in range(m + 1) for j in range(n + 1)} - {0.0})]
    got = exact(spark, cases + [(5, 3, None), (5, 3, 0.0)] + cases[:3])
    assert all(abs(got[case] - brute_p(*case)) < 1e-9 for case in cases)
    assert got[5, 3, None] is None and got[5, 3, 0.0] == 1.0


def test_exact_p_needs_no_python_worker(spark):
    df = spark.createDataFrame([("W", D(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(60)],
                               "warehouse_name string, usage_date date, credits_used double")
    plan = drift.usage_drift(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ks_statistic_and_drift(spark):
    rng = np.random.default_rng(1)
    base = list(rng.normal(10, 1, 30))
    rows = [("steady", D(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(base)]
    rows += [("jump", D(2024, 1, 1) + dt.timedelta(days=i), float(v + (50 if i >= 22 else 0)))
             for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, credits_used double")
    out = {r.warehouse_name: r for r in drift.usage_drift(df).collect()}
    assert out["jump"].n_reference == 22 and out["jump"].n_current == 8
    assert out["jump"].ks_d == 1.0 and out["jump"].drift_detected
    want = float(ks_d(base[:22], base[22:]))
    assert abs(out["steady"].ks_d - want) < 1e-12
    assert abs(out["steady"].p_value - exact(spark, [(22, 8, want)])[22, 8, want]) < 1e-12
    share = drift.drift_share(drift.usage_drift(df)).first()
    assert share.n_columns == 2 and share.n_drifted >= 1


def test_exact_p_symmetric_and_monotone(spark):
    for m, n in [(8, 22), (5, 12), (30, 8)]:
        ds = sorted({round(abs(i / m - j / n), 12) for i in range(m + 1) for j in range(n + 1)} - {0.0})
        one, other = exact(spark, [(m, n, d) for d in ds]), exact(spark, [(n, m, d) for d in ds])
        ps = [one[m, n, d] for d in ds]
        assert all(abs(p - other[n, m, d]) < 1e-12 for p, d in zip(ps, ds))
        assert all(a >= b - 1e-15 for a, b in zip(ps, ps[1:]))  # larger D, smaller p


def test_short_history_and_stopped_warehouse(spark):
    """Eight days are one window and nothing before it; a stopped warehouse has no current side."""
    rows = [("old", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, credits_used double")
    r = drift.usage_drift(df).first()
    assert (r.n_reference, r.n_current, r.ks_d, r.p_value, r.drift_detected) == (0, 8, None, None, None)
    rows = [("on", D(2024, 1, 1) + dt.timedelta(days=i), float(i % 5)) for i in range(40)]
    rows += [("off", D(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, credits_used double")
    for exact in (True, False):
        got = {r.warehouse_name: r for r in drift.usage_drift(df, exact=exact).collect()}
        assert got["off"].ks_d is None and got["off"].p_value is None and got["on"].p_value > 0.5
        share = drift.drift_share(drift.usage_drift(df, exact=exact)).first()
        assert (share.n_columns, share.n_drifted) == (2, 0)


def test_limit_of_small_distances(spark):
    """D = 0.001 with 500 and 500 values: the limiting p-value is 1."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(500, 500, d) for d in (0.0, 0.001, 0.012, 0.013, 0.05, 0.1)], "n_reference long, n_current long, ks_d double")
    got = [r[0] for r in df.orderBy("ks_d").select(drift.asymptotic_p()).collect()]
    def limit(lam):
        return 1 - math.sqrt(2 * math.pi) / lam * sum(math.exp(-((2 * k - 1) * math.pi / lam) ** 2 / 8) for k in range(1, 200))
    want = [1.0] + [limit(d * math.sqrt(250)) for d in (0.001, 0.012, 0.013, 0.05, 0.1)]
    assert got == [__import__("pytest").approx(w, abs=1e-9) for w in want]
