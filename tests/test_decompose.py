import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwatch.operators import decompose

D = dt.date


def classical(x, period=7, two_sided=True):
    """Plain loop of the classical additive decomposition (reference algorithm)."""
    x = np.asarray(x, dtype=float)
    n, h = len(x), period // 2
    trend = np.full(n, np.nan)
    if two_sided:
        for i in range(h, n - h):
            trend[i] = x[i - h:i + h + 1].mean()
    else:
        for i in range(period - 1, n):
            trend[i] = x[i - period + 1:i + 1].mean()
    ok = np.where(~np.isnan(trend))[0]
    front, back = ok[0], ok[-1]
    fl = min(front + period, back)
    k, c = np.polyfit(np.arange(front, fl), trend[front:fl], 1)
    trend[:front] = k * np.arange(0, front) + c
    bf = max(front, back - period)
    k, c = np.polyfit(np.arange(bf, back), trend[bf:back], 1)
    trend[back + 1:] = k * np.arange(back + 1, n) + c
    det = x - trend
    pm = np.array([det[p::period].mean() for p in range(period)])
    pm -= pm.mean()
    seasonal = pm[np.arange(n) % period]
    return trend, seasonal, det - seasonal


def _frame(spark, series):
    rows = []
    for key, xs in series.items():
        for i, v in enumerate(xs):
            rows.append((key, D(2024, 1, 1) + dt.timedelta(days=i), float(v)))
    return spark.createDataFrame(rows, "warehouse_name string, usage_date date, credits_used double")


@pytest.mark.parametrize("two_sided", [True, False])
def test_matches_plain_loop(spark, two_sided):
    rng = np.random.default_rng(7)
    series = {"A": rng.gamma(2.0, 10.0, 40) + 5 * np.sin(np.arange(40)), "B": rng.normal(100, 5, 21)}
    out = decompose.seasonal_features(_frame(spark, series), two_sided=two_sided).collect()
    for key, xs in series.items():
        t, s, r = classical(xs, two_sided=two_sided)
        got = sorted([o for o in out if o.warehouse_name == key], key=lambda o: o.usage_date)
        assert len(got) == len(xs)
        for i, o in enumerate(got):
            assert math.isclose(o.trend, t[i], abs_tol=1e-8)
            assert math.isclose(o.seasonal, s[i], abs_tol=1e-8)
            assert math.isclose(o.residual, r[i], abs_tol=1e-8)
            assert math.isclose(o.trend + o.seasonal + o.residual, xs[i], abs_tol=1e-8)


def test_short_series_skipped_and_gaps_filled(spark):
    series = {"S13": np.ones(13), "S14": np.arange(14.0)}
    df = _frame(spark, series)
    # drop one middle day of S14: it is filled with 0, so the series keeps 14 days
    df = df.where("not (warehouse_name = 'S14' and usage_date = date'2024-01-05')")
    out = decompose.seasonal_features(df).collect()
    assert {o.warehouse_name for o in out} == {"S14"}
    assert len(out) == 14
    assert [o.warehouse_name for o in decompose.skipped_series(df).collect()] == ["S13"]
    by_day = {o.usage_date: o for o in out}
    assert float(by_day[D(2024, 1, 5)].credits_used) == 0.0
    week = sum(o.seasonal for o in sorted(out, key=lambda o: o.usage_date)[:7])
    assert abs(week) < 1e-9


@pytest.mark.parametrize("two_sided", [True, False])
def test_random_lengths_and_gaps(spark, two_sided):
    rng = np.random.default_rng(5)
    series = {f"S{n}": rng.gamma(3.0, 20.0, n) for n in (14, 15, 21, 33, 60)}
    for xs in series.values():
        xs[len(xs) // 2] = 0.0  # this day is dropped below and must come back as a zero
    df = _frame(spark, series)
    gaps = [(k, D(2024, 1, 1) + dt.timedelta(days=len(xs) // 2)) for k, xs in series.items()]
    for k, d in gaps:
        df = df.where(~((F.col("warehouse_name") == k) & (F.col("usage_date") == F.lit(d))))
    out = decompose.seasonal_features(df, two_sided=two_sided).collect()
    for key, xs in series.items():
        t, s, r = classical(xs, two_sided=two_sided)
        got = sorted([o for o in out if o.warehouse_name == key], key=lambda o: o.usage_date)
        assert len(got) == len(xs), key
        for i, o in enumerate(got):
            assert math.isclose(o.trend, t[i], rel_tol=1e-9, abs_tol=1e-7)
            assert math.isclose(o.residual, r[i], rel_tol=1e-9, abs_tol=1e-7)
