import datetime as dt
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from spendwatch.functions.seeds import tree_seed_of, tree_seeds
from spendwatch.operators import forest
from spendwatch.sources import tables

D = dt.date
GAMMA = 0.5772156649015329


def c(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + GAMMA) - 2 * (n - 1) / n


def mix(seed, node):
    m = 2 ** 31
    a = (seed * 69069 + node * 362437 + 1) % m
    b = (a * 1103515245 + 12345) % m
    return ((b * 1103515245 + 12345) % m) / m


def drawn(n, psi, tseed):
    """The positions a tree samples: 0 .. psi - 1 through the seeded permutation of 0 .. n - 1."""
    k = max(1, math.ceil(math.log2(n)))

    def step(v):
        for r in (1, 2, 3):
            v = (v * ((2 * tseed * r + 2 * r + 1) % 2 ** k) + tseed + r) % 2 ** k
            v ^= v >> ((k + 1) // 2)
        return v

    out = []
    for j in range(psi):
        v = step(j)
        while v >= n:
            v = step(v)
        out.append(v)
    return out if n > psi else list(range(n))


def brute_scores(key, dates, xs, n_trees, max_samples, seed=0):
    """Recursive isolation trees with the same seeded sampling and split draws."""
    n = len(xs)
    psi = min(n, max_samples)
    limit = math.ceil(math.log2(max(psi, 2)))
    paths = np.zeros(n)
    for tree in range(n_trees):
        ts = int(hashlib.md5(f"{seed}|{key}|{tree}".encode()).hexdigest()[:7], 16)
        leaves = []

        def grow(vals, node, depth, lo_b, hi_b):
            lo, hi = min(vals), max(vals)
            if depth < limit and len(vals) >= 2 and hi > lo + 1e-7:
                raw = lo + mix(ts, node) * (hi - lo)
                split = lo if raw >= hi else raw
                grow([v for v in vals if not v > split], 2 * node, depth + 1, lo_b, split)
                grow([v for v in vals if v > split], 2 * node + 1, depth + 1, split, hi_b)
            else:
                leaves.append((lo_b, hi_b, depth + c(len(vals))))

        grow([xs[i] for i in drawn(n, psi, ts)], 1, 0, -math.inf, math.inf)
        for i, x in enumerate(xs):
            paths[i] += next(p for lo, hi, p in leaves if lo < x <= hi)
    return 0.5 - 2 ** (-(paths / n_trees) / c(psi))


def test_scores_match_recursive_trees(spark):
    rng = np.random.default_rng(3)
    data = {"A": rng.normal(0, 1, 30), "B": np.r_[rng.normal(0, 1, 24), [8.0, -6.0]]}
    rows = [(k, D(2024, 1, 1) + dt.timedelta(days=i), float(v), float(v)) for k, xs in data.items()
            for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double")
    fit = forest.fit_forest(df, n_trees=12, max_samples=16, seed=0)
    got = {(r.warehouse_name, r.usage_date): r.score for r in fit.scores.collect()}
    for k, xs in data.items():
        dates = [str(D(2024, 1, 1) + dt.timedelta(days=i)) for i in range(len(xs))]
        want = brute_scores(k, dates, list(map(float, xs)), 12, 16)
        for i, d in enumerate(dates):
            assert abs(got[(k, D.fromisoformat(d))] - want[i]) < 1e-9
    # the two planted outliers get the lowest decision values of their series
    b = sorted((v, d) for (k, d), v in got.items() if k == "B")
    assert {d for _, d in b[:2]} == {D(2024, 1, 25), D(2024, 1, 26)}
    # model tables: scoring new rows through the merged step function = routing
    new = spark.createDataFrame([("B", D(2024, 2, 1), 8.0, 0.0, 0.0, 8.0)],
                                "warehouse_name string, usage_date date, residual double, trend double, "
                                "seasonal double, credits_used double")
    s = forest.score_rows(new, fit.segments, fit.meta).first().score
    assert abs(s - got[("B", D(2024, 1, 25))]) < 1e-9


def test_t9_training_needs_high_credits(spark):
    scores = spark.createDataFrame(
        [("W", D(2024, 1, i), float(c), -0.2 if i == 1 else 0.1, 0.0) for i, c in [(1, 1), (2, 10), (3, 10)]],
        "warehouse_name string, usage_date date, credits_used double, score double, threshold double")
    # day 1 is below the threshold but its credits are below the mean: training drops it
    assert forest.training_anomalies(scores).count() == 0
    assert scores.where("score <= threshold").count() == 1  # prediction keeps it


def test_t10_dedupe_predictions(spark):
    from spendwatch.operators import anomalies
    rows = [("W", D(2024, 1, 5), dt.datetime(2024, 1, d), 0.1) for d in (6, 7)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, prediction_datetime timestamp_ntz, "
                                     "score double")
    assert df.count() == 2
    one = anomalies.dedupe_predictions(df).collect()
    assert len(one) == 1 and one[0].prediction_datetime == dt.datetime(2024, 1, 7)


def test_step_function_boundaries(spark):
    """A value equal to a split point belongs to the left leaf (x <= split goes left)."""
    inf = float("inf")
    leaf = {"tree": np.array([1, 0, 0, 1]), "lo": np.array([0.2, -inf, 0.5, -inf])}
    points, mean = forest.merge(leaf, np.array([5.0, 1.0, 2.0, 3.0]), 2)
    assert points.tolist() == [-inf, 0.2, 0.5] and mean.tolist() == [2.0, 3.0, 3.5]
    seg = spark.createDataFrame([("W", 1, float(p), float(m)) for p, m in zip(points, mean)],
                                "warehouse_name string, model_version int, lo double, mean_path double")
    meta = spark.createDataFrame([("W", 1, 1.0, 0.0)], "warehouse_name string, model_version int, c_psi double, "
                                                       "threshold double")
    rows = spark.createDataFrame([("W", float(v)) for v in (0.1, 0.2, 0.3, 0.5, 0.7)],
                                 "warehouse_name string, residual double")
    got = {r.residual: r.score for r in forest.score_rows(rows, seg, meta).collect()}
    mean_path = {0.1: 2.0, 0.2: 2.0, 0.3: 3.0, 0.5: 3.0, 0.7: 3.5}
    for v, p in mean_path.items():
        assert abs(got[v] - (0.5 - 2 ** -p)) < 1e-12, v


def test_t10_view_latest_option(spark):
    from spendwatch.operators import anomalies
    metrics = spark.createDataFrame([("W", D(2024, 1, 5), 1.0)], "warehouse_name string, usage_date date, credits_used double")
    runs = spark.createDataFrame(
        [("W", D(2024, 1, 5), 0.0, 0.0, 0.0, -0.1 * d, dt.datetime(2024, 1, d)) for d in (6, 7)],
        "warehouse_name string, usage_date date, trend double, seasonal double, residual double, score double, "
        "prediction_datetime timestamp_ntz")
    assert anomalies.anomalies_view(metrics, runs).count() == 2  # the reference's fan-out
    one = anomalies.anomalies_view(metrics, runs, latest=True).collect()
    assert len(one) == 1 and one[0].prediction_datetime == dt.datetime(2024, 1, 7) and one[0].is_anomaly


def test_m13_latest_model_version(spark):
    inf = float("inf")
    seg = spark.createDataFrame([("W", 1, -inf, 1.0), ("W", 2, -inf, 4.0), ("V", 1, -inf, 2.0)],
                                "warehouse_name string, model_version int, lo double, mean_path double")
    meta = spark.createDataFrame([("W", 1, 1.0, 0.9), ("W", 2, 1.0, -0.9), ("V", 1, 1.0, 0.0)],
                                 "warehouse_name string, model_version int, c_psi double, threshold double")
    s, m = forest.latest_model(seg, meta)
    assert sorted((r.warehouse_name, r.model_version) for r in m.collect()) == [("V", 1), ("W", 2)]
    rows = spark.createDataFrame([("W", 0.3), ("V", 0.3)], "warehouse_name string, residual double")
    got = {r.warehouse_name: (r.score, r.threshold) for r in forest.score_rows(rows, s, m).collect()}
    assert got["W"] == (0.5 - 2 ** -4.0, -0.9) and got["V"] == (0.5 - 2 ** -2.0, 0.0)


def test_draws_are_distinct_positions():
    """On both sides of the sample size, every tree draws min(n, size) distinct rows of the series."""
    seeds = np.array([tree_seed_of(0, "e", t) for t in range(20)])
    for n in (1, 2, 255, 256, 257, 300, 512, 5000):
        got = forest.draw_positions(n, 256, seeds)
        assert got.shape == (20, min(n, 256)) and got.min() >= 0 and got.max() < n
        assert all(len(set(row)) == len(row) for row in got.tolist())
        assert all(got[t].tolist() == drawn(n, min(n, 256), int(seeds[t])) for t in range(0, 20, 7))
    # every row of a long series is drawn about equally often
    import collections
    hits = collections.Counter(p // 500 for t in range(20) for p in forest.draw_positions(5000, 256, seeds)[t])
    assert len(hits) == 10 and max(hits.values()) < 1.3 * min(hits.values())


def test_training_fills_missing_days(spark):
    rows = [("W", D(2024, 1, d), float(d), float(d)) for d in (1, 2, 5)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double")
    fit = forest.train_forest(df, "2024-02-01", n_trees=3)
    assert sorted((r.usage_date.day, r.residual) for r in fit.scores.collect()) == [(1, 1.0), (2, 2.0), (3, 0.0), (4, 0.0), (5, 5.0)]


def test_growth_has_no_window_and_no_sort_per_level(spark, monkeypatch):
    """The leaves come from one shuffle of the series: no window, whatever the number of levels."""
    plans = []
    monkeypatch.setattr(tables, "STAGE_PLANS", plans)
    rows = [(w, D(2024, 1, 1) + dt.timedelta(days=i), float(i * i % 37)) for w in "AB" for i in range(300)]
    forest.fit_forest(spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double"), n_trees=4)
    leaves = dict(plans)["forest_model"]
    assert "Window" not in leaves and leaves.count("Exchange") == 1


def test_ties_and_constant_series(spark):
    """Equal values cannot be split; null residuals count as 0."""
    rows = [("C", D(2024, 1, i + 1), 5.0) for i in range(20)] + [("T", D(2024, 1, i + 1), float(i % 2)) for i in range(20)]
    rows += [("N", D(2024, 1, i + 1), None) for i in range(3)] + [("S", D(2024, 1, 1), 1.0)]
    fit = forest.fit_forest(spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double"), n_trees=5)
    got = {}
    for r in fit.leaves.collect():
        got.setdefault((r.warehouse_name, r.tree_id), []).append((r.node, round(r.path_len, 9)))
    assert all(got["C", t] == [(1, round(c(20), 9))] and got["N", t] == [(1, round(c(3), 9))] and got["S", t] == [(1, 0.0)] for t in range(5))
    assert all(sorted(got["T", t]) == [(2, round(1 + c(10), 9)), (3, round(1 + c(10), 9))] for t in range(5))


def test_models_are_one_row_and_score_as_their_segments(spark):
    """A model is one stored row, training rows are scored in its pass, and both ways of scoring agree."""
    rows = [(w, D(2024, 1, 1) + dt.timedelta(days=i), float(i * 7 % 23) + n, float(i), 0.0, 0.0)
            for n, w in enumerate("ABC") for i in range(30)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double, "
                                     "trend double, seasonal double")
    models = forest.grow_models(df.drop("trend", "seasonal"), n_trees=7).withColumn("model_version", F.lit(1))
    assert models.count() == 3 and models._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = forest.score_models(df, models)
    want = forest.score_rows(df, forest.segments(models), forest.meta(models)).select(got.columns)
    one, two = (sorted((r.warehouse_name, r.usage_date, round(r.score, 9)) for r in x.collect()) for x in (got, want))
    assert one == two and len(one) == 90
    again = sorted((r.warehouse_name, r.usage_date, round(r.score, 9)) for r in forest.training_scores(models).collect())
    assert again == one
    # an older version serves a series that the newest training lacks
    both = models.unionByName(models.where("warehouse_name = 'A'").withColumn("model_version", F.lit(2)).withColumn("threshold", F.lit(9.0)))
    found = {r.warehouse_name: r.threshold for r in forest.score_models(df, both).collect()}
    assert found["A"] == 9.0 and found["B"] < 9.0 and forest.score_models(df, both).count() == 90


def test_many_series_grow_at_once_and_unfold_from_two_numbers_a_leaf(monkeypatch):
    """The series of a batch grow in one pass, and what is stored of a leaf (depth, size) gives it back bit for bit."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    xs = [rng.normal(0, 1, n) for n in (1, 2, 3, 23, 255, 256, 257, 700)] + [np.zeros(9), np.r_[np.ones(5), np.zeros(4)]]
    names = [f"w{i}" for i in range(len(xs) - 1)] + [None]
    calls, grown, grow = [], [], forest.grow
    assert all(tree_seeds(12, s, w).tolist() == [tree_seed_of(s, w, i) for i in range(12)] for s in (0, 7, None) for w in ("é", "a|b", None))
    monkeypatch.setattr(forest, "LEAVES_AT_ONCE", 1 << 19)
    monkeypatch.setattr(forest, "grow", lambda *a: calls.append(a) or grown.append(grow(*a)) or grown[-1])
    b = pa.RecordBatch.from_arrays([pa.array(names), pa.array([[0]] * len(xs)), pa.array([list(x) for x in xs])], names=["key", "training", "xs"])
    out = list(forest._model_batches(10, 256, 0, 3.0)([b]))
    assert len(calls) == 1 and sum(o.num_rows for o in out) == len(xs)
    depth, size = (np.concatenate([o.column(c).flatten().to_numpy() for o in out]) for c in ("depth", "size"))
    x, bounds, seeds = calls[0]
    back = forest.unfold(depth, size, x, seeds)
    assert all((back[c] == grown[0][c]).all() for c in ("tree", "node", "lo", "hi", "depth", "size")) and len(depth) > 500
    # each series alone gives the same leaves
    for i in (3, 7):
        one = list(forest._model_batches(10, 256, 0, 3.0)([b.slice(i, 1)]))[0]
        assert one.column("depth").to_pylist() == out[0].slice(i, 1).column("depth").to_pylist()
        assert one.column("score").to_pylist() == out[0].slice(i, 1).column("score").to_pylist()
    # parts of a batch are cut by the weight of their series
    monkeypatch.setattr(forest, "LEAVES_AT_ONCE", 3000)
    again = list(forest._model_batches(10, 256, 0, 3.0)([b]))
    assert len(again) > 1 and [r for o in again for r in o.column("score").to_pylist()] == out[0].column("score").to_pylist()


def test_training_and_statistics_stay_spread_over_all_tasks(spark):
    """Work that is heavy per row is not packed into as many tasks as its few bytes fill, and moves no more often for it."""
    from spendwatch.operators import calendar, metering
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(f"W{w}", D(2024, 1, 1) + dt.timedelta(days=i), float(i), float(i)) for w in range(9) for i in range(5)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double")
    grown = forest.grow_models(forest.training_rows(df, "2024-02-01"), n_trees=2)
    assert n > 1 and grown.rdd.getNumPartitions() == n and grown.count() == 9
    assert grown._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    raw = df.select("warehouse_name", "usage_date", *[F.col("credits_used").cast("decimal(38,9)").alias(m) for m in metering.MEASURES])
    assert metering.metering_metrics(raw, calendar.build_calendar(spark, "2024-01-01", 5), "2024-01-05").rdd.getNumPartitions() == n


def test_models_are_never_broadcast(spark, tmp_path):
    rows = [(w, D(2024, 1, 1) + dt.timedelta(days=i), float(i * 7 % 23), float(i)) for w in "AB" for i in range(30)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double")
    forest.grow_models(df, n_trees=3).withColumn("model_version", F.lit(1)).write.parquet(f"{tmp_path}/m")
    got = forest.score_models(df, spark.read.parquet(f"{tmp_path}/m"))
    assert got.count() == 60
    met = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in met


def test_leaves_are_shuffled_as_one_small_column(spark):
    """Models meet the rows with their leaves packed, and the packing gives them back."""
    import pyarrow as pa
    xs = [np.arange(40.0), np.array([3.0]), np.random.default_rng(1).normal(0, 1, 700)]
    b = pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array([[0]] * 3), pa.array([list(x) for x in xs])], names=["key", "training", "xs"])
    depth, size = (pa.concat_arrays([o.column(c) for o in forest._model_batches(100, 256, 0, 3.0)([b])]) for c in ("depth", "size"))
    one = pa.array([1, 1, 1])
    m = pa.RecordBatch.from_arrays([b.column(0), *[one] * 6, depth, size, b.column(2)], names=[str(i) for i in range(10)])
    packed = next(forest._packed([m]))
    back = forest._unpacked(packed, 7)
    assert back.column(7).equals(depth) and back.column(8).equals(size) and back.column(9).equals(b.column(2))
    assert packed.column(7).nbytes * 3 < depth.nbytes + size.nbytes
    rows = [(w, D(2024, 1, 1) + dt.timedelta(days=i), float(i * 7 % 23), float(i)) for w in "AB" for i in range(30)]
    df = spark.createDataFrame(rows, "warehouse_name string, usage_date date, residual double, credits_used double")
    got = forest.score_models(df, forest.grow_models(df, n_trees=3).withColumn("model_version", F.lit(1)))
    assert "leaf" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 60
