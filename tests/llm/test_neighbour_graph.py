"""NN-descent and greedy search against brute force: recall, exact scores, copies, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwatch.llm import neighbour_graph as ng
from spendwatch.llm.queries import REGISTRY

from ..conftest import SF

SF01 = SF.replace("0.001", "0.1")


def brute(rows, k=5):
    """[(query row, [(vec_id, score), ...])] of rows (vec_id, vector), shorter vectors ending in zeros."""
    def ok(v):
        return v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and ok(v)]
    n = max(len(v) for _, v in rows)
    x = np.array([np.append(v, np.zeros(n - len(v))) for _, v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = x @ x[a]
            best = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-round(s[b], 12), rows[b][0]))[:k]
            out.append((i, [(rows[b][0], s[b]) for b in best]))
    return out


def asked(df):
    got = {}
    for r in ng.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {}
    for r in REGISTRY["op12_neighbour_graph"](spark, SF01).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows)
    vec = {i: np.array(v, float) for i, v in rows}
    assert set(got) == {q for q, _ in want} and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    found = sum(len({i for i, _ in got[q].values()} & {i for i, _ in best}) for q, best in want)
    assert found >= 0.95 * 5 * len(want)
    for q, near in got.items():
        scores = [near[k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True) and q not in {i for i, _ in near.values()}
        for i, s in near.values():
            assert abs(s - vec[q] @ vec[i] / np.linalg.norm(vec[q]) / np.linalg.norm(vec[i])) < 1e-12


def test_copies_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 160)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]          # a large group of copies
    rows += [(400 + i, [2.0, 4.0, -0.0]) for i in range(3)]                          # the same direction, shorter
    rows += [(500, None), (550, []), (600, [0.0] * 6), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [math.nan] * 6), (750, [math.inf] + [1.0] * 5)]
    rows += [(None, [1.0] * 6), (800, [1e300, 1e300, 0.0, 0.0, 0.0, 1e300]), (850, [1e-300, 0.0]), (50, [3.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<double>, score string, rank int").repartition(4)
    got, want = asked(df), brute(rows)
    assert set(got) == {q for q, _ in want}
    for q, best in want:
        if q == 50:                       # two rows with this id: two queries
            continue
        assert [i for i, _ in got[q]] == [i for i, _ in best], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1e-12)
    both = sorted(i for q, best in want if q == 50 for i, _ in best)
    assert sorted(i for i, _ in got[50]) == both


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    assert {q: [i for i, _ in v] for q, v in asked(df).items()} == {q: [i for i, _ in best] for q, best in (brute(rows) if n else []) if best}


def test_queries_from_outside(spark):
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((600, 8)), rng.standard_normal((12, 8))
    index = ng.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>"))
    got = ng.search_vectors(index, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>"), k=3)
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(12) for j in np.argsort(-s[i])[:3]}
    assert len(want & {(r.query_id, r.vec_id) for r in got.collect()}) >= 0.9 * len(want)
