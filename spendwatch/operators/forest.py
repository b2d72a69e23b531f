"""Isolation forests per warehouse, grown and scored as DataFrame jobs (J6, J7, J22; M6-M13).

One feature (the residual), so every tree cuts the real line into intervals.

Fit (``fit_forest``)
  * the series of a warehouse is one array in date order, at most one value per
    day kept; each tree samples ``psi = min(max_samples, n)`` positions of it
    without replacement by a seeded permutation (``draw_positions``);
  * all trees of many warehouses grow together (``grow``): a tree's sample is a
    sorted run, a node a part of it, so a split is a binary search in the run
    and a level is a handful of array operations, however many trees there are;
  * a node splits when it has at least two sampled rows, a value range above
    1e-7 and depth below ``ceil(log2(psi))``; the split is ``lo + u * (hi - lo)``
    with ``u`` from an integer mix of the node id and the tree's seed (md5 of
    seed, warehouse, tree);
  * a leaf's path length is ``depth + c(sampled rows in the leaf)``;
  * training rows are scored in the same pass, by the lookup below.

Models (``grow_models``)
  * one row per (warehouse, version): its leaves as lists (depth, sampled rows;
    tree by tree from left to right), n_trees, max_samples, seed, psi, c_psi, the
    training rows with their scores, score_mean, score_std, threshold; a leaf's
    ends and node follow from these (``unfold``), so that a version is some two
    bytes a leaf wherever it is written or shuffled;
  * ``leaves``: (warehouse, version, tree_id, node, lo, hi, path_len), interval (lo, hi] of the leaf;
  * ``segments``: the step functions of a warehouse merged into one: breakpoints
    of all trees sorted, with the mean path length right of each breakpoint;
  * ``meta``: (warehouse, version, n_trees, psi, c_psi, score_mean, score_std, threshold).

Scoring is an as-of lookup in the merged step function.  ``score_models`` brings
the rows of a warehouse, as an array, to its model row; ``score_rows`` does it
over segments as rows.  No pair of (row, interval) is ever formed.

Randomness is seeded, so fits are reproducible and checkable against DuckDB;
the reference's library fit is unseeded, so its scores match in distribution.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EULER_GAMMA, dealt_by, lit_date
from ..functions.seeds import mix_uniform_np, tree_seeds
from ..sources.tables import materialize as write_stage
from .decompose import fill_series_gaps

FEATURE_THRESHOLD = 1e-7  # a node whose value range is at most this is constant


@dataclass
class Forest:
    leaves: DataFrame
    segments: DataFrame
    meta: DataFrame
    scores: DataFrame  # training rows with score and threshold


def path_lengths(leaf: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of every leaf."""
    return leaf["depth"] + path_length_np(np.arange(leaf["size"].max(initial=0) + 1))[leaf["size"]]


def draw_positions(n: int, max_samples: int, seeds: np.ndarray) -> np.ndarray:
    """``min(n, max_samples)`` distinct positions of 0 .. n - 1 per tree, one row for each of ``seeds``.

    The first numbers go through a seeded permutation of [0, 2^k), 2^k being
    the next power of two, and numbers that land at n or above go through it
    again until all are below n (cycle walking), which permutes [0, n).  A
    series that is sampled whole needs no permutation.  Integer arithmetic
    only, so DuckDB repeats it.
    """
    v = np.tile(np.arange(min(n, max_samples), dtype=np.int64), (len(seeds), 1))
    if n <= max_samples:
        return v
    k, seed = max(1, (n - 1).bit_length()), seeds[:, None]

    def step(v):
        """Three rounds of (odd multiplier, shift, xor with the high half) on k-bit numbers."""
        for r in (1, 2, 3):
            v = (v * ((2 * seed * r + 2 * r + 1) % (1 << k)) + seed + r) % (1 << k)
            v = v ^ (v >> ((k + 1) // 2))
        return v

    v = step(v)
    while (v >= n).any():
        v = np.where(v >= n, step(v), v)
    return v


def grow(x: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> dict[str, np.ndarray]:
    """Leaves of all trees, tree by tree from left to right: tree, node, lo, hi, depth, size.

    The sample of tree ``t`` is the sorted run ``x[bounds[t]:bounds[t + 1]]``; the trees may be of any number of series.
    """
    trees = len(seeds)
    run = {"tree": np.arange(trees), "node": np.ones(trees, np.int64), "lo": np.full(trees, -np.inf),
           "hi": np.full(trees, np.inf), "start": bounds[:-1], "end": bounds[1:]}
    limit = np.frexp(np.maximum(np.diff(bounds), 2) - 1.0)[1]          # ceil(log2(psi))
    leaves = []
    for depth in range(limit.max(initial=0) + 1):
        least, most = x[run["start"]], x[run["end"] - 1]
        splits = (run["end"] - run["start"] >= 2) & (most > least + FEATURE_THRESHOLD) & (depth < limit[run["tree"]])
        stays, goes = np.flatnonzero(~splits), np.flatnonzero(splits)
        leaves.append({**{c: v[stays] for c, v in run.items()}, "depth": np.full(len(stays), depth)})
        run, least, most = {c: v[goes] for c, v in run.items()}, least[goes], most[goes]
        if not len(least):
            break
        at = _split(least, most, seeds[run["tree"]], run["node"])
        # the first value of the run above the split lies in [low, high]: its least value is not above it, its most is
        low, high = run["start"] + 1, run["end"] - 1
        left = np.flatnonzero(low < high)
        while len(left):
            i, j = low[left], high[left]
            mid = (i + j) // 2
            below = x[mid] <= at[left]
            low[left], high[left] = i, j = np.where(below, mid + 1, i), np.where(below, j, mid)
            left = left[i < j]
        run = {c: np.concatenate([v, v]) for c, v in run.items()}
        n = len(at)
        run["node"] = run["node"] * 2 + np.repeat([0, 1], n)
        run["hi"][:n], run["lo"][n:] = at, at
        run["end"][:n], run["start"][n:] = low, low
    out = {c: np.concatenate([leaf[c] for leaf in leaves]) for c in leaves[0]}
    out["size"] = out.pop("end") - out.pop("start")
    order = np.argsort(out["tree"] + out["node"] * 2.0 ** -out["depth"], kind="stable")       # node / 2^depth grows from left to right
    return {c: v[order] for c, v in out.items()}


def _split(least: np.ndarray, most: np.ndarray, seeds: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where nodes split the range of their samples."""
    at = least + mix_uniform_np(seeds, node) * (most - least)
    return np.where(at >= most, least, at)


def unfold(depth: np.ndarray, size: np.ndarray, x: np.ndarray, seeds: np.ndarray) -> dict[str, np.ndarray]:
    """The leaves that ``grow`` gave, from their depths and sizes: nothing is searched or split again.

    A leaf of depth d takes 2^-d of its tree, so the sum of the leaves before
    it is its tree and its place in it, which give its node.  Its lower end is
    the split of the node whose right part it begins; the leaves of that node
    say which run of the sample the node had.
    """
    share = 2.0 ** -depth.astype(float)
    begin = np.cumsum(share) - share                  # sums of powers of two: exact
    tree = begin.astype(np.int64)
    node = ((1 + begin - tree) / share).astype(np.int64)
    first = begin == tree                             # of its tree
    inner = np.flatnonzero(~first)
    odd = node[inner] & -node[inner]                  # node = (2 * parent + 1) * odd, a power of two
    part = share[inner] * odd                         # what each half of the parent takes
    taken = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start, end = (taken[np.searchsorted(begin, begin[inner] + d)] for d in (-part, part))
    lo = np.full(len(node), -np.inf)
    lo[inner] = _split(x[start], x[end - 1], seeds[tree[inner]], node[inner] // (2 * odd))
    hi = np.where(np.append(first[1:], True), np.inf, np.append(lo[1:], np.inf))
    return {"tree": tree, "node": node, "lo": lo, "hi": hi, "depth": depth, "size": size}


def path_length_np(n: np.ndarray) -> np.ndarray:
    """``avg_path_length`` of an array of sizes."""
    m = np.maximum(n, 3).astype(float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m))


def merge(leaf: dict[str, np.ndarray], path: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """The step functions of all trees of a series as one: (breakpoints, mean path length right of each).

    Sweeping the line left to right, at a split of a tree its path length
    changes from that of the leaf left of it to that of the leaf right of it;
    the mean right of a breakpoint is the sum of the leftmost leaves and all
    changes up to it.
    """
    order = np.lexsort((leaf["lo"], leaf["tree"]))
    return _sweep(leaf["lo"][order], path[order], trees)


def _sweep(lo: np.ndarray, path: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` of leaves that come tree by tree from left to right."""
    step = path.copy()
    inner = np.flatnonzero(~np.isneginf(lo))
    step[inner] -= path[inner - 1]
    points, at = np.unique(lo, return_inverse=True)
    return points, np.cumsum(np.bincount(at, step, len(points))) / trees


LISTS = "depth array<tinyint>, size array<int>"      # the leaves of a series, tree by tree from left to right


def _lists(values: np.ndarray, lengths) -> pa.Array:
    """An Arrow list column from its values one after another."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column."""
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


LEAVES_AT_ONCE = 1 << 16        # sampled values, or leaves, of the series that are worked on together


def _parts(b: pa.RecordBatch, weights: np.ndarray):
    """Slices of a batch of at most ``LEAVES_AT_ONCE`` by weight, or of one row."""
    group = np.cumsum(weights) // LEAVES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), b.num_rows]
    return [b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i]


def _samples(names, xs, seed, max_samples, n_trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted samples of all trees of the given series, where each begins, and the trees' seeds."""
    seeds = [tree_seeds(n, s, name) for s, name, n in zip(seed, names, n_trees)]
    drawn = [np.tile(np.sort(x), (len(t), 1)) if len(x) <= m else np.sort(x[draw_positions(len(x), m, t)], axis=1)
             for x, m, t in zip(xs, max_samples, seeds)]
    sizes = np.repeat([d.shape[1] for d in drawn], [len(d) for d in drawn])
    return np.concatenate([d.ravel() for d in drawn]), np.cumsum([0, *sizes]), np.concatenate(seeds)


def decision(points: np.ndarray, mean: np.ndarray, x: np.ndarray, c_psi: float) -> np.ndarray:
    """Scores of ``x``: the mean path length of the segment that a value falls in, (point, next point]."""
    path = mean[np.searchsorted(points, x, side="left") - 1]
    # a model of one row has c(1) = 0: every score of it is neutral
    return 0.5 - np.power(2.0, -(path / c_psi if c_psi else np.ones(len(x))))


def _model_batches(n_trees: int, max_samples: int, seed: int, sigmas: float):
    """One row per series: its leaves as lists, the scores of its training rows and their statistics."""
    def stats(x, lo, path):
        psi = min(len(x), max_samples)
        c_psi = float(path_length_np(np.array([psi]))[0])
        score = decision(*_sweep(lo, path, n_trees), x, c_psi)
        mean, std = float(score.mean()), float(score.std(ddof=1)) if len(x) > 1 else None
        return score, (psi, c_psi, mean, std, None if std is None else mean - sigmas * std)

    def run(batches):
        for b in batches:
            for part in _parts(b, np.minimum(b.column(2).value_lengths().to_numpy(), max_samples) * n_trees):
                xs, n = _arrays(part.column(2)), part.num_rows
                x, bounds, seeds = _samples(part.column(0).to_pylist(), xs, [seed] * n, [max_samples] * n, [n_trees] * n)
                leaf = grow(x, bounds, seeds)
                path = path_lengths(leaf)
                ends = np.searchsorted(leaf["tree"], np.arange(n + 1) * n_trees)
                got = [stats(x, leaf["lo"][i:j], path[i:j]) for x, i, j in zip(xs, ends, ends[1:])]
                plain = [pa.array(c, t) for c, t in zip(zip(*[g[1] for g in got]), (pa.int64(), *[pa.float64()] * 4))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *plain, *[_lists(leaf[c].astype(t), np.diff(ends)) for c, t in (("depth", np.int8), ("size", np.int32))],
                     _lists(np.concatenate([g[0] for g in got]), [len(x) for x in xs])],
                    names=["key", "training", "psi", "c_psi", "score_mean", "score_std", "threshold", "depth", "size", "score"])
    return run


def grow_models(rows: DataFrame, key: str = "warehouse_name", date_col: str = "usage_date", value: str = "residual",
                n_trees: int = 100, max_samples: int = 256, seed: int = 0, sigmas: float = 3.0) -> DataFrame:
    """One row per ``key``: leaves (``depth``, ``size``), training rows, their scores and the threshold.

    The rows of a series are one array (one shuffle), bounded by the days kept.
    A leaf is its depth and its number of sampled rows; everything else about
    it follows from these, the training rows and the seed (see ``unfold``).
    """
    names = [c for c in rows.columns if c != key]
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    series = rows.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(date_col).alias("_d"), x.alias("_x"), F.struct(*names).alias("_row")))).alias("s"))
    series = series.select("key", F.transform("s", lambda s: s["_row"]).alias("training"), F.transform("s", lambda s: s["_x"]).alias("xs"))
    kind = series.schema["training"].dataType.simpleString()
    model = series.mapInArrow(_model_batches(n_trees, max_samples, seed, sigmas),
                              f"key string, training {kind}, psi long, c_psi double, score_mean double, score_std double, "
                              f"threshold double, {LISTS}, score array<double>")
    return model.withColumnRenamed("key", key).withColumns({
        "n_trees": F.lit(n_trees), "max_samples": F.lit(max_samples), "seed": F.lit(seed).cast("long")})


def _stored(value: str) -> list[Column]:
    """What the leaves of a stored model are read from (see ``_trees``)."""
    return [F.col("seed"), F.col("max_samples"), F.col("n_trees"), F.col("depth"), F.col("size"),
            F.transform("training", lambda r: F.coalesce(r[value].cast("double"), F.lit(0.0))).alias("xs")]


def _trees(b: pa.RecordBatch, at: int):
    """For slices of a batch with the key first and the columns of ``_stored`` from ``at`` on: (slice, leaves, path lengths,
    where the leaves of each row end)."""
    for part in _parts(b, b.column(at + 3).value_lengths().to_numpy()):
        seed, max_samples, n_trees, depth, size, xs = part.columns[at:at + 6]
        x, _, seeds = _samples(part.column(0).to_pylist(), _arrays(xs), *[c.to_pylist() for c in (seed, max_samples, n_trees)])
        leaf = unfold(depth.flatten().to_numpy(), size.flatten().to_numpy(), x, seeds)
        yield part, leaf, path_lengths(leaf), np.cumsum([0, *depth.value_lengths().to_numpy()])


def leaves(models: DataFrame, key: str = "warehouse_name", value: str = "residual") -> DataFrame:
    """One row per leaf of the models."""
    def run(batches):
        for b in batches:
            for part, leaf, path, ends in _trees(b, 2):
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                tree = leaf["tree"] - leaf["tree"][ends[:-1]][row]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(tree, pa.int32()), pa.array(leaf["node"], pa.int32()),
                     *[pa.array(v) for v in (leaf["lo"], leaf["hi"], path)], part.column(1).take(pa.array(row))],
                    names=[key, "tree_id", "node", "lo", "hi", "path_len", "model_version"])
    return models.select(key, F.col("model_version").cast("long"), *_stored(value)).mapInArrow(
        run, f"`{key}` string, tree_id int, node int, lo double, hi double, path_len double, model_version long")


def segments(models: DataFrame, key: str = "warehouse_name", value: str = "residual") -> DataFrame:
    """One row per segment of the merged step functions of the models."""
    def run(batches):
        for b in batches:
            for part, leaf, path, ends in _trees(b, 2):
                for r, (i, j, n_trees) in enumerate(zip(ends, ends[1:], part.column(4).to_pylist())):
                    points, mean = _sweep(leaf["lo"][i:j], path[i:j], n_trees)
                    of = pa.array(np.full(len(points), r))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(of), part.column(1).take(of), pa.array(points), pa.array(mean)],
                        names=[key, "model_version", "lo", "mean_path"])
    return models.select(key, F.col("model_version").cast("long"), *_stored(value)).mapInArrow(
        run, f"`{key}` string, model_version long, lo double, mean_path double")


def meta(models: DataFrame, key: str = "warehouse_name") -> DataFrame:
    """One row per model: shape, statistics of the training scores, threshold."""
    return models.select(key, "model_version", "n_trees", "psi", "c_psi", "score_mean", "score_std", "threshold")


def training_scores(models: DataFrame, key: str = "warehouse_name") -> DataFrame:
    """One row per training row of the models, with its score and the model's statistics."""
    names = models.schema["training"].dataType.elementType.fieldNames()
    each = models.select(key, "score_mean", "score_std", "threshold", F.explode(F.arrays_zip("training", "score")).alias("_t"))
    return each.select(key, *[F.col(f"_t.training.{c}").alias(c) for c in names], F.col("_t.score").alias("score"),
                       "score_mean", "score_std", "threshold")


def fit_forest(rows: DataFrame, key: str = "warehouse_name", date_col: str = "usage_date",
               value: str = "residual", n_trees: int = 100, max_samples: int = 256, seed: int = 0,
               sigmas: float = 3.0, version: int | Column = 0, materialize: bool = True) -> Forest:
    """Fit one forest per ``key`` on ``value`` of the given (gap-free) rows (see ``grow_models``).

    The models are written once, with the scores of their training rows; leaves,
    segments and thresholds are read from them.
    """
    models = grow_models(rows, key, date_col, value, n_trees, max_samples, seed, sigmas)
    if materialize:
        models = write_stage(models, "forest_model")
    models = models.withColumn("model_version", version if isinstance(version, Column) else F.lit(version))
    return Forest(leaves=leaves(models, key, value), segments=segments(models, key, value), meta=meta(models, key),
                  scores=training_scores(models, key))


def score_rows(rows: DataFrame, segments: DataFrame, meta: DataFrame, key: str = "warehouse_name",
               value: str = "residual") -> DataFrame:
    """Decision function of every row against its warehouse's model (as-of lookup).

    ``segments`` and ``meta`` must hold one model version per warehouse (see
    ``latest_model``).  Rows of warehouses without a model are dropped, as a
    prediction without a model cannot run.
    """
    m = meta.select(key, "c_psi", *(["threshold"] if "threshold" in meta.columns else []))
    q = (rows.join(m, [key])  # one meta row per warehouse
         .withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
         .withColumn("_kind", F.lit(0)).withColumn("_mp", F.lit(None).cast("double")))
    s = segments.select(key, F.col("lo").alias("_v"), F.lit(1).alias("_kind"), F.col("mean_path").alias("_mp"))
    u = q.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    looked = u.withColumn("_path", F.last("_mp", ignorenulls=True).over(w)).where(F.col("_kind") == 0)
    # a model of one row has c(1) = 0: every score of it is neutral
    ratio = F.when(F.col("c_psi") != 0, F.col("_path") / F.col("c_psi")).otherwise(F.lit(1.0))
    score = F.lit(0.5) - F.pow(F.lit(2.0), -ratio)
    return looked.withColumn("score", score).drop("_v", "_kind", "_mp", "_path", "c_psi")


def latest_model(segments: DataFrame, meta: DataFrame, key: str = "warehouse_name"):
    """Keep the highest model version per warehouse (the ``latest`` tag)."""
    top = meta.groupBy(key).agg(F.max("model_version").alias("model_version"))
    return (segments.join(top, [key, "model_version"], "left_semi"),
            meta.join(top, [key, "model_version"], "left_semi"))


def training_anomalies(scores: DataFrame, key: str = "warehouse_name", credits: str = "credits_used",
                       global_mean: bool = False) -> DataFrame:
    """Training rows at or below the threshold whose credits exceed the mean credits.

    The mean is per warehouse for the weekly training (J6) and over all rows in
    the notebook's history scan (J22, ``global_mean=True``).
    """
    if global_mean:
        mean = F.lit(scores.agg(F.avg(F.col(credits).cast("double"))).first()[0]).cast("double")
    else:
        mean = F.avg(F.col(credits).cast("double")).over(Window.partitionBy(key))
    return (scores.withColumn("_mean_credits", mean)
            .where((F.col("score") <= F.col("threshold")) & (F.col(credits).cast("double") > F.col("_mean_credits")))
            .drop("_mean_credits"))


def training_rows(features: DataFrame, before, key: str = "warehouse_name") -> DataFrame:
    """Rows before ``before`` of every warehouse; days that are missing inside a series are rows of 0, as a daily
    frequency gives them (M1)."""
    return fill_series_gaps(dealt_by(features.where(F.col("usage_date") < lit_date(before)), key), key, "usage_date", "credits_used", "residual")


def train_forest(features: DataFrame, before, n_trees: int = 100, max_samples: int = 256, seed: int = 0,
                 sigmas: float = 3.0, version: int | Column = 0, key: str = "warehouse_name") -> Forest:
    """Weekly training (J6): ``training_rows`` of every warehouse, residual feature."""
    return fit_forest(training_rows(features, before, key), key=key, n_trees=n_trees, max_samples=max_samples, seed=seed,
                      sigmas=sigmas, version=version)


def _packed(batches):
    """Models with their leaves as one compressed column: lists of small numbers are several times that in a shuffle."""
    for b in batches:
        leaf = [zlib.compress(d.tobytes() + s.astype("<i4").tobytes(), 1) for d, s in zip(*map(_arrays, b.columns[7:9]))]
        yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(leaf, pa.binary()), b.column(9)],
                                         names=["key", "model_version", "threshold", "c_psi", "seed", "max_samples", "n_trees", "leaf", "xs"])


def _unpacked(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The column ``at`` of ``_packed`` as the lists it was made of (5 bytes a leaf)."""
    leaf = [zlib.decompress(v.as_py()) for v in b.column(at)]
    lists = [_lists(np.concatenate([np.frombuffer(v, t, *part) for v, part in zip(leaf, parts)]), [len(v) // 5 for v in leaf])
             for t, parts in (("i1", [(len(v) // 5,) for v in leaf]), ("<i4", [(-1, len(v) // 5) for v in leaf]))]
    columns = [*b.columns[:at], *lists, *b.columns[at + 1:]]
    return pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


def _scored(batches):
    for b in batches:
        if not b.num_rows:
            continue
        for part, leaf, path, ends in _trees(_unpacked(b, 8), 5):
            c_psi, n_trees, xs = part.column(3).to_pylist(), part.column(7).to_pylist(), _arrays(part.column(4))
            scores = [decision(*_sweep(leaf["lo"][i:j], path[i:j], n), x, c) for i, j, n, x, c in zip(ends, ends[1:], n_trees, xs, c_psi)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], _lists(np.concatenate(scores), map(len, xs))],
                                             names=["key", "threshold", "rows", "score"])


def score_models(rows: DataFrame, models: DataFrame, key: str = "warehouse_name", value: str = "residual") -> DataFrame:
    """``score_rows`` over the stored models: the rows of a series (an array) meet the latest model of it as one row.

    Of the models only the versions that are the latest of some series are read, and no leaf or segment is a row.
    """
    top = models.groupBy(key).agg(F.max("model_version").alias("model_version"))
    versions = [r[0] for r in top.select("model_version").distinct().collect()]       # one number per version
    names = [c for c in rows.columns if c != key]
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    series = rows.groupBy(key).agg(F.collect_list(F.struct(F.struct(*names).alias("r"), x.alias("x"))).alias("s")).join(top, [key])
    kind = models.schema[key].dataType.simpleString()
    models = models.where(F.col("model_version").isin(versions)).select(
        key, F.col("model_version").cast("long"), "threshold", "c_psi", "seed", F.col("max_samples").cast("int"), F.col("n_trees").cast("int"),
        *_stored(value)[3:]).mapInArrow(_packed, f"`{key}` {kind}, model_version long, threshold double, c_psi double, "
                                        "seed long, max_samples int, n_trees int, leaf binary, xs array<double>")
    # merged: a model is many times its file's bytes in memory, and none is sent to the driver and to every executor
    met = series.join(models.hint("merge"), [key, "model_version"]).select(
        F.col(key).alias("key"), "threshold", F.transform("s", lambda s: s["r"]).alias("rows"), "c_psi",
        F.transform("s", lambda s: s["x"]).alias("values"), "seed", "max_samples", "n_trees", "leaf", "xs")
    kind = met.schema["rows"].dataType.simpleString()
    out = met.mapInArrow(_scored, f"key string, threshold double, rows {kind}, score array<double>")
    out = out.select("key", "threshold", F.explode(F.arrays_zip("rows", "score")).alias("_t"))
    return out.select(F.col("key").alias(key), *[F.col(f"_t.rows.{c}").alias(c) for c in names], "threshold", F.col("_t.score").alias("score"))


def score_forest(features: DataFrame, models: DataFrame, ds, days: int = 7, key: str = "warehouse_name") -> DataFrame:
    """Daily prediction (J7): rows of [ds - days, ds] scored with the latest model of
    each warehouse; ``is_anomaly`` marks scores at or below the threshold."""
    d = lit_date(ds)
    rows = features.where(F.col("usage_date").between(F.date_sub(d, days), d)).select(
        key, "usage_date", "credits_used", "trend", "seasonal", "residual")
    scored = score_models(rows, models, key)
    return (scored.withColumn("is_anomaly", F.col("score") <= F.col("threshold"))
            .withColumn("prediction_datetime", d.cast("timestamp_ntz")))


def predicted_anomalies(scored: DataFrame) -> DataFrame:
    """Rows of the model output table: scored rows at or below the threshold."""
    return scored.where("is_anomaly").select(
        "warehouse_name", "usage_date", F.col("credits_used").cast("double").alias("credits_used"),
        "trend", "seasonal", "residual", "score", "prediction_datetime")
