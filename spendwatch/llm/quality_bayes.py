"""Document quality by hierarchical empirical Bayes.

Evidence: a naive Bayes classifier over hashed words and word shapes.  Each
task adds up, for its labelled texts, in how many good and bad texts a feature
occurs; the sums are grouped and give one log ratio per feature (2^18 at most).
Texts fall into ``FOLDS`` folds by a hash of the text, so copies share a fold,
and the ratios that judge a fold are those of the other folds' labels: no text's
evidence comes from its own label.  A text's evidence is the mean log ratio of
its features, turned into log odds by a logistic curve fitted to the labelled
texts' evidence, binned.

Sites: labelled texts are counted per site (source) and per path below it
(documents have no address below the source, so the language stands for the
path unless another column is named).  Rates shrink level by level: a site's towards the
global rate, a path's towards its site's, with beta priors whose strengths are
fitted by moments, so a sparse site keeps close to the global prior.

Score: evidence log odds plus the path's log odds relative to the global ones.
Unlabelled documents and unseen sites get the prior of the level above.

Defined cases: a null or empty text has no evidence, only its site's prior; a
null site or path is a site or path of its own; a label without a document, or
with a null quality, teaches nothing; a document with several labels counts
with each; repeated rows are scored each; a fold whose labels are the only ones
has evidence 0; without labels every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side
from .words import SPACED, U, Words, chunks, mix

FEATURES = 1 << 18
FOLDS = 5
BINS = 400
RANGE = 4.0          # evidence is held within +-RANGE for binning and scoring


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) once each: words in lower case and their shapes.

    A shape is the set of byte classes in the word: lower, upper, digit, symbol, other.
    """
    word = (w.hash % U(FEATURES // 2)).astype(np.int64)
    cls = _CLASS[w.raw]
    if len(w.start):
        edges = np.stack([w.start, w.end], 1).ravel()
        held = np.concatenate([cls, np.zeros(1, np.uint8)])
        shape = np.bitwise_or.reduceat(held, edges)[::2].astype(np.uint64)
        last = w.raw[w.end - 1].astype(np.uint64)
        shape = mix(shape * U(256) + np.where(_CLASS[w.raw[w.end - 1]] == 8, last, U(0)))
    else:
        shape = np.zeros(0, np.uint64)
    shape = (shape % U(FEATURES // 2)).astype(np.int64) + FEATURES // 2
    key = np.unique(np.concatenate([w.doc, w.doc]) * FEATURES + np.concatenate([word, shape]))
    return key // FEATURES, key % FEATURES


_CLASS = np.full(256, 16, np.uint8)
_CLASS[33:127] = 8
_CLASS[48:58] = 4
_CLASS[65:91] = 2
_CLASS[97:123] = 1


class _Raw(Words):
    """Words that also keep the bytes as written."""

    def __init__(self, data, bounds):
        self.raw = data
        super().__init__(data, bounds, SPACED)


def _label_counts(batches):
    """(fold and feature as one number, texts of quality 1, texts of quality 0), summed over the task.

    Feature ``FEATURES`` counts the texts of a fold.
    """
    total = np.zeros((FOLDS * (FEATURES + 1), 2), np.int64)
    for b in batches:
        fold = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * (FEATURES + 1)
        bad = 1 - b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end, data, bounds in chunks(b.column(2)):
            doc, feature = _features(_Raw(data, bounds))
            np.add.at(total, (fold[first:end][doc] + feature, bad[first:end][doc]), 1)
        np.add.at(total, (fold + FEATURES, bad), 1)
    f = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(total[f, 0]), pa.array(total[f, 1])], names=["f", "good", "bad"])


class Evidence:
    """Log ratio of each feature, for each fold from the labels of the other folds."""

    def __init__(self, counts: pa.Table):
        n = np.zeros((FOLDS * (FEATURES + 1), 2))
        n[counts.column("f").to_numpy()] = np.stack([counts.column(c).to_numpy() for c in ("good", "bad")], 1)
        n = n.reshape(FOLDS, FEATURES + 1, 2)
        every = n.sum(0)
        good, bad = every[FEATURES]
        self.prior = float((good + 0.5) / (good + bad + 1.0))
        self.ratio = np.zeros((FOLDS, FEATURES), np.float32)
        for k in range(FOLDS):
            other = every - n[k]
            met = other[:FEATURES].any(1)
            share = np.log((other[:FEATURES][met] + 0.5) / (other[FEATURES] + 1.0))
            self.ratio[k, met] = share[:, 0] - share[:, 1]

    def of(self, data: np.ndarray, bounds: np.ndarray, fold: np.ndarray) -> np.ndarray:
        doc, feature = _features(_Raw(data, bounds))
        n = np.bincount(doc, minlength=len(bounds) - 1)
        s = np.bincount(doc, self.ratio[fold[doc], feature], minlength=len(bounds) - 1)
        return np.clip(s / np.maximum(n, 1), -RANGE, RANGE)


def _scorer(evidence):
    def run(batches):
        for b in batches:
            fold = b.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
            out = [evidence.value.of(data, bounds, fold[first:end])
                   for first, end, data, bounds in chunks(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.concatenate([*out, np.zeros(0)]))],
                                             names=[*b.schema.names[:-2], "e"])
    return run


def fit_curve(bins) -> tuple[float, float]:
    """Slope and offset of P(good) = sigmoid(slope * e + offset) from (e, good, bad) sums, by Newton steps
    with a weak prior on the slope."""
    if not bins:
        return 0.0, 0.0
    x, g, b = (np.array(v, float) for v in zip(*bins))
    n, w = g + b, np.zeros(2)
    m = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (g - n * p) - np.array([1e-3, 1e-3]) * w
        step = np.linalg.solve(m.T @ (m * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
        w = w + np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def _strength(n: float, nn: float, hosts: int, spread: float, noise: float) -> float:
    """Beta strength by moments: ``spread`` is the sum of n * (rate - mean)^2, ``noise`` the mean of m * (1 - m)."""
    true = max(spread - max(hosts - 1, 0) * noise, 0.0) / max(n - nn / max(n, 1.0), 1.0)
    mean = n / max(hosts, 1)
    return min(max(noise / true - 1 if true > 0 else 100 * mean, 1.0), max(100 * mean, 1.0))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", site: str = "source",
                    path: str = "lang") -> DataFrame:
    """One row per document: doc_id, evidence, site_rate, path_rate, score in 0 to 1."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"),
                    F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", "site", "path", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    lab = labels.select(F.col("doc_id").alias("__l"), F.col("quality").cast("long").alias("quality")).where(
        "quality is not null")
    sc = d.sparkSession.sparkContext
    # labels join by id; texts move once, whatever the number of labels
    taught = d.join(lab.hint("merge"), F.col("doc_id") == F.col("__l"))
    counts = (taught.select("fold", "quality", "text").mapInArrow(_label_counts, "f long, good long, bad long")
              .groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    evidence = Evidence(counts.toArrow())      # FOLDS * (FEATURES + 1) rows of three numbers at most
    scored = materialize(d.mapInArrow(_scorer(sc.broadcast(evidence)), f"doc_id {kind}, site string, path string, e double"),
                         "evidence")
    seen = materialize(scored.join(lab, F.col("doc_id") == F.col("__l")).select("site", "path", "e", "quality"), "seen")
    good = F.sum("quality").alias("good")
    bins = seen.groupBy(F.round(F.col("e") * (BINS / (2 * RANGE))).alias("k")).agg(
        F.avg("e").alias("e"), good, F.sum(1 - F.col("quality")).alias("bad")).collect()
    slope, offset = fit_curve(sorted((r.e, r.good, r.bad) for r in bins))
    base = math.log(evidence.prior / (1 - evidence.prior))

    def shrunk(level, parent):
        """Rates of ``level`` (n, good and its parent's rate) shrunk towards that rate."""
        s = level.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"),
                      F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(parent), F.lit(2.0))).alias("v"),
                      F.avg(F.col(parent) * (1 - F.col(parent))).alias("m")).first()
        a = _strength(float(s.n or 0), float(s.nn or 0), s.k, s.v or 0.0, s.m or 0.25)
        return (F.col("good") + F.lit(a) * F.col(parent)) / (F.col("n") + F.lit(a))

    paths = materialize(seen.groupBy("site", "path").agg(F.count("*").alias("n"), good), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn(
        "prior", F.lit(evidence.prior))
    sites = materialize(sites.withColumn("site_rate", shrunk(sites, "prior")).select("site", "site_rate"), "sites")
    s2 = sites.select(F.col("site").alias("__s"), "site_rate")
    paths = paths.join(s2, F.col("site").eqNullSafe(F.col("__s")))
    paths = materialize(paths.withColumn("path_rate", shrunk(paths, "site_rate")).select(
        F.col("site").alias("__p"), F.col("path").alias("__q"), "path_rate"), "path_rates")
    out = scored.join(small_side(s2), F.col("site").eqNullSafe(F.col("__s")), "left")
    out = out.join(small_side(paths), F.col("site").eqNullSafe(F.col("__p")) & F.col("path").eqNullSafe(F.col("__q")), "left")
    out = out.withColumn("site_rate", F.coalesce("site_rate", F.lit(evidence.prior)))
    out = out.withColumn("path_rate", F.coalesce("path_rate", "site_rate"))
    odds = (F.lit(slope) * F.col("e") + F.lit(offset)
            + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - F.lit(base))
    return out.select("doc_id", F.col("e").alias("evidence"), "site_rate", "path_rate",
                      (1 / (1 + F.exp(-odds))).alias("score"))
