"""Usage drift per warehouse (J23, Q2-Q5): the last week against all days before it.

* ``daily_pivot`` is the date x warehouse matrix the notebook tests (A13);
* ``ks_statistic`` computes the two-sample Kolmogorov-Smirnov distance per
  warehouse with windows: both samples are unioned, ordered by value, and the
  two empirical CDFs are running counts over a RANGE frame (ties are counted
  together, as the statistic requires); D is their largest gap;
* the asymptotic p-value is the Kolmogorov series, evaluated natively with a
  higher-order function;
* the exact p-value (what the library uses for samples this small) is the
  share of lattice paths from (0, 0) to (m, n) that leave the band
  ``|x/m - y/n| < D``; it depends only on (m, n, D) and is a fold of arrays over
  the distinct cases (``exact_p``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def daily_pivot(daily: DataFrame, warehouses: list[str], value: str = "credits_used") -> DataFrame:
    """Date x warehouse matrix with no aggregation: a repeated (date, warehouse) fails.

    The caller lists the warehouses, one column each; the drift test itself works on rows.
    """
    cell = F.when(F.count(F.lit(1)) > 1,
                  F.raise_error(F.lit("duplicate (usage_date, warehouse_name) in pivot"))
                  ).otherwise(F.first(value))
    return daily.groupBy("usage_date").pivot("warehouse_name", list(warehouses)).agg(cell)


def split_recent(daily: DataFrame, days: int = 7) -> DataFrame:
    """Flag rows of the last ``days + 1`` days (from max date - days on) as current."""
    last = daily.agg(F.max("usage_date")).first()[0]
    return daily.withColumn("is_current", F.col("usage_date") >= F.date_sub(F.lit(last).cast("date"), days))


def ks_statistic(daily: DataFrame, days: int = 7, value: str = "credits_used") -> DataFrame:
    """Per warehouse: sizes of the reference and current samples and the KS distance D."""
    df = split_recent(daily, days).select("warehouse_name", F.col(value).cast("double").alias("_v"), "is_current")
    per = Window.partitionBy("warehouse_name")
    cum = Window.partitionBy("warehouse_name").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    cur = F.col("is_current").cast("int")
    ecdf = (df.withColumn("_n2", F.sum(cur).over(per))
            .withColumn("_n1", F.count(F.lit(1)).over(per) - F.col("_n2"))
            .withColumn("_c2", F.sum(cur).over(cum))
            .withColumn("_c1", F.count(F.lit(1)).over(cum) - F.col("_c2")))
    # a warehouse with an empty side has no distance: NULL, and no p-value or flag
    gap = F.abs(F.try_divide("_c1", "_n1") - F.try_divide("_c2", "_n2"))
    return (ecdf.groupBy("warehouse_name")
            .agg(F.first("_n1").alias("n_reference"), F.first("_n2").alias("n_current"),
                 F.max(gap).alias("ks_d")))


# Below this lambda the limiting p-value is 1 to within 1e-12; from it on, term 30 of the series is below 1e-30.
SMALL_LAMBDA = 0.2
TERMS = 30


def asymptotic_p(d: str = "ks_d", n1: str = "n_reference", n2: str = "n_current", terms: int = TERMS):
    """Kolmogorov limiting distribution: 2 sum_k (-1)^(k-1) exp(-2 k^2 l^2), l = D sqrt(n1 n2 / (n1 + n2)).

    The alternating series needs ever more terms as l falls; below ``SMALL_LAMBDA`` the value is 1.
    """
    lam = F.col(d) * F.sqrt(F.col(n1) * F.col(n2) / (F.col(n1) + F.col(n2)))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < SMALL_LAMBDA, F.lit(1.0)).when(lam.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def exact_p(samples: DataFrame, m: str = "n_reference", n: str = "n_current", d: str = "ks_d") -> DataFrame:
    """``samples`` with ``p_value`` = P(D >= d) for two samples of sizes m and n from one continuous distribution.

    Lattice paths from (0, 0) to (m, n), each step adding one point of either
    sample; a path stays inside while ``|x n - y m| < D m n``, a whole number.
    Probabilities (not counts) are propagated so large samples cannot overflow.
    The points x + y = s of one length are one array over the shorter side, and
    the next length is a ``transform`` of it, so the work is (m + n) times the
    shorter side, once for each distinct (m, n, D).  NULL D gives NULL.
    """
    one = samples.select(m, n, d).where(F.col(d).isNotNull()).distinct()
    one = one.select(m, n, d, F.greatest(m, n).cast("long").alias("_m"), F.least(m, n).cast("long").alias("_n"))
    one = one.withColumn("_t", F.round(F.col(d) * F.col("_m") * F.col("_n")).cast("long"))
    inside = """aggregate(sequence(1L, _m + _n), transform(sequence(0L, _n), y -> if(y = 0, 1D, 0D)),
      (a, s) -> transform(sequence(0L, _n), y -> if(s - y between 0 and _m and abs((s - y) * _n - y * _m) < _t,
        (a[int(y)] * (_m - (s - y) + 1) + if(y > 0, a[int(y) - 1] * (_n - y + 1), 0D)) / (_m + _n - s + 1), 0D)),
      a -> a[int(_n)])"""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.expr(inside)))
    one = one.select(F.col(m).alias("_a"), F.col(n).alias("_b"), F.col(d).alias("_d"), p.alias("p_value"))
    same = (F.col(m) == F.col("_a")) & (F.col(n) == F.col("_b")) & (F.col(d) == F.col("_d"))
    return samples.join(one, same, "left").drop("_a", "_b", "_d")


def usage_drift(daily: DataFrame, days: int = 7, alpha: float = 0.05, exact: bool = True,
                value: str = "credits_used") -> DataFrame:
    """One row per warehouse: KS distance, p-value, threshold and drift flag.

    ``exact=True`` uses the exact distribution (the library default for these
    sample sizes), whose work is sample size times window size; ``exact=False``
    the asymptotic one, native and meant for samples of many thousands.  A
    warehouse without rows on one side has NULL distance, p-value and flag.
    """
    stat = ks_statistic(daily, days, value)
    if exact:
        stat = materialize(stat, "drift")          # read for its distinct cases and for its rows
    stat = exact_p(stat) if exact else stat.withColumn("p_value", asymptotic_p())
    return (stat.withColumn("stattest", F.lit("ks"))
            .withColumn("threshold", F.lit(alpha))
            .withColumn("drift_detected", F.col("p_value") < F.lit(alpha)))


def drift_share(results: DataFrame, share: float = 0.5) -> DataFrame:
    """Dataset drift: share of drifted warehouses against ``share``."""
    return (results.agg(F.count(F.lit(1)).alias("n_columns"),
                        F.sum(F.col("drift_detected").cast("int")).alias("n_drifted"))
            .withColumn("drift_share", F.col("n_drifted") / F.col("n_columns"))
            .withColumn("dataset_drift", F.col("drift_share") >= F.lit(share)))
