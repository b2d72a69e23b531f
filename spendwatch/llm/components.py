"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise; a path halves, a star stays.  The rounds
    end when only stars are left.  Minima are grouped map-side first and joined
    back on the node, a join that AQE may split, so a node with very many
    neighbours is no single task's work.  Each round is written once; only one
    count reaches the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = materialize(small.where("a <> b").distinct(), "cc")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node of ``e`` (a > b, distinct) is the centre or a leaf of one star."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                      F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    deg = ends.groupBy("x.n").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return not deg.where("up > 1 or (up = 1 and down = 1)").limit(1).count()
