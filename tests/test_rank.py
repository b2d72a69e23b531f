import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from spendwatch.operators.costs import rank_desc_nulls_first


def test_histogram_rank_equals_window_rank(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        ds = rnd.choice(["2024-01-01", "2024-01-02"])
        wh = rnd.choice(["A", "B", "C", None])  # C is rare, None is a key too
        v = None if rnd.random() < 0.05 else rnd.choice([0, 999, 1000, 1001, rnd.randint(0, 50_000)])
        rows.append((i, ds, wh, v))
    df = spark.createDataFrame(rows, "id long, ds string, warehouse_name string, total_elapsed_time long")
    want = df.withColumn("r", F.rank().over(
        Window.partitionBy("ds", "warehouse_name").orderBy(F.col("total_elapsed_time").desc_nulls_first())))
    got = rank_desc_nulls_first(df, ["ds", "warehouse_name"], "total_elapsed_time", "r")
    a = {r.id: r.r for r in want.collect()}
    b = {r.id: r.r for r in got.collect()}
    assert a == b


def test_ranks_meet_wide_rows_by_block(spark):
    """The ranks of neighbouring rows move as one array by a shuffle: never broadcast row by row, however small, and the wide rows
    are not sorted."""
    from spendwatch.operators.costs import RANK_BLOCK
    df = spark.range(0, 3 * RANK_BLOCK + 700, 1, 2).selectExpr(
        "id", "if(id % 7 = 0, null, id % 3) as k", "if(id % 11 = 0, null, id * 7919 % 400) as v", "'text' || id as wide")
    got = rank_desc_nulls_first(df, ["k"], "v", "r")
    want = df.withColumn("r", F.rank().over(Window.partitionBy("k").orderBy(F.col("v").desc_nulls_first())).cast("long"))
    assert got.columns == want.columns and got.count() == df.count() and got.exceptAll(want).count() == 0
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [x for x in plan.splitlines() if "Join [" in x]
    assert "ShuffledHashJoin [_block" in joins[0] and not any("[_row" in x for x in joins)
    assert "SortMergeJoin" not in plan
