"""Filters and column pruning reach the Parquet scan of a stored source."""

from spendwatch import schemas
from spendwatch.operators import costs, metering
from spendwatch.sources import tables
from spendwatch.sources.adapters import source

from .conftest import SF


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")  # print whole filter lists
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_filter_and_pruning_reach_the_scan(spark):
    path = tables.scratch_path(spark, "metering_view")
    source(spark, SF, "metering_src").write.parquet(path)
    src = spark.read.schema(schemas.SRC_METERING).parquet(path)
    plan = _plan(metering.ingest_metering(src, "ACME", ds="2024-01-05"))
    assert "GreaterThanOrEqual(end_time" in plan and "LessThan(end_time" in plan  # pushed day range
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "region" not in read and "organization_name" not in read  # unused columns pruned


def test_partition_pruning_on_ds(spark):
    path = tables.scratch_path(spark, "qh")
    q = costs.load_query_history(source(spark, SF, "query_src"))
    q.write.partitionBy("ds").parquet(path)
    stored = tables.read_table(spark, path, schemas.QUERY_HISTORY)
    plan = _plan(stored.where("ds = date'2024-01-05'").select("query_id"))
    assert "PartitionFilters: [isnotnull(ds" in plan and "2024-01-05" in plan
