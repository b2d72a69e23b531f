"""Declared schemas of every table the jobs write.

Writers cast to these, so a replace or an append can never change a column
type (the reference lost its ``DS`` column that way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CREDITS = T.DecimalType(38, 9)
SMA = T.DecimalType(38, 12)
SECONDS = T.DecimalType(38, 6)
WHOLE = T.DecimalType(38, 0)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CALENDAR = _s(
    ("usage_date", T.DateType()),
    ("year", T.ShortType()),
    ("month", T.ShortType()),
    ("month_name", T.StringType()),
    ("day_of_mon", T.ShortType()),
    ("day_of_week", T.StringType()),
    ("week_of_year", T.ShortType()),
    ("day_of_year", T.ShortType()),
)

RAW_METERING = _s(
    ("account_name", T.StringType()),
    ("service_type", T.StringType()),
    ("usage_date", T.DateType()),
    ("warehouse_name", T.StringType()),
    ("credits_used", CREDITS),
    ("credits_used_compute", CREDITS),
    ("credits_used_cloud_services", CREDITS),
    ("ds", T.DateType()),
)

METERING_METRICS = _s(
    ("warehouse_name", T.StringType()),
    ("usage_date", T.DateType()),
    ("credits_used", CREDITS),
    ("credits_used_compute", CREDITS),
    ("credits_used_cloud_services", CREDITS),
    ("credits_used_sma30", SMA),
    ("credits_used_compute_sma30", SMA),
    ("credits_used_cloud_services_sma30", SMA),
    ("credits_used_std30", T.DoubleType()),
    ("credits_used_compute_std30", T.DoubleType()),
    ("credits_used_cloud_services_std30", T.DoubleType()),
)

SEASONAL_FEATURES = _s(
    ("usage_date", T.DateType()),
    ("credits_used", CREDITS),
    ("trend", T.DoubleType()),
    ("seasonal", T.DoubleType()),
    ("residual", T.DoubleType()),
    ("warehouse_name", T.StringType()),
)

MODEL_OUTPUT_ANOMALIES = _s(
    ("warehouse_name", T.StringType()),
    ("usage_date", T.DateType()),
    ("credits_used", T.DoubleType()),
    ("trend", T.DoubleType()),
    ("seasonal", T.DoubleType()),
    ("residual", T.DoubleType()),
    ("score", T.DoubleType()),
    ("prediction_datetime", T.TimestampNTZType()),
)

WAREHOUSE_CREDITS = _s(
    ("warehouse_name", T.StringType()),
    ("warehouse_credits", CREDITS),
    ("total_time_elapsed", WHOLE),
    ("effective_rate", CREDITS),
    ("ds", T.DateType()),
)

QUERY_HISTORY = _s(
    ("query_id", T.StringType()),
    ("query_text", T.StringType()),
    ("database_name", T.StringType()),
    ("schema_name", T.StringType()),
    ("warehouse_name", T.StringType()),
    ("warehouse_size", T.StringType()),
    ("warehouse_type", T.StringType()),
    ("user_name", T.StringType()),
    ("role_name", T.StringType()),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
    ("error_code", T.StringType()),
    ("execution_status", T.StringType()),
    ("execution_time_sec", SECONDS),
    ("total_elapsed_time", WHOLE),
    ("total_elapsed_time_sec", SECONDS),
    ("queued_overload_time", WHOLE),
    ("queued_pct", T.DoubleType()),
    ("query_time_rank", T.LongType()),
    ("rows_deleted", WHOLE),
    ("rows_inserted", WHOLE),
    ("rows_produced", WHOLE),
    ("rows_unloaded", WHOLE),
    ("rows_updated", WHOLE),
    ("airflow_dag_id", T.StringType()),
    ("airflow_task_id", T.StringType()),
    ("airflow_run_id", T.StringType()),
    ("airflow_logical_date", T.TimestampNTZType()),
    ("airflow_started", T.TimestampNTZType()),
    ("airflow_operator", T.StringType()),
    ("ds", T.DateType()),
)

STORAGE_COST = _s(
    ("usage_date", T.DateType()),
    ("database_id", WHOLE),
    ("database_name", T.StringType()),
    ("database_bytes", T.DoubleType()),
    ("database_terabytes", T.DoubleType()),
    ("database_storage_cost", T.DoubleType()),
    ("ds", T.DateType()),
)

# Source views read by the loads (only the columns that are read).
SRC_METERING = _s(
    ("organization_name", T.StringType()),
    ("account_name", T.StringType()),
    ("region", T.StringType()),
    ("account_locator", T.StringType()),
    ("service_type", T.StringType()),
    ("start_time", T.TimestampNTZType()),
    ("end_time", T.TimestampNTZType()),
    ("warehouse_id", T.LongType()),
    ("warehouse_name", T.StringType()),
    ("credits_used", CREDITS),
    ("credits_used_compute", CREDITS),
    ("credits_used_cloud_services", CREDITS),
)

SRC_QUERY_HISTORY = _s(
    ("query_id", T.StringType()),
    ("query_text", T.StringType()),
    ("database_name", T.StringType()),
    ("schema_name", T.StringType()),
    ("warehouse_name", T.StringType()),
    ("warehouse_size", T.StringType()),
    ("warehouse_type", T.StringType()),
    ("user_name", T.StringType()),
    ("role_name", T.StringType()),
    ("start_time", T.TimestampNTZType()),
    ("end_time", T.TimestampNTZType()),
    ("error_code", T.StringType()),
    ("execution_status", T.StringType()),
    ("execution_time", T.LongType()),
    ("total_elapsed_time", T.LongType()),
    ("queued_overload_time", T.LongType()),
    ("rows_deleted", T.LongType()),
    ("rows_inserted", T.LongType()),
    ("rows_produced", T.LongType()),
    ("rows_unloaded", T.LongType()),
    ("rows_updated", T.LongType()),
    ("query_tag", T.StringType()),
)

SRC_RATES = _s(
    ("date", T.DateType()),
    ("account_name", T.StringType()),
    ("usage_type", T.StringType()),
    ("effective_rate", CREDITS),
)

SRC_STORAGE = _s(
    ("usage_date", T.DateType()),
    ("database_id", T.LongType()),
    ("database_name", T.StringType()),
    ("average_database_bytes", T.DoubleType()),
)

SRC_CURRENCY = _s(
    ("organization_name", T.StringType()),
    ("contract_number", T.StringType()),
    ("account_name", T.StringType()),
    ("account_locator", T.StringType()),
    ("region", T.StringType()),
    ("service_level", T.StringType()),
    ("usage_date", T.DateType()),
    ("usage_type", T.StringType()),
    ("currency", T.StringType()),
    ("balance_source", T.StringType()),
    ("usage_in_currency", T.DecimalType(38, 2)),
)


def without(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in names])


def conform(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, order and types.

    A missing column is an error, so a source that lost one cannot turn into
    empty data; only the columns a caller names in ``optional`` are NULL then.
    """
    cols = set(df.columns)
    lost = [f.name for f in schema.fields if f.name not in cols and f.name not in optional]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*[
        (F.col(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
