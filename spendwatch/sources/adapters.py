"""Vendor-shaped source views derived from the driver tables.

The reference reads six usage views of a warehouse vendor (metering by
organization and by account, query history, daily rate sheet, storage history,
currency usage).  Here they are SQL projections of the driver's ``events`` and
``orders`` tables.  Each adapter is one SQL template with ``{events}`` /
``{orders}`` placeholders: Spark binds DataFrames into it
(``spark.sql(text, events=df)``) and the DuckDB oracle uses the same text with
its own view names, so both engines see identical inputs.  The only dialect
difference, reading a key of a JSON text, is the ``@K@`` marker.

All adapters are plain scans, projections and grouped sums: they grow with the
driver tables and are pushed down / pruned like any other scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..schemas import conform

# JSON key access per dialect (the only difference between the two engines).
_JSON_K = {
    "spark": "get_json_object(props, '$.k')",
    "duckdb": "(props ->> '$.k')",
}

_WAREHOUSE = (
    "case when user_id % 50 = 1 then null "
    "when user_id % 20 = 0 then 'WH_shared' "
    "else 'WH_' || event_type end"
)

ADAPTERS: dict[str, str] = {
    # metering by organization (and, projected, by account)
    "metering_src": f"""
        select
            'ORG_1' as organization_name,
            case when user_id % 10 = 9 then 'OTHER' else 'ACME' end as account_name,
            'AWS_US_EAST_1' as region,
            'LOC_1' as account_locator,
            case when user_id % 7 = 3 then 'REPLICATION' else 'WAREHOUSE_METERING' end as service_type,
            date_trunc('hour', ts) as start_time,
            date_trunc('hour', ts) + interval '1' hour as end_time,
            user_id as warehouse_id,
            {_WAREHOUSE} as warehouse_name,
            cast(value as decimal(38,9)) as credits_used,
            cast(floor(value) as decimal(38,9)) as credits_used_compute,
            cast(cast(value as decimal(38,9)) - cast(floor(value) as decimal(38,9)) as decimal(38,9))
                as credits_used_cloud_services
        from {{events}}
    """,
    # raw metering table with gaps: one series per user, 30 days
    "metering_sparse": """
        select
            'ACME' as account_name,
            'WAREHOUSE_METERING' as service_type,
            cast(ts as date) as usage_date,
            'WH_' || cast(user_id as string) as warehouse_name,
            cast(sum(cast(value as decimal(38,9))) as decimal(38,9)) as credits_used,
            cast(sum(cast(floor(value) as decimal(38,9))) as decimal(38,9)) as credits_used_compute,
            cast(sum(cast(value as decimal(38,9)) - cast(floor(value) as decimal(38,9))) as decimal(38,9))
                as credits_used_cloud_services,
            cast(ts as date) as ds
        from {events}
        group by cast(ts as date), 'WH_' || cast(user_id as string)
    """,
    # raw metering table of long series (five warehouses over six years)
    "metering_long": """
        select
            'ACME' as account_name,
            'WAREHOUSE_METERING' as service_type,
            cast(o_orderdate as date) as usage_date,
            o_orderpriority as warehouse_name,
            cast(sum(cast(o_totalprice as decimal(38,9))) as decimal(38,9)) as credits_used,
            cast(sum(cast(floor(o_totalprice) as decimal(38,9))) as decimal(38,9)) as credits_used_compute,
            cast(sum(cast(o_totalprice as decimal(38,9)) - cast(floor(o_totalprice) as decimal(38,9)))
                as decimal(38,9)) as credits_used_cloud_services,
            cast(o_orderdate as date) as ds
        from {orders}
        group by cast(o_orderdate as date), o_orderpriority
    """,
    "query_src": f"""
        select
            cast(event_id as string) as query_id,
            event_type as query_text,
            'DB_' || cast(user_id % 5 as string) as database_name,
            'PUBLIC' as schema_name,
            {_WAREHOUSE} as warehouse_name,
            'X-Small' as warehouse_size,
            'STANDARD' as warehouse_type,
            'U_' || cast(user_id as string) as user_name,
            'R_' || cast(user_id % 3 as string) as role_name,
            ts as start_time,
            ts + interval '5' minute as end_time,
            case when event_type = 'error' then '00' || cast(100 + user_id % 3 as string) end as error_code,
            case when event_type = 'error' then 'FAIL' else 'SUCCESS' end as execution_status,
            cast(floor(value * 900) as bigint) as execution_time,
            case when event_id % 97 = 0 then null
                 when event_id % 89 = 0 then cast(0 as bigint)
                 else cast(floor(value * 1000) as bigint) end as total_elapsed_time,
            cast(floor(value * 50) as bigint) as queued_overload_time,
            cast(0 as bigint) as rows_deleted,
            cast(event_id % 100 as bigint) as rows_inserted,
            cast(event_id % 1000 as bigint) as rows_produced,
            cast(0 as bigint) as rows_unloaded,
            cast(0 as bigint) as rows_updated,
            case when user_id % 11 = 5 then 'not json'
                 when user_id % 13 = 5 then null
                 when user_id % 17 = 5 then '{{{{"dag_id": "adhoc"}}}}'
                 else '{{{{"dag_id": "dag_' || @K@ || '", "task_id": "task_' || event_type
                      || '", "run_id": "r' || cast(event_id as string)
                      || '", "logical_date": "' || cast(cast(ts as date) as string)
                      || 'T00:00:00", "started": "bad", "operator": "SQL"}}}}'
            end as query_tag
        from {{events}}
    """,
    # daily rate sheet: every event day x two accounts x two usage types
    "rates_src": """
        with d as (select distinct cast(ts as date) as date from {events})
        select date, 'ACME' as account_name, 'compute' as usage_type,
               cast(2.0 + (day(date) % 7) * 0.25 as decimal(38,9)) as effective_rate from d
        union all
        select date, 'ACME', 'storage', cast(2.0 + (day(date) % 7) * 0.25 as decimal(38,9)) from d
        union all
        select date, 'OTHER', 'compute', cast(2.0 + (day(date) % 7) * 0.25 as decimal(38,9)) from d
        union all
        select date, 'OTHER', 'storage', cast(2.0 + (day(date) % 7) * 0.25 as decimal(38,9)) from d
    """,
    "storage_src": """
        select
            cast(o_orderdate as date) as usage_date,
            cast(substr(o_orderpriority, 1, 1) as bigint) as database_id,
            o_orderpriority as database_name,
            cast(sum(cast(o_totalprice as decimal(38,2))) as double) * 1000000 as average_database_bytes
        from {orders}
        group by cast(o_orderdate as date), o_orderpriority
    """,
    "storage_rates_src": """
        select distinct
            cast(o_orderdate as date) as date,
            'ACME' as account_name,
            'storage' as usage_type,
            cast(20 + day(cast(o_orderdate as date)) % 3 as decimal(38,9)) as effective_rate
        from {orders}
    """,
    "currency_src": """
        select
            'ORG_1' as organization_name,
            'C-1' as contract_number,
            'ACME' as account_name,
            'LOC_1' as account_locator,
            'AWS_US_EAST_1' as region,
            'Enterprise' as service_level,
            cast(o_orderdate as date) as usage_date,
            case o_custkey % 12
                when 0 then 'storage'
                when 1 then 'overage-storage'
                when 2 then 'compute'
                when 3 then 'overage-compute'
                when 4 then 'cloud services'
                when 5 then 'automatic clustering'
                when 6 then 'serverless tasks'
                when 7 then 'snowpipe'
                when 8 then 'snowpark container'
                when 9 then 'materialized views'
                when 10 then 'data transfer'
                else case when o_custkey % 24 = 11 then 'priority support' else 'adjustment' end
            end as usage_type,
            'USD' as currency,
            'capacity' as balance_source,
            cast(o_totalprice as decimal(38,2)) as usage_in_currency
        from {orders}
    """,
}

# Driver columns the adapters read
DRIVER_COLUMNS = {
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
               "props": "string"},
    "orders": {"o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
}

# Which driver tables each adapter reads.
_READS = {
    "metering_src": ("events",),
    "metering_sparse": ("events",),
    "metering_long": ("orders",),
    "query_src": ("events",),
    "rates_src": ("events",),
    "storage_src": ("orders",),
    "storage_rates_src": ("orders",),
    "currency_src": ("orders",),
}

# Declared shapes of the adapters that stand for vendor views.
_SCHEMA = {
    "metering_src": schemas.SRC_METERING,
    "query_src": schemas.SRC_QUERY_HISTORY,
    "rates_src": schemas.SRC_RATES,
    "storage_rates_src": schemas.SRC_RATES,
    "storage_src": schemas.SRC_STORAGE,
    "currency_src": schemas.SRC_CURRENCY,
    "metering_sparse": schemas.RAW_METERING,
    "metering_long": schemas.RAW_METERING,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def adapter_sql(name: str, dialect: str) -> str:
    """SQL text of adapter ``name`` for ``dialect`` ('spark' keeps the
    placeholders for DataFrame binding; 'duckdb' names the driver views)."""
    text = ADAPTERS[name].replace("@K@", _JSON_K[dialect])
    if dialect == "duckdb":
        text = text.format(events="events", orders="orders")
    return text


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adapter ``name`` as a DataFrame over the driver tables in ``sf_dir``."""
    tables = {t: read_table(spark, sf_dir, t) for t in _READS[name]}
    df = spark.sql(adapter_sql(name, "spark"), **tables)
    return conform(df, _SCHEMA[name])


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the given adapters for the DuckDB oracle."""
    parts = [f"{n} AS ({adapter_sql(n, 'duckdb')})" for n in names]
    return "WITH " + ",\n".join(parts)
