"""Cost attribution: query history (J9), warehouse credits (J10), storage cost
(J11), credit deltas (J13), per-query cost (J14), task cost deltas (J15),
warnings (J16), currency categories and yearly roll-up (J17, J18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from . import cost_sql
from ..functions.columns import TB_BYTES, in_day, json_text, lit_date
from ..sources.tables import materialize as write_stage

RANK_BLOCK = 1 << 10        # divides the first row numbers of tasks, multiples of 2^33


def _day_filter(df: DataFrame, ts: str, ds) -> DataFrame:
    return df if ds is None else df.where(in_day(ts, ds))


def _ds(ds, default: Column) -> Column:
    return lit_date(ds) if ds is not None else default


def rank_desc_nulls_first(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``rank() over (partition by keys order by value desc nulls first)`` without
    sorting a whole key group, or all rows of one value, in one task.

    The keys, the value and a row number are dealt by ranges of (keys, value,
    row), so every task has about as many rows however hot a key or a value is.
    With the tasks' row counts as offsets each row knows its place among all;
    the first places of its key and of its value come from its own task or, for
    the first rows of a task, from one line per earlier task.  The rank is
    their difference.  Only these narrow rows are sorted.  The ranks of
    ``RANK_BLOCK`` rows that were numbered together become one array, and the
    wide rows move once, by block, to these arrays: rows that were written
    together stay together, none is sorted, and no rank is sent to the driver
    however small the files of the ranks are.
    """
    wide = write_stage(df.withColumn("_row", F.monotonically_increasing_id()), "rank_rows")
    order = [*[F.col(k) for k in keys], F.col(value).desc_nulls_first(), F.col("_row")]
    dealt = wide.select("_row", *keys, value).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = write_stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "rank_sorted")
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    what = F.struct(*keys, value)
    tasks = Window.orderBy("_task")                     # one line per task
    earlier = tasks.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_task").agg(F.max_by(what, "_at").alias("_end"), F.count(F.lit(1)).alias("_n")).select(
        "_task", F.lag("_end").over(tasks).alias("_before"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_task").orderBy("_at")
    r = (rows.join(F.broadcast(ends), "_task")
         .withColumn("_prev", F.coalesce(F.lag(what).over(own), F.col("_before")))
         .withColumn("_place", F.col("_offset") + F.col("_at") - F.shiftleft("_task", 33)))
    new_key = F.col("_prev").isNull()
    for k in keys:                                      # NULL keys (no warehouse) are keys too
        new_key = new_key | ~F.col(f"_prev.{k}").eqNullSafe(F.col(k))
    new_value = new_key | ~F.col(f"_prev.{value}").eqNullSafe(F.col(value))
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    r = r.select("_row", "_task", *[F.max(F.when(new, F.col("_place"))).over(upto).alias(n)
                                    for n, new in (("_key", new_key), ("_value", new_value))])
    r = write_stage(r, "rank_places")
    carried = r.groupBy("_task").agg(F.max("_key").alias("_k"), F.max("_value").alias("_v")).select(
        "_task", F.max("_k").over(earlier).alias("_k"), F.max("_v").over(earlier).alias("_v"))
    ranks = r.join(F.broadcast(carried), "_task").select(
        "_row", (F.coalesce("_value", "_v") - F.coalesce("_key", "_k") + 1).cast("long").alias(out))
    block = F.expr(f"_row div {RANK_BLOCK}").alias("_block")          # row numbers of a task have no gaps
    blocks = ranks.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("_row", out))).alias("_ranks")).select(
        "_block", F.col(f"_ranks.{out}").alias("_ranks"))
    place = F.pmod("_row", F.lit(RANK_BLOCK)).cast("int")
    return wide.withColumn("_block", block).join(blocks.hint("shuffle_hash"), "_block").select(
        *df.columns, F.get("_ranks", place).alias(out))


def load_query_history(src: DataFrame, ds=None, rank_strategy: str | None = "ranges") -> DataFrame:
    """One day (``ds``) or every day (``ds=None``) of queries, with parsed tags,
    seconds, queue share and the rank of elapsed time within the warehouse-day
    (``rank_strategy=None`` leaves the rank out, for the cost path that has no use for it).

    The day of a query is the date of its end.  The tag is parsed once per row
    (``try_parse_json``; bad text gives NULL) and read as text per key.  The
    queue share divides by elapsed time with ``try_divide`` (0 or NULL elapsed
    gives NULL instead of an error).  Rank orders NULL elapsed first, as the
    vendor does for descending order.  ``rank_strategy="ranges"`` (default)
    computes it without sorting a warehouse-day in one task (see
    ``rank_desc_nulls_first``); ``"window"`` is the plain rank window.
    """
    q = _day_filter(src, "end_time", ds)
    ds_col = _ds(ds, F.to_date("end_time"))
    tag = F.try_parse_json("query_tag")
    whole = schemas.WHOLE
    rank_w = Window.partitionBy("ds", "warehouse_name").orderBy(F.col("total_elapsed_time").desc_nulls_first())
    out = q.select(
        "query_id", "query_text", "database_name", "schema_name", "warehouse_name",
        "warehouse_size", "warehouse_type", "user_name", "role_name",
        F.to_date("start_time").alias("start_date"),
        F.to_date("end_time").alias("end_date"),
        "error_code", "execution_status",
        (F.col("execution_time").cast(whole) / 1000).cast(schemas.SECONDS).alias("execution_time_sec"),
        F.col("total_elapsed_time").cast(whole).alias("total_elapsed_time"),
        (F.col("total_elapsed_time").cast(whole) / 1000).cast(schemas.SECONDS).alias("total_elapsed_time_sec"),
        F.col("queued_overload_time").cast(whole).alias("queued_overload_time"),
        F.try_divide(F.col("queued_overload_time").cast("double"),
                     F.col("total_elapsed_time").cast("double")).alias("queued_pct"),
        *[F.col(c).cast(whole).alias(c) for c in
          ("rows_deleted", "rows_inserted", "rows_produced", "rows_unloaded", "rows_updated")],
        json_text(tag, "dag_id").alias("airflow_dag_id"),
        json_text(tag, "task_id").alias("airflow_task_id"),
        json_text(tag, "run_id").alias("airflow_run_id"),
        F.try_to_timestamp(json_text(tag, "logical_date")).cast("timestamp_ntz").alias("airflow_logical_date"),
        F.try_to_timestamp(json_text(tag, "started")).cast("timestamp_ntz").alias("airflow_started"),
        json_text(tag, "operator").alias("airflow_operator"),
        ds_col.alias("ds"),
    )
    if rank_strategy is None:
        return schemas.conform(out, schemas.without(schemas.QUERY_HISTORY, "query_time_rank"))
    if rank_strategy == "window":
        out = out.withColumn("query_time_rank", F.rank().over(rank_w))
    else:
        out = rank_desc_nulls_first(out, ["ds", "warehouse_name"], "total_elapsed_time", "query_time_rank")
    return schemas.conform(out, schemas.QUERY_HISTORY)


def load_warehouse_credits(queries: DataFrame, metering: DataFrame, rates: DataFrame,
                           account: str, ds=None) -> DataFrame:
    """Per warehouse and day: summed elapsed ms, credits, and the compute rate.

    Elapsed time counts queries that end on the day.  Credits count metering
    hours that start on the day and end before the next day starts (the
    reference's ``<= day end - 1 ns``; microsecond timestamps make it ``<``),
    so an hour ending at midnight belongs to no day.  Both sides are grouped
    before they are joined (map-side partial sums), and the rate is joined on
    the day: at most one row per day per account and usage type.
    """
    t = (_day_filter(queries, "end_time", ds)
         .groupBy(_ds(ds, F.to_date("end_time")).alias("ds"), "warehouse_name")
         .agg(F.sum("total_elapsed_time").cast(schemas.WHOLE).alias("total_time_elapsed")))
    m = metering
    if ds is not None:
        m = m.where((F.col("start_time") >= lit_date(ds).cast("timestamp_ntz"))
                    & (F.col("end_time") < F.date_add(lit_date(ds), 1).cast("timestamp_ntz")))
        m_day = lit_date(ds)
    else:
        m_day = F.to_date("start_time")
        m = m.where(F.col("end_time") < F.date_add(F.to_date("start_time"), 1).cast("timestamp_ntz"))
    c = (m.groupBy(m_day.alias("ds"), "warehouse_name")
         .agg(F.sum("credits_used").alias("warehouse_credits")))
    r = (rates.where((F.col("account_name") == F.lit(account)) & (F.col("usage_type") == "compute"))
         .select(F.col("date").alias("ds"), "effective_rate"))
    if ds is not None:
        r = r.where(F.col("ds") == lit_date(ds))
    out = t.join(c, ["ds", "warehouse_name"]).join(r, ["ds"])
    return schemas.conform(out, schemas.WAREHOUSE_CREDITS)


def load_storage_cost(storage: DataFrame, rates: DataFrame, account: str, ds=None) -> DataFrame:
    """Terabytes and dollars per database and day (storage rate of ``account``)."""
    u = storage if ds is None else storage.where(F.col("usage_date") == lit_date(ds))
    r = (rates.where((F.col("account_name") == F.lit(account)) & (F.col("usage_type") == "storage"))
         .select(F.col("date").alias("usage_date"), "effective_rate"))
    tb = F.col("average_database_bytes") / F.lit(float(TB_BYTES))
    out = (u.join(r, ["usage_date"])
           .select("usage_date", "database_id", "database_name",
                   F.col("average_database_bytes").alias("database_bytes"),
                   tb.alias("database_terabytes"),
                   (F.col("effective_rate").cast("double") * tb).alias("database_storage_cost"),
                   _ds(ds, F.col("usage_date")).alias("ds")))
    return schemas.conform(out, schemas.STORAGE_COST)


def warehouse_credits_delta(credits: DataFrame) -> DataFrame:
    """Credits minus the previous day's (NULL when the previous day is missing)."""
    return credits.sparkSession.sql(cost_sql.warehouse_credits_delta("{credits}"), credits=credits)


def dag_cost(queries: DataFrame, credits: DataFrame) -> DataFrame:
    """Each query's share of its warehouse-day elapsed time, in credits and dollars.

    Shares are exact decimals rounded to 6 places in the reference's order
    (share, then credits, then dollars).  The credits side is one row per
    warehouse-day; AQE broadcasts it when its measured size is small and keeps
    the shuffle join (with skew splitting) when it is not.
    """
    return queries.sparkSession.sql(cost_sql.dag_cost("{queries}", "{credits}"), queries=queries, credits=credits)


def dag_cost_delta(cost: DataFrame, by_warehouse: bool = False, last_day=None) -> DataFrame:
    """Task cost of the last day against 1, 7 and 28 days before, plus the same
    comparison one day earlier (the "yesterday warning").

    The reference scans and groups the cost four times; here it is grouped once
    over the seven days it needs (last, -1, -2, -7, -8, -28, -29), and one
    shuffle on the task lines the days up (see ``cost_sql``).  The last day
    (``last_day``, else one scalar fetched first) is a literal, so a
    ds-partitioned cost table is pruned to the seven days; callers that know
    the last partition pass it and save the first pass.  As in the reference,
    the periods are keyed on (task, dag, shifted day) without the warehouse, so
    a task that ran in several warehouses multiplies rows; ``by_warehouse=True``
    adds the warehouse to the keys.  Rows without a task are kept for the last
    day only.
    """
    if last_day is None:
        last_day = cost.agg(F.max("ds")).first()[0]  # one scalar; as a literal it prunes ds partitions
    last = f"date'{last_day}'" if last_day is not None else "cast(null as date)"
    return cost.sparkSession.sql(cost_sql.dag_cost_delta("{cost}", last, by_warehouse), cost=cost)


def dag_cost_warnings(delta: DataFrame, usd: float = cost_sql.USD, pct: float = cost_sql.PCT) -> DataFrame:
    """Rows whose change against some period exceeds both the dollar and the
    percent limit; direction of the change; rebounds suppressed.

    A warning is dropped when yesterday had a warning for the same period in
    the opposite direction (cost returning to normal).  Percent is measured on
    credits and the limit on dollars, so a rate change alone cannot trigger.
    """
    return delta.sparkSession.sql(cost_sql.dag_cost_warnings("{delta}", usd, pct), delta=delta)


# Usage type patterns -> (rating type, resource type); first match wins.
COST_CATEGORY_RULES = (
    ("%storage", "storage", "storage"),
    ("%compute", "compute", "virtual warehouse"),
    ("%cloud services", "compute", "cloud services"),
    ("%automatic clustering", "compute", "serverless"),
    ("serverless tasks", "compute", "serverless"),
    ("%snowpipe%", "compute", "serverless"),
    ("%snowpark%", "compute", "serverless"),
    ("%materialized views", "compute", "serverless"),
    ("%data transfer", "data transfer", "data transfer"),
    ("%support%", "other", "other"),
)


def cost_categories(currency: DataFrame, account: str | None = None, start=None, end=None) -> DataFrame:
    """Currency usage with rating and resource type from the usage type ('' when none matches)."""
    df = currency
    if account is not None:
        df = df.where(F.col("account_name") == F.lit(account))
    if start is not None and end is not None:
        df = df.where(F.col("usage_date").between(lit_date(start), lit_date(end)))
    rating = resource = None
    for pat, rat, res in COST_CATEGORY_RULES:
        cond = F.col("usage_type").like(pat)
        rating = F.when(cond, F.lit(rat)) if rating is None else rating.when(cond, F.lit(rat))
        resource = F.when(cond, F.lit(res)) if resource is None else resource.when(cond, F.lit(res))
    return df.select(
        "organization_name", "contract_number", "account_name", "account_locator", "region",
        "service_level", "usage_date", "usage_type", "currency", "balance_source",
        rating.otherwise(F.lit("")).alias("rating_type"),
        resource.otherwise(F.lit("")).alias("resource_type"),
        "usage_in_currency")


# The categories the rules can give, the empty one included.
COST_CATEGORIES = tuple(dict.fromkeys([f"{rat} | {res}" for _, rat, res in COST_CATEGORY_RULES] + [" | "]))


def cost_by_year(categorized: DataFrame) -> DataFrame:
    """Year x (rating type | resource type) matrix of summed currency, 0 where empty."""
    key = F.concat_ws(" | ", "rating_type", "resource_type").alias("category")
    wide = (categorized.select(F.year("usage_date").alias("year"), key, "usage_in_currency")
            .groupBy("year").pivot("category", list(COST_CATEGORIES)).agg(F.sum("usage_in_currency")))
    return wide.na.fill(0, subset=list(COST_CATEGORIES))
