"""DuckDB SQL for every registered query, written independently of the Spark
jobs from the reference's SQL and the documented semantics.

The driver tables are views named after themselves; the adapters come from the
same SQL templates Spark uses (``duck_cte``).  Exact decimal arithmetic is kept
where the jobs keep it: DuckDB turns decimal division into a double, so the
6-place shares are computed with integer half-up rounding instead.
"""

from __future__ import annotations

from ..operators.costs import COST_CATEGORY_RULES
from ..sources.adapters import DRIVER_COLUMNS
from ..sources.adapters import duck_cte as _duck_cte

ORACLE: dict[str, str] = {}


def duck_cte(*names: str) -> str:
    return _duck_cte(*names).replace("WITH ", "WITH RECURSIVE ", 1)


def r6(x: str) -> str:
    return f"round(cast({x} as double), 6)"


ORACLE["calendar"] = f"""
{duck_cte('metering_sparse')},
s AS (select min(usage_date) as d from metering_sparse),
days AS (select cast(d + cast(range as integer) as date) as usage_date from s, range(1826))
select usage_date,
       cast(year(usage_date) as smallint) as year,
       cast(month(usage_date) as smallint) as month,
       strftime(usage_date, '%b') as month_name,
       cast(day(usage_date) as smallint) as day_of_mon,
       cast(dayofweek(usage_date) as varchar) as day_of_week,
       cast(weekofyear(usage_date) as smallint) as week_of_year,
       cast(dayofyear(usage_date) as smallint) as day_of_year
from days
"""

_INGEST = """
select account_name, service_type, day as usage_date, warehouse_name, sum(credits_used) as credits_used,
       sum(credits_used_compute) as credits_used_compute,
       sum(credits_used_cloud_services) as credits_used_cloud_services, day as ds
from (select * exclude (end_time), end_time::date as day from metering_src
      where account_name = 'ACME' and warehouse_id > 0)
group by all
"""

ORACLE["ingest_metering"] = f"{duck_cte('metering_src')}\n{_INGEST}"


def _without_first_day(body: str, key: str) -> str:
    """A reload leaves every day but the first, which was loaded again from an empty source."""
    return f"select * from ({body}) where {key} > (select min({key}) from ({body}))"


ORACLE["ingest_reload"] = f"{duck_cte('metering_src')}\n{_without_first_day(_INGEST, 'usage_date')}"

ORACLE["missing_dates"] = f"""
{duck_cte('metering_long')},
b AS (select min(usage_date) as s, max(usage_date) as e from metering_long)
select count(distinct usage_date) as loaded_dates,
       cast(max(b.e) - max(b.s) as integer) as total_dates,
       cast(max(b.e) - max(b.s) as integer) - count(distinct usage_date) as missing_dates
from metering_long, b
where usage_date between b.s and b.e
"""

ORACLE["missing_dates_list"] = f"""
{duck_cte('metering_long')},
b AS (select min(usage_date) as s, max(usage_date) as e from metering_long),
d AS (select cast(unnest(generate_series(s, e, interval 1 day)) as date) as usage_date from b)
select usage_date from d where usage_date not in (select usage_date from metering_long)
"""

_MEASURES = ("credits_used", "credits_used_compute", "credits_used_cloud_services")


def _zeros(src: str, measures) -> str:
    """A row of zeros for every named warehouse and day between the first and last day of the source."""
    return (f"select warehouse_name, unnest(generate_series(lo, hi, interval 1 day))::date as usage_date, "
            f"{', '.join(f'0 as {m}' for m in measures)} from (select distinct warehouse_name from {src} "
            f"where warehouse_name is not null), (select min(usage_date) as lo, max(usage_date) as hi from {src})")


def _daily(src: str, measures) -> str:
    return (f"select warehouse_name, usage_date, {', '.join(f'sum({m})::decimal(38,9) as {m}' for m in measures)} "
            f"from (select warehouse_name, usage_date, {', '.join(measures)} from {src} where warehouse_name is not null "
            f"union all {_zeros(src, measures)}) group by all")


def _metrics_of(src: str) -> str:
    moving = ", ".join(f"{f}({m}) over month as {m}_{n}" for f, n in (("avg", "sma30"), ("stddev_samp", "std30"))
                       for m in _MEASURES)
    return f"""metrics AS (select *, {moving} from ({_daily(src, _MEASURES)})
  window month as (partition by warehouse_name order by usage_date rows 29 preceding))"""


_METRICS_BODY = _metrics_of("metering_sparse")


def _metrics_out(digits: int, src: str = "metrics") -> str:
    cols = [f"{m}_{n}" for n in ("sma30", "std30") for m in _MEASURES]
    return (f"select warehouse_name, usage_date, {', '.join(_MEASURES)}, "
            f"{', '.join(f'round(cast({c} as double), {digits}) as {c}' for c in cols)} from {src}")


ORACLE["metering_metrics"] = f"{duck_cte('metering_sparse')},\n{_METRICS_BODY}\n{_metrics_out(6)}"
ORACLE["metering_metrics_long"] = f"{duck_cte('metering_long')},\n{_metrics_of('metering_long')}\n{_metrics_out(3)}"

LONG_WAREHOUSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _wide(names, key: str, value: str) -> str:
    """One column per name, summed."""
    return ", ".join(f"""coalesce(sum(case when {key} = '{n}' then {value} end), 0) as "{n}\"""" for n in names)


def _by_year(where: str = "warehouse_name is not null") -> str:
    return (f"{duck_cte('metering_long')}\nselect year(usage_date)::integer as year, "
            f"{_wide(LONG_WAREHOUSES, 'warehouse_name', 'credits_used')} from metering_long where {where} group by 1")


ORACLE["usage_by_year"] = _by_year()
ORACLE["usage_by_year_range"] = _by_year("usage_date between date '1996-03-01' and date '1999-02-28'")
ORACLE["usage_by_year_long"] = f"""{duck_cte('metering_long')}
select year(usage_date)::integer as year, warehouse_name, sum(credits_used) as credits_used
from metering_long where warehouse_name is not null group by all"""

_FILL = f"filled AS ({_daily('metering_long', ('credits_used',))})"

ORACLE["fill_daily_gaps"] = f"{duck_cte('metering_long')},\n{_FILL}\nselect * from filled"

ORACLE["weekly_usage"] = f"""
{duck_cte('metering_long')},
{_FILL}
select warehouse_name,
       cast(usage_date + cast((7 - dayofweek(usage_date)) % 7 as integer) as date) as usage_date,
       cast(sum(credits_used) as decimal(38,9)) as credits_used
from filled group by 1, 2
"""

# ---------------------------------------------------------------- costs

_QH = """
qh AS (
  select query_id, query_text, database_name, schema_name, warehouse_name, warehouse_size, warehouse_type,
         user_name, role_name,
         cast(start_time as date) as start_date,
         cast(end_time as date) as end_date,
         error_code, execution_status,
         cast(cast(execution_time as decimal(38,0)) * cast(0.001 as decimal(4,3)) as decimal(38,6))
             as execution_time_sec,
         cast(total_elapsed_time as decimal(38,0)) as total_elapsed_time,
         cast(cast(total_elapsed_time as decimal(38,0)) * cast(0.001 as decimal(4,3)) as decimal(38,6))
             as total_elapsed_time_sec,
         cast(queued_overload_time as decimal(38,0)) as queued_overload_time,
         cast(queued_overload_time as double) / nullif(cast(total_elapsed_time as double), 0) as queued_pct,
         rank() over (partition by cast(end_time as date), warehouse_name
                      order by total_elapsed_time desc nulls first) as query_time_rank,
         cast(rows_deleted as decimal(38,0)) as rows_deleted,
         cast(rows_inserted as decimal(38,0)) as rows_inserted,
         cast(rows_produced as decimal(38,0)) as rows_produced,
         cast(rows_unloaded as decimal(38,0)) as rows_unloaded,
         cast(rows_updated as decimal(38,0)) as rows_updated,
         case when json_valid(query_tag) then json_extract_string(query_tag, '$.dag_id') end as airflow_dag_id,
         case when json_valid(query_tag) then json_extract_string(query_tag, '$.task_id') end as airflow_task_id,
         case when json_valid(query_tag) then json_extract_string(query_tag, '$.run_id') end as airflow_run_id,
         try_cast(case when json_valid(query_tag) then json_extract_string(query_tag, '$.logical_date') end
                  as timestamp) as airflow_logical_date,
         try_cast(case when json_valid(query_tag) then json_extract_string(query_tag, '$.started') end
                  as timestamp) as airflow_started,
         case when json_valid(query_tag) then json_extract_string(query_tag, '$.operator') end as airflow_operator,
         cast(end_time as date) as ds
  from query_src)
"""

_WC = """
used AS (select end_time::date as ds, warehouse_name, total_elapsed_time as ms, null::decimal(38,9) as credits,
           true as is_query from query_src
         union all
         select start_time::date, warehouse_name, null, credits_used, false from metering_src
         where start_time::date = end_time::date),
wc AS (select warehouse_name, sum(credits) as warehouse_credits, sum(ms)::decimal(38,0) as total_time_elapsed,
         effective_rate, used.ds
       from used join rates_src on rates_src.date = used.ds and usage_type = 'compute' and account_name = 'ACME'
       where warehouse_name is not null
       group by warehouse_name, effective_rate, used.ds
       having bool_or(is_query) and not bool_and(is_query))
"""

ORACLE["query_history"] = f"{duck_cte('query_src')},\n{_QH}\nselect * from qh"

ORACLE["warehouse_credits"] = f"{duck_cte('query_src', 'metering_src', 'rates_src')},\n{_WC}\nselect * from wc"

ORACLE["credits_delta"] = f"""
{duck_cte('query_src', 'metering_src', 'rates_src')},
{_WC}
select warehouse_name, warehouse_credits, ds,
       case when lag(ds) over d = ds - 1 then warehouse_credits - lag(warehouse_credits) over d end
           as warehouse_credits_delta_yesterday
from wc window d as (partition by warehouse_name order by ds)
"""

ORACLE["query_history_reload"] = f"{duck_cte('query_src')},\n{_QH}\n{_without_first_day('select * from qh', 'ds')}"
ORACLE["warehouse_credits_reload"] = (f"{duck_cte('query_src', 'metering_src', 'rates_src')},\n{_WC}\n"
                                      f"{_without_first_day('select * from wc', 'ds')}")

ORACLE["storage_cost"] = f"""
{duck_cte('storage_src', 'storage_rates_src')}
select u.usage_date, cast(u.database_id as decimal(38,0)) as database_id, u.database_name,
       {r6('u.average_database_bytes')} as database_bytes,
       {r6('u.average_database_bytes / 1099511627776.0')} as database_terabytes,
       {r6('cast(r.effective_rate as double) * (u.average_database_bytes / 1099511627776.0)')}
           as database_storage_cost,
       u.usage_date as ds
from storage_src u join storage_rates_src r on u.usage_date = r.date
where r.account_name = 'ACME' and r.usage_type = 'storage'
"""

ORACLE["storage_cost_reload"] = _without_first_day(ORACLE["storage_cost"], "ds")


def _half_up_div6(num: str, den: str) -> str:
    """round(num / den, 6) for non-negative whole numbers, exact, as DECIMAL(38,6)."""
    return (f"case when {den} is null or {den} = 0 or {num} is null then null else "
            f"cast((cast({num} as hugeint) * 2000000 + cast({den} as hugeint)) // (2 * cast({den} as hugeint))"
            f" as decimal(38,0)) * cast(0.000001 as decimal(7,6)) end")


_DC = f"""
dc AS (
  select d.*,
         cast({_half_up_div6('d.total_elapsed_time', 'c.total_time_elapsed')} as decimal(38,6)) as warehouse_pct,
         cast(round(cast({_half_up_div6('d.total_elapsed_time', 'c.total_time_elapsed')} as decimal(38,6))
                    * c.warehouse_credits, 6) as decimal(38,6)) as task_credit_cost,
         cast(round(cast(round(cast({_half_up_div6('d.total_elapsed_time', 'c.total_time_elapsed')}
                                    as decimal(38,6)) * c.warehouse_credits, 6) as decimal(38,6))
                    * c.effective_rate, 6) as decimal(38,6)) as task_dollar_cost
  from qh d join wc c on d.warehouse_name = c.warehouse_name and d.ds = c.ds)
"""

ORACLE["dag_cost"] = f"""
{duck_cte('query_src', 'metering_src', 'rates_src')},
{_QH}, {_WC}, {_DC}
select * from dc
"""


_OFFSETS = {"yesterday": 1, "last_week": 7, "last_month": 28}


def _delta_sql(by_warehouse: bool = False) -> str:
    """Task sums of the days that matter; the sums 1, 7 and 28 days older are lists, unnested one
    after the other, so several matches multiply rows as joins would."""
    key = ["airflow_dag_id", "airflow_task_id"] + ["warehouse_name"] * by_warehouse
    steps, last = [], "recent"
    for n, k in _OFFSETS.items():
        on = " and ".join(f"o.{c} = c.{c}" for c in key)
        steps.append(f"with_{n} AS (select c.*, unnest(coalesce(o.sums, [null])) as {n} from {last} c "
                     f"left join older o on {on} and o.age = c.age + {k})")
        last = f"with_{n}"
    change = {f"{u}_delta_{n}": f"{u} - {n}.{u}" for n in _OFFSETS for u in ("dollar", "credit")}
    change |= {f"pct_change_{n}": f"credit::double / nullif({n}.credit, 0)::double - 1" for n in _OFFSETS}
    return f"""
newest AS (select max(ds) as day from dc),
aged AS (select *, day - ds as age from dc, newest),
sums AS (select airflow_dag_id, airflow_task_id, warehouse_name, ds, age, sum(task_dollar_cost) as dollar,
           sum(task_credit_cost) as credit from aged where age in (0, 1, 2, 7, 8, 28, 29) group by all),
older AS (select {', '.join(key)}, age, list({{'dollar': dollar, 'credit': credit}}) as sums
          from sums where airflow_task_id is not null group by all),
recent AS (select * from sums where age = 0 or age = 1 and airflow_task_id is not null),
{', '.join(steps)},
warned AS (select {', '.join(key)}, {', '.join(f'{e} as yesterday_warn_{c}' for c, e in change.items())}
           from {last} where age = 1),
delta AS (select r.ds, r.airflow_dag_id, r.airflow_task_id, r.warehouse_name,
            dollar as task_dollar_cost_today, credit as task_credit_cost_today,
            {', '.join(f'{n}.{u} as task_{u}_cost_{n}' for n in _OFFSETS for u in ('dollar', 'credit'))},
            {', '.join(f'{e} as {c}' for c, e in change.items())}, w.* exclude ({', '.join(key)})
          from {last} r left join warned w on {' and '.join(f'w.{c} = r.{c}' for c in key)} where age = 0)
"""


_PCT_COLS = [f"{p}pct_change_{n}" for p in ("", "yesterday_warn_") for n in _OFFSETS]


def _rounded(cols: list[str], source: str) -> str:
    return f"select * replace ({', '.join(f'{r6(c)} as {c}' for c in cols)}) from {source}"


_COST = f"{duck_cte('query_src', 'metering_src', 'rates_src')},\n{_QH}, {_WC}, {_DC}"

ORACLE["dag_cost_delta"] = f"{_COST}, {_delta_sql()} {_rounded(_PCT_COLS, 'delta')}"
ORACLE["dag_cost_delta_by_warehouse"] = f"{_COST}, {_delta_sql(True)} {_rounded(_PCT_COLS, 'delta')}"


def _first_hit(prefix: str) -> str:
    """The first period over both limits."""
    periods = ", ".join(f"{{'label': '{n.replace('_', ' ')}', 'usd': {prefix}dollar_delta_{n}, "
                        f"'pct': {prefix}pct_change_{n}}}" for n in _OFFSETS)
    return f"list_filter([{periods}], lambda p: abs(p.usd) > 25 and abs(p.pct) > 0.33)[1]"


_WORD = "case sign({0}.pct) when 1 then 'increase' when -1 then 'decrease' end"

ORACLE["dag_cost_warnings"] = f"""{_COST}, {_delta_sql()},
hits AS (select *, {_first_hit('')} as now, {_first_hit('yesterday_warn_')} as before from delta),
named AS (select * exclude (now, before), now.label as trigger_period, {_WORD.format('now')} as change_type,
            before.label as yesterday_warn_trigger_period, {_WORD.format('before')} as yesterday_warn_change_type
          from hits where now is not null)
select columns(c -> c not like 'yesterday_warn_%' or c like '%trigger_period' or c like '%change_type')
from ({_rounded(_PCT_COLS[:3], 'named')})
where coalesce(trigger_period <> yesterday_warn_trigger_period or change_type = yesterday_warn_change_type, true)
""".replace("columns(c -> ", "columns(lambda c: ")

_CAT = f"""
rules AS (select unnest([{', '.join(f"{{'n': {i}, 'pattern': '{p}', 'rating': '{a}', 'resource': '{b}'}}"
                                    for i, (p, a, b) in enumerate(COST_CATEGORY_RULES))}], recursive := true)),
kinds AS (select usage_type, arg_min(rating, n) as rating, arg_min(resource, n) as resource
          from (select distinct usage_type from currency_src) join rules on usage_type like pattern group by all),
cat AS (select c.* exclude (usage_in_currency), coalesce(rating, '') as rating_type,
          coalesce(resource, '') as resource_type, usage_in_currency
        from currency_src c left join kinds using (usage_type) where account_name = 'ACME')
"""

ORACLE["cost_categories"] = f"{duck_cte('currency_src')},\n{_CAT}\nselect * from cat"
ORACLE["cost_categories_range"] = (f"{duck_cte('currency_src')},\n{_CAT}\nselect * from cat "
                                   "where usage_date >= date '1996-03-01' and usage_date < date '1997-03-01'")

_CATEGORIES = sorted({f"{a} | {b}" for _, a, b in COST_CATEGORY_RULES} | {" | "})

ORACLE["cost_by_year"] = f"""{duck_cte('currency_src')},
{_CAT}
select year(usage_date)::integer as year, {_wide(_CATEGORIES, "rating_type || ' | ' || resource_type", 'usage_in_currency')}
from cat group by 1"""

ORACLE["source_check"] = " union all ".join(
    f"select '{t}' as source, '{c}' as column_name, '{k}' as expected_type, '{k}' as actual_type, true as present, "
    f"true as type_ok, count(*) as n_rows, count(*) - count({c}) as n_null from {t}"
    for t, cols in DRIVER_COLUMNS.items() for c, k in cols.items())

# ---------------------------------------------------------------- decomposition


def decompose_sql(src: str, two_sided: bool, period: int = 7, prefix: str = "dx") -> str:
    """CTE chain decomposing the dense series in ``src`` (warehouse_name, usage_date, credits_used);
    the last CTE is ``{prefix}_out``."""
    h = period // 2
    if two_sided:
        t0 = (f"case when i >= {h} and i <= n - 1 - {h} then avg(x) over (partition by warehouse_name "
              f"order by usage_date rows between {h} preceding and {h} following) end")
        front, back = f"{h}", f"n - 1 - {h}"
    else:
        t0 = (f"case when i >= {period - 1} then avg(x) over (partition by warehouse_name "
              f"order by usage_date rows between {period - 1} preceding and current row) end")
        front, back = f"{period - 1}", "n - 1"
    head = f"i >= {front} and i < least({front} + {period}, {back})"
    tail = f"i >= greatest({front}, {back} - {period}) and i < {back}"
    p = prefix
    return f"""
{p}_0 AS (select warehouse_name, usage_date, credits_used, cast(credits_used as double) as x,
          row_number() over (partition by warehouse_name order by usage_date) - 1 as i,
          count(*) over (partition by warehouse_name) as n
        from {src}),
{p}_1 AS (select *, {t0} as t0 from {p}_0 where n >= {2 * period}),
{p}_l AS (select warehouse_name,
          regr_slope(t0, cast(i as double)) filter (where {head}) as hs,
          regr_intercept(t0, cast(i as double)) filter (where {head}) as hi,
          regr_slope(t0, cast(i as double)) filter (where {tail}) as ts,
          regr_intercept(t0, cast(i as double)) filter (where {tail}) as ti
        from {p}_1 group by warehouse_name),
{p}_2 AS (select a.*, case when i < {front} then hs * i + hi when i > {back} then ts * i + ti else t0 end as trend
        from {p}_1 a join {p}_l using (warehouse_name)),
{p}_3 AS (select *, x - trend as det, i % {period} as ph from {p}_2),
{p}_p AS (select warehouse_name, ph, avg(det) as pm from {p}_3 group by 1, 2),
{p}_c AS (select warehouse_name, avg(pm) as c from {p}_p group by 1),
{p}_out AS (select a.usage_date, cast(a.credits_used as decimal(38,9)) as credits_used, a.trend,
                 p.pm - c.c as seasonal, a.det - (p.pm - c.c) as residual, a.warehouse_name
          from {p}_3 a join {p}_p p on a.warehouse_name = p.warehouse_name and a.ph = p.ph
               join {p}_c c on a.warehouse_name = c.warehouse_name)"""


def _rounded_components(src: str, digits: int) -> str:
    return (f"select usage_date, credits_used, round(trend, {digits}) as trend, "
            f"round(seasonal, {digits}) as seasonal, round(residual, {digits}) as residual, "
            f"warehouse_name from {src}")


ORACLE["seasonal_two_sided"] = f"""
{duck_cte('metering_sparse')},
{_METRICS_BODY},
{decompose_sql('metrics', True)}
{_rounded_components('dx_out', 6)}
"""

ORACLE["seasonal_one_sided"] = f"""
{duck_cte('metering_long')},
{_FILL},
{decompose_sql('filled', False)}
{_rounded_components('dx_out', 3)}
"""


# ---------------------------------------------------------------- forests


def _c(n: str) -> str:
    return (f"(case when {n} <= 1 then 0.0 when {n} = 2 then 1.0 "
            f"else 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} end)")


def _mix() -> str:
    a = "((tseed * 69069 + cast(node as bigint) * 362437 + 1) % 2147483648)"
    b = f"(({a} * 1103515245 + 12345) % 2147483648)"
    c = f"(({b} * 1103515245 + 12345) % 2147483648)"
    return f"(cast({c} as double) / 2147483648.0)"


def _permute(v: str) -> str:
    """Three rounds of odd multiplier, shift and xor with the high half, on k-bit numbers."""
    for r in (1, 2, 3):
        v = f"(({v} * ((2 * tseed * {r} + 2 * {r} + 1) % (1::bigint << k)) + tseed + {r}) % (1::bigint << k))"
        v = f"xor({v}, {v} >> ((k + 1) // 2))"
    return v


def forest_sql(src: str, p: str, n_trees: int = 100, max_samples: int = 256, seed: int = 0,
               levels: int = 8) -> str:
    """CTEs growing seeded isolation trees over ``src`` (warehouse_name, usage_date, x, ...);
    ``{p}_g`` holds every row x tree with its leaf, ``{p}_leaves`` the leaves."""
    s = [f"""
{p}_n AS (select warehouse_name, n, least(n, {max_samples}) as psi, greatest(1, ceil(log2(n)))::integer as k, tree_id,
            ('0x' || substr(md5(concat_ws('|', '{seed}', warehouse_name, tree_id::varchar)), 1, 7))::bigint as tseed
          from (select warehouse_name, count(*) as n from {src} group by all),
               (select unnest(range({n_trees})) as tree_id)),
{p}_w AS (select * exclude (j), {_permute('j')} as v
          from (select *, unnest(range(psi)) as j from {p}_n where n > {max_samples})
          union all select * exclude (v), {_permute('v')} as v from {p}_w where v >= n),
{p}_d AS (select warehouse_name, tree_id, v as pos from {p}_w where v < n
          union all select warehouse_name, tree_id, unnest(range(n)) from {p}_n where n <= {max_samples}),
{p}_t AS (select b.*, t.psi, t.tseed, ceil(log2(greatest(t.psi, 2))) as dl, t.tree_id
          from (select *, row_number() over (partition by warehouse_name order by usage_date) - 1 as pos from {src}) b
               join {p}_n t using (warehouse_name)),
{p}_0 AS (select t.*, d.pos is not null as sampled, 1 as node, 0 as depth, '-inf'::double as lo, 'inf'::double as hi
          from {p}_t t left join {p}_d d on d.warehouse_name = t.warehouse_name and d.tree_id = t.tree_id and d.pos = t.pos)"""]
    for k in range(levels):
        a, b = f"{p}_{k}", f"{p}_{k + 1}"
        s.append(f"""
{a}s AS (select *, min(case when sampled then x end) over w as slo,
            max(case when sampled then x end) over w as shi,
            count(case when sampled then x end) over w as scnt
          from {a} window w as (partition by warehouse_name, tree_id, node)),
{a}p AS (select *, (depth < dl and scnt >= 2 and shi > slo + 1e-7) as ok,
            case when slo + {_mix()} * (shi - slo) >= shi then slo
                 else slo + {_mix()} * (shi - slo) end as split
          from {a}s),
{b} AS (select * exclude (slo, shi, scnt, ok, split, node, depth, lo, hi),
          case when ok then node * 2 + cast(x > split as integer) else node end as node,
          depth + cast(ok as integer) as depth,
          case when ok and x > split then split else lo end as lo,
          case when ok and not (x > split) then split else hi end as hi
        from {a}p)""")
    s.append(f"""
{p}_g AS (select *, depth + {_c('count(case when sampled then 1 end) over (partition by warehouse_name, tree_id, node)')}
            as path_len from {p}_{levels}),
{p}_leaves AS (select distinct warehouse_name, tree_id, node, lo, hi, path_len from {p}_g where sampled),
{p}_sc AS (select warehouse_name, usage_date, any_value(x) as x, any_value(psi) as psi,
             0.5 - pow(2.0, -avg(path_len) / {_c('any_value(psi)')}) as score
           from {p}_g group by warehouse_name, usage_date),
{p}_st AS (select warehouse_name, avg(score) as score_mean, stddev_samp(score) as score_std,
             any_value(psi) as psi from {p}_sc group by warehouse_name)""")
    return ",".join(s)


_FEATS = f"""
{duck_cte('metering_sparse')},
{_METRICS_BODY},
{decompose_sql('metrics', True)},
last AS (select max(usage_date) as d from dx_out),
train AS (select warehouse_name, usage_date, credits_used, coalesce(residual, 0) as x
          from dx_out where usage_date < (select d from last) - 7),
{forest_sql('train', 'fz')}
"""

ORACLE["forest_model"] = f"""
{_FEATS}
select warehouse_name, cast(tree_id as integer) as tree_id, node, round(lo, 6) as lo, round(hi, 6) as hi, round(path_len, 6) as path_len,
       2::bigint as model_version
from fz_leaves
"""


def _meta_sql(p: str, version: int) -> str:
    return (f"select warehouse_name, {version}::bigint as model_version, 100 as n_trees, psi, round({_c('psi')}, 6) as c_psi, "
            f"round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, "
            f"round(score_mean - 3 * score_std, 6) as threshold from {p}_st")


ORACLE["model_reload"] = f"""
{_FEATS},
earlier AS (select warehouse_name, usage_date, credits_used, coalesce(residual, 0) as x
            from dx_out where usage_date < (select d from last) - 14),
{forest_sql('earlier', 'fe')}
{_meta_sql('fe', 1)} union all {_meta_sql('fz', 2)}
"""

ORACLE["forest_train_anomalies"] = f"""
{_FEATS},
sc AS (select s.warehouse_name, s.usage_date, t.credits_used, s.x as residual, s.score,
              st.score_mean, st.score_std, st.score_mean - 3 * st.score_std as threshold,
              avg(cast(t.credits_used as double)) over (partition by s.warehouse_name) as mc
       from fz_sc s join fz_st st using (warehouse_name)
            join train t on t.warehouse_name = s.warehouse_name and t.usage_date = s.usage_date)
select warehouse_name, usage_date, credits_used, round(residual, 6) as residual, round(score, 6) as score,
       round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, round(threshold, 6) as threshold
from sc where score <= threshold and cast(credits_used as double) > mc
"""

_SCORED = f"""
{_FEATS},
win AS (select warehouse_name, usage_date, credits_used, trend, seasonal, residual
        from dx_out where usage_date between (select d from last) - 7 and (select d from last)),
hit AS (select w.warehouse_name, w.usage_date, avg(l.path_len) as mp
        from win w join fz_leaves l on l.warehouse_name = w.warehouse_name
             and l.lo < coalesce(w.residual, 0) and coalesce(w.residual, 0) <= l.hi
        group by 1, 2),
scored AS (select w.*, st.score_mean - 3 * st.score_std as threshold,
                  0.5 - pow(2.0, -h.mp / {_c('st.psi')}) as score
           from win w join hit h using (warehouse_name, usage_date) join fz_st st using (warehouse_name)),
flagged AS (select *, score <= threshold as is_anomaly,
                   cast((select d from last) as timestamp) as prediction_datetime from scored)
"""

ORACLE["forest_scores"] = f"""
{_SCORED}
select warehouse_name, usage_date, credits_used, round(trend, 6) as trend, round(seasonal, 6) as seasonal,
       round(residual, 6) as residual, round(threshold, 6) as threshold, round(score, 6) as score,
       is_anomaly, prediction_datetime
from flagged
"""

ORACLE["prediction_reload"] = f"""
{_SCORED}
select warehouse_name, usage_date, {r6('credits_used')} as credits_used, round(trend, 6) as trend,
       round(seasonal, 6) as seasonal, round(residual, 6) as residual, round(score, 6) as score, prediction_datetime
from flagged where is_anomaly
"""

# the same windows one day earlier
_SCORED_BEFORE = _SCORED.replace("(select d from last) - 7 and (select d from last)", "(select d from last) - 8 and (select d from last) - 1"
                                 ).replace("cast((select d from last) as timestamp)", "cast((select d from last) - 1 as timestamp)")
_FOUND = f"""select warehouse_name, usage_date, {r6('credits_used')} as credits_used, round(trend, 6) as trend,
       round(seasonal, 6) as seasonal, round(residual, 6) as residual, round(score, 6) as score, prediction_datetime
from flagged where is_anomaly"""
ORACLE["prediction_append"] = f"select * from ({_SCORED}\n{_FOUND}) union all select * from ({_SCORED_BEFORE}\n{_FOUND})"
ORACLE["model_snapshot"] = ORACLE["forest_scores"]

ORACLE["alert_gate"] = f"""
{_SCORED}
select count(*) as n_anomalies, count(*) > 0 as send_alert from flagged where is_anomaly
"""

ORACLE["anomalies_view"] = f"""
{_SCORED}
select m.*, round(o.trend, 6) as trend, round(o.seasonal, 6) as seasonal, round(o.residual, 6) as residual,
       round(o.score, 6) as score, o.prediction_datetime, o.score is not null as is_anomaly
from ({_metrics_out(6)}) m left join (select * from flagged where is_anomaly) o using (warehouse_name, usage_date)
"""

_REPORT = f"""
{_SCORED},
an AS (select * from flagged where is_anomaly),
report AS (select u.warehouse_name, u.usage_date, u.credits_used, u.credits_used_compute, u.credits_used_cloud_services,
             round(an.score, 6) as score, an.score is not null as is_anomaly
           from metering_sparse u left join an using (warehouse_name, usage_date)
           where u.warehouse_name in (select warehouse_name from an)
             and u.usage_date between (select min(usage_date) - 7 from an) and (select max(usage_date) + 7 from an))
"""

ORACLE["anomaly_report"] = f"{_REPORT} select * from report"
ORACLE["anomaly_report_text"] = f"""{_REPORT}
select warehouse_name, usage_date, concat_ws(' | ', warehouse_name, usage_date::varchar, credits_used::varchar,
         credits_used_compute::varchar, credits_used_cloud_services::varchar,
         case when score is null then '' else printf('%.6f', score) end, is_anomaly::varchar) as line
from report"""

ORACLE["anomaly_message"] = f"""
with lines as ({ORACLE["anomaly_report_text"]}),
placed as (select line, row_number() over (order by usage_date, warehouse_name, line) - 1 as place from lines)
select (place // 20 + 1)::int as page, count(*) as n_lines,
       'warehouse_name | usage_date | credits_used | credits_used_compute | credits_used_cloud_services | score | is_anomaly' || chr(10)
       || string_agg(line, chr(10) order by place) as body
from placed group by 1"""

# 14 days are the first that hold two weeks
ORACLE["short_series"] = f"""
{duck_cte('metering_sparse')},
named as (select distinct warehouse_name from metering_sparse where warehouse_name is not null
          and usage_date <= (select min(usage_date) + 12 from metering_sparse)),
later as (select distinct warehouse_name from metering_sparse where warehouse_name is not null
          and usage_date <= (select min(usage_date) + 13 from metering_sparse))
select 13 as days, warehouse_name, true as skipped, 0::bigint as feature_rows from named
union all select 14, warehouse_name, false, 14::bigint from later
"""

ORACLE["warehouses"] = f"""
{duck_cte('metering_sparse')},
{_METRICS_BODY},
{decompose_sql('metrics', True)}
select distinct warehouse_name from dx_out
"""

ORACLE["forest_history"] = f"""
{duck_cte('metering_long')},
{_FILL},
{decompose_sql('filled', False)},
hist AS (select warehouse_name, usage_date, credits_used, coalesce(residual, 0) as x from dx_out),
{forest_sql('hist', 'fh')},
sc AS (select s.warehouse_name, s.usage_date, h.credits_used, s.x as residual, s.score,
              st.score_mean, st.score_std, st.score_mean - 2 * st.score_std as threshold
       from fh_sc s join fh_st st using (warehouse_name)
            join hist h on h.warehouse_name = s.warehouse_name and h.usage_date = s.usage_date)
select warehouse_name, usage_date, credits_used, round(residual, 6) as residual, round(score, 6) as score,
       round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, round(threshold, 6) as threshold
from sc where score <= threshold
  and cast(credits_used as double) > (select avg(cast(credits_used as double)) from hist)
"""


# ---------------------------------------------------------------- drift

ORACLE["daily_pivot"] = f"""
{duck_cte('metering_long')},
{_FILL}
select usage_date, {", ".join(f"""max(case when warehouse_name = '{n}' then credits_used end) as "{n}\"""" for n in LONG_WAREHOUSES)}
from filled group by usage_date
"""

_KS = f"""
{duck_cte('metering_long')},
{_FILL},
sample AS (select warehouse_name, credits_used::double as v,
             usage_date + 7 >= max(usage_date) over () as is_current from filled),
sized AS (select warehouse_name, count(*) filter (not is_current) as m, count(*) filter (is_current) as n
          from sample group by all),
steps AS (select warehouse_name, v, count(*) filter (not is_current) as a, count(*) filter (is_current) as b
          from sample group by all),
gaps AS (select warehouse_name, abs(sum(a) over upto / m - sum(b) over upto / n) as gap
         from steps join sized using (warehouse_name)
         window upto as (partition by warehouse_name order by v)),
ks AS (select warehouse_name, m, n, max(gap) as d from gaps join sized using (warehouse_name) group by all)
"""

# the limit law from its other series (Jacobi's form), which converges fast for small lambda
ORACLE["usage_drift_stat"] = f"""{_KS},
l AS (select *, d * sqrt(m * n / (m + n)) as lam from ks)
select warehouse_name, m as n_reference, n as n_current, round(d, 9) as ks_d,
       round(case when lam < 0.05 then 1.0 else greatest(0.0, 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 400),
           lambda k: exp(-pow((2 * k - 1) * pi() / lam, 2) / 8)))) end, 6) as p_value_asymptotic
from l
"""

# lattice paths inside the band, one anti-diagonal per step
_EXACT = f"""{_KS},
band AS (select warehouse_name, greatest(m, n) as big, least(m, n) as small, round(d * lcm(m, n)) * gcd(m, n) as bound from ks),
walk AS (select band.*, 0 as s, list_transform(range(0, small + 1), lambda y: case when y = 0 then 1.0::double else 0.0::double end) as p
         from band
         union all
         select warehouse_name, big, small, bound, s + 1, list_transform(range(0, small + 1), lambda y:
             case when s + 1 - y between 0 and big and abs((s + 1 - y) * small - y * big) < bound
                  then (p[y + 1] * greatest(big - (s + 1 - y) + 1, 0)
                        + case when y > 0 then p[y] * (small - y + 1) else 0 end) / (big + small - s)
                  else 0.0::double end)
         from walk where s < big + small),
tested AS (select ks.*, least(1.0, greatest(0.0, case when bound <= 0 then 1.0 else 1 - p[small + 1] end)) as p_value
           from ks join walk using (warehouse_name) where s = big + small)
"""

ORACLE["usage_drift"] = f"""{_EXACT}
select warehouse_name, m as n_reference, n as n_current, round(d, 6) as ks_d, round(p_value, 6) as p_value,
       'ks' as stattest, 0.05::double as threshold, p_value < 0.05 as drift_detected
from tested
"""

ORACLE["drift_share"] = f"""{_EXACT}
select count(*) as n_columns, count(*) filter (p_value < 0.05) as n_drifted, avg((p_value < 0.05)::integer) as drift_share,
       avg((p_value < 0.05)::integer) >= 0.5 as dataset_drift
from tested
"""

# the stored views hold what the jobs compute
for _name in ("dag_cost", "dag_cost_delta", "dag_cost_warnings", "credits_delta"):
    ORACLE[f"view_{_name}"] = ORACLE[_name]
ORACLE["view_anomalies"] = ORACLE["anomalies_view"]
