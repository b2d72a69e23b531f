"""SQL of the cost and anomaly views: one text for the jobs (over DataFrames) and the stored views (over tables).

Every function takes the relations as SQL: a table, a subquery, or the
``{name}`` of a DataFrame that is passed to ``spark.sql``.
"""

from __future__ import annotations

PERIODS = (("yesterday", 1), ("last_week", 7), ("last_month", 28))
DAYS = (0, 1, 2, 7, 8, 28, 29)          # ages in days that a comparison of the last day and the day before needs
USD, PCT = 25, 0.33


def dag_cost(queries: str, credits: str) -> str:
    """Each query's share of its warehouse-day: rounded to 6 places as share, then credits, then dollars."""
    return f"""
select q.*,
       round(try_divide(cast(q.total_elapsed_time as decimal(38,0)), cast(c.total_time_elapsed as decimal(38,0))), 6) as warehouse_pct,
       round(warehouse_pct * c.warehouse_credits, 6) as task_credit_cost,
       round(task_credit_cost * c.effective_rate, 6) as task_dollar_cost
from {queries} q join {credits} c on q.warehouse_name = c.warehouse_name and q.ds = c.ds"""


def warehouse_credits_delta(credits: str) -> str:
    """Credits minus those of the day before, in decimals that keep nine places."""
    return f"""
select c.warehouse_name, c.warehouse_credits, c.ds,
       cast(c.warehouse_credits as decimal(37,9)) - cast(y.warehouse_credits as decimal(37,9)) as warehouse_credits_delta_yesterday
from {credits} c left join {credits} y on y.warehouse_name = c.warehouse_name and date_add(y.ds, 1) = c.ds"""


def _compared(unit: str, now: str, before: str) -> str:
    return f"{now}.{unit} - {before}.{unit}"


def _change(now: str, before: str) -> str:
    return f"cast({now}.credit as double) / cast(nullif({before}.credit, 0) as double) - 1"


def dag_cost_delta(cost: str, last: str, by_warehouse: bool = False) -> str:
    """Task cost of the day ``last`` against 1, 7 and 28 days before, and the same comparison a day earlier.

    The sums of the seven days that matter are lined up by one shuffle on the
    task: each falls into the lists of the days it is compared with.  The lists
    of a task are then multiplied out, as a join on the task would: a task that
    ran in several warehouses gives a row for every combination, unless
    ``by_warehouse`` lines up warehouses too.  Rows without a task or DAG have
    nothing to be compared with.
    """
    keys = ["airflow_task_id", "airflow_dag_id", *(["warehouse_name"] if by_warehouse else [])]
    known = " and ".join(f"{k} is not null" for k in keys)

    def slot(name, age):
        return f"collect_list(struct(dollar, credit)) filter (where age = {age} and {known}) as {name}"

    slots = [slot(f"{w}{n}", age + k) for w, age in (("t", 0), ("w", 1)) for n, k in PERIODS] + [slot("w", 1)]
    views = [f"lateral view outer explode(t{n}) as p_{n}" for n, _ in PERIODS]
    views += ["lateral view outer explode(w) as now"]
    # without a row of the day before there is no comparison to multiply
    views += [f"lateral view outer explode(case when size(w) > 0 then w{n} end) as q_{n}" for n, _ in PERIODS]
    out = [f"p_{n}.{u} as task_{u}_cost_{n}" for n, _ in PERIODS for u in ("dollar", "credit")]
    for prefix, now, p in (("", "today", "p"), ("yesterday_warn_", "now", "q")):
        out += [f"{_compared(u, now, f'{p}_{n}')} as {prefix}{u}_delta_{n}" for n, _ in PERIODS for u in ("dollar", "credit")]
        out += [f"{_change(now, f'{p}_{n}')} as {prefix}pct_change_{n}" for n, _ in PERIODS]
    return f"""
with sums as (select airflow_dag_id, airflow_task_id, ds, warehouse_name, sum(task_dollar_cost) as dollar, sum(task_credit_cost) as credit
              from {cost} where ds in ({", ".join(f"date_sub({last}, {k})" for k in DAYS)}) group by all),
aged as (select *, datediff({last}, ds) as age from sums),
lined as (select {", ".join(keys)}, {", ".join(slots)},
                 collect_list(struct(ds, warehouse_name as warehouse, dollar, credit)) filter (where age = 0) as t
          from aged group by {", ".join(keys)})
select today.ds, airflow_dag_id, airflow_task_id, today.warehouse as warehouse_name,
       today.dollar as task_dollar_cost_today, today.credit as task_credit_cost_today, {", ".join(out)}
from lined lateral view explode(t) as today {" ".join(views)}"""


def dag_cost_warnings(delta: str, usd: float = USD, pct: float = PCT) -> str:
    """First period whose change passes both limits, unless yesterday warned of the opposite for it."""
    def first(prefix):
        periods = ", ".join(f"struct('{n.replace('_', ' ')}' as label, {prefix}dollar_delta_{n} as usd, {prefix}pct_change_{n} as pct)"
                            for n, _ in PERIODS)
        return f"slice(filter(array({periods}), p -> abs(p.usd) > {usd} and abs(p.pct) > {pct}D), 1, 1)"

    def word(p):
        return f"case when {p}.pct > 0 then 'increase' when {p}.pct < 0 then 'decrease' end"

    earlier = [f"yesterday_warn_{c}_{n}" for n, _ in PERIODS for c in ("dollar_delta", "credit_delta", "pct_change")]
    # exploded, not projected: a filter on columns whose expressions the plan knows would be restated in terms of
    # every other column made of them, a number of constraints that doubles with each
    return f"""
select * except (hit, old, {", ".join(earlier)}),
       hit.label as trigger_period, {word('hit')} as change_type,
       old.label as yesterday_warn_trigger_period, {word('old')} as yesterday_warn_change_type
from {delta} lateral view outer explode({first('')}) as hit lateral view outer explode({first('yesterday_warn_')}) as old
where hit is not null and not coalesce(hit.label = old.label and {word('hit')} <> {word('old')}, false)"""


def anomalies(metrics: str, found: str) -> str:
    """Metrics with the model output of the same warehouse-day; a day predicted by several runs appears once per run."""
    return f"""
select m.*, a.trend, a.seasonal, a.residual, a.score, a.prediction_datetime, a.score is not null as is_anomaly
from {metrics} m left join {found} a on a.warehouse_name = m.warehouse_name and cast(a.usage_date as date) = m.usage_date"""
