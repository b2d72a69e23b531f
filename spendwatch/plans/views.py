"""The five reporting views as Spark SQL over the stored tables.

The texts are those of the jobs (``operators.cost_sql``).  A view is analysed
anew whenever it is read and follows the manifests of its tables by itself: the
newest manifest names the batches and so prunes the folders, and the last
costed day is its greatest day with rows, which no data is read for.
"""

from __future__ import annotations

from ..operators import cost_sql
from ..sources import manifest


def view_sql(t, prefix: str = "") -> dict[str, tuple[tuple[str, ...], str]]:
    """View name -> (tables it reads, SQL); ``t`` has the tables' folders."""
    queries, credits = "reporting_query_history", "reporting_warehouse_credits"
    metrics, found = "metrics_warehouse_metering_history", "model_output_anomalies"
    q, c = (manifest.sql_table(getattr(t, n), "ds") for n in (queries, credits))
    live = [manifest.sql_live(getattr(t, n)) for n in (queries, credits)]
    last = f"(select max(cast(a.value as date)) from {live[0]} a join {live[1]} b on a.value = b.value)"
    days = ", ".join(f"date_sub({last}, {k})" for k in cost_sql.DAYS)
    # the days are filtered at the tables, where they prune folders
    narrow = f"(select * except (query_time_rank) from {q} where ds in ({days}))"
    cost = f"({cost_sql.dag_cost(narrow, c)})"
    return {
        "view_reporting_warehouse_credits_delta": ((credits,), cost_sql.warehouse_credits_delta(c)),
        "view_reporting_dag_cost": ((queries, credits), cost_sql.dag_cost(q, c)),
        "view_reporting_dag_cost_delta": ((queries, credits), cost_sql.dag_cost_delta(cost, last)),
        "view_reporting_dag_cost_warnings": ((queries, credits), cost_sql.dag_cost_warnings(f"{prefix}view_reporting_dag_cost_delta")),
        "view_reporting_anomalies": ((metrics, found), cost_sql.anomalies(
            f"parquet.`{getattr(t, metrics)}`", manifest.sql_table(getattr(t, found), "prediction_date"))),
    }
