"""Anomaly outputs: report (J8), metrics view (J12), warehouse list (J24), alert gate (J25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import latest_per_key, materialize
from . import cost_sql


def anomalies_view(metrics: DataFrame, anomalies: DataFrame, latest: bool = False) -> DataFrame:
    """Metrics with the model output of the same warehouse-day and an ``is_anomaly`` flag.

    A left join on (warehouse, day); appended predictions of overlapping runs
    appear once per run, as in the reference.  ``latest=True`` keeps only the
    latest prediction per warehouse-day (``dedupe_predictions``).
    """
    if latest:
        anomalies = dedupe_predictions(anomalies)
    return metrics.sparkSession.sql(cost_sql.anomalies("{metrics}", "{found}"), metrics=metrics, found=anomalies)


def dedupe_predictions(anomalies: DataFrame) -> DataFrame:
    """Latest prediction per (warehouse, day): the variant without duplicate rows."""
    return latest_per_key(anomalies, ["warehouse_name", "usage_date"], "prediction_datetime")


def anomaly_report(raw: DataFrame, anomalies: DataFrame, days: int = 7) -> DataFrame:
    """Raw usage of the anomalous warehouses from ``days`` before the first to ``days``
    after the last anomaly, each row flagged with its anomaly score.

    The date bounds are two scalars (literals prune the raw scan); the
    warehouse list is a semi join
    (no literal IN list); the score comes from a left join on (day, warehouse).
    """
    row = anomalies.agg(F.min("usage_date").alias("lo"), F.max("usage_date").alias("hi")).first()
    lo = F.lit(row["lo"]).cast("date")
    hi = F.lit(row["hi"]).cast("date")
    names = anomalies.select("warehouse_name").distinct()
    usage = (raw.where(F.col("usage_date").between(F.date_sub(lo, days), F.date_add(hi, days)))
             .join(names, ["warehouse_name"], "left_semi")
             .select("warehouse_name", "usage_date", "credits_used", "credits_used_compute",
                     "credits_used_cloud_services"))
    a = anomalies.select("warehouse_name", F.col("usage_date").cast("date").alias("usage_date"), "score")
    return (usage.join(a, ["usage_date", "warehouse_name"], "left")
            .withColumn("is_anomaly", F.col("score").isNotNull()))


REPORT_COLUMNS = ("warehouse_name", "usage_date", "credits_used", "credits_used_compute",
                  "credits_used_cloud_services", "score", "is_anomaly")


def report_text(report: DataFrame) -> DataFrame:
    """One text line per report row with all seven columns, empty where a value is missing."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REPORT_COLUMNS]
    return report.select("warehouse_name", "usage_date", F.concat_ws(" | ", *text).alias("line"))


PAGE_LINES = 200


def report_pages(report: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """The message in pages: (page, n_lines, body), each a header line and at most ``page_lines`` report lines.

    The lines are in the order of day, warehouse and text over all pages; a
    report without an anomaly has no page.  Lines are dealt by ranges of that
    order, their places come from the tasks' counts, and a page collects its own
    lines only, so no row and no task holds the whole message.
    """
    if report.where("is_anomaly").isEmpty():
        report = report.where("false")
    order = ["usage_date", "warehouse_name", "line"]
    dealt = report_text(report).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "report_lines")
    lines = lines.withColumn("_task", F.shiftright("_at", 33))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)        # one line per task
    offsets = lines.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_at") - F.shiftleft("_task", 33)
    placed = lines.join(F.broadcast(offsets), "_task").select(place.alias("_place"), "line")
    pages = placed.groupBy((F.expr(f"_place div {page_lines}") + 1).cast("int").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("_place", "line"))).alias("r"))
    header = F.lit(" | ".join(REPORT_COLUMNS) + "\n")
    return pages.select("page", F.size("r").cast("long").alias("n_lines"),
                        F.concat(header, F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("body"))


def list_warehouses(features: DataFrame) -> DataFrame:
    """Distinct warehouse names, sorted."""
    return features.select("warehouse_name").distinct().orderBy("warehouse_name")


def alert_gate(anomalies: DataFrame) -> DataFrame:
    """One row: number of anomalies and whether an alert is sent."""
    return anomalies.agg(F.count(F.lit(1)).alias("n_anomalies")).withColumn(
        "send_alert", F.col("n_anomalies") > 0)
