"""Windowed feature table: one row per job with actions in the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions.scalars import day_span
from rankmill.operators.actions import COUNT_COLUMNS
from rankmill.operators.clicks import ctr_by_job_action, ctr_features
from rankmill.operators.jobs import job_attributes, open_days


def date_window(df: DataFrame, start, stop, column: str = "date") -> DataFrame:
    """Rows of an inclusive date window; on stored tables the filter reaches the scan."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(stop).cast("date")))


def features(
    unstacked: DataFrame,
    ranges: DataFrame,
    jobs: DataFrame,
    start,
    stop,
    rates: DataFrame | None = None,
    floor_zero: bool = False,
) -> DataFrame:
    """Counts, counts per open day, view ratios, job attributes and the window itself.

    ``rates`` (click-through rows) adds the three CTR columns. All joins are on ``jobno``, the key the
    counts are already partitioned by. A ratio with a zero or missing divisor is NULL.
    """
    counts = (
        date_window(unstacked, start, stop).groupBy("jobno").agg(*(F.sum(c).alias(c) for c in COUNT_COLUMNS))
    )
    joined = counts.join(open_days(ranges, start, stop, floor_zero), "jobno", "left")
    if rates is not None:
        joined = joined.join(ctr_features(ctr_by_job_action(rates, start, stop)), "jobno", "left")
    joined = joined.join(job_attributes(jobs), "jobno", "left")
    window = {"start_date": F.lit(start).cast("date"), "stop_date": F.lit(stop).cast("date")}
    return joined.withColumns(_ratios() | window)


def _ratios() -> dict[str, Column]:
    return {
        **{f"{c}_per_day": F.try_divide(c, "open_days") for c in COUNT_COLUMNS},
        # Views over saves and over applies, whatever the older names of these ratios said.
        "view_per_save": F.try_divide("viewJob_total", "saveJob_total"),
        "view_per_apply": F.try_divide("viewJob_total", "applyJob_total"),
    }


def running_counts(unstacked: DataFrame) -> DataFrame:
    """(jobno, days): per job its days with actions, each with the sums of all counts up to that day.

    Stored once, it serves every window: one row per job, bounded by the days of the logs.
    """
    upto = Window.partitionBy("jobno").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = F.struct("date", *(F.sum(c).over(upto).alias(c) for c in COUNT_COLUMNS)).alias("day")
    return unstacked.select("jobno", sums).groupBy("jobno").agg(F.array_sort(F.collect_list("day")).alias("days"))


def window_counts(running: DataFrame, windows: DataFrame) -> DataFrame:
    """(window columns, jobno, counts) for every window and every job with actions in it.

    ``windows`` has ``start_date`` and ``stop_date`` and any further columns, some rows in all (folds): they are made
    one literal array. Every window's counts are the difference of two look-ups.
    """
    rows = [tuple(row) for row in windows.collect()]
    schema = windows.schema
    each = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema, strict=True))) for r in rows))
    paired = running.select("jobno", "days", F.explode(each).alias("w")) if rows else running.select(
        "jobno", "days", F.lit(None).cast(schema).alias("w")
    ).where("false")
    last = F.element_at(F.filter("days", lambda d: d["date"] <= F.col("w.stop_date")), -1)
    before = F.try_element_at(F.filter("days", lambda d: d["date"] < F.col("w.start_date")), F.lit(-1))
    inside = F.exists("days", lambda d: d["date"].between(F.col("w.start_date"), F.col("w.stop_date")))
    found = paired.where(inside).select("w", "jobno", last.alias("last"), before.alias("before"))
    return found.select(
        "w.*", "jobno", *((F.col(f"last.{c}") - F.coalesce(F.col(f"before.{c}"), F.lit(0))).alias(c) for c in COUNT_COLUMNS)
    )


def features_per_window(
    unstacked: DataFrame, ranges: DataFrame, jobs: DataFrame, windows: DataFrame, floor_zero: bool = False
) -> DataFrame:
    """``features`` of several windows at once, from one pass over the counts.

    ``windows`` is a small table with ``start_date``, ``stop_date`` and columns that name a window, such as a fold.
    """
    counts = window_counts(running_counts(unstacked), windows)
    joined = counts.join(ranges.select("jobno", "date_start", "date_stop"), "jobno", "left")
    # Without a range there is nothing to clamp.
    known = F.col("date_start").isNotNull()
    clamped = joined.withColumns(
        {
            "date_stop": F.when(known, F.least("date_stop", "stop_date")),
            "date_start": F.when(known, F.greatest("date_start", "start_date")),
        }
    )
    days = day_span(F.col("date_start"), F.col("date_stop"))
    with_days = clamped.withColumn("open_days", F.greatest(days, F.lit(0)) if floor_zero else days)
    return with_days.join(job_attributes(jobs), "jobno", "left").withColumns(_ratios())
