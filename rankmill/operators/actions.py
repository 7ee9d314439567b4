"""Item-action log: typed rows, daily counts, source-by-action columns, rates per day."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.scalars import day_span, epoch_to_ts, to_integer

# Sources and actions that get columns of their own.
SOURCES = ("web", "mobileWeb", "app")
ACTIONS = ("viewJob", "saveJob", "applyJob")

# The 16 count columns: source by measure, then measure totals.
MEASURES = ACTIONS + ("total",)
COUNT_COLUMNS = tuple(f"{s}_{m}" for m in MEASURES for s in SOURCES) + tuple(f"{m}_total" for m in MEASURES)


def row_total(*columns: str) -> Column:
    return reduce(add, map(F.col, columns))


def action_processed(log: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Typed action rows. ``row_id`` identifies a row; by default the position in the scan does."""
    return log.select(
        (F.xxhash64(*log.columns) if row_id is None else row_id).alias("id"),
        to_integer(F.col("jobno")).alias("jobno"),
        epoch_to_ts(F.col("date")).alias("datetime"),
        "action",
        "source",
        "device",
    ).withColumn("date", F.to_date("datetime"))


def action_count(processed: DataFrame) -> DataFrame:
    return processed.groupBy("date", "source", "action", "jobno").count()


def action_pivot(counts: DataFrame) -> DataFrame:
    """One row per (date, jobno, source) with a column per listed action and their total.

    Conditional sums need one aggregation, a pivot two. A group that has unlisted actions only keeps its
    row, with zeros.
    """
    listed = [
        F.coalesce(F.sum(F.when(F.col("action") == a, F.col("count"))), F.lit(0)).alias(a) for a in ACTIONS
    ]
    return counts.groupBy("date", "jobno", "source").agg(*listed).withColumn("total", row_total(*ACTIONS))


def action_unstacked(counts: DataFrame) -> DataFrame:
    """One row per (date, jobno): counts by source and action, and their totals, in one aggregation."""

    def cell(source: str, action: str) -> Column:
        wanted = (F.col("source") == source) & (F.col("action") == action)
        return F.coalesce(F.sum(F.when(wanted, F.col("count"))), F.lit(0)).alias(f"{source}_{action}")

    cells = counts.groupBy("date", "jobno").agg(*(cell(s, a) for a in ACTIONS for s in SOURCES))
    with_source_totals = cells.withColumns(
        {f"{s}_total": row_total(*(f"{s}_{a}" for a in ACTIONS)) for s in SOURCES}
    )
    with_totals = with_source_totals.withColumns(
        {f"{m}_total": row_total(*(f"{s}_{m}" for s in SOURCES)) for m in MEASURES}
    )
    return with_totals.select("date", "jobno", *COUNT_COLUMNS)


def action_count_per_day(counts: DataFrame) -> DataFrame:
    """Per job and action: total count over the days from the first to the last one seen, as columns."""
    rates = (
        counts.groupBy("jobno", "action")
        .agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.sum("count").alias("n"))
        .withColumn("rate", F.try_divide("n", day_span(F.col("start"), F.col("stop"))))
    )
    return rates.groupBy("jobno").agg(
        *(
            F.coalesce(F.avg(F.when(F.col("action") == a, F.col("rate"))), F.lit(0.0)).alias(a)
            for a in ACTIONS
        )
    )


def date_span(df: DataFrame, start: str = "date", stop: str = "date") -> DataFrame:
    """One row: first day, last day, days between."""
    return df.agg(F.min(start).alias("date_start"), F.max(stop).alias("date_stop")).withColumn(
        "days", F.datediff("date_stop", "date_start")
    )
