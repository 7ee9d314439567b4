"""Job and company masters, and the days a job was open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions.scalars import case_codes, day_span, to_integer, uuid_to_long
from rankmill.functions.text import tokenize_to_struct

# Columns of the job master with their types after the cast (None keeps the source type).
JOB_TEXT = ("description", "job", "others")
JOB_COLUMNS = {
    "addr_no": None,
    "edu": None,
    "exp_jobcat1": "bigint",
    "exp_jobcat2": "bigint",
    "exp_jobcat3": "bigint",
    "industry": "bigint",
    "jobcat1": "bigint",
    "jobcat2": "bigint",
    "jobcat3": "bigint",
    "language1": None,
    "language2": None,
    "language3": None,
    "major_cat": "int",
    "major_cat2": "int",
    "major_cat3": "int",
    "need_emp": None,
    "need_emp1": None,
    "period": None,
    "role": None,
    "role_status": None,
    "s2": None,
    "s3": None,
    "s9": None,
    "salary_high": None,
    "salary_low": None,
    "startby": None,
}
COMPANY_TEXT = ("name", "management", "product", "profile", "welfare")
WORKTIME_CODES = {"週休二日": 1, "隔週休": 2}


def job_processed(master: DataFrame) -> DataFrame:
    """Typed job attributes, coded working time, and the three texts with their tokens."""
    return master.select(
        "custno",
        to_integer(F.col("jobno"), "int").alias("jobno"),
        *(tokenize_to_struct(F.col(name)).alias(name) for name in JOB_TEXT),
        *(
            F.col(name) if dtype is None else to_integer(F.col(name), dtype).alias(name)
            for name, dtype in JOB_COLUMNS.items()
        ),
        case_codes(F.col("worktime"), WORKTIME_CODES).alias("worktime"),
    )


def company_processed(master: DataFrame) -> DataFrame:
    """All columns; the five texts become text and tokens."""
    return master.withColumns({name: tokenize_to_struct(F.col(name)) for name in COMPANY_TEXT})


def job_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with the columns of their company, if it is known."""
    return jobs.join(companies, "custno", "left")


def job_attributes(jobs: DataFrame) -> DataFrame:
    """Numeric job columns for features: texts dropped, company number hashed."""
    return jobs.drop(*JOB_TEXT).withColumn("custno", uuid_to_long(F.col("custno")))


def job_date_range(actions: DataFrame, shown: DataFrame) -> DataFrame:
    """First and last day of every job seen in both logs, per log and overall.

    ``shown`` holds (job, date) of listed jobs: exploded impressions, or ``shown_jobs`` of the clicks.
    """
    acted = actions.groupBy("jobno").agg(
        F.min("date").alias("action_date_start"), F.max("date").alias("action_date_stop")
    )
    listed = shown.groupBy(F.col("job").alias("jobno")).agg(
        F.min("date").alias("click_date_start"), F.max("date").alias("click_date_stop")
    )
    return acted.join(listed, "jobno").withColumns(
        {
            "date_start": F.least("action_date_start", "click_date_start"),
            "date_stop": F.greatest("action_date_stop", "click_date_stop"),
        }
    )


def open_days(ranges: DataFrame, start, stop, floor_zero: bool = False) -> DataFrame:
    """Job ranges clamped to a window, with the inclusive day count.

    A range outside the window gives a count of 0 or less; ``floor_zero`` lifts that to 0.
    """
    clamped = ranges.select(
        "jobno",
        F.least("date_stop", F.lit(stop).cast("date")).alias("date_stop"),
        F.greatest("date_start", F.lit(start).cast("date")).alias("date_start"),
    )
    days = day_span(F.col("date_start"), F.col("date_stop"))
    return clamped.withColumn("open_days", F.greatest(days, F.lit(0)) if floor_zero else days)
