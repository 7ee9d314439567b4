"""Input schemas and the layout of every table of the pipeline."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rankmill.sources.tables import TableSpec

# Column names and types of the raw logs.
CLICK_SCHEMA = StructType(
    [
        StructField("action", StringType()),
        StructField("date", StringType()),
        StructField("joblist", ArrayType(StringType())),
        StructField("jobno", StringType()),
        StructField("querystring", StringType()),
        StructField("source", StringType()),
    ]
)
ACTION_SCHEMA = StructType(
    [StructField(name, StringType()) for name in ("jobno", "date", "action", "source", "device")]
)
TESTSET_SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("joblist", ArrayType(StringType())),
        StructField("querystring", StringType()),
    ]
)

FEATURE_WINDOW = ("start_date", "stop_date")
DATASET_WINDOW = FEATURE_WINDOW + ("features_start_date", "features_stop_date")

CLICK_LOG = TableSpec("train-click.json", "json", CLICK_SCHEMA)
ACTION_LOG = TableSpec("train-action.json", "json", ACTION_SCHEMA)
TESTSET_LOG = TableSpec("testset-click.json", "json", TESTSET_SCHEMA)
JOB_MASTER = TableSpec("job.json", "json")
COMPANY_MASTER = TableSpec("company.json", "json")

# One folder a day.
DAY = ("date",)

ACTION_PROCESSED = TableSpec("train-action-processed.pq", partition_by=DAY)
ACTION_COUNT = TableSpec("train-action-count.pq", partition_by=DAY)
ACTION_UNSTACKED = TableSpec("train-action-unstacked.pq", partition_by=DAY)
CLICK_PROCESSED = TableSpec("train-click-processed.pq", partition_by=DAY)
CLICK_GROUPED = TableSpec("train-click-grouped.pq", partition_by=DAY)
CLICK_EXPLODED = TableSpec("train-click-exploded.pq")
CLICK_CTR = TableSpec("train-click-ctr.pq", partition_by=DAY)
JOB_DAYS = TableSpec("job-days.pq", partition_by=DAY)
JOB_DATE_RANGE = TableSpec("train-action-date-range.pq")
JOB_PROCESSED = TableSpec("job-processed.pq")
COMPANY_PROCESSED = TableSpec("company-processed.pq")
JOB_COMPANY = TableSpec("job-company-joined.pq")
JOB_COMPANY_JSON = TableSpec("job-company-joined.json", "json")
FIELD_TOKENS = TableSpec("field-tokens.pq")
TEXT_INDEX = TableSpec("text-index.pq", bucket_by=("job",), buckets=64, gathered=True)
FEATURES = TableSpec("features.pq", partition_by=FEATURE_WINDOW)
DATASET = TableSpec("fast/dataset.pq", partition_by=DATASET_WINDOW)
LABELS = TableSpec("labels.pq")
TESTSET = TableSpec("testset.pq", partition_by=DATASET_WINDOW)
KEYWORD_IMPRESSIONS = TableSpec("train-impression.jsonl", "json")
