"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage works on all that the one before kept, and its result is written and read again. All but the last
return the columns of documents; packing returns where each piece of each document's tokens lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import decontaminate, jaccard, linededup, packing, quality
from rankmill.sources.scratch import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(docs: DataFrame, verdicts: DataFrame, key: str, keep_if: str) -> DataFrame:
    """The documents whose verdict holds; ``key`` is unique."""
    ids = verdicts.where(keep_if).select(key).distinct()
    return docs.join(ids, key, "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the classifier does not reject."""
    labels = _table(spark, sf_dir, "labels").where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.keep_rows(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least ten characters stay in the smallest document that has them."""
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts with five-word shingle similarity of 0.8 or more.

    One row of a group stays: where ids are null or repeated, rows are numbered by id (null last) and text, and
    each row is a document of its own.
    """
    key = "doc_id"
    rows_of_id = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not rows_of_id.where("doc_id is null or n > 1").isEmpty():
        key = "_row"
        ordered = docs.select(*COLUMNS).orderBy(F.asc_nulls_last("doc_id"), "text")
        docs = keep(ordered.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.near_duplicates(docs, key, shingle=5, similarity=(80, 100))
    return _of(docs, groups, key, f"{key} = component_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of a benchmark item."""
    return decontaminate.clean_rows(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

# The classifier and the tokenizer have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
