"""Named tables: format, schema and partition layout, plus reading and writing them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("json", "parquet")


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives below a base folder, and in which form."""

    path: str
    format: str = "parquet"
    schema: StructType | None = None
    partition_by: tuple[str, ...] = ()
    # Columns and number of buckets; joins and groupings on the columns then need no shuffle of the table.
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    # What is written has the rows of a bucket together already, as ``weighted_index`` has: no shuffle before writing.
    gathered: bool = False

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, got {self.format!r}")

    def location(self, base: str) -> str:
        return f"{base.rstrip('/')}/{self.path}"


def _table_name(base: str, spec: TableSpec) -> str:
    """The name under which a bucketed table is known to the session's catalog, made from its place."""
    return f"rankmill_{hashlib.md5(spec.location(base).encode()).hexdigest()}"


def _bucketed(spark: SparkSession, base: str, spec: TableSpec) -> DataFrame:
    """Buckets are a matter of the catalog: a session that did not write the table enters it there first."""
    name, location = _table_name(base, spec), spec.location(base)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{n}` {t}" for n, t in spark.read.format(spec.format).load(location).dtypes)
        keys = ", ".join(f"`{c}`" for c in spec.bucket_by)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {spec.format} "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {spec.buckets} BUCKETS LOCATION '{location}'"
        )
    return spark.table(name)


def read_table(spark: SparkSession, base: str, spec: TableSpec) -> DataFrame:
    """Lazy scan. Without a schema, JSON is inferred (one extra pass over the files)."""
    if spec.bucket_by:
        return _bucketed(spark, base, spec)
    reader = spark.read.format(spec.format)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return reader.load(spec.location(base))


def write_table(
    df: DataFrame,
    base: str,
    spec: TableSpec,
    mode: str = "overwrite",
    compression: str = "zstd",
) -> None:
    """Write a table; for partitioned tables an overwrite replaces only the partitions present in ``df``.

    A bucketed table has one file a bucket, or a file per bucket and task if it is gathered, sorted by its columns. ``compression`` is for parquet; JSON is gzipped.
    """
    if spec.bucket_by and not spec.gathered:
        df = df.repartition(spec.buckets, *spec.bucket_by)
    writer = df.write.format(spec.format).mode(mode)
    # JSON repeats names and most values from row to row.
    writer = writer.option("compression", "gzip" if spec.format == "json" else compression)
    if spec.partition_by:
        writer = writer.partitionBy(*spec.partition_by).option("partitionOverwriteMode", "dynamic")
    if spec.bucket_by:
        writer = writer.bucketBy(spec.buckets, *spec.bucket_by).sortBy(*spec.bucket_by)
        writer.option("path", spec.location(base)).saveAsTable(_table_name(base, spec))
    else:
        writer.save(spec.location(base))


def partition_filter(keys: Mapping[str, Any]) -> Column:
    """Conjunction of equalities; on partition columns it prunes directories."""
    return reduce(and_, (F.col(name) == F.lit(value) for name, value in keys.items()), F.lit(True))


def read_through(
    spark: SparkSession,
    base: str,
    spec: TableSpec,
    keys: Mapping[str, Any],
    populate: Callable[[], DataFrame],
) -> DataFrame:
    """Rows of the partition ``keys``; when the table or the partition is missing, build and write it first."""

    def stored() -> DataFrame:
        return read_table(spark, base, spec).where(partition_filter(keys))

    try:
        found = stored()
        if not found.isEmpty():
            return found
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    write_table(populate(), base, spec)
    return stored()
