"""Small helpers around DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_id(df: DataFrame, id_col: str, ddl: str, name: str | None = None) -> T.StructType:
    """A schema of the id column of ``df``, of whatever type, and the columns in ``ddl``."""
    own = T.StructField(name or id_col, df.schema[id_col].dataType)
    return T.StructType([own, *T.StructType.fromDDL(ddl).fields])


def whole_rows(df: DataFrame, text_col: str, judge: Callable[[DataFrame, str, str], DataFrame], condition: str) -> DataFrame:
    """The rows of ``df`` for which the verdict of a row-by-row operator holds, without a join.

    ``judge`` gets the rows as one struct column in place of the id, and its text.
    """
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(text_col).alias("_text"))
    return judge(rows, "_row", "_text").where(condition).select("_row.*")
