"""Apply a trained model to feature rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]


def score_rows(df: DataFrame, feature_cols: Sequence[str], scorer: Scorer, target: str = "pred") -> DataFrame:
    """Add ``target = scorer(matrix)`` batch by batch; the scorer is any picklable function of a float matrix.

    Models are Python objects; only the features go to them, as one struct of doubles, and the other columns stay
    where they are. Missing features reach the scorer as NaN. A score of NaN is NULL. A column named ``target`` is
    replaced; an empty table gives no rows.
    """

    def apply(features: pa.Array) -> pa.Array:
        matrix = np.column_stack([x.to_numpy(zero_copy_only=False) for x in features.flatten()])
        return pa.array(np.asarray(scorer(matrix), dtype="float64"), from_pandas=True)

    scored = F.arrow_udf(apply, "double")
    return df.withColumn(target, scored(F.struct(*(F.col(f"`{c}`").cast("double").alias(c) for c in feature_cols))))
