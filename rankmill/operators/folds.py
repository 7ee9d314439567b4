"""Rolling train/test folds over a run of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_cv(length: Column, n_splits: int = 3, step_ratio: float = 0.2, train_ratio: float = 0.7) -> Column:
    """Array of folds with inclusive day offsets; halves round to even."""
    step = F.bround(length * step_ratio / (1 + step_ratio * (n_splits - 1))).cast("int")
    chunk = length.cast("int") - step * (n_splits - 1)
    train = F.bround(chunk * train_ratio).cast("int")

    def fold(i: int) -> Column:
        shift = step * i
        return F.struct(
            F.lit(i).alias("fold"),
            shift.alias("train_start"),
            (shift + train - 1).alias("train_stop"),
            (shift + train).alias("test_start"),
            (shift + chunk - 1).alias("test_stop"),
        )

    return F.array(*map(fold, range(n_splits)))


def cv_folds(span: DataFrame, n_splits: int = 3, step_ratio: float = 0.2, train_ratio: float = 0.7) -> DataFrame:
    """One row per fold, with dates, from a one-row span (date_start, days between)."""
    folds = series_cv(F.col("days") + 1, n_splits, step_ratio, train_ratio)
    bounds = ("train_start", "train_stop", "test_start", "test_stop")
    exploded = span.select("date_start", F.explode(folds).alias("f")).select("date_start", "f.*")
    return exploded.select(
        "fold", *bounds, *(F.date_add("date_start", F.col(name)).alias(f"{name}_date") for name in bounds)
    )


def cv_assign(rows: DataFrame, folds: DataFrame, day: str = "date") -> DataFrame:
    """Tag every row with the folds and roles its day falls in.

    What is broadcast is one row with one entry a fold, however long the span of days is.
    """
    bounds = F.struct("fold", *(f"{role}_{end}_date" for role in ("train", "test") for end in ("start", "stop")))
    listed = folds.agg(F.collect_list(bounds).alias("_folds"))

    def role(fold: Column) -> Column:
        def within(name: str) -> Column:
            return F.col(day).between(fold[f"{name}_start_date"], fold[f"{name}_stop_date"])

        return F.when(within("train"), "train").when(within("test"), "test")

    tagged = F.transform("_folds", lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role")))
    hits = F.explode(F.filter(tagged, lambda t: t["role"].isNotNull())).alias("_hit")
    return rows.join(F.broadcast(listed)).select(*rows.columns, hits).select(*rows.columns, "_hit.*")
