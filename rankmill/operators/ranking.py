"""Ranking quality over rows (group, label, prediction): re-ranking, NDCG, mean average precision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.metrics import EMPTY_GROUP, discount, ndcg_at_k, rerank
from rankmill.operators.running import BIG_GROUP, group_totals, in_groups, number_rows, window_totals

CHUNK = 20


def _one() -> Column:
    return F.lit(1).cast("bigint")


def group_lengths(df: DataFrame, group: str = "gid") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("length"))


def rank_rows(
    scored: DataFrame,
    group: str = "gid",
    label: str = "y",
    prediction: str = "pred",
) -> DataFrame:
    """Add the 1-based ``rank`` by falling prediction inside each group; larger labels first among ties."""
    order = [F.desc(prediction), F.desc(label)]

    def ranked(totals):
        return lambda rows: totals(rows, group, order, {"rank": _one()})

    return in_groups(scored, group, ranked(window_totals), ranked(group_totals))


def grouped_ndcg(
    scored: DataFrame,
    group: str = "gid",
    label: str = "y",
    prediction: str = "pred",
    k: int | None = None,
    method: int = 1,
    empty_group: str = "zero",
    big_group: int = BIG_GROUP,
) -> DataFrame:
    """NDCG of the predicted order per group: (group, n, ndcg); ``empty_group`` scores groups without gain.

    A group is summed up, not gathered, whatever its size. Both orders of a small group are made from one shuffle.
    """
    narrow = scored.select(group, label, prediction)

    def both(totals):
        def ranks(rows: DataFrame) -> DataFrame:
            predicted = totals(rows, group, [F.desc(prediction), F.desc(label)], {"_rank": _one()})
            return totals(predicted, group, [F.desc(label)], {"_best": _one()})

        return ranks

    ranked = in_groups(narrow, group, both(window_totals), both(group_totals), big_group)

    def gain(position: str) -> Column:
        value = F.col(label).cast("double") / discount(F.col(position), method)
        return F.sum(value if k is None else F.when(F.col(position) <= k, value).otherwise(0.0))

    none = F.lit(EMPTY_GROUP[empty_group]).cast("double")
    score = F.when(gain("_best") == 0, none).otherwise(F.coalesce(F.try_divide(gain("_rank"), gain("_best")), none))
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), score.alias("ndcg"))


def grouped_average_precision(
    rows: DataFrame,
    position: str,
    group: str = "gid",
    label: str = "y",
    empty_group: str = "zero",
) -> DataFrame:
    """Average precision of the given order per group; ``empty_group`` scores groups without positives."""
    positive = F.when(F.col(label) > 0, _one()).otherwise(F.lit(0).cast("bigint"))

    def ranks(totals):
        return lambda found: totals(found, group, [F.col(position)], {"_rank": _one(), "_hits": positive})

    ranked = in_groups(rows.select(group, label, position), group, ranks(window_totals), ranks(group_totals))
    precision = F.sum(F.when(F.col(label) > 0, F.col("_hits") / F.col("_rank")))
    hits = F.sum(F.when(F.col(label) > 0, 1))
    score = F.coalesce(F.try_divide(precision, hits), F.lit(EMPTY_GROUP[empty_group]).cast("double"))
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), score.alias("ap"))


def mean_metric(scores: DataFrame, name: str) -> DataFrame:
    """One row: the mean over groups, groups without a score left out."""
    return scores.agg(F.avg(name).alias(name))


def mean_by_rule(scores: DataFrame, name: str) -> DataFrame:
    """(empty_group, mean): the mean under every rule for empty groups, from one ranking.

    ``scores`` must have been made with the rule ``skip``, which leaves an empty group without a score.
    """
    rules = {
        rule: F.avg(F.col(name) if value is None else F.coalesce(F.col(name), F.lit(float(value))))
        for rule, value in EMPTY_GROUP.items()
    }
    entries = F.array(*(F.struct(F.lit(r).alias("empty_group"), F.col(r).alias(name)) for r in rules))
    means = scores.agg(*(mean.alias(rule) for rule, mean in rules.items()))
    return means.select(F.inline(entries))


def metric_set(
    scored: DataFrame, position: str, group: str = "gid", label: str = "y", prediction: str = "pred", k: int = CHUNK
) -> DataFrame:
    """(metric, value): ``ndcg``, ``map``, ``ndcg@k`` and ``ndcg@k-``, means over groups.

    A group without positive labels counts 1, and 0 where the name ends in a minus. ``position`` is the logged order,
    which ``map`` judges.
    """
    def means(scores: DataFrame, name: str) -> DataFrame:
        return mean_by_rule(scores, name).withColumnRenamed(name, "value")

    def ndcg(cut: int | None) -> DataFrame:
        return means(grouped_ndcg(scored, group, label, prediction, cut, empty_group="skip"), "ndcg")

    precision = means(grouped_average_precision(scored, position, group, label, empty_group="skip"), "ap")
    at_k = ndcg(k)
    chosen = [(ndcg(None), "one", "ndcg"), (precision, "one", "map"), (at_k, "one", f"ndcg@{k}"), (at_k, "zero", f"ndcg@{k}-")]
    rows = [f.where(F.col("empty_group") == rule).select(F.lit(n).alias("metric"), "value") for f, rule, n in chosen]
    return reduce(DataFrame.unionByName, rows)


def mean_list_ndcg(lists: DataFrame, labels: str = "rel_list", k: int | None = None, method: int = 1) -> DataFrame:
    """One row: mean NDCG of the label lists held in the rows."""
    return lists.agg(F.avg(ndcg_at_k(F.col(labels), k, method)).alias("ndcg"))


def chunk_lists(
    df: DataFrame, order_by: Sequence[Column], values: Sequence[str], size: int = CHUNK
) -> DataFrame:
    """Cut a row sequence into lists of ``size`` rows; the last one may be shorter."""
    chunk = F.floor((F.col("row_no") - 1) / F.lit(size))
    numbered = number_rows(df, order_by).withColumn("chunk", chunk)
    # Bounded: a chunk holds at most ``size`` rows.
    lists = numbered.groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("row_no", *values))).alias("_rows")
    )
    return lists.select("chunk", *(F.col(f"_rows.{name}").alias(name) for name in values))


def ndcg_score_of_truth(df: DataFrame, order_by: Sequence[Column], label: str = "y", size: int = CHUNK) -> DataFrame:
    """One row: mean NDCG of the given order over chunks."""
    chunks = chunk_lists(df, order_by, [label], size)
    return chunks.agg(F.avg(ndcg_at_k(F.col(label))).alias("ndcg"))


def ndcg_score_of_prediction(
    df: DataFrame, order_by: Sequence[Column], label: str = "y", prediction: str = "pred", size: int = CHUNK
) -> DataFrame:
    """One row: mean NDCG over chunks after sorting each chunk by falling prediction."""
    chunks = chunk_lists(df, order_by, [label, prediction], size)
    return chunks.agg(F.avg(ndcg_at_k(rerank(F.col(label), F.col(prediction)))).alias("ndcg"))
