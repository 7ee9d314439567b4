"""Relevance and ranking metrics over array columns; each array is one result list held in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.expressions import named

# Graded relevance of a click.
RELEVANCE = {"clickJob": 1, "clickSave": 2, "clickApply": 3}


def action_weight(action: Column) -> Column:
    """Grade of an action; unknown actions count 0."""
    graded = reduce(lambda c, kv: c.when(action == kv[0], F.lit(kv[1])), RELEVANCE.items(), F)
    return graded.otherwise(F.lit(0)).cast("bigint")


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda total, x: total + x)


@named
def score_relevance(joblist: Column, jobs: Column, actions: Column, scalar: bool = False) -> Column:
    """Summed grade of the clicks on each listed job, 0 without a click.

    ``jobs`` and ``actions`` are parallel arrays, or with ``scalar`` one click's job and action.
    """
    if scalar:
        weight = action_weight(actions)
        return F.transform(joblist, lambda job: F.when(job == jobs, weight).otherwise(F.lit(0).cast("bigint")))

    def hit(job: Column) -> Column:
        grades = F.zip_with(
            jobs, actions, lambda j, a: F.when(j == job, action_weight(a)).otherwise(F.lit(0).cast("bigint"))
        )
        return _sum(grades, F.lit(0).cast("bigint"))

    return F.transform(joblist, hit)


def discount(position: Column, method: int = 1) -> Column:
    """Divisor of the gain at a 1-based position.

    Method 1: log2(1), shifted by one: 1, log2(3), 2 ... ; method 0: 1, 1, log2(3), 2 ...
    """
    if method == 1:
        return F.log2(position.cast("double") + 1)
    if method == 0:
        return F.when(position == 1, F.lit(1.0)).otherwise(F.log2(position.cast("double")))
    raise ValueError("method must be 0 or 1")


@named
def dcg_at_k(labels: Column, k: int | None = None, method: int = 1) -> Column:
    """Discounted cumulative gain of a list in rank order, cut at ``k``; an empty list scores 0."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    cut = labels if k is None else F.slice(labels, 1, k)
    gains = F.transform(cut, lambda x, i: x.cast("double") / discount(i + 1, method))
    return _sum(gains, F.lit(0.0))


@named
def ndcg_at_k(labels: Column, k: int | None = None, method: int = 1) -> Column:
    """DCG over the DCG of the whole list sorted by falling label; 0 when the ideal is 0."""
    ideal = dcg_at_k(F.sort_array(labels, asc=False), k, method)
    return F.coalesce(F.try_divide(dcg_at_k(labels, k, method), ideal), F.lit(0.0))


@named
def rerank(labels: Column, predictions: Column) -> Column:
    """Labels by falling prediction; among equal predictions the larger label comes first."""
    pairs = F.zip_with(predictions, labels, lambda p, y: F.struct(p.alias("p"), y.alias("y")))
    return F.transform(F.sort_array(pairs, asc=False), lambda pair: pair["y"])


# Score of a list without any positive label.
EMPTY_GROUP = {"zero": 0.0, "one": 1.0, "skip": None}


@named
def average_precision(labels: Column, empty_group: str = "zero") -> Column:
    """Mean over the positives of (positives so far / position)."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("hits"), F.lit(0.0).alias("total")
    )

    def step(state: Column, label: Column) -> Column:
        pos, positive = state["pos"] + 1, label > 0
        hits = state["hits"] + F.when(positive, 1).otherwise(0)
        gain = F.when(positive, hits / pos).otherwise(F.lit(0.0))
        return F.struct(pos.alias("pos"), hits.alias("hits"), (state["total"] + gain).alias("total"))

    precision = F.aggregate(labels, start, step, lambda s: F.try_divide(s["total"], s["hits"]))
    return F.coalesce(precision, F.lit(EMPTY_GROUP[empty_group]).cast("double"))
