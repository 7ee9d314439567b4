import random

import pytest
from pyspark.sql import functions as F

from rankmill.functions import metrics

# A published worked example of DCG and NDCG, its labels and its results.
R = [3, 2, 3, 0, 0, 1, 2, 2, 3, 0]


def value(spark, labels, builder):
    frame = spark.createDataFrame([(labels,)], "r array<bigint>")
    return frame.select(builder(F.col("r")).alias("v")).first().v


@pytest.mark.parametrize(
    ("labels", "k", "method", "expected"),
    [
        (R, 1, 0, 3.0),
        (R, 1, 1, 3.0),
        (R, 2, 0, 5.0),
        (R, 2, 1, 4.2618595071429155),
        (R, 10, 0, 9.605117739188811),
        (R, 11, 0, 9.605117739188811),
        (R, 10, 1, 8.318753101481006),
        ([], None, 1, 0.0),
        (R, 0, 1, 0.0),
    ],
)
def test_dcg(spark, labels, k, method, expected):
    assert value(spark, labels, lambda r: metrics.dcg_at_k(r, k, method)) == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize(
    ("labels", "k", "method", "expected"),
    [
        ([2, 1, 2, 0], 4, 0, 0.9203032077642922),
        ([2, 1, 2, 0], 4, 1, 0.96519546960144276),
        ([0], 1, 1, 0.0),
        ([1], 2, 1, 1.0),
        (R, 1, 1, 1.0),
    ],
)
def test_ndcg(spark, labels, k, method, expected):
    assert value(spark, labels, lambda r: metrics.ndcg_at_k(r, k, method)) == pytest.approx(expected, rel=1e-12)


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        metrics.dcg_at_k(F.col("r"), method=2)
    with pytest.raises(ValueError):
        metrics.dcg_at_k(F.col("r"), k=-1)


def test_rerank_and_average_precision(spark):
    frame = spark.createDataFrame([([0, 2, 1], [0.5, 0.5, 0.9])], "y array<int>, p array<double>")
    assert frame.select(metrics.rerank.udf("y", "p").alias("v")).first().v == [1, 2, 0]
    assert value(spark, [0, 1, 0, 1], metrics.average_precision) == 0.5
    assert value(spark, [0, 0], metrics.average_precision) == 0.0
    assert value(spark, [0, 0], lambda r: metrics.average_precision(r, "one")) == 1.0
    assert value(spark, [0, 0], lambda r: metrics.average_precision(r, "skip")) is None


def test_relevance_matches_a_plain_statement(spark):
    rng = random.Random(5)
    grade = {"clickJob": 1, "clickSave": 2, "clickApply": 3}
    actions = [*grade, "other"]
    rows = []
    for _ in range(300):
        shown = [rng.randint(1, 6) for _ in range(rng.randint(0, 8))]
        clicked = [rng.randint(1, 8) for _ in range(rng.randint(0, 5))]
        rows.append((shown, clicked, [rng.choice(actions) for _ in clicked]))
    frame = spark.createDataFrame(rows, "l array<bigint>, j array<bigint>, a array<string>")
    got = frame.select("l", "j", "a", metrics.score_relevance.udf("l", "j", "a").alias("v")).collect()
    for row in got:
        expected = [sum(grade.get(a, 0) for j, a in zip(row.j, row.a) if j == job) for job in row.l]
        assert row.v == expected
    single = frame.select(metrics.score_relevance(F.array(F.lit(3), F.lit(4)), F.lit(4), F.lit("clickSave"), scalar=True))
    assert single.first()[0] == [0, 2]
