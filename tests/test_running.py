"""Groups and runs of copies beyond any size limit give the same results as small ones."""

import math
import random

from pyspark.sql import functions as F

from rankmill.operators import ranking, running
from rankmill.operators.running import group_totals, in_groups, window_totals


def scored(spark, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(0, 3), rng.randint(0, 4) / 10) for _ in range(400)]
    rows += [(1, 2, 0.3)] * 90
    return rows, spark.createDataFrame(rows, "gid bigint, y bigint, pred double")


def plain_ndcg(rows, gid):
    group = [(p, y) for g, y, p in rows if g == gid]

    def dcg(labels):
        return sum(y / math.log2(i + 2) for i, y in enumerate(labels))

    return dcg([y for _, y in sorted(group, reverse=True)]) / dcg(sorted((y for _, y in group), reverse=True))


def test_hot_groups_score_like_ordinary_ones(spark):
    rows, frame = scored(spark)
    got = {r.gid: r for r in ranking.grouped_ndcg(frame).collect()}
    assert set(got) == {1, 2, 3, 4}
    for gid, row in got.items():
        assert row.n == sum(1 for r in rows if r[0] == gid)
        assert abs(row.ndcg - plain_ndcg(rows, gid)) < 1e-9


def test_groups_without_gain_follow_the_rule(spark):
    frame = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.1), (None, 2, 0.5)], "gid bigint, y bigint, pred double")
    for rule, value in (("zero", 0.0), ("one", 1.0), ("skip", None)):
        assert {r.gid: r.ndcg for r in ranking.grouped_ndcg(frame, empty_group=rule).collect()} == {1: value, None: 1.0}


def test_hot_ranks_are_complete(spark):
    rows, frame = scored(spark)
    got = ranking.rank_rows(frame).collect()
    for gid in (1, 2, 3, 4):
        mine = sorted((r["rank"], r.pred, r.y) for r in got if r.gid == gid)
        expected = sorted(((p, y) for g, y, p in rows if g == gid), reverse=True)
        assert mine == [(i + 1, p, y) for i, (p, y) in enumerate(expected)]


def test_average_precision_of_hot_groups(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, rng.randint(0, 1)) for i in range(120)]
    frame = spark.createDataFrame(rows, "gid bigint, pos bigint, y bigint")
    got = {r.gid: r.ap for r in ranking.grouped_average_precision(frame, "pos").collect()}
    for gid in (0, 1, 2):
        labels = [y for g, _, y in sorted(rows) if g == gid]
        hits = [sum(labels[: i + 1]) / (i + 1) for i, y in enumerate(labels) if y]
        assert abs(got[gid] - sum(hits) / len(hits)) < 1e-12


def test_running_totals_with_copies(spark):
    rows = [(i % 7, i % 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "k bigint, w bigint")
    got = running.running_totals(
        frame, [F.col("k")], {"n": F.lit(1).cast("bigint"), "total": F.col("w")}, num_partitions=5, block=4
    ).collect()
    seen = total = 0
    for row, (k, w) in zip(sorted(got, key=lambda r: r.n), sorted(rows), strict=True):
        seen, total = seen + 1, total + w
        assert (row.n, row.total, row.k, row.w) == (seen, total, k, w)


def test_chunks_keep_a_short_last_one(spark):
    frame = spark.createDataFrame([(i, i % 2) for i in range(45)], "i bigint, y bigint")
    sizes = {r.chunk: len(r.y) for r in ranking.chunk_lists(frame, [F.col("i")], ["y"]).collect()}
    assert sizes == {0: 20, 1: 20, 2: 5}


def test_big_and_small_groups_are_ranked_alike(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.randrange(5), rng.randrange(3)) for _ in range(400)]
    rows += [(9, i, i) for i in range(3)]
    frame = spark.createDataFrame(rows, "g int, v int, w int")
    totals = {"n": F.lit(1).cast("bigint"), "s": F.col("w").cast("bigint")}

    def with_limit(limit):
        found = in_groups(
            frame,
            "g",
            lambda df: window_totals(df, "g", [F.col("v"), F.col("w")], totals),
            lambda df: group_totals(df, "g", [F.col("v"), F.col("w")], totals),
            limit,
        )
        return sorted(map(tuple, found.select("g", "v", "w", "n", "s").collect()), key=repr)

    assert with_limit(10**6) == with_limit(50) == with_limit(0)
    assert len(with_limit(50)) == len(rows)
