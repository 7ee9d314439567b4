"""Tree scoring and windows against plain statements."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rankmill.checks import model
from rankmill.operators.actions import COUNT_COLUMNS
from rankmill.operators.trees import Ensemble, from_dump, score_trees
from rankmill.plans.features import running_counts, window_counts


def walk(node, row):
    while "leaf" not in node:
        x = row[node["split"]]
        way = node["missing"] if x is None or math.isnan(x) else node["yes"] if x < node["split_condition"] else node["no"]
        (node,) = (child for child in node["children"] if child["nodeid"] == way)
    return node["leaf"]


def grown(rng, names, depth, number=0):
    if depth == 0 or rng.random() < 0.2:
        return {"nodeid": number, "leaf": rng.uniform(-1, 1)}
    below = [grown(rng, names, depth - 1, 2 * number + i) for i in (1, 2)]
    ways = [child["nodeid"] for child in below]
    split = {"split": rng.choice(names), "split_condition": rng.choice([0.0, 0.5, 1.0]), "missing": rng.choice(ways)}
    return {"nodeid": number, **split, "yes": ways[0], "no": ways[1], "children": below}


def test_random_trees_match_a_walk(spark):
    rng = random.Random(5)
    names = ["a", "b.c", "d"]
    dump = [grown(rng, names, 6) for _ in range(12)]
    values = [None, float("nan"), -1.0, 0.0, 0.5, 0.75, 1.0, 3.0]
    rows = [tuple(rng.choice(values) for _ in names) for _ in range(300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "a double, `b.c` double, d double, pred string")
    scored = score_trees(frame, from_dump(dump, names, 0.25))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    for r in scored.collect():
        row = dict(zip(names, r, strict=False))
        assert math.isclose(r.pred, 0.25 + sum(walk(tree, row) for tree in dump), abs_tol=1e-9)


def test_empty_ensembles_and_bounds(spark, monkeypatch):
    frame = spark.createDataFrame([(1.0,)], "a double")
    assert score_trees(frame, from_dump([], ["a"], 0.5)).first().pred == 0.5
    assert score_trees(frame, from_dump([{"nodeid": 0, "leaf": 2.0}], ["a"])).first().pred == 2.0
    assert isinstance(from_dump(model.TREES, model.FEATURES), Ensemble)
    monkeypatch.setattr("rankmill.operators.trees.MAX_NODES", 3)
    with pytest.raises(ValueError):
        from_dump(model.TREES, model.FEATURES)


def test_windows_are_differences_of_running_sums(spark):
    rng = random.Random(2)
    first = date(2024, 1, 1)
    days = {(rng.choice(["p", "q", "r"]), first + timedelta(rng.randrange(20))) for _ in range(30)}
    rows = [(job, day, *(rng.randrange(5) for _ in COUNT_COLUMNS)) for job, day in sorted(days)]
    schema = "jobno string, date date, " + ", ".join(f"{c} bigint" for c in COUNT_COLUMNS)
    windows = [("a", first, first + timedelta(5)), ("b", first + timedelta(4), first + timedelta(19)), ("none", date(2020, 1, 1), date(2020, 2, 1))]
    found = window_counts(
        running_counts(spark.createDataFrame(rows, schema)),
        spark.createDataFrame(windows, "fold string, start_date date, stop_date date"),
    )
    want = {}
    for name, start, stop in windows:
        for job, day, *counts in rows:
            if start <= day <= stop:
                key = (name, job)
                want[key] = [x + y for x, y in zip(want.get(key, [0] * len(counts)), counts)]
    assert {(r.fold, r.jobno): [r[c] for c in COUNT_COLUMNS] for r in found.collect()} == want
    none = spark.createDataFrame([], "fold string, start_date date, stop_date date")
    assert window_counts(running_counts(spark.createDataFrame(rows, schema)), none).count() == 0


def test_one_pass_over_the_counts_serves_all_windows(spark):
    schema = "jobno string, date date, " + ", ".join(f"{c} bigint" for c in COUNT_COLUMNS)
    windows = spark.createDataFrame(
        [(i, date(2024, 1, 1 + i), date(2024, 1, 9 + i)) for i in range(5)], "fold int, start_date date, stop_date date"
    )
    found = window_counts(running_counts(spark.createDataFrame([], schema)), windows).agg(F.sum("total_total"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(jobno") == 1 and "Join" not in plan
