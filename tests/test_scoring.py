"""Model scoring: only features reach the model, missing ones as NaN."""

import subprocess
import sys

import numpy as np
import pytest

from rankmill.operators.scoring import score_rows


@pytest.fixture(scope="module")
def rows(spark):
    given = [(1, None, 2.5, "a", [1], 0.0), (2, 3, None, None, None, 0.0), (3, 4, 1.0, "b", [], 0.0), (3, 4, 1.0, "b", [], 0.0)]
    return spark.createDataFrame(given, "k int, a int, `b.c` double, t string, l array<int>, pred double")


def test_scores_and_other_columns(rows):
    got = score_rows(rows, ["b.c", "a"], lambda m: m[:, 0] * 10 + np.nan_to_num(m[:, 1]))
    assert got.columns == rows.columns
    assert sorted((r.k, r.t, r.l, r.pred) for r in got.collect() if r.t) == [
        (1, "a", [1], 25.0), (3, "b", [], 14.0), (3, "b", [], 14.0),
    ]
    assert [r.pred for r in got.where("k = 2").collect()] == [None]
    assert score_rows(rows.limit(0), ["a"], lambda m: m[:, 0], "other").collect() == []


def test_only_features_reach_the_model(rows):
    plan = score_rows(rows, ["a"], lambda m: m[:, 0], "other")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_workers_load_no_pandas():
    code = "import sys, rankmill; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
