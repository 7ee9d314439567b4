"""Intermediate tables go to the configured folder and nowhere else."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rankmill.operators.running import group_rank
from rankmill.sources import scratch


def test_no_folder_is_an_error():
    context = SimpleNamespace(getCheckpointDir=lambda: None, applicationId="app")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="share"):
        scratch.scratch_path(session, "table")


def test_kept_tables_can_be_dropped(spark):
    kept = scratch.keep(spark.range(5))
    assert kept.count() == 5
    folder = f"{scratch.shared_dir(spark)}/rankmill-{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.listdir(folder)
    scratch.drop_scratch(spark)
    assert not os.path.exists(folder)


def test_ranks_in_groups_of_any_size(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 7}", i * 7919 % 1009) for i in range(1000)]
    frame = spark.createDataFrame(rows, "g string, v bigint")
    for partitions in (1, 3, 40):
        got = group_rank(frame, ["g"], [F.col("v")], num_partitions=partitions).collect()
        for g in {g for g, _ in rows}:
            mine = sorted((r["rank"], r.v) for r in got if r.g == g)
            assert mine == [(i + 1, v) for i, v in enumerate(sorted(v for h, v in rows if h == g))]
