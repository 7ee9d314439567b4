"""Label rows: scores and features by one move of the positions, and text exports that are spelled once."""

import pytest
from pyspark.sql import functions as F

from rankmill.functions.querystring import SCALAR_PARAMS
from rankmill.operators import clicks, textscore
from rankmill.plans import dataset as ds
from rankmill.plans import export
from rankmill.sources import catalog
from rankmill.sources.scratch import keep, scratch_path
from rankmill.sources.tables import read_table, write_table

PARAMS = "struct<" + ",".join(f"{name}:int" for name in ("keyword", *SCALAR_PARAMS)) + ">"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(job, "job", ["a", f"w{job}"]) for job in range(5)]
    tokens = keep(spark.createDataFrame(rows, "job bigint, field string, tokens array<string>"))
    base = scratch_path(spark, "index")
    write_table(textscore.weighted_index(tokens), base, catalog.TEXT_INDEX)
    return read_table(spark, base, catalog.TEXT_INDEX)


def lists(spark, gids):
    """Lists that name a job twice, an unknown one, none at all and the one numbered 0."""
    jobs = [[1, 2, 1], [99, None, 0], [], None, [4] * 9]
    rows = [(g, jobs[i % 5], ["a", "w1", "w4"] if i % 3 else None, (None, *range(i, i + 11))) for i, g in enumerate(gids)]
    made = spark.createDataFrame(rows, f"gid string, joblist array<bigint>, tokens array<string>, query_params {PARAMS}")
    item = lambda job: F.struct(job.alias("job"), (job % 3).alias("rel"), F.lit("x").alias("action"))
    stamp = {"source": F.lit("web"), "date": F.lit("2024-01-01").cast("date"), "datetime": F.lit("2024-01-01").cast("timestamp")}
    return keep(made.withColumn("job_rel_list", F.transform("joblist", item)).withColumns(stamp))


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("hot_share", [textscore.HOT_SHARE, 2.0])
def test_positions_get_the_scores_of_their_lists(spark, index, monkeypatch, hot_share):
    monkeypatch.setattr(textscore.with_position_scores, "__defaults__", (hot_share,))
    grouped = lists(spark, [f"{i:032x}" for i in range(40)])
    want = ds.label_columns(clicks.click_exploded(textscore.with_text_scores(grouped, index)))
    got = ds.label_columns(ds.impression_labels(grouped, index))
    assert got.dtypes == want.dtypes
    assert rows_of(got) == rows_of(want) and got.where("text_job > 0").count() > 0


def test_positions_move_once_to_scores_and_features(spark, index, monkeypatch):
    # Without hot jobs, and with features too large to be broadcast.
    monkeypatch.setattr(textscore.with_position_scores, "__defaults__", (2.0,))
    features = spark.range(5).select(
        F.col("id").alias("jobno"), (F.col("id") * 10).alias("views"), F.lit(1).alias("start_date"), F.lit(1).alias("stop_date")
    )
    grouped = lists(spark, [f"{i:032x}" for i in range(40)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ds.dataset(ds.impression_labels(grouped, index), features.distinct(), "2024-01-01", "2024-01-02")
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moves = [line for line in plan.split("\n") if "Exchange" in line and "gid" in line]
    assert not moves, moves
    # One of the positions, one or two of the features.
    assert plan.count("Exchange hashpartitioning(job#") <= 2
    views = {r.job: r.views for r in made.where("job < 5").collect()}
    assert views == {job: job * 10 for job in views} and 0 in views


def test_lists_with_one_id_are_scored_as_before(spark, index):
    shown = lists(spark, ["1", "1", None, "2"]).select("gid", "query_params", "joblist", "tokens")
    want = clicks.testset_exploded(textscore.with_text_scores(clicks.testset_lists(shown), index))
    assert rows_of(ds.label_columns(ds.testset_labels(shown, index))) == rows_of(ds.label_columns(want))


def test_lines_are_spelled_once_and_read_back_from_compressed_files(spark):
    spelled = spark.sparkContext.accumulator(0)
    rows = [(f"g{i % 50:02d}", i // 50, i % 3, f"{i}", i / 7) for i in range(500)]
    frame = keep(spark.createDataFrame(rows, "gid string, pos_in_list int, rel bigint, job string, f double"))

    def counted(batches):
        for batch in batches:
            spelled.add(batch.num_rows)
            yield batch

    watched = frame.mapInArrow(counted, frame.schema)
    path, plain = scratch_path(spark, "export"), scratch_path(spark, "plain")
    made = {}
    for at, how in ((path, "gzip"), (plain, None)):
        export.write_libsvm(watched, at, ["f"], index_base=1, compression=how)
        made[at] = [r.value for r in spark.read.text(f"{at}/rows").collect()], export.read_group_file(spark, f"{at}/query").collect()
    # Twice for the two exports, once each for the lines, at most twice for the lengths, which are sampled too.
    assert spelled.value <= 2 * 3 * 500
    assert made[path] == made[plain] and len(made[path][0]) == 500 and sum(r.length for r in made[path][1]) == 500
    names = spark.read.text(f"{path}/rows").inputFiles()
    assert names and all(f.endswith(".gz") for f in names)
    assert export.read_libsvm(spark, f"{path}/rows", 1).count() == 500
