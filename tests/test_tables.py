import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rankmill.functions.scalars import float_text, uuid_to_long
from rankmill.operators.folds import series_cv
from rankmill.plans import export
from rankmill.sources.scratch import keep, scratch_path
from rankmill.sources.tables import TableSpec, read_table, read_through, write_table

SPEC = TableSpec("t.pq", partition_by=("day",))


def test_unknown_format():
    with pytest.raises(ValueError):
        TableSpec("x", "csv")


def test_read_through_builds_once_and_prunes(spark):
    base, calls = scratch_path(spark, "rt"), []

    def build(day):
        calls.append(day)
        return spark.range(3).withColumn("day", F.lit(day).cast("date"))

    for day in ("2024-01-01", "2024-01-02", "2024-01-01"):
        found = read_through(spark, base, SPEC, {"day": day}, lambda d=day: build(d))
        assert found.count() == 3
    assert calls == ["2024-01-01", "2024-01-02"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert read_table(spark, base, SPEC).count() == 6


def test_missing_table_surfaces(spark):
    with pytest.raises(AnalysisException):
        read_table(spark, scratch_path(spark, "none"), SPEC)


def test_overwrite_keeps_other_partitions(spark):
    base = scratch_path(spark, "dyn")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string")
    write_table(frame, base, SPEC)
    write_table(spark.createDataFrame([(9, "b")], "x int, day string"), base, SPEC)
    assert sorted((r.x, r.day) for r in read_table(spark, base, SPEC).collect()) == [(1, "a"), (9, "b")]


def test_libsvm_lines_and_files(spark):
    rows = [("b", 1, 0, 7, 2.5, None, True), ("a", 0, 3, 8, 0.0, 1e16, False), ("b", 0, 1, 9, -1.0, 3.0, None)]
    frame = spark.createDataFrame(
        rows, "gid string, pos_in_list int, rel bigint, job bigint, f double, g double, h boolean"
    )
    lines = export.to_libsvm_lines(frame, ["f", "g", "h"], with_tag=True).orderBy("gid", "pos_in_list")
    assert [r.value for r in lines.collect()] == [
        "3 1:1e+16 # gid:a job:8",
        "1 0:-1.0 1:3.0 # gid:b job:9",
        "0 0:2.5 2:1.0 # gid:b job:7",
    ]
    path = scratch_path(spark, "svm")
    export.write_libsvm(frame, path, ["f", "g", "h"], index_base=1)
    assert [r.value for r in spark.read.text(f"{path}/rows").coalesce(1).collect()] == [
        "3 2:1e+16",
        "1 1:-1.0 2:3.0",
        "0 1:2.5 3:1.0",
    ]
    assert [r.length for r in export.read_group_file(spark, f"{path}/query").coalesce(1).collect()] == [1, 2]
    assert sorted(r.label for r in export.read_libsvm(spark, f"{path}/rows", 3).collect()) == [0.0, 1.0, 3.0]


def test_number_text(spark):
    values = [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 1e16, 1e-3, 1e-4, 1e-5, 0.1 + 0.2, 3.830567886485311e17, 1e100]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in frame.select(float_text(F.col("v")).alias("t")).collect()] == [repr(v) for v in values]


def test_uuid(spark):
    ids = [str(uuid.UUID(int=i * 7**40 % 2**128)) for i in range(1, 50)]
    rows = spark.createDataFrame([(i,) for i in ids], "u string").select("u", uuid_to_long.udf("u").alias("n")).collect()
    assert all(r.n == hash(uuid.UUID(r.u).int) for r in rows)


@pytest.mark.parametrize("train_ratio", [0.9, 0.7, 0.5])
@pytest.mark.parametrize("length", [31, 7, 100, 25])
def test_folds(spark, length, train_ratio):
    folds = spark.range(1).select(F.explode(series_cv(F.lit(length), train_ratio=train_ratio)).alias("f")).select("f.*")
    step = round(0.2 * length / 1.4)
    chunk = length - 2 * step
    train = round(chunk * train_ratio)
    expected = [(i, i * step, i * step + train - 1, i * step + train, i * step + chunk - 1) for i in range(3)]
    assert [tuple(r) for r in folds.orderBy("fold").collect()] == expected


def test_json_is_stored_compressed_and_read_back(spark, tmp_path):
    spec = TableSpec("rows.json", "json")
    rows = spark.range(1000).selectExpr("id", "concat('same words in every row ', id) as text")
    write_table(rows, str(tmp_path), spec)
    files = list((tmp_path / "rows.json").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 1000 * 20
    assert sorted(map(tuple, read_table(spark, str(tmp_path), spec).collect())) == sorted(map(tuple, rows.collect()))


def test_stored_tables_are_written_with_zstd(spark):
    base = scratch_path(spark, "zstd")
    write_table(spark.range(9), base, TableSpec("t.pq"))
    assert all(".zstd." in name for name in read_table(spark, base, TableSpec("t.pq")).inputFiles())
    assert all(".zstd." in name for name in keep(spark.range(9)).inputFiles())


def test_aligned_parts_hold_the_lines_and_give_what_is_asked_of_them(spark):
    rows = [(f"{g:02x}", at, g % 3, g * 10 + at, float(at), None if g % 2 else 1.5) for g in range(9) for at in range(g % 4 + 1)]
    frame = keep(spark.createDataFrame(rows, "gid string, pos_in_list int, rel bigint, job bigint, f double, g double"))
    for options in ({}, {"with_tag": True}, {"features": ["g", "rel"], "with_tag": True, "index_base": 1}):
        path = scratch_path(spark, "aligned")
        export.write_aligned(frame, path, 3, **options)
        found = export.read_parts(spark, f"{path}/rows").orderBy("part", "line").collect()
        want = [r.value for r in export.to_libsvm_lines(frame, **options).collect()]
        assert sorted(r.value for r in found) == sorted(want)
    gid = F.regexp_extract("value", "gid:([0-9a-f]+)", 1)
    short = export.read_parts(spark, f"{path}/rows", gid).orderBy("part", "line").collect()
    assert [(r.part, r.line, r.value) for r in short] == [(r.part, r.line, r.value.split("gid:")[1].split(" ")[0]) for r in found]
    for part in {r.part for r in short}:
        gids = [r.value for r in short if r.part == part]
        assert gids == sorted(gids)
