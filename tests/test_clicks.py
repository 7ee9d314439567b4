from pyspark.sql import functions as F

from rankmill.functions.querystring import DEFAULT_PARAMS
from rankmill.operators import clicks, textscore

LOG = "action string, date string, joblist array<string>, jobno string, querystring string, source string, n bigint"
DAY = "1714521600000"


def log(spark, extra=0):
    rows = [
        ("clickJob", DAY, ["1", "2", "2"], "2", "keyword=a", "web", 1),
        ("clickApply", DAY, ["1", "2", "2"], "2", "keyword=a&page=3", "web", 2),
        ("other", DAY, ["1", "2", "2"], "1", "keyword=a", "web", 3),
        ("clickJob", DAY, ["1", "2", "2"], "99", "keyword=b", "web", 4),
        ("clickJob", "bad", ["x", "5"], "5", "", "app", 5),
    ]
    rows += [("clickSave", DAY, ["1", "2", "2"], "2", "keyword=a", "web", 10 + i) for i in range(extra)]
    return clicks.click_processed(spark.createDataFrame(rows, LOG), row_id=F.col("n"))


def by_keyword(frame):
    return {r.query_params.keyword: r for r in frame.collect()}


def test_grouping(spark):
    got = by_keyword(clicks.click_grouped(log(spark)))
    assert set(got) == {"a", "b", None}
    # Ignored parameters do not split an impression; unknown actions weigh nothing; duplicates both score.
    assert got["a"].rel_list == [0, 4, 4] and got["a"].n_clicks == 3
    assert [i.action for i in got["a"].job_rel_list] == ["other", "clickApply", "clickApply"]
    assert got["b"].rel_list == [0, 0, 0] and got["b"].n_clicks == 1
    assert got[None].joblist == [None, 5] and got[None].rel_list == [0, 1] and got[None].datetime is None


def test_a_hot_impression_keeps_every_click(spark):
    processed = log(spark, extra=50)
    assert by_keyword(clicks.click_grouped(processed))["a"].rel_list == [0, 104, 104]
    pages = clicks.click_lists(processed, page_size=10).collect()
    assert max(r.n_pages for r in pages) == 6
    assert max(len(r.id_list) for r in pages) == 10
    assert sorted(i for r in pages for i in r.id_list) == [1, 2, 3, 4, 5, *range(10, 60)]


def test_pages_keep_their_size_for_ids_in_steps(spark):
    rows = [("clickJob", DAY, ["1"], "1", "keyword=a", "web", 10 * i) for i in range(100)]
    processed = clicks.click_processed(spark.createDataFrame(rows, LOG), row_id=F.col("n"))
    pages = sorted(clicks.click_lists(processed, page_size=10).collect(), key=lambda r: r.page)
    assert [list(r.id_list) for r in pages] == [[10 * (10 * p + i) for i in range(10)] for p in range(10)]


def test_ids_do_not_depend_on_the_partitioning(spark):
    def ids(frame):
        return {r.gid for r in clicks.click_grouped(frame).select("gid").collect()}

    assert ids(log(spark)) == ids(log(spark).repartition(3)) and len(ids(log(spark))) == 3


def test_text_scores_follow_the_list(spark):
    docs = spark.createDataFrame(
        [(1, (None, ["a", "b"])), (2, (None, ["b"])), (3, (None, ["c"]))],
        "jobno bigint, name struct<keyword string, token array<string>>",
    )
    lists = spark.createDataFrame(
        [("g", [2, 9, 1], ["b", "b", "z"]), ("h", [1], None)], "gid string, joblist array<bigint>, tokens array<string>"
    )
    rows = textscore.text_field_scores(lists, textscore.weighted_index(textscore.field_tokens(docs))).orderBy("gid", "pos_in_list").collect()
    # N = 3 texts, "b" in two of them.
    import math

    b = math.log(1 + 1.5 / 2.5)
    assert [round(r.text_name, 9) for r in rows] == [round(2 * b, 9), 0.0, round(2 * b, 9), 0.0]
    assert all(r.text_profile == 0.0 for r in rows)


def test_query_strings_parsed_per_impression_give_the_same_rows(spark):
    processed = log(spark, extra=20)
    more = processed.where("action = 'clickApply'").withColumn("datetime", F.lit(None).cast("timestamp"))
    processed = processed.unionByName(more).unionByName(more.withColumn("joblist", F.lit(None).cast("array<bigint>")))

    def rows(frame):
        return sorted(repr(r) for r in frame.collect())

    assert rows(clicks.click_grouped(processed, DEFAULT_PARAMS)) == rows(clicks.click_grouped(processed))
    for size in (3, 1000):
        pages = clicks.click_lists(processed, size, DEFAULT_PARAMS)
        assert rows(pages) == rows(clicks.click_lists(processed, size))


def test_clicks_are_moved_once_and_unparsed(spark):
    plan = clicks.click_grouped(log(spark), DEFAULT_PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "query_params" in plan and "query_params" not in below


def test_click_lists_parse_after_equal_queries_are_put_together(spark):
    plan = clicks._with_ids(log(spark), DEFAULT_PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source" in plan
