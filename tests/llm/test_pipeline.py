"""The pipeline's stages on what the stage before kept, against brute force."""

import corpus_pipeline
from rankmill.llm import quality
from rankmill.sources.scratch import keep
from tests.llm.test_exact import check_packed, plain_components, plain_contamination, plain_lines


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
        after.append(docs)
        if len(after) < 5:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality as label")
    kept = quality.apply_rules(given, quality.fit(given, rows)).where("kept")
    assert {i for i, _ in texts(after[0])} == {r.doc_id for r in kept.collect()}
    lines = plain_lines(texts(after[0]))
    assert dict(texts(after[1])) == {i: text for i, (_, _, text) in lines.items()}
    groups = plain_components(texts(after[1]), 5, 80, 100)
    assert {i for i, _ in texts(after[2])} == {i for i, (_, c) in groups.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = plain_contamination(texts(after[2]), items)
    assert {i for i, _ in texts(after[3])} == {i for i, (_, n, _) in hits.items() if n == 0}
    assert check_packed(after[4].collect(), texts(after[3]), 1024) > 0.9


def test_run_keeps_extra_columns_and_nulls_in_hand(spark, sf_dir):
    odd = spark.createDataFrame(
        [(1, None, "en", "s", 0, 1), (None, "x " * 40, None, None, None, 2), (3, "", "en", "s", 0, 3)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int",
    )
    for _, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, odd, sf_dir)
        assert tuple(found.columns) == corpus_pipeline.COLUMNS
        found.collect()


def test_one_row_of_each_near_duplicate_group_stays(spark, sf_dir):
    """Null and repeated ids: no text without a copy is lost, no second copy stays."""
    a, b, c, d, e, f = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef")
    rows = [
        (None, a),
        *[(None, b), (None, b), (None, b + " more")],
        *[(5, c), (5, c), (5, c + " more")],
        *[(6, d), (6, e)],
        *[(9, f + " more"), (8, f), (None, f)],
    ]
    frame = spark.createDataFrame(
        [(i, text, "en", "s", len(text)) for i, text in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    kept = texts(corpus_pipeline.near_duplicates(spark, frame, sf_dir))
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (5, c), (6, d), (6, e), (8, f)], key=str)
