"""The weighted index against a plain statement, hot jobs, and what the checked tables exercise."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from rankmill.checks.queries import all_queries
from rankmill.operators import textscore
from rankmill.operators.textscore import SCORE_COLUMNS, TEXT_FIELDS
from rankmill.sources import catalog
from rankmill.sources.scratch import keep, scratch_path
from rankmill.sources.tables import read_table, write_table

QUERIES = all_queries()


def plain_scores(lists, index):
    """{(gid, position): eight sums}; ``index`` maps (job, field) to a set of tokens."""
    sizes = Counter(field for _, field in index)
    df = Counter((field, token) for (_, field), tokens in index.items() for token in tokens)
    out = {}
    for gid, jobs, tokens in lists:
        for at, job in enumerate(jobs):
            sums = []
            for field in TEXT_FIELDS:
                n = sizes[field]
                hits = [df[field, t] for t in tokens or [] if t in index.get((job, field), ())]
                sums.append(sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in hits))
            out[gid, at] = sums
    return out


def made(spark, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    index = {}
    for job in range(30):
        for field in rng.sample(TEXT_FIELDS, rng.randint(0, 8)):
            index[job, field] = set(rng.choices(words, k=rng.choice([1, 5, 200])))
    lists = [(str(g), [rng.choice([0, 0, 0, rng.randrange(33)]) for _ in range(rng.randint(0, 6))], rng.choices(words, k=4) * 2) for g in range(80)]
    lists += [("none", [1, 2], []), ("null", [1, 2], None), ("nowhere", [99, None], ["w1"])]
    rows = [(job, field, sorted(tokens)) for (job, field), tokens in index.items()]
    tokens = spark.createDataFrame(rows, "job bigint, field string, tokens array<string>")
    shown = spark.createDataFrame(lists, "gid string, joblist array<bigint>, tokens array<string>")
    return lists, index, keep(shown), keep(tokens)


def stored(spark, tokens):
    base = scratch_path(spark, "index")
    write_table(textscore.weighted_index(tokens), base, catalog.TEXT_INDEX)
    return base, read_table(spark, base, catalog.TEXT_INDEX)


def test_scores_match_a_plain_statement_with_and_without_hot_jobs(spark):
    lists, index, shown, tokens = made(spark)
    _, weights = stored(spark, tokens)
    want = plain_scores(lists, index)
    for share in (1.1, 1 / 20, 1e-9):
        rows = textscore.text_field_scores(shown, weights, hot_share=share).collect()
        assert len(rows) == len(want)
        for r in rows:
            assert all(math.isclose(r[c], w, abs_tol=1e-9) for c, w in zip(SCORE_COLUMNS, want[r.gid, r.pos_in_list]))


def test_hot_jobs_are_few_and_none_is_left_out(spark):
    _, _, shown, _ = made(spark)
    positions = shown.select(F.explode("joblist").alias("job")).groupBy("job").count().collect()
    total = sum(r["count"] for r in positions)
    hot = textscore._hot_jobs(shown, 1 / 20)
    assert sorted(hot) == sorted(r.job for r in positions if r.job is not None and r["count"] > total / 20)
    assert 0 in hot and len(hot) < 20


def test_the_index_is_not_shuffled(spark):
    _, _, shown, tokens = made(spark)
    base, weights = stored(spark, tokens)
    # Another session would find the files, not the table.
    spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith('rankmill_')][-1]}")
    for index in (weights, read_table(spark, base, catalog.TEXT_INDEX)):
        plan = textscore.text_field_scores(shown, index)._jdf.queryExecution().executedPlan().toString()
        right = plan[plan.index("SortMergeJoin") :].split("FileScan")
        assert "Exchange hashpartitioning(job" in right[0] and "Exchange" not in right[1].split("\n", 1)[1]
        assert "Bucketed: true" in plan


def test_blocks_give_the_index_of_one_block_and_move_no_postings(spark):
    lists, index, shown, tokens = made(spark, 2)
    odd = [(7, "job", ["w1", None, "twice", "twice"]), (None, "name", ["w1"]), (40, "job", []), (41, "job", [None])]
    both = keep(tokens.where("job <> 7").unionByName(spark.createDataFrame(odd, tokens.schema)))
    want = sorted((str(j), f, t) for j, f, held in both.collect() for t in held if t is not None)
    weight = {(r.field, r.token): r.idf for r in textscore.idf_table(both).collect()}
    for size in (10**9, 100):
        rows = textscore.weighted_index(both, block_tokens=size).collect()
        assert len(rows) == len({j for j, *_ in want})
        assert sorted((str(r.job), TEXT_FIELDS[f - 1], t) for r in rows for f, t in zip(r.field, r.token)) == want
        for r in rows:
            assert r.starts[0] == 0 and r.starts[-1] == len(r.token) == len(r.idf) and r.starts == sorted(r.starts)
            assert all(math.isclose(w, weight[TEXT_FIELDS[f - 1], t]) for f, t, w in zip(r.field, r.token, r.idf))
    plan = textscore.weighted_index(both)._jdf.queryExecution().executedPlan().toString().split("\n")
    exploded = [at for at, line in enumerate(plan) if "Generate explode" in line]
    assert exploded and all("HashAggregate" in "".join(plan[at - 3 : at]) and "Exchange" not in "".join(plan[at - 3 : at]) for at in exploded)


def test_the_index_is_written_without_a_shuffle(spark):
    _, _, _, tokens = made(spark, 3)
    assert catalog.TEXT_INDEX.gathered
    index = textscore.weighted_index(tokens, block_tokens=100)
    bucket = F.pmod(F.hash("job"), F.lit(catalog.TEXT_INDEX.buckets))
    # A job lies in one row, a block in one task, and a bucket's blocks are a part of it.
    rows = index.select("job", bucket.alias("bucket"), F.spark_partition_id().alias("task")).collect()
    assert len({r.job for r in rows}) == len(rows)
    _, weights = stored(spark, tokens)
    assert len(weights.inputFiles()) == len({r.bucket for r in rows})
    assert {r.job for r in weights.select("job").collect()} == {r.job for r in rows}


def test_checked_tables_reach_every_score_and_label(spark, sf_dir):
    scores = QUERIES["text_field_scores"](spark, sf_dir).select(*(F.max(c) for c in SCORE_COLUMNS)).first()
    assert all(value > 0 for value in scores)
    labels = QUERIES["label_with_action"](spark, sf_dir).select("label").distinct().collect()
    assert {r.label for r in labels} == {0, 1, 2, 3}


def test_every_document_is_a_company_text(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert QUERIES["company_processed"](spark, sf_dir).count() == n
