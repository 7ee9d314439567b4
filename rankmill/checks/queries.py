"""Every operator of the package as a query over whole supplied tables, flattened to plain columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rankmill.checks import adapters as raw
from rankmill.checks import model
from rankmill.functions import metrics, querystring, scalars, text
from rankmill.functions.querystring import DEFAULT_PARAMS
from rankmill.operators import actions, clicks, folds, jobs, ranking, scoring, textscore, trees
from rankmill.plans import dataset as ds
from rankmill.plans import export, training
from rankmill.plans.features import date_window, features, features_per_window
from rankmill.sources import catalog
from rankmill.sources.scratch import keep, scratch_path
from rankmill.sources.stages import days
from rankmill.sources.tables import TableSpec, read_table, read_through, write_table

Query = Callable[[SparkSession, str], DataFrame]

TRAIN_START, TRAIN_STOP = "2024-01-01", "2024-01-21"
TEST_START, TEST_STOP = "2024-01-22", "2024-01-23"
LAST_DAY = "2024-01-31"

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name; a trailing underscore avoids a clash with an import."""
    _REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- shared stages -----------------------------------------------------------------------------------


def _actions(spark, d):
    return actions.action_processed(raw.action_log(spark, d), row_id=F.col("event_id"))


def _counts(spark, d):
    return actions.action_count(_actions(spark, d))


def _unstacked(spark, d):
    return actions.action_unstacked(_counts(spark, d))


def _clicks(spark, d):
    return clicks.click_processed(raw.click_log(spark, d), row_id=F.col("click_id"))


def _grouped(spark, d):
    return clicks.click_grouped(_clicks(spark, d), DEFAULT_PARAMS)


def _exploded(spark, d):
    return clicks.click_exploded(_grouped(spark, d))


def _ctr(spark, d):
    return clicks.ctr(_exploded(spark, d))


def _ranges(spark, d):
    return jobs.job_date_range(_actions(spark, d), clicks.shown_jobs(_clicks(spark, d)))


def _jobs(spark, d):
    return jobs.job_processed(raw.job_master(spark, d))


def _companies(spark, d):
    return jobs.company_processed(raw.company_master(spark, d))


def _docs(spark, d):
    return jobs.job_company(_jobs(spark, d), _companies(spark, d))


def _built_index(spark, d):
    tokens = keep(textscore.field_tokens(_docs(spark, d)), "field-tokens")
    return _stored(textscore.weighted_index(tokens), catalog.TEXT_INDEX)


# The stored text index of this application, by the folder of its tables.
_INDEXES: dict[tuple[str, str], DataFrame] = {}


def _there(spark, stored):
    """Whether the files of a stored table were not dropped with the scratch folder."""
    paths = map(spark._jvm.org.apache.hadoop.fs.Path, stored.inputFiles()[:1])
    return all(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) for path in paths)


def _index(spark, d):
    """The index is a table that is built once and stored; every query that scores texts reads it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES or not _there(spark, _INDEXES[key]):
        _INDEXES[key] = _built_index(spark, d)
    return _INDEXES[key]


def _testset_rows(spark, d):
    return keep(clicks.testset_processed(raw.testset_log(spark, d)), "testset-processed")


def _features(spark, d, start=TRAIN_START, stop=TRAIN_STOP, rates=None):
    return features(_unstacked(spark, d), _ranges(spark, d), _jobs(spark, d), start, stop, rates)


def _labels(spark, d, start, stop):
    return ds.click_labels(_clicks(spark, d), _index(spark, d), start, stop, DEFAULT_PARAMS)


def _dataset(spark, d, start=TRAIN_START, stop=TRAIN_STOP):
    train = _features(spark, d)
    return ds.dataset(_labels(spark, d, start, stop), train, start, stop, TRAIN_START, TRAIN_STOP)


def _testset(spark, d):
    labels = ds.testset_labels(_testset_rows(spark, d), _index(spark, d))
    return ds.dataset(labels, _features(spark, d), TRAIN_START, TRAIN_STOP)


def _flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, doubles rounded, arrays joined: forms every engine prints alike."""

    def plain(name: str, dtype: str) -> Column:
        if dtype in ("date", "timestamp"):
            return F.col(name).cast("string").alias(name)
        if dtype == "double":
            return F.round(name, digits).alias(name)
        if dtype.startswith("array"):
            return F.array_join(name, ",", "?").alias(name)
        return F.col(name)

    return df.select(*(plain(name, dtype) for name, dtype in df.dtypes))


def _millis(df: DataFrame) -> DataFrame:
    return df.withColumn("datetime", F.unix_millis("datetime"))


def _stored(df: DataFrame, spec: TableSpec) -> DataFrame:
    spark = df.sparkSession
    base = scratch_path(spark, "tables")
    write_table(df, base, spec)
    return read_table(spark, base, spec)


# --- sources and sinks -------------------------------------------------------------------------------


@query
def scan_json_schema(spark, d):
    return _stored(raw.action_log(spark, d).drop("event_id"), catalog.ACTION_LOG)


@query
def scan_json_infer(spark, d):
    stored = _stored(raw.job_master(spark, d), catalog.JOB_MASTER)
    return stored.select("custno", "jobno", "description", "edu", "exp_jobcat3", "salary_low", "worktime")


@query
def scan_json_clicks(spark, d):
    """Click log through JSON with its fixed schema, arrays included."""
    return _flat(_stored(raw.click_log(spark, d).drop("click_id"), catalog.CLICK_LOG))


@query
def scan_parquet(spark, d):
    orders = read_table(spark, d, TableSpec("orders.parquet"))
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query
def sink_parquet(spark, d):
    return _flat(_stored(_counts(spark, d), replace(catalog.ACTION_COUNT, partition_by=())))


@query
def sink_json(spark, d):
    joined = _docs(spark, d).select("custno", "jobno", "job", "name", "invoice", "salary_low")
    stored = _stored(joined, catalog.JOB_COMPANY_JSON)
    return stored.select(
        "custno",
        "jobno",
        F.col("job.keyword").alias("job"),
        F.array_join("job.token", " ").alias("job_token"),
        F.col("name.keyword").alias("name"),
        "invoice",
        "salary_low",
    )


@query
def sink_partitioned(spark, d):
    both = [
        _features(spark, d, start, stop).select(
            "jobno", "viewJob_total", "open_days", "addr_no", "start_date", "stop_date"
        )
        for start, stop in ((TRAIN_START, TRAIN_STOP), (TEST_START, TEST_STOP))
    ]
    stored = _stored(both[0].unionByName(both[1]), catalog.FEATURES)
    return _flat(stored.where(F.col("start_date") == F.lit(TEST_START).cast("date")))


@query
def sink_dynamic_overwrite(spark, d):
    """A second write of one day replaces that day and keeps the others."""
    spec = TableSpec("action-count-by-day.pq", partition_by=("date",))
    base = scratch_path(spark, "tables")
    counts = _counts(spark, d)
    write_table(counts, base, spec)
    one_day = counts.where(F.col("date") == F.lit(TEST_START).cast("date"))
    write_table(one_day.withColumn("count", F.col("count") * 100), base, spec)
    return _flat(read_table(spark, base, spec))


@query
def read_through_(spark, d):
    base = scratch_path(spark, "tables")
    keys = {"start_date": TRAIN_START, "stop_date": TRAIN_STOP}

    def lookup():
        return read_through(spark, base, catalog.FEATURES, keys, lambda: _features(spark, d))

    lookup()
    return _flat(lookup().select("jobno", "viewJob_total", "web_total", "open_days", "start_date", "stop_date"))


def _store(spark, d):
    sources = {
        "actions": lambda: raw.action_log(spark, d),
        "clicks": lambda: raw.click_log(spark, d),
        "jobs": lambda: raw.job_master(spark, d),
        "companies": lambda: raw.company_master(spark, d),
    }
    ids = {"action_id": F.col("event_id"), "click_id": F.col("click_id")}
    return training.training_store(spark, scratch_path(spark, "stages"), sources, TRAIN_START, LAST_DAY, **ids)


@query
def dataset_read_through(spark, d):
    """The training set from stored stages, all of which the first call builds."""
    store = _store(spark, d)
    key = training.dataset_key(TRAIN_START, TRAIN_STOP)
    store.ensure("dataset", [key])
    return _flat(store.read("dataset", [key]))


@query
def incremental_days(spark, d):
    """Click rates of every day, built in two calls for windows that overlap: which build made each day's rows."""
    store = _store(spark, d)
    store.ensure("click_ctr", days("2024-01-05", TRAIN_STOP))
    before = sorted({entry.build for entry in store.entries("click_ctr").values()})
    rows = store.read("click_ctr", days(TRAIN_START, LAST_DAY))
    counted = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("impr").alias("impr"), F.sum("click").alias("click")
    )
    made = store.lineage().where(F.col("stage") == "click_ctr").select(
        F.to_date("key").alias("date"), F.when(F.col("build").isin(before), 1).otherwise(2).alias("call"), "input"
    )
    return _flat(counted.join(made, "date"))


def _rounded(frame):
    """Exported numbers rounded, so that their text is short."""
    names = ds.feature_columns(frame)
    return frame.withColumns({n: F.round(n, 6) for n, t in frame.dtypes if n in names and t == "double"})


def _export_frame(spark, d):
    frame = _rounded(_dataset(spark, d))
    return frame, ds.feature_columns(frame)


@query
def to_libsvm_lines(spark, d):
    frame, names = _export_frame(spark, d)
    return export.to_libsvm_lines(frame, names, with_tag=True)


@query
def group_lengths(spark, d):
    return ranking.group_lengths(_exploded(spark, d))


def _exported(spark, d, index_base):
    frame, names = _export_frame(spark, d)
    path = scratch_path(spark, "trainset")
    stored = _stored(frame, catalog.DATASET)
    export.write_libsvm(stored, path, names, index_base=index_base, compression="gzip")
    return path, len(names)


@query
def read_libsvm(spark, d):
    path, width = _exported(spark, d, 1)
    values = vector_to_array("features")
    return export.read_libsvm(spark, f"{path}/rows", width).select(
        F.col("label").cast("bigint").alias("label"), F.size(F.filter(values, lambda v: v != 0)).alias("nnz")
    )


@query
def read_group_file(spark, d):
    path, _ = _exported(spark, d, 0)
    return export.read_group_file(spark, f"{path}/query")


@query
def train_valid_export(spark, d):
    """The lines of both sets, exported from stages that are built once for the two."""
    store = _store(spark, d)
    train = training.dataset_key(TRAIN_START, TRAIN_STOP)
    valid = training.dataset_key(TEST_START, TEST_STOP, TRAIN_START, TRAIN_STOP)
    options = {"prepare": _rounded, "with_tag": True, "compression": "gzip"}
    paths = training.export_sets(store, scratch_path(spark, "export"), train, valid, **options)
    sets = [spark.read.text(f"{path}/rows").withColumn("name", F.lit(path.rsplit("/", 1)[-1])) for path in paths]
    return sets[0].unionByName(sets[1])


@query
def export_alignment(spark, d):
    """Rows and lengths of an export in parts put together by position: every group meets its own length."""
    labels = ds.label_columns(_exploded(spark, d).withColumn("text_score", _no_scores()))
    path = scratch_path(spark, "aligned")
    export.write_aligned(_stored(labels, catalog.LABELS), path, 7, ["rel", "order"], with_tag=True, compression="gzip")
    upto = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lengths = export.read_parts(spark, f"{path}/query", F.col("value").cast("bigint")).select(
        "part", F.col("line").alias("group"), F.col("value").alias("length"), F.sum("value").over(upto).alias("stop")
    )
    # A group's length stands at its first row; rows go on until the next one.
    starts = lengths.select("part", (F.col("stop") - F.col("length")).alias("line"), "group", "length")
    gid = F.regexp_extract("value", "# gid:([0-9a-f]+)", 1)
    rows = export.read_parts(spark, f"{path}/rows", gid).join(starts, ["part", "line"], "left")
    filled = rows.withColumns({c: F.last(c, True).over(upto) for c in ("group", "length")})
    return filled.groupBy(F.col("value").alias("gid")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("length").alias("length"),
        F.count_distinct("part", "group").alias("n_groups"),
    )


def _no_scores():
    return F.struct(*(F.lit(0.0).alias(c) for c in textscore.SCORE_COLUMNS))


# --- projections and filters -------------------------------------------------------------------------


@query
def job_processed(spark, d):
    frame = _jobs(spark, d)
    for name in jobs.JOB_TEXT:
        frame = frame.withColumn(f"{name}_token", F.array_join(f"{name}.token", " ")).withColumn(
            name, F.col(f"{name}.keyword")
        )
    return frame


@query
def company_processed(spark, d):
    frame = _companies(spark, d)
    return frame.select(
        "custno",
        "invoice",
        F.col("name.keyword").alias("name"),
        F.array_join("name.token", " ").alias("name_token"),
        *(
            F.md5(part).alias(f"{name}_{kind}")
            for name in jobs.COMPANY_TEXT[1:]
            for kind, part in (("text", F.col(f"{name}.keyword")), ("token", F.array_join(f"{name}.token", " ")))
        ),
    )


@query
def label_flatten(spark, d):
    return _flat(ds.label_columns(_labels(spark, d, TRAIN_START, LAST_DAY)))


@query
def date_window_filter(spark, d):
    return _flat(date_window(_actions(spark, d), TRAIN_START, TRAIN_STOP).select("id", "jobno", "date", "action"))


@query
def case_codes(spark, d):
    code = scalars.case_codes(F.col("worktime"), jobs.WORKTIME_CODES)
    return raw.job_master(spark, d).select("jobno", "worktime", code.alias("code"))


@query
def no_keyword_rows(spark, d):
    return clicks.no_keyword_rows(raw.click_log(spark, d)).select("click_id", "jobno", "action", "querystring")


@query
def no_keyword_top(spark, d):
    """The first ten such rows in log order."""
    rows = clicks.no_keyword_rows(raw.click_log(spark, d))
    return rows.select("click_id", "jobno", "action").orderBy("click_id", "jobno", "action").limit(10)


@query
def split_xy(spark, d):
    return _flat(ds.split_xy(_dataset(spark, d))[1])


@query
def split_y(spark, d):
    return ds.split_xy(_dataset(spark, d))[0]


# --- actions -----------------------------------------------------------------------------------------


@query
def action_processed(spark, d):
    return _flat(_millis(_actions(spark, d)))


@query
def action_count(spark, d):
    return _flat(_counts(spark, d))


@query
def action_pivot(spark, d):
    return _flat(actions.action_pivot(_counts(spark, d)))


@query
def action_unstacked(spark, d):
    return _flat(_unstacked(spark, d))


@query
def action_count_per_day(spark, d):
    return _flat(actions.action_count_per_day(_counts(spark, d)))


@query
def date_span(spark, d):
    return _flat(actions.date_span(_ranges(spark, d), "date_start", "date_stop"))


@query
def epoch_to_ts(spark, d):
    log = raw.action_log(spark, d)
    stamp = scalars.epoch_to_ts(F.col("date"))
    return log.select(
        "event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS").alias("datetime"), F.to_date(stamp).cast("string").alias("date")
    )


# --- clicks ------------------------------------------------------------------------------------------


@query
def click_processed(spark, d):
    frame = _millis(_clicks(spark, d)).withColumn("edu", F.col("query_params.edu")).withColumn(
        "keyword", F.col("query_params.keyword")
    )
    return _flat(frame.drop("query_params"))


@query
def cast_array(spark, d):
    log = raw.testset_log(spark, d)
    return log.select("id", F.array_join(clicks.cast_array(F.col("joblist")), ",").alias("joblist"))


@query
def click_grouped(spark, d):
    frame = _grouped(spark, d)
    return _flat(
        _millis(frame).select(
            "gid",
            "source",
            "date",
            "datetime",
            F.col("query_params.keyword").alias("keyword"),
            "joblist",
            "tokens",
            "n_clicks",
            "rel_list",
            F.col("job_rel_list.action").alias("action_of_job"),
        )
    )


@query
def click_lists(spark, d):
    return _flat(clicks.click_lists(_clicks(spark, d), registry=DEFAULT_PARAMS))


@query
def impression_explode(spark, d):
    frame = _millis(_exploded(spark, d)).withColumn("keyword", F.col("query_params.keyword"))
    return _flat(frame.drop("query_params"))


@query
def ctr(spark, d):
    return _flat(clicks.ctr_report(_ctr(spark, d)))


@query
def ctr_binary(spark, d):
    return _flat(clicks.ctr(_exploded(spark, d), binary_click=True))


@query
def ctr_by_job_action(spark, d):
    return _flat(clicks.ctr_by_job_action(_ctr(spark, d), TRAIN_START, TRAIN_STOP))


@query
def ctr_features(spark, d):
    return _flat(clicks.ctr_features(clicks.ctr_by_job_action(_ctr(spark, d), TRAIN_START, TRAIN_STOP)))


@query
def click_label_explode(spark, d):
    return _flat(_millis(clicks.click_label_explode(_clicks(spark, d))))


@query
def label_with_action(spark, d):
    per_day = actions.action_count_per_day(_counts(spark, d))
    return _flat(clicks.label_with_action(clicks.click_label_explode(_clicks(spark, d)), per_day))


@query
def keyword_impressions(spark, d):
    stored = _stored(clicks.keyword_impressions(raw.click_log(spark, d)), catalog.KEYWORD_IMPRESSIONS)
    return stored.select("keyword", "jobno", "impression")


@query
def testset_exploded(spark, d):
    lists = clicks.testset_lists(clicks.testset_processed(raw.testset_log(spark, d)))
    frame = clicks.testset_exploded(lists)
    return _flat(frame.withColumn("keyword", F.col("query_params.keyword")).drop("query_params"))


@query
def score_relevance(spark, d):
    """Relevance from the parallel lists of ``click_lists``, by the list form of the function."""
    processed = _clicks(spark, d)
    lists = clicks.click_lists(processed, registry=DEFAULT_PARAMS)
    shown = clicks.click_grouped(processed, DEFAULT_PARAMS).select("gid", "joblist")
    per_page = lists.join(shown, "gid").select(
        "gid",
        F.posexplode(metrics.score_relevance(F.col("joblist"), F.col("jobno_list"), F.col("action_list"))).alias(
            "pos_in_list", "rel"
        ),
    )
    return per_page.groupBy("gid", "pos_in_list").agg(F.sum("rel").alias("rel"))


# --- jobs --------------------------------------------------------------------------------------------


@query
def job_date_range(spark, d):
    return _flat(_ranges(spark, d))


@query
def open_days(spark, d):
    return _flat(jobs.open_days(_ranges(spark, d), "2024-01-03", "2024-01-20"))


@query
def job_company(spark, d):
    return _docs(spark, d).select(
        "custno", "jobno", F.col("job.keyword").alias("job"), F.col("name.keyword").alias("name"), "invoice"
    )


@query
def uuid_to_long(spark, d):
    return raw.job_master(spark, d).select("jobno", scalars.uuid_to_long(F.col("custno")).alias("custno"))


# --- features and datasets ---------------------------------------------------------------------------


@query
def features_(spark, d):
    return _flat(_features(spark, d))


@query
def features_with_ctr(spark, d):
    frame = _features(spark, d, rates=_ctr(spark, d))
    return _flat(frame.select("jobno", "viewJob_total", "open_days", "CTR_clickApply", "CTR_clickSave", "CTR_clickJob"))


@query
def dataset(spark, d):
    return _flat(_dataset(spark, d))


@query
def testset_dataset(spark, d):
    return _flat(_testset(spark, d))


# --- text --------------------------------------------------------------------------------------------

_NARROW = "abcdefghijklmnopqrstuvwxyz0123456789 "
_WIDE = "".join("　" if c == " " else chr(ord(c) + 0xFEE0) for c in _NARROW)


@query
def to_halfwidth(spark, d):
    """Documents widened first, as the tables hold no full-width text."""
    wide = F.translate("text", _NARROW, _WIDE)
    return raw.table(spark, d, "documents").select("doc_id", F.md5(text.to_halfwidth(wide)).alias("digest"))


@query
def rm_repeat(spark, d):
    cleaned = text.rm_repeat(F.col("text"))
    return raw.table(spark, d, "documents").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("n_chars")
    )


@query
def simple_clean(spark, d):
    cleaned = text.simple_clean(F.col("text"))
    return raw.table(spark, d, "documents").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("n_chars")
    )


@query
def tokenize(spark, d):
    tokens = text.tokenize(F.col("text"))
    return raw.table(spark, d, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest")
    )


@query
def tokenize_signs(spark, d):
    tokens = text.tokenize(F.col("text"), signs=True)
    return raw.table(spark, d, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest")
    )


@query
def postings(spark, d):
    return textscore.postings(textscore.field_tokens(_docs(spark, d)))


@query
def idf_table(spark, d):
    return _flat(textscore.idf_table(keep(textscore.field_tokens(_docs(spark, d)))))


@query
def text_index(spark, d):
    """The weighted index, built anew: entries, tokens and weights of every job."""
    total = F.aggregate("idf", F.lit(0.0), lambda acc, weight: acc + weight)
    return _built_index(spark, d).select(
        F.col("job"),
        F.size("token").alias("n_entries"),
        F.size(F.array_distinct("token")).alias("n_tokens"),
        F.round(total, 4).alias("weight"),
    )


def _scored_lists(spark, d):
    return textscore.text_field_scores(_testset_rows(spark, d), _index(spark, d))


@query
def text_field_scores(spark, d):
    return _flat(_scored_lists(spark, d))


# --- query strings -----------------------------------------------------------------------------------


def _page_queries(spark, d):
    after = F.when(F.instr("url", "?") > 0, F.substring_index("url", "?", -1))
    return raw.table(spark, d, "pages").select("page_id", after.alias("q"))


@query
def qs_parse_map(spark, d):
    parsed = _page_queries(spark, d).select("page_id", F.explode(querystring.query_map(F.col("q"))).alias("k", "v"))
    return parsed


@query
def qs_params(spark, d):
    parsed = querystring.with_query_params(raw.testset_log(spark, d)).select("id", "query_params.*")
    return _flat(parsed)


@query
def qs_custom_param(spark, d):
    """A registry extended by one parameter of its own."""
    registry = querystring.DEFAULT_PARAMS.copy()
    registry.register("page", IntegerType(), lambda v: v.try_cast("int") * 10)
    parsed = querystring.with_query_params(_page_queries(spark, d), "q", registry=registry)
    return parsed.select("page_id", F.col("query_params.page").alias("page"), F.col("query_params.order").alias("order"))


# --- metrics -----------------------------------------------------------------------------------------


@query
def dcg_at_k(spark, d):
    rel = F.col("rel_list")
    return _flat(
        _grouped(spark, d).select(
            "gid",
            metrics.dcg_at_k(rel).alias("dcg"),
            metrics.dcg_at_k(rel, 3).alias("dcg_3"),
            metrics.dcg_at_k(rel, 3, method=0).alias("dcg_3_m0"),
        )
    )


@query
def ndcg_at_k(spark, d):
    rel = F.col("rel_list")
    return _flat(
        _grouped(spark, d).select(
            "gid",
            metrics.ndcg_at_k(rel).alias("ndcg"),
            metrics.ndcg_at_k(rel, 3).alias("ndcg_3"),
            metrics.ndcg_at_k(rel, 3, method=0).alias("ndcg_3_m0"),
        )
    )


@query
def mean_ndcg(spark, d):
    per_click = ranking.mean_list_ndcg(_clicks(spark, d)).withColumn("over", F.lit("click"))
    per_list = ranking.mean_list_ndcg(_grouped(spark, d)).withColumn("over", F.lit("impression"))
    return _flat(per_click.unionByName(per_list))


@query
def rerank(spark, d):
    return ranking.rank_rows(raw.scored_rows(spark, d)).select("gid", "rank", "y", "pred")


@query
def ndcg_prediction(spark, d):
    return _flat(ranking.grouped_ndcg(raw.scored_rows(spark, d)))


@query
def ndcg_prediction_mean(spark, d):
    scored = raw.scored_rows(spark, d)
    return _flat(ranking.mean_metric(ranking.grouped_ndcg(scored, k=20), "ndcg"))


@query
def ndcg_empty_rules(spark, d):
    """NDCG at 20 under all rules for groups without gain."""
    scores = ranking.grouped_ndcg(raw.scored_rows(spark, d), k=20, empty_group="skip")
    return _flat(ranking.mean_by_rule(scores, "ndcg"))


@query
def ndcg_hot_group(spark, d):
    """Every group a large part of all rows, and handled as such."""
    rows = raw.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("gid"), (F.col("l_quantity") % 4).cast("bigint").alias("y"), F.col("l_discount").alias("pred")
    )
    return _flat(ranking.grouped_ndcg(rows, k=500, big_group=1000))


def _placed(spark, d):
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return raw.scored_rows(spark, d).withColumn("pos", place)


@query
def mean_average_precision(spark, d):
    scores = ranking.grouped_average_precision(_placed(spark, d), "pos", empty_group="skip")
    return _flat(ranking.mean_by_rule(scores, "ap"))


@query
def metric_set(spark, d):
    return _flat(ranking.metric_set(_placed(spark, d), "pos"))


def _sequence(spark, d):
    labels = raw.table(spark, d, "labels")
    return labels.select("doc_id", (F.col("quality") + F.col("toxic")).alias("y"), (F.col("doc_id") % 7).alias("pred"))


@query
def chunk20_ndcg(spark, d):
    return _flat(ranking.ndcg_score_of_truth(_sequence(spark, d), [F.col("doc_id")]))


@query
def chunk20_ndcg_prediction(spark, d):
    return _flat(ranking.ndcg_score_of_prediction(_sequence(spark, d), [F.col("doc_id")]))


# --- folds, scoring, surface -------------------------------------------------------------------------


def _folds(spark, d):
    return folds.cv_folds(actions.date_span(_actions(spark, d)), train_ratio=0.9)


@query
def cv_folds(spark, d):
    return _flat(_folds(spark, d))


@query
def cv_assign(spark, d):
    tagged = folds.cv_assign(_counts(spark, d), _folds(spark, d))
    return tagged.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("n_actions"))


def linear_scorer(weights):
    """Weighted sum of the features, missing ones counting 0."""
    fixed = np.asarray(weights, dtype="float64")
    return lambda matrix: np.nan_to_num(matrix) @ fixed


@query
def score_rows(spark, d):
    columns = ["viewJob_total", "saveJob_total", "applyJob_total"]
    frame = _unstacked(spark, d).select("date", "jobno", *columns)
    return _flat(scoring.score_rows(frame, columns, linear_scorer([0.5, 2.0, 3.25])))


@query
def score_trees(spark, d):
    """A tree ensemble over counts, where no action counts as missing."""
    present = {name: F.nullif(F.col(name), F.lit(0)) for name in model.FEATURES}
    frame = _unstacked(spark, d).select("date", "jobno", *model.FEATURES).withColumns(present)
    return _flat(trees.score_trees(frame, trees.from_dump(model.TREES, model.FEATURES, model.BASE)))


@query
def features_per_fold(spark, d):
    """Features of the training window of every fold."""
    windows = _folds(spark, d).select(
        "fold", F.col("train_start_date").alias("start_date"), F.col("train_stop_date").alias("stop_date")
    )
    return _flat(features_per_window(_unstacked(spark, d), _ranges(spark, d), _jobs(spark, d), windows))


@query
def udf_surface(spark, d):
    """Builders called by column name, as registered functions would be."""
    return _flat(
        _grouped(spark, d).select(
            "gid",
            metrics.ndcg_at_k.udf("rel_list", k=5).alias("ndcg_5"),
            F.size(text.tokenize.udf("query_params.keyword")).alias("n_tokens"),
        )
    )
