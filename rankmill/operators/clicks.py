"""Search-click log: typed clicks, impressions with graded relevance, exploded lists, click-through rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.expressions import bind
from rankmill.functions.metrics import action_weight, score_relevance
from rankmill.functions.querystring import DEFAULT_PARAMS, ParamRegistry, query_map, with_query_params
from rankmill.functions.scalars import case_codes, epoch_to_ts, to_integer
from rankmill.functions.text import tokenize
from rankmill.operators.running import group_rank

IMPRESSION_KEYS = ("source", "date", "datetime", "query_params", "joblist", "tokens")

# What impressions with the same id have in common beside the meaning of their query.
PLACE = ("source", "ms", "joblist")

# Clicks per row of ``click_lists``.
LIST_PAGE = 10_000


def cast_array(items: Column) -> Column:
    return F.transform(items, lambda item: to_integer(item))


def click_processed(
    log: DataFrame, row_id: Column | None = None, registry: ParamRegistry = DEFAULT_PARAMS
) -> DataFrame:
    """Typed clicks with parsed query, keyword tokens and the relevance of this one click per list item.

    Without ``row_id`` the id is a hash of the row, which a retried task gives again.
    """
    typed = log.select(
        (F.xxhash64(*log.columns) if row_id is None else row_id).alias("id"),
        "source",
        "action",
        epoch_to_ts(F.col("date")).alias("datetime"),
        to_integer(F.col("jobno")).alias("jobno"),
        cast_array(F.col("joblist")).alias("joblist"),
        "querystring",
    ).withColumn("date", F.to_date("datetime"))
    return (
        with_tokens(with_query_params(typed, registry=registry))
        .withColumn("rel_list", score_relevance(F.col("joblist"), F.col("jobno"), F.col("action"), scalar=True))
    )


def with_tokens(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("tokens", tokenize(F.col("query_params.keyword")))


def impression_id() -> Column:
    """128-bit id from the impression keys: the same on every run and on every retry of a task.

    The date follows from the time, the tokens from the keyword, so neither is needed.
    """
    keys = F.struct("source", F.unix_millis("datetime").alias("ms"), "joblist", "query_params")
    return F.md5(F.to_json(keys))


def _combine_clicks(joblist: Column, clicks: Column) -> Column:
    """Per list item: summed relevance and the action of its last click ('' without a click)."""

    def item(job: Column) -> Column:
        own = F.filter(clicks, lambda c: c["job"] == job)
        rel = F.aggregate(own, F.lit(0).cast("bigint"), lambda total, c: total + c["rel"])
        last = F.array_max(F.transform(own, lambda c: F.struct(c["id"], c["action"])))
        return F.struct(job.alias("job"), rel.alias("rel"), F.coalesce(last["action"], F.lit("")).alias("action"))

    return F.transform(joblist, item)


def _raw_clicks(processed: DataFrame, *columns: str) -> DataFrame:
    """The given columns beside source, list, time and its milliseconds; what is the same in these lies together.

    All impressions that can share an id have equal values here, so what follows needs no shuffle. Equal rows next to
    each other also take little room when they are moved.
    """
    milliseconds = processed.withColumn("ms", F.unix_millis("datetime"))
    return milliseconds.select("source", "date", "datetime", "ms", "joblist", *columns).repartition(*PLACE)


def click_grouped(processed: DataFrame, registry: ParamRegistry | None = None) -> DataFrame:
    """One row per impression: keys, id, number of clicks, relevance list and ``job_rel_list``.

    Clicks are first reduced to one row per (impression, listed job, action) with long buffers, so the
    second step gathers no more than one short list per impression, however often it was clicked. Clicks
    on jobs outside the list keep the impression alive and add no relevance.

    Give the ``registry`` of ``click_processed`` to parse every query string once per impression: clicks are then
    reduced by the string, and impressions whose strings mean the same are put together. All is done from one shuffle.
    """
    keys = ("source", "date", "datetime", "ms", "joblist")
    queries = ("query_params", "tokens") if registry is None else ("querystring",)
    listed = F.when(F.array_contains("joblist", F.col("jobno")), F.col("jobno"))
    per_job = (
        _raw_clicks(processed, *queries, "jobno", "action", "id")
        .withColumn("job", listed)
        .withColumn("act", F.when(F.col("job").isNotNull(), F.col("action")))
        .groupBy(*keys, *queries, "job", "act")
        .agg(
            F.sum(action_weight(F.col("act"))).alias("rel"),
            F.max("id").alias("id"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    click = F.struct("job", F.col("act").alias("action"), "rel", "id")
    gathered = per_job.groupBy(*keys, *queries).agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("job").isNotNull(), click)).alias("clicks")
    )
    if registry is not None:
        gathered = with_tokens(with_query_params(gathered, registry=registry))
    parts = F.struct("joblist", F.flatten(F.collect_list("clicks")).alias("clicks"))
    # Combined inside the aggregation, so that no later filter repeats the work.
    grouped = (
        gathered.withColumn("gid", impression_id())
        .groupBy("gid", *PLACE)
        .agg(
            *(F.first(key).alias(key) for key in IMPRESSION_KEYS if key not in PLACE),
            F.sum("n").alias("n_clicks"),
            bind(parts, lambda p: _combine_clicks(p["joblist"], p["clicks"])).alias("job_rel_list"),
        )
    )
    return grouped.withColumn("rel_list", F.col("job_rel_list.rel")).select(
        "gid", *IMPRESSION_KEYS, "n_clicks", "rel_list", "job_rel_list"
    )


def _with_ids(processed: DataFrame, registry: ParamRegistry) -> DataFrame:
    """(gid, id, jobno, action) of every click; each different query string of an impression is parsed once."""
    raw = ("source", "datetime", "joblist", "querystring")
    same = F.md5(F.to_json(F.struct("source", F.unix_millis("datetime").alias("ms"), "joblist", "querystring")))
    # Counted, as a mere distinct() would be dropped for the one by digest, after all clicks are parsed.
    different = processed.groupBy(*raw).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    parsed = with_query_params(different, registry=registry)
    ids = parsed.select(same.alias("raw"), impression_id().alias("gid")).groupBy("raw").agg(F.first("gid").alias("gid"))
    rows = processed.select(same.alias("raw"), "id", "jobno", "action")
    # Both sides grow with the clicks.
    return rows.join(ids.hint("merge"), "raw").select("gid", "id", "jobno", "action")


def click_lists(
    processed: DataFrame, page_size: int = LIST_PAGE, registry: ParamRegistry | None = None
) -> DataFrame:
    """The clicks of every impression as parallel lists ``id_list, jobno_list, action_list`` in id order.

    Page p holds the clicks with ranks p * ``page_size`` + 1 and on in the impression, so no task gathers an
    unbounded list, no page exceeds its size and no click is left out. ``registry`` is as for ``click_grouped``.
    """
    if registry is None:
        clicks = processed.select(impression_id().alias("gid"), "id", "jobno", "action")
    else:
        clicks = _with_ids(processed, registry)
    ranked = group_rank(clicks, ["gid"], [F.col("id"), F.col("action"), F.col("jobno")], "_rank")
    members = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / F.lit(page_size)))
    pages = members.groupBy("gid").agg((F.max("page") + 1).alias("n_pages"))
    members = members.join(pages, "gid")
    lists = members.groupBy("gid", "n_pages", "page").agg(
        F.array_sort(F.collect_list(F.struct("id", "action", "jobno"))).alias("c")
    )
    return lists.select(
        "gid",
        "n_pages",
        "page",
        F.col("c.id").alias("id_list"),
        F.col("c.jobno").alias("jobno_list"),
        F.col("c.action").alias("action_list"),
    )


def click_exploded(grouped: DataFrame) -> DataFrame:
    """One row per (impression, 0-based list position); text scores follow if the list carries them."""
    return grouped.select(
        "gid",
        "source",
        "date",
        "datetime",
        "query_params",
        "tokens",
        F.posexplode("job_rel_list").alias("pos_in_list", "item"),
    ).select("*", "item.*").drop("item")


def shown_jobs(processed: DataFrame) -> DataFrame:
    """(job, date) of every listed job, straight from the clicks.

    Every impression has a click that carries its list and date, so first and last days need no grouping.
    """
    return processed.select(F.explode("joblist").alias("job"), "date")


def ctr(exploded: DataFrame, binary_click: bool = False) -> DataFrame:
    """Impressions, clicks and their ratio by (date, source, action, keyword, job).

    ``click`` sums graded relevance, so the ratio may pass 1; ``binary_click`` counts clicked items instead.
    """
    click = F.when(F.col("rel") > 0, 1).otherwise(0) if binary_click else F.col("rel")
    return (
        exploded.groupBy("date", "source", "action", F.col("query_params.keyword").alias("keyword"), "job")
        .agg(F.count(F.lit(1)).alias("impr"), F.sum(click).alias("click"))
        .withColumn("CTR", F.col("click") / F.col("impr"))
    )


def ctr_report(rates: DataFrame) -> DataFrame:
    """CTR rows by falling (action, impr, CTR); the other keys break ties and split runs of equal rates."""
    return rates.orderBy(
        F.desc("action"), F.desc("impr"), F.desc("CTR"), "job", "keyword", "date", "source"
    )


def ctr_by_job_action(rates: DataFrame, start, stop) -> DataFrame:
    """Ratio of sums per (job, action) over an inclusive date window."""
    return (
        rates.where(F.col("date").between(F.lit(start), F.lit(stop)))
        .groupBy("job", "action")
        .agg(F.try_divide(F.sum("click"), F.sum("impr")).alias("CTR"))
    )


def ctr_features(by_job_action: DataFrame) -> DataFrame:
    """One row per job with a CTR column per click action, 0 where there is none."""
    return by_job_action.groupBy(F.col("job").alias("jobno")).agg(
        *(
            F.sum(F.when(F.col("action") == a, F.col("CTR")).otherwise(0.0)).alias(f"CTR_{a}")
            for a in ("clickApply", "clickSave", "clickJob")
        )
    )


def click_label_explode(processed: DataFrame) -> DataFrame:
    """Every click's list, exploded; the action stays only on the clicked item."""
    return (
        processed.select("*", F.posexplode("joblist").alias("pos", "job"))
        .withColumn("action", F.when(F.col("job") == F.col("jobno"), F.col("action")))
        .withColumn("keyword", F.col("query_params.keyword"))
        .select("id", "source", "date", "datetime", "keyword", "tokens", "pos", "job", "action")
    )


def label_with_action(labels: DataFrame, per_day: DataFrame) -> DataFrame:
    """Exploded labels with the daily action rates of the job, and the older label codes."""
    joined = labels.join(per_day.withColumnRenamed("jobno", "job"), "job", "left")
    # Label codes.
    codes = {"clickJob": 1, "saveJob": 2, "applyJob": 3}
    return joined.select(
        case_codes(F.col("action"), codes).alias("label"), "id", "pos", "viewJob", "saveJob", "applyJob"
    )


def keyword_impressions(log: DataFrame) -> DataFrame:
    """How often each (keyword, job) was shown, over click rows that carry a keyword."""
    return (
        with_keyword(log)
        .select("keyword", F.explode("joblist").alias("jobno"))
        .groupBy("keyword", "jobno")
        .agg(F.count(F.lit(1)).alias("impression"))
    )


def with_keyword(log: DataFrame) -> DataFrame:
    """Click rows whose parsed query holds ``keyword`` (fragments are not stripped here)."""
    params = log.withColumn("params", query_map(F.col("querystring"), strip_fragment=False))
    return params.where(F.map_contains_key("params", "keyword")).withColumn("keyword", F.col("params")["keyword"])


def no_keyword_rows(log: DataFrame) -> DataFrame:
    """Click rows whose parsed query holds no ``keyword``."""
    params = log.withColumn("params", query_map(F.col("querystring"), strip_fragment=False))
    return params.where(~F.map_contains_key("params", "keyword"))


def testset_processed(log: DataFrame, registry: ParamRegistry = DEFAULT_PARAMS) -> DataFrame:
    """Test queries, typed: list, parsed query and keyword tokens."""
    typed = log.select(F.col("id").alias("gid"), cast_array(F.col("joblist")).alias("joblist"), "querystring")
    return with_tokens(with_query_params(typed, registry=registry))


def testset_lists(processed: DataFrame) -> DataFrame:
    """Test queries with ``job_rel_list`` as impressions have it; relevance is unknown, so 0."""
    item = F.transform(
        "joblist",
        lambda job: F.struct(job.alias("job"), F.lit(0).cast("bigint").alias("rel"), F.lit("").alias("action")),
    )
    return processed.withColumn("job_rel_list", item)


def testset_exploded(lists: DataFrame) -> DataFrame:
    """One row per (test query, position); text scores follow if the list carries them."""
    return (
        lists.select(
            "gid", "query_params", "tokens", F.posexplode("job_rel_list").alias("pos_in_list", "item")
        )
        .select("*", "item.*")
        .drop("item", "action")
    )
