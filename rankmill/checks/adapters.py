"""Turn the supplied tables into the raw logs and masters the pipeline reads.

All are projections or joins on a unique key; no list is gathered across rows, so a hot order or a run of
copied rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First day of the logs, as epoch milliseconds (2024-01-01), and the length of a day.
FIRST_DAY_MS = 1_704_067_200_000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle a table by ``key``: row-wise parsing follows, and a file may have fewer parts than there are tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _pick(value: Column, *choices: str) -> Column:
    """Choice number ``value``; the last one for anything beyond."""
    picked = F
    for i, choice in enumerate(choices[:-1]):
        picked = picked.when(value == i, F.lit(choice))
    return picked.otherwise(F.lit(choices[-1]))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw item actions from ``events``; keeps ``event_id`` to identify rows."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "viewJob")
        .when(kind == "click", "saveJob")
        .when(kind == "purchase", "applyJob")
        .otherwise(kind)
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("jobno"),
        millis.cast("string").alias("date"),
        action.alias("action"),
        _pick(F.col("event_id") % 4, "web", "mobileWeb", "app", "other").alias("source"),
        F.lit(None).cast("string").alias("device"),
        "event_id",
    )


def _query_string(k: Column, keyword: Column) -> Column:
    return F.concat(
        F.when((k % 5 == 0) | keyword.isNull(), F.lit(""))
        .when(k % 5 == 1, F.lit("keyword=&"))
        .otherwise(F.concat(F.lit("keyword="), F.replace(keyword, F.lit(" "), F.lit("+")), F.lit("&"))),
        F.lit("edu=2%2C"),
        (k % 4).cast("string"),
        F.lit("&order="),
        (k % 7).cast("string"),
        F.lit("&asc=&mode="),
        _pick(k % 3, "s", "l", "z"),
        F.lit("&kwop="),
        (k % 2).cast("string"),
        F.lit("&sctp="),
        _pick(k % 4, "P", "S", "N"),
        F.lit("&wktm="),
        _pick(k % 6, "%E9%80%B1%E4%BC%91%E4%BA%8C%E6%97%A5", "%E9%9A%94%E9%80%B1%E4%BC%91", "none"),
        F.lit("&zone=1%2Cx%2C"),
        (k % 5).cast("string"),
        F.lit("&scmin="),
        (k % 9 * 1000).cast("string"),
        F.when(k % 6 == 0, F.lit("&order=9&broken")).otherwise(F.lit("")),
        F.when(k % 8 == 0, F.lit("&s5=256&sr=99&m=1")).otherwise(F.lit("&s5=1")),
        F.lit("#frag"),
        k.cast("string"),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _plain_word(line: Column) -> Column:
    """The first word of ASCII letters between blanks, or at an end; NULL if there is none."""
    found = F.regexp_extract(F.lower(line), "(^| )([a-z]+)( |$)", 2)
    return F.when(found != "", found)


def _query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a word of its first, second and last line."""
    lines = _lines(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(
            " ", _plain_word(F.get(lines, 0)), _plain_word(F.get(lines, 1)), _plain_word(F.element_at(lines, -1))
        ).alias("words"),
    )


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the names and words that its query is made of."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    orders = _spread(orders, "o_orderkey").withColumn("doc_id", F.floor(F.col("o_custkey") / 2))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_custkey"), "p_name", "p_type")
    return orders.join(_query_words(spark, sf_dir), "doc_id", "left").join(names, "o_custkey", "left").drop("doc_id")


def _list_columns() -> list[Column]:
    """List, time, source and query string of an order from ``_shown``."""
    k = F.col("o_orderkey")
    parts = (F.col("p_name"), F.lower("p_type"), F.lit("brand company"), F.col("words"), F.expr("substr(o_orderpriority, 3)"))
    keyword = F.when(F.col("p_name").isNotNull(), F.concat_ws(" ", *parts))
    items = F.transform(F.sequence(F.lit(0), (k % 13).cast("int")), lambda i: F.col("o_custkey") + i * (k % 7))
    millis = F.lit(FIRST_DAY_MS) + (k % 31) * F.lit(DAY_MS) + (k * 7919) % F.lit(DAY_MS)
    return [
        F.transform(items, lambda item: item.cast("string")).alias("joblist"),
        millis.cast("string").alias("date"),
        _pick(k % 3, "web", "mobileWeb", "app").alias("source"),
        _query_string(k, keyword).alias("querystring"),
    ]


def result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shown result list per order: 1 to 13 item numbers, some lists repeating one item.

    The query has words of the first item, of its kinds and of its company's text.
    """
    return _shown(spark, sf_dir).select("o_orderkey", *_list_columns())


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw clicks: every line of an order is one click on its list; keeps ``click_id`` to order clicks."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    flag = F.col("l_returnflag")
    action = (
        F.when(F.col("l_linenumber") == 6, "saveJob")
        .when(F.col("l_linenumber") == 5, "applyJob")
        .when((flag == "A") & (F.col("l_linestatus") == "O"), "clickShare")
        .when(flag == "A", "clickJob")
        .when(flag == "R", "clickSave")
        .otherwise("clickApply")
    )
    place = ((F.col("l_linenumber") + F.col("l_partkey")) % F.size("joblist") + 1).cast("int")
    outside = F.col("l_linenumber") == 7
    job = F.when(outside, F.col("l_partkey").cast("string")).otherwise(F.element_at("joblist", place))
    # Both sides grow with the data: shuffle them, a hot order's lines can then be split at run time. What is moved are
    # the few columns that lists are made of, not the lists.
    shown = lines.join(_shown(spark, sf_dir).hint("merge"), "o_orderkey")
    clicks = shown.select("o_orderkey", *_list_columns(), *(c for c in lines.columns if c != "o_orderkey"))
    return clicks.select(
        action.alias("action"),
        "date",
        "joblist",
        job.alias("jobno"),
        "querystring",
        "source",
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("click_id"),
    )


def testset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_lists(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "joblist", "querystring")


def _uuid_of(number: Column) -> Column:
    digits = F.md5(number.cast("string"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digits, start, size) for start, size in cuts))


def job_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from ``part``; two parts share a company."""
    k = F.col("p_partkey")

    def small(modulus: int) -> Column:
        return k % modulus

    def text(modulus: int) -> Column:
        return (k % modulus).cast("string")

    return _spread(table(spark, sf_dir, "part"), "p_partkey").select(
        _uuid_of(F.floor(k / 2)).alias("custno"),
        k.cast("string").alias("jobno"),
        F.col("p_type").alias("description"),
        F.col("p_name").alias("job"),
        F.col("p_brand").alias("others"),
        small(97).alias("addr_no"),
        F.col("p_size").cast("bigint").alias("edu"),
        text(11).alias("exp_jobcat1"),
        text(12).alias("exp_jobcat2"),
        # Not a number for every 13th item.
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(text(13)).alias("exp_jobcat3"),
        text(14).alias("industry"),
        text(15).alias("jobcat1"),
        text(16).alias("jobcat2"),
        text(17).alias("jobcat3"),
        small(3).alias("language1"),
        small(4).alias("language2"),
        small(5).alias("language3"),
        text(18).alias("major_cat"),
        text(19).alias("major_cat2"),
        text(20).alias("major_cat3"),
        small(6).alias("need_emp"),
        small(7).alias("need_emp1"),
        small(8).alias("period"),
        small(9).alias("role"),
        small(10).alias("role_status"),
        small(21).alias("s2"),
        small(22).alias("s3"),
        small(23).alias("s9"),
        F.floor(F.col("p_retailprice") * 2).alias("salary_high"),
        F.floor("p_retailprice").alias("salary_low"),
        small(24).alias("startby"),
        _pick(k % 3, "週休二日", "隔週休", "其他").alias("worktime"),
    )


def company_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company per document, whose text is its profile; the first ones have the name and number of a supplier.

    Three more texts are the first, the second and the last line of the profile.
    """
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey", "s_name")
    lines = _lines(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        # By key on both sides: cleaning the texts is spread over all tasks.
        .join(suppliers.hint("merge"), "doc_id", "left")
        .select(
            _uuid_of(F.col("doc_id")).alias("custno"),
            F.col("s_suppkey").alias("invoice"),
            F.coalesce("s_name", F.concat(F.lit("Company#"), F.col("doc_id").cast("string"))).alias("name"),
            F.get(lines, 0).alias("management"),
            F.get(lines, 1).alias("product"),
            F.col("text").alias("profile"),
            F.element_at(lines, -1).alias("welfare"),
        )
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking groups from ``lineitem``, some 30 rows each: label by flag, prediction with many ties."""
    label = F.when(F.col("l_linestatus") == "O", 0).otherwise(_grade(F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("gid"),
        "l_orderkey",
        label.cast("bigint").alias("y"),
        F.col("l_discount").alias("pred"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_extendedprice"),
    )


def _grade(flag: Column) -> Column:
    return F.when(flag == "A", 1).when(flag == "R", 2).otherwise(3)
