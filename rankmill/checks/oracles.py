"""The same results in plain SQL over the supplied tables, written independently of the Spark code."""

from __future__ import annotations

import re

from rankmill.checks import model
from rankmill.checks.queries import LAST_DAY, TEST_START, TEST_STOP, TRAIN_START, TRAIN_STOP
from rankmill.functions.querystring import LIST_PARAMS
from rankmill.operators.jobs import JOB_COLUMNS

SOURCES = ("web", "mobileWeb", "app")
ACTIONS = ("viewJob", "saveJob", "applyJob")
MEASURES = ACTIONS + ("total",)
COUNTS = [f"{s}_{m}" for m in MEASURES for s in SOURCES] + [f"{m}_total" for m in MEASURES]
FIELDS = ("description", "job", "others", "management", "name", "product", "profile", "welfare")
PARAM_ORDER = (
    ("keyword", "sctp", "mode", "wktm") + LIST_PARAMS + ("order", "asc", "scmax", "scmin", "kwop", "m", "s5", "sr")
)
SCALARS = ("sctp", "mode", "wktm", "order", "asc", "scmax", "scmin", "kwop", "m", "s5", "sr")


def _join(items, sep=", "):
    return sep.join(items)


def _param(name: str, entries: str = "e") -> str:
    """Value of the last entry with this key."""
    return f"list_extract(list_filter({entries}, lambda p: p.k = '{name}'), -1).v"


def _entries(text: str) -> str:
    kept = f"list_filter(string_split({text}, '&'), lambda p: instr(p, '=') > 0 AND instr(p, '=') < length(p))"
    return (
        f"list_transform({kept}, lambda p: "
        "{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), "
        "'v': url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' '))})"
    )


def _typed_param(name: str) -> str:
    value = _param(name)
    if name == "keyword":
        return value
    if name in LIST_PARAMS:
        return (
            f"coalesce(list_transform(string_split({value}, ','), lambda i: TRY_CAST(i AS INTEGER)), "
            "CAST([] AS INTEGER[]))"
        )
    if name in ("order", "asc", "scmax", "scmin"):
        return f"CASE WHEN {value} IS NULL THEN -1 ELSE TRY_CAST({value} AS INTEGER) END"
    if name in ("kwop", "m"):
        return f"coalesce({value} = '1', false)"
    if name == "s5":
        return f"CASE WHEN {value} = '256' THEN 1 ELSE 0 END"
    if name == "sr":
        return f"CASE WHEN {value} = '99' THEN 1 ELSE 0 END"
    codes = {"sctp": ("P", "S"), "mode": ("s", "l"), "wktm": ("週休二日", "隔週休")}[name]
    return f"CASE {value} WHEN '{codes[0]}' THEN 1 WHEN '{codes[1]}' THEN 2 ELSE 0 END"


def _list_text(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda i: coalesce(CAST(i AS VARCHAR), '?')), ',')"


def _gid() -> str:
    """Digest of the keys as JSON; NULL fields are left out, NULL list items stay."""
    params = []
    for name in PARAM_ORDER:
        value = f"CAST(to_json(p_{name}) AS VARCHAR)"
        params.append(f"CASE WHEN p_{name} IS NOT NULL THEN '\"{name}\":' || {value} END")
    return (
        "md5('{\"source\":\"' || source || '\",\"ms\":' || ms || ',\"joblist\":' || CAST(to_json(joblist) AS VARCHAR)"
        " || ',\"query_params\":{' || concat_ws(',', " + ", ".join(params) + ") || '}}')"
    )


_TOKEN = r"'\p{Han}|[\p{L}\p{N}]+'"


def _uuid(number: str) -> str:
    h = f"md5(CAST({number} AS VARCHAR))"
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), substr({h},21,12))"


def _cleaned(text: str) -> str:
    # Short ASCII names only: no line breaks, no repeats that the cleaning would shorten.
    return f"lower(trim({text}))"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {_TOKEN})"


def _numbers(mod: dict[str, int], as_text: bool) -> str:
    return _join(f"CAST(p_partkey % {m} AS {'VARCHAR' if as_text else 'BIGINT'}) AS {n}" for n, m in mod.items())


_TEXT_MODULI = {
    "exp_jobcat1": 11, "exp_jobcat2": 12, "industry": 14, "jobcat1": 15, "jobcat2": 16, "jobcat3": 17,
    "major_cat": 18, "major_cat2": 19, "major_cat3": 20,
}
_NUMBER_MODULI = {
    "addr_no": 97, "language1": 3, "language2": 4, "language3": 5, "need_emp": 6, "need_emp1": 7, "period": 8,
    "role": 9, "role_status": 10, "s2": 21, "s3": 22, "s9": 23, "startby": 24,
}


def _job_cast(name: str, dtype: str | None) -> str:
    if dtype is None:
        return name
    return f"TRY_CAST({name} AS {dtype.upper()}) AS {name}"


def _dcg(column: str, k: str = "NULL", method: int = 1) -> str:
    """Sum over the unnested list, cut at k."""
    pos = f"generate_subscripts({column}, 1)"
    weight = "ln(i + 1) / ln(2)" if method == 1 else "CASE WHEN i = 1 THEN 1.0 ELSE ln(i) / ln(2) END"
    limit = "" if k == "NULL" else f" WHERE i <= {k}"
    return (
        f"coalesce((SELECT sum(gain / ({weight})) FROM (SELECT unnest({column}) AS gain, {pos} AS i){limit}), 0.0)"
    )


def _ndcg(column: str, k: str = "NULL", method: int = 1) -> str:
    ideal = _dcg(f"list_sort({column}, 'DESC')", k, method)
    return f"coalesce({_dcg(column, k, method)} / nullif({ideal}, 0.0), 0.0)"


_SCORE = {f: f"sum(CASE WHEN field = '{f}' THEN idf END)" for f in FIELDS}


def _feature_select(start: str, stop: str) -> str:
    sums = _join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
    per_day = _join(f"{c} / nullif(open_days, 0) AS {c}_per_day" for c in COUNTS)
    attrs = _join(f"j.{n}" for n in JOB_COLUMNS)
    return f"""
      SELECT f.*, o.date_stop, o.date_start, o.open_days, {per_day},
             viewJob_total / nullif(saveJob_total, 0) AS view_per_save,
             viewJob_total / nullif(applyJob_total, 0) AS view_per_apply,
             j.custno_long AS custno, {attrs}, j.worktime,
             DATE '{start}' AS start_date, DATE '{stop}' AS stop_date
      FROM (SELECT jobno, {sums} FROM unstacked
            WHERE date BETWEEN DATE '{start}' AND DATE '{stop}' GROUP BY jobno) f
      LEFT JOIN (
        SELECT jobno, least(date_stop, DATE '{stop}') AS date_stop, greatest(date_start, DATE '{start}') AS date_start,
               date_diff('day', greatest(date_start, DATE '{start}'), least(date_stop, DATE '{stop}')) + 1 AS open_days
        FROM job_ranges) o USING (jobno)
      LEFT JOIN job_rows j USING (jobno)"""


def _dataset_select(labels: str, where: str, start: str, stop: str) -> str:
    flags = _join(f"l.p_{n} AS \"{n}\"" for n in SCALARS)
    scores = _join(f"l.text_{f}" for f in FIELDS)
    return f"""
      SELECT l.gid, l.pos_in_list, l.job, l.rel, {flags}, {scores},
             f.* EXCLUDE (jobno, start_date, stop_date),
             DATE '{start}' AS start_date, DATE '{stop}' AS stop_date,
             DATE '{TRAIN_START}' AS features_start_date, DATE '{TRAIN_STOP}' AS features_stop_date
      FROM {labels} l LEFT JOIN train_features f ON f.jobno = l.job {where}"""


def _word(line: str) -> str:
    return f"nullif(regexp_extract(lower({line}), '(^| )([a-z]+)( |$)', 2), '')"


CTES: dict[str, str] = {
    "action_raw": """
      SELECT event_id, user_id AS jobno, epoch_us(ts) // 1000 AS ms,
             CASE event_type WHEN 'view' THEN 'viewJob' WHEN 'click' THEN 'saveJob'
                  WHEN 'purchase' THEN 'applyJob' ELSE event_type END AS action,
             CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobileWeb' WHEN 2 THEN 'app' ELSE 'other' END AS source
      FROM events""",
    "action_rows": """
      SELECT event_id AS id, jobno, ms, CAST(make_timestamp(ms * 1000) AS DATE) AS date, action, source
      FROM action_raw""",
    "counts": """
      SELECT date, source, action, jobno, count(*) AS n FROM action_rows GROUP BY ALL""",
    "unstacked": "SELECT *, "
    + _join("+".join(f"{s}_{m}" for s in SOURCES) + f" AS {m}_total" for m in MEASURES)
    + " FROM (SELECT *, "
    + _join("+".join(f"{s}_{a}" for a in ACTIONS) + f" AS {s}_total" for s in SOURCES)
    + " FROM (SELECT date, jobno, "
    + _join(
        f"CAST(coalesce(sum(n) FILTER (source = '{s}' AND action = '{a}'), 0) AS BIGINT) AS {s}_{a}"
        for a in ACTIONS
        for s in SOURCES
    )
    + " FROM counts GROUP BY date, jobno))",
    "query_words": f"""
      SELECT doc_id, concat_ws(' ', {_word("lines[1]")}, {_word("lines[2]")}, {_word("lines[-1]")}) AS words
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""",
    "lists": """
      SELECT o_orderkey AS k, list_transform(range(0, o_orderkey % 13 + 1), lambda i: o_custkey + i * (o_orderkey % 7))
               AS joblist,
             1704067200000 + (o_orderkey % 31) * 86400000 + (o_orderkey * 7919) % 86400000 AS ms,
             CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobileWeb' ELSE 'app' END AS source,
             CASE WHEN o_orderkey % 5 = 0 OR p_name IS NULL THEN '' WHEN o_orderkey % 5 = 1 THEN 'keyword=&'
                  ELSE 'keyword=' || replace(concat_ws(' ', p_name, lower(p_type), 'brand company', words,
                                                       substr(o_orderpriority, 3)), ' ', '+') || '&' END
             || 'edu=2%2C' || o_orderkey % 4 || '&order=' || o_orderkey % 7 || '&asc=&mode='
             || CASE o_orderkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'l' ELSE 'z' END
             || '&kwop=' || o_orderkey % 2
             || '&sctp=' || CASE o_orderkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'N' END
             || '&wktm=' || CASE o_orderkey % 6 WHEN 0 THEN '%E9%80%B1%E4%BC%91%E4%BA%8C%E6%97%A5'
                                 WHEN 1 THEN '%E9%9A%94%E9%80%B1%E4%BC%91' ELSE 'none' END
             || '&zone=1%2Cx%2C' || o_orderkey % 5 || '&scmin=' || o_orderkey % 9 * 1000
             || CASE WHEN o_orderkey % 6 = 0 THEN '&order=9&broken' ELSE '' END
             || CASE WHEN o_orderkey % 8 = 0 THEN '&s5=256&sr=99&m=1' ELSE '&s5=1' END
             || '#frag' || o_orderkey AS querystring
      FROM orders LEFT JOIN part ON p_partkey = o_custkey LEFT JOIN query_words q ON q.doc_id = o_custkey // 2""",
    "list_entries": f"""
      SELECT *, {_entries("regexp_replace(querystring, '#.*$', '', 's')")} AS e FROM lists""",
    "parsed_lists": "SELECT k, joblist, ms, CAST(make_timestamp(ms * 1000) AS DATE) AS date, source, querystring, "
    + _join(f"{_typed_param(n)} AS p_{n}" for n in PARAM_ORDER)
    + " FROM list_entries",
    "impressions": f"""
      SELECT *, {_tokens("p_keyword")} AS tokens, {_gid()} AS gid FROM parsed_lists""",
    "click_raw": """
      SELECT k * 10 + l_linenumber AS id, i.*,
             CASE WHEN l_linenumber = 6 THEN 'saveJob' WHEN l_linenumber = 5 THEN 'applyJob'
                  WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'clickShare' WHEN l_returnflag = 'A' THEN 'clickJob'
                  WHEN l_returnflag = 'R' THEN 'clickSave' ELSE 'clickApply' END AS action,
             CASE WHEN l_linenumber = 7 THEN l_partkey
                  ELSE joblist[(l_linenumber + l_partkey) % len(joblist) + 1] END AS jobno
      FROM lineitem JOIN impressions i ON l_orderkey = k""",
    "click_rows": """
      SELECT *, CASE action WHEN 'clickJob' THEN 1 WHEN 'clickSave' THEN 2 WHEN 'clickApply' THEN 3 ELSE 0 END AS weight
      FROM click_raw""",
    "job_clicks": """
      SELECT gid, jobno AS job, sum(weight) AS rel, arg_max(action, (id, action)) AS action
      FROM click_rows GROUP BY ALL""",
    "clicked": """
      SELECT i.*, n_clicks
      FROM (SELECT gid, min(k) AS k, count(*) AS n_clicks FROM click_rows GROUP BY gid) JOIN impressions i USING (gid, k)""",
    "positions": """
      SELECT * EXCLUDE (pos), pos - 1 AS pos_in_list
      FROM (SELECT *, unnest(joblist) AS job, generate_subscripts(joblist, 1) AS pos FROM clicked)""",
    "exploded": """
      SELECT p.*, CAST(coalesce(c.rel, 0) AS BIGINT) AS rel, coalesce(c.action, '') AS action
      FROM positions p LEFT JOIN job_clicks c USING (gid, job)""",
    "rel_lists": """
      SELECT gid, list(rel ORDER BY pos_in_list) AS rel_list, list(action ORDER BY pos_in_list) AS actions
      FROM exploded GROUP BY gid""",
    "ctr_rows": """
      SELECT *, click / impr AS "CTR"
      FROM (SELECT date, source, action, p_keyword AS keyword, job, count(*) AS impr,
                   CAST(sum(rel) AS BIGINT) AS click, count(*) FILTER (rel > 0) AS clicked
            FROM exploded GROUP BY ALL)""",
    "ctr_window": f"""
      SELECT job, action, sum(click) / sum(impr) AS "CTR" FROM ctr_rows
      WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_STOP}' GROUP BY ALL""",
    "ctr_columns": "SELECT job AS jobno, "
    + _join(
        f"coalesce(sum(\"CTR\") FILTER (action = '{a}'), 0.0) AS \"CTR_{a}\""
        for a in ("clickApply", "clickSave", "clickJob")
    )
    + " FROM ctr_window GROUP BY job",
    "job_ranges": """
      SELECT jobno, action_date_start, action_date_stop, click_date_start, click_date_stop,
             least(action_date_start, click_date_start) AS date_start,
             greatest(action_date_stop, click_date_stop) AS date_stop
      FROM (SELECT jobno, min(date) AS action_date_start, max(date) AS action_date_stop FROM action_rows GROUP BY jobno)
      JOIN (SELECT job AS jobno, min(date) AS click_date_start, max(date) AS click_date_stop FROM exploded GROUP BY job)
      USING (jobno)""",
    "job_raw": f"""
      SELECT {_uuid("p_partkey // 2")} AS custno, p_partkey AS jobno, p_type AS description, p_name AS job,
             p_brand AS others, CAST(p_size AS BIGINT) AS edu, {_numbers(_TEXT_MODULI, True)},
             CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE CAST(p_partkey % 13 AS VARCHAR) END AS exp_jobcat3,
             {_numbers(_NUMBER_MODULI, False)}, CAST(floor(p_retailprice * 2) AS BIGINT) AS salary_high,
             CAST(floor(p_retailprice) AS BIGINT) AS salary_low,
             CASE p_partkey % 3 WHEN 0 THEN '週休二日' WHEN 1 THEN '隔週休' ELSE '其他' END AS worktime_text
      FROM part""",
    "job_rows": "SELECT custno, CAST(jobno AS INTEGER) AS jobno, description, job, others, "
    + _join(_job_cast(n, t) for n, t in JOB_COLUMNS.items())
    + ", CASE worktime_text WHEN '週休二日' THEN 1 WHEN '隔週休' THEN 2 ELSE 0 END AS worktime, "
    + "CAST((CAST(CAST('0x' || substr(replace(custno, '-', ''), 1, 16) AS UBIGINT) AS UHUGEINT) * 18446744073709551616"
    + " + CAST('0x' || substr(replace(custno, '-', ''), 17) AS UBIGINT)) % 2305843009213693951 AS BIGINT)"
    + " AS custno_long FROM job_raw",
    "company_rows": f"""
      SELECT {_uuid("doc_id")} AS custno, s_suppkey AS invoice, coalesce(s_name, 'Company#' || doc_id) AS name,
             lines[1] AS management, lines[2] AS product, text AS profile, lines[-1] AS welfare
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents) LEFT JOIN supplier ON doc_id = s_suppkey""",
    "company_texts": "SELECT DISTINCT unnest([name, management, product, profile, welfare]) AS doc_id FROM company_rows",
    "texts": f"""
      SELECT jobno AS job, 'description' AS field, {_cleaned("description")} AS t FROM job_rows
      UNION ALL SELECT jobno, 'job', {_cleaned("job")} FROM job_rows
      UNION ALL SELECT jobno, 'others', {_cleaned("others")} FROM job_rows
      """
    + " ".join(
        f"""UNION ALL SELECT jobno, '{n}', lower(t) FROM job_rows j JOIN company_rows c ON j.custno = c.custno
            JOIN field_out ON doc_id = {n}"""
        for n in ("management", "name", "product", "profile", "welfare")
    ),
    "job_postings": f"""
      SELECT DISTINCT field, job, unnest({_tokens("t")}) AS token FROM texts""",
    "idfs": """
      SELECT field, token, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
      FROM (SELECT field, token, count(*) AS df FROM job_postings GROUP BY ALL)
      JOIN (SELECT field, count(DISTINCT job) AS n_docs FROM job_postings GROUP BY field) USING (field)""",
    "query_tokens": """
      SELECT k, job, token, count(*) AS n
      FROM (SELECT DISTINCT k, unnest(joblist) AS job FROM impressions)
      JOIN (SELECT k, unnest(tokens) AS token FROM impressions) USING (k) GROUP BY ALL""",
    "matches": "SELECT k, job, "
    + _join(f"coalesce(sum(n * idf) FILTER (field = '{f}'), 0.0) AS text_{f}" for f in FIELDS)
    + " FROM query_tokens JOIN job_postings USING (job, token) JOIN idfs USING (field, token) GROUP BY k, job",
    "labels_scored": "SELECT e.*, "
    + _join(f"coalesce(m.text_{f}, 0.0) AS text_{f}" for f in FIELDS)
    + " FROM exploded e LEFT JOIN matches m USING (k, job)",
    "train_features": _feature_select(TRAIN_START, TRAIN_STOP),
    "test_features": _feature_select(TEST_START, TEST_STOP),
    "train_set": _dataset_select(
        "labels_scored",
        f"WHERE l.date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_STOP}'",
        TRAIN_START,
        TRAIN_STOP,
    ),
    "valid_set": _dataset_select(
        "labels_scored",
        f"WHERE l.date BETWEEN DATE '{TEST_START}' AND DATE '{TEST_STOP}'",
        TEST_START,
        TEST_STOP,
    ),
    "test_labels": "SELECT t.* EXCLUDE (gid), t.k AS gid, 0 AS rel, "
    + _join(f"coalesce(m.text_{f}, 0.0) AS text_{f}" for f in FIELDS)
    + """ FROM (SELECT * EXCLUDE (pos), pos - 1 AS pos_in_list FROM
            (SELECT *, unnest(joblist) AS job, generate_subscripts(joblist, 1) AS pos FROM impressions)) t
          LEFT JOIN matches m USING (k, job)""",
    "test_set": _dataset_select("test_labels", "", TRAIN_START, TRAIN_STOP),
    "scored": """
      SELECT l_orderkey // 8 AS gid, l_orderkey, l_discount AS pred, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
             CASE WHEN l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END
               AS y FROM lineitem""",
    "ranked": """
      SELECT *, row_number() OVER (PARTITION BY gid ORDER BY pred DESC, y DESC) AS rank,
             row_number() OVER (PARTITION BY gid ORDER BY y DESC) AS best,
             row_number() OVER w AS pos, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER w AS hits
      FROM scored
      WINDOW w AS (PARTITION BY gid ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                   ROWS UNBOUNDED PRECEDING)""",
    "group_scores": """
      SELECT gid, count(*) AS n,
             coalesce(sum(y / ln(rank + 1)) / nullif(sum(y / ln(best + 1)), 0), 0) AS ndcg,
             coalesce(sum(y / ln(rank + 1)) FILTER (rank <= 20) / nullif(sum(y / ln(best + 1)) FILTER (best <= 20), 0), 0)
               AS ndcg_20,
             sum(hits / pos) FILTER (y > 0) / count(*) FILTER (y > 0) AS ap
      FROM ranked GROUP BY gid""",
    "empty_rules": """
      SELECT rule AS empty_group, avg(coalesce(ndcg_all, other)) AS ndcg, avg(coalesce(ndcg_cut, other)) AS ndcg_20,
             avg(coalesce(ap, other)) AS ap
      FROM (SELECT ap, CASE WHEN gain > 0 THEN ndcg END AS ndcg_all, CASE WHEN gain > 0 THEN ndcg_20 END AS ndcg_cut
            FROM group_scores JOIN (SELECT gid, sum(y) AS gain FROM scored GROUP BY gid) USING (gid)),
           (VALUES ('zero', 0.0), ('one', 1.0), ('skip', NULL)) AS rules(rule, other)
      GROUP BY rule""",
    "flag_ranks": """
      SELECT l_returnflag AS gid, CAST(l_quantity % 4 AS BIGINT) AS y,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount DESC, CAST(l_quantity % 4 AS BIGINT) DESC) AS rank,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_quantity % 4 AS BIGINT) DESC) AS best
      FROM lineitem""",
    "sequence_rows": """
      SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS chunk, row_number() OVER (ORDER BY doc_id) AS n,
             quality + toxic AS y, doc_id % 7 AS pred FROM labels""",
    "sequence_ranks": """
      SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n) AS seen,
             row_number() OVER (PARTITION BY chunk ORDER BY pred DESC, y DESC) AS rank,
             row_number() OVER (PARTITION BY chunk ORDER BY y DESC) AS best FROM sequence_rows""",
    "chunk_scores": """
      SELECT chunk, coalesce(sum(y / ln(seen + 1)) / nullif(sum(y / ln(best + 1)), 0), 0) AS truth,
             coalesce(sum(y / ln(rank + 1)) / nullif(sum(y / ln(best + 1)), 0), 0) AS predicted
      FROM sequence_ranks GROUP BY chunk""",
    "span": """
      SELECT min(date) AS d0, date_diff('day', min(date), max(date)) + 1 AS n FROM action_rows""",
    "fold_sizes": """
      SELECT d0, n, step, n - step * 2 AS chunk, CAST(round_even((n - step * 2) * 0.9, 0) AS INTEGER) AS train
      FROM (SELECT d0, n, CAST(round_even(0.2 * n / 1.4, 0) AS INTEGER) AS step FROM span)""",
    "folds": """
      SELECT CAST(fold AS INTEGER) AS fold, CAST(step * fold AS INTEGER) AS train_start,
             CAST(step * fold + train - 1 AS INTEGER) AS train_stop, CAST(step * fold + train AS INTEGER) AS test_start,
             CAST(step * fold + chunk - 1 AS INTEGER) AS test_stop, d0
      FROM fold_sizes, unnest([0, 1, 2]) AS u(fold)""",
    "page_queries": """
      SELECT page_id, CASE WHEN instr(url, '?') > 0 THEN split_part(url, '?', -1) END AS q FROM pages""",
    "page_entries": f"""
      SELECT page_id, {_entries("regexp_replace(q, '#.*$', '', 's')")} AS e FROM page_queries""",
}

# Unicode white space, and what is not.
_BLANK = r"\t-\r \x{85}\x{A0}\p{Zs}\p{Zl}\p{Zp}"


def _repeat_ctes(name: str, text: str, rows: str = "documents") -> dict[str, str]:
    """``<name>_out(doc_id, t)``: ``rows`` with ``text`` after both steps of the removal of repeats.

    Runs of a character are cut by a filter over the characters. The second step works on the distinct words: at
    each place the shortest repeated piece, then from left to right those that do not overlap.
    """
    once = (
        "array_to_string(list_filter(c, lambda x, i: x = chr(10) OR i < 3 "
        "OR NOT (c[greatest(i - 1, 1)] = x AND c[greatest(i - 2, 1)] = x)), '')"
    )
    return {
        f"{name}_once": f"""
      SELECT doc_id, {once} AS t FROM (SELECT doc_id, string_split({text}, '') AS c FROM {rows})""",
        f"{name}_parts": f"""
      SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n
      FROM (SELECT doc_id, regexp_extract_all(t, '[^{_BLANK}]+|[{_BLANK}]+') AS parts FROM {name}_once)""",
        f"{name}_words": f"""
      SELECT DISTINCT part AS w FROM {name}_parts WHERE length(part) >= 4""",
        f"{name}_pieces": f"""
      SELECT w, i, substr(w, i, 2) AS piece FROM (SELECT w, unnest(range(1, length(w))) AS i FROM {name}_words)""",
        f"{name}_found": f"""
      SELECT w, i, p,
             list_max(list_filter(range(2, length(w) // p + 1),
                                  lambda m: substr(w, i, p * m) = repeat(substr(w, i, p), m))) AS times
      FROM (SELECT a.w, a.i, min(b.i - a.i) AS p FROM {name}_pieces a JOIN {name}_pieces b
              ON a.w = b.w AND a.piece = b.piece AND b.i >= a.i + 2
            WHERE a.i + 2 * (b.i - a.i) - 1 <= length(a.w) AND substr(a.w, a.i, b.i - a.i) = substr(a.w, b.i, b.i - a.i)
            GROUP BY a.w, a.i)""",
        f"{name}_taken": f"""
      SELECT w, 1 AS at, 0 AS i, 0 AS p, 0 AS times FROM {name}_words
      UNION ALL
      SELECT w, first.i + first.p * first.times, first.i, first.p, first.times
      FROM (SELECT t.w, arg_min({{'i': f.i, 'p': f.p, 'times': f.times}}, f.i) AS first
            FROM {name}_taken t JOIN {name}_found f ON f.w = t.w AND f.i >= t.at GROUP BY t.w)""",
        f"{name}_short": f"""
      SELECT w, array_to_string(list_filter(string_split(w, ''), lambda x, n:
               len(list_filter(gaps, lambda g: n >= g.a AND n < g.b)) = 0), '') AS short
      FROM (SELECT w, list({{'a': i + p, 'b': i + p * times}}) AS gaps FROM {name}_taken WHERE p > 0 GROUP BY w)""",
        f"{name}_out": f"""
      SELECT o.doc_id, CASE WHEN o.t = '' THEN '' ELSE j.t END AS t FROM {name}_once o LEFT JOIN
        (SELECT doc_id, string_agg(coalesce(short, part), '' ORDER BY n) AS t
         FROM {name}_parts LEFT JOIN {name}_short ON w = part GROUP BY doc_id) j USING (doc_id)""",
    }


_NARROW = "abcdefghijklmnopqrstuvwxyz0123456789 "
_WIDE = "".join("　" if c == " " else chr(ord(c) + 0xFEE0) for c in _NARROW)
_ALL_WIDE = "".join(map(chr, range(0xFF00, 0xFF5F))) + "　"
_ALL_NARROW = "".join(map(chr, range(0x20, 0x7F))) + " "
CTES |= _repeat_ctes("shrunk", "text")


def _one_line(text: str) -> str:
    narrow = _ALL_NARROW.replace("'", "''")
    return f"translate(replace(replace({text}, chr(10), ' '), chr(13), ''), '{_ALL_WIDE}', '{narrow}')"


CTES |= _repeat_ctes("cleaned", _one_line("text"))
CTES |= _repeat_ctes("field", _one_line("doc_id"), "company_texts")

# Parts come before those that name them.
_LATER = ("texts", "job_postings", "idfs", "query_tokens", "matches", "labels_scored", "train_set", "valid_set", "test_labels", "test_set")
CTES |= {name: CTES.pop(name) for name in _LATER}

_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def _case(node: dict) -> str:
    """A tree as nested CASE; a count of 0 is missing."""
    if "leaf" in node:
        return f"{node['leaf']}::DOUBLE"
    below = {child["nodeid"]: _case(child) for child in node["children"]}
    value = f"nullif({node['split']}, 0)"
    return (
        f"CASE WHEN {value} IS NULL THEN {below[node['missing']]} WHEN {value} < {node['split_condition']} "
        f"THEN {below[node['yes']]} ELSE {below[node['no']]} END"
    )


def _sql(body: str) -> str:
    """Put the needed named parts in front, in their order of definition."""
    needed: set[str] = set()
    open_names = set(_NAMES.findall(body))
    while open_names:
        name = open_names.pop()
        if name not in needed:
            needed.add(name)
            open_names |= set(_NAMES.findall(CTES[name])) - needed
    # A part that names itself is recursive, and kept anyway.
    own = {name for name in needed if name in _NAMES.findall(CTES[name])}
    parts = [
        f"{name} AS {'' if name in own else 'MATERIALIZED '}({sql})" for name, sql in CTES.items() if name in needed
    ]
    start = "WITH RECURSIVE" if own else "WITH"
    return (f"{start} {', '.join(parts)} " if parts else "") + body


def _dates(*names: str) -> str:
    return _join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


def _rounded(names, digits: int = 6) -> str:
    return _join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


_PER_DAY = [f"{c}_per_day" for c in COUNTS]
_RATIOS = _PER_DAY + ["view_per_save", "view_per_apply"]
_SCORES = [f"text_{f}" for f in FIELDS]
_FEATURE_REPLACE = _join(f"round({c}, 6) AS {c}" for c in _RATIOS)
_FEATURE_DATES = _join(f"CAST({c} AS VARCHAR) AS {c}" for c in ("date_start", "date_stop", "start_date", "stop_date"))
_SET_REPLACE = _join(
    [f"round({c}, 6) AS {c}" for c in _RATIOS + _SCORES]
    + [
        f"CAST({c} AS VARCHAR) AS {c}"
        for c in ("date_start", "date_stop", "start_date", "stop_date", "features_start_date", "features_stop_date")
    ]
)
# Exported columns in the order of the data set.
_EXPORTED = (
    list(SCALARS)
    + _SCORES
    + COUNTS
    + ["open_days", "custno"]
    + list(JOB_COLUMNS)
    + ["worktime"]
    + _PER_DAY
    + ["view_per_save", "view_per_apply"]
)


def _number(name: str) -> str:
    value = f"CAST(\"{name}\" AS DOUBLE)"
    return f"round({value}, 6)" if name in _RATIOS + _SCORES else value


_LINE = (
    "rel || ' ' || concat_ws(' ', "
    + _join(
        f"CASE WHEN {_number(n)} <> 0 THEN '{i}:' || CAST({_number(n)} AS VARCHAR) END" for i, n in enumerate(_EXPORTED)
    )
    + ")"
)
_NNZ = " + ".join(f"CASE WHEN {_number(n)} <> 0 THEN 1 ELSE 0 END" for n in _EXPORTED)

def oracle_sql() -> dict[str, str]:
    bodies = {
        "scan_json_schema": """SELECT CAST(jobno AS VARCHAR) AS jobno, CAST(ms AS VARCHAR) AS date, action, source,
            CAST(NULL AS VARCHAR) AS device FROM action_raw""",
        "scan_json_infer": """SELECT custno, CAST(jobno AS VARCHAR) AS jobno, description, edu, exp_jobcat3, salary_low,
            worktime_text AS worktime FROM job_raw""",
        "scan_json_clicks": f"""SELECT action, CAST(ms AS VARCHAR) AS date, {_list_text("joblist")} AS joblist,
            CAST(jobno AS VARCHAR) AS jobno, querystring, source FROM click_rows""",
        "scan_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
        "sink_parquet": f"""SELECT {_dates("date")}, source, action, jobno, n AS "count" FROM counts""",
        "sink_json": f"""SELECT j.custno, jobno, job, array_to_string({_tokens(_cleaned("job"))}, ' ') AS job_token,
            name, invoice, salary_low FROM job_rows j LEFT JOIN company_rows c ON j.custno = c.custno""",
        "sink_partitioned": f"""SELECT jobno, viewJob_total, open_days, addr_no, {_dates("start_date", "stop_date")}
            FROM test_features""",
        "sink_dynamic_overwrite": f"""SELECT {_dates("date")}, source, action, jobno,
            CASE WHEN date = DATE '{TEST_START}' THEN n * 100 ELSE n END AS "count" FROM counts""",
        "read_through": f"""SELECT jobno, viewJob_total, web_total, open_days,
            {_dates("start_date", "stop_date")} FROM train_features""",
        "dataset_read_through": f"SELECT * REPLACE ({_SET_REPLACE}) FROM train_set",
        "incremental_days": f"""SELECT {_dates("date")}, count(*) AS n_rows, CAST(sum(impr) AS BIGINT) AS impr,
            CAST(sum(click) AS BIGINT) AS click,
            CASE WHEN date BETWEEN DATE '2024-01-05' AND DATE '{TRAIN_STOP}' THEN 1 ELSE 2 END AS call,
            'click_grouped' AS input FROM ctr_rows GROUP BY date""",
        "to_libsvm_lines": f"""SELECT gid, pos_in_list, {_LINE} || ' # gid:' || gid || ' job:' || job AS value
            FROM train_set""",
        "group_lengths": "SELECT gid, count(*) AS length FROM exploded GROUP BY gid",
        "read_libsvm": f"SELECT rel AS label, CAST({_NNZ} AS INTEGER) AS nnz FROM train_set",
        "read_group_file": "SELECT CAST(count(*) AS INTEGER) AS length FROM train_set GROUP BY gid",
        "train_valid_export": " UNION ALL ".join(
            f"SELECT '{n}' AS name, {_LINE} || ' # gid:' || gid || ' job:' || job AS value FROM {n}_set"
            for n in ("train", "valid")
        ),
        "export_alignment": "SELECT gid, count(*) AS n_rows, count(*) AS length, 1 AS n_groups FROM exploded GROUP BY gid",
        "job_processed": "SELECT * EXCLUDE (custno_long), "
        + _join(f"array_to_string({_tokens(_cleaned(n))}, ' ') AS {n}_token" for n in ("description", "job", "others"))
        + " FROM job_rows",
        "company_processed": f"""SELECT custno, invoice, name, array_to_string({_tokens("lower(n.t)")}, ' ') AS name_token, """
        + _join(
            f"md5({n}) AS {n}_text, md5(array_to_string({_tokens(f'lower({a}.t)')}, ' ')) AS {n}_token"
            for a, n in (("m", "management"), ("p", "product"), ("r", "profile"), ("w", "welfare"))
        )
        + """ FROM company_rows LEFT JOIN field_out n ON n.doc_id = name"""
        + " ".join(
            f" LEFT JOIN field_out {a} ON {a}.doc_id = {n}"
            for a, n in (("m", "management"), ("p", "product"), ("r", "profile"), ("w", "welfare"))
        ),
        "label_flatten": "SELECT gid, pos_in_list, job, rel, "
        + _join(f"p_{n} AS \"{n}\"" for n in SCALARS)
        + f", {_rounded(_SCORES)} FROM labels_scored WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{LAST_DAY}'",
        "date_window_filter": f"""SELECT id, jobno, {_dates("date")}, action FROM action_rows
            WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_STOP}'""",
        "case_codes": """SELECT CAST(jobno AS VARCHAR) AS jobno, worktime_text AS worktime, worktime AS code
            FROM job_rows JOIN (SELECT jobno, worktime_text FROM job_raw) USING (jobno)""",
        "no_keyword_rows": """SELECT id AS click_id, CAST(jobno AS VARCHAR) AS jobno, action, querystring FROM click_rows
            WHERE p_keyword IS NULL""",
        "no_keyword_top": """SELECT id AS click_id, CAST(jobno AS VARCHAR) AS jobno, action FROM click_rows
            WHERE p_keyword IS NULL ORDER BY id, CAST(jobno AS VARCHAR), action LIMIT 10""",
        "split_xy": "SELECT gid, pos_in_list, "
        + _join(f"{_number(n)} AS \"{n}\"" if n in _RATIOS + _SCORES else f'"{n}"' for n in _EXPORTED)
        + " FROM train_set",
        "split_y": "SELECT gid, pos_in_list, rel FROM train_set",
        "action_processed": f"""SELECT id, jobno, ms AS datetime, {_dates("date")}, action, source,
            CAST(NULL AS VARCHAR) AS device FROM action_rows""",
        "action_count": f"""SELECT {_dates("date")}, source, action, jobno, n AS "count" FROM counts""",
        "action_pivot": f"SELECT *, {'+'.join(ACTIONS)} AS total FROM (SELECT {_dates('date')}, jobno, source, "
        + _join(f"CAST(coalesce(sum(n) FILTER (action = '{a}'), 0) AS BIGINT) AS {a}" for a in ACTIONS)
        + " FROM counts GROUP BY date, jobno, source)",
        "action_unstacked": f"SELECT * REPLACE ({_dates('date')}) FROM unstacked",
        "action_count_per_day": "SELECT jobno, "
        + _join(f"round(coalesce(avg(rate) FILTER (action = '{a}'), 0.0), 6) AS {a}" for a in ACTIONS)
        + """ FROM (SELECT jobno, action, sum(n) / (date_diff('day', min(date), max(date)) + 1) AS rate
              FROM counts GROUP BY jobno, action) GROUP BY jobno""",
        "date_span": """SELECT CAST(min(date_start) AS VARCHAR) AS date_start, CAST(max(date_stop) AS VARCHAR) AS date_stop,
            CAST(date_diff('day', min(date_start), max(date_stop)) AS INTEGER) AS days FROM job_ranges""",
        "epoch_to_ts": """SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS datetime,
            CAST(CAST(make_timestamp(ms * 1000) AS DATE) AS VARCHAR) AS date FROM action_raw""",
        "click_processed": f"""SELECT id, source, action, ms AS datetime, jobno, {_list_text("joblist")} AS joblist,
            querystring, {_dates("date")}, {_list_text("tokens")} AS tokens,
            array_to_string(list_transform(joblist, lambda j: CASE WHEN j = jobno THEN weight ELSE 0 END), ',') AS rel_list,
            {_list_text("p_edu")} AS edu, p_keyword AS keyword FROM click_rows""",
        "cast_array": f"""SELECT k AS id, {_list_text("joblist")} AS joblist FROM lists""",
        "click_grouped": f"""SELECT gid, source, {_dates("date")}, ms AS datetime, p_keyword AS keyword,
            {_list_text("joblist")} AS joblist, {_list_text("tokens")} AS tokens, n_clicks,
            {_list_text("rel_list")} AS rel_list, {_list_text("actions")} AS action_of_job
            FROM clicked JOIN rel_lists USING (gid)""",
        "click_lists": """SELECT gid, CAST(1 AS BIGINT) AS n_pages, CAST(0 AS BIGINT) AS page,
            array_to_string(list(id ORDER BY id, action, jobno), ',') AS id_list,
            array_to_string(list(jobno ORDER BY id, action, jobno), ',') AS jobno_list,
            array_to_string(list(action ORDER BY id, action, jobno), ',') AS action_list
            FROM click_rows GROUP BY gid""",
        "impression_explode": f"""SELECT gid, source, {_dates("date")}, ms AS datetime, {_list_text("tokens")} AS tokens,
            CAST(pos_in_list AS INTEGER) AS pos_in_list, job, rel, action, p_keyword AS keyword FROM exploded""",
        "ctr": f"""SELECT {_dates("date")}, source, action, keyword, job, impr, click, round("CTR", 6) AS "CTR"
            FROM ctr_rows""",
        "ctr_binary": f"""SELECT {_dates("date")}, source, action, keyword, job, impr, clicked AS click,
            round(clicked / impr, 6) AS "CTR" FROM ctr_rows""",
        "ctr_by_job_action": """SELECT job, action, round("CTR", 6) AS "CTR" FROM ctr_window""",
        "ctr_features": "SELECT jobno, "
        + _rounded(f'"CTR_{a}"' for a in ("clickApply", "clickSave", "clickJob"))
        + " FROM ctr_columns",
        "click_label_explode": f"""SELECT id, source, {_dates("date")}, ms AS datetime, keyword, tokens, pos, job,
            CASE WHEN job = jobno THEN action END AS action
            FROM (SELECT id, source, date, ms, p_keyword AS keyword, {_list_text("tokens")} AS tokens, jobno, action,
                         CAST(generate_subscripts(joblist, 1) - 1 AS INTEGER) AS pos, unnest(joblist) AS job FROM click_rows)""",
        "label_with_action": """SELECT CASE WHEN job <> jobno THEN 0 WHEN action = 'clickJob' THEN 1 WHEN action = 'saveJob' THEN 2
            WHEN action = 'applyJob' THEN 3 ELSE 0 END AS label, id, pos,
            """
        + _join(f"round({a}, 6) AS {a}" for a in ACTIONS)
        + """ FROM (SELECT id, jobno, action, CAST(generate_subscripts(joblist, 1) - 1 AS INTEGER) AS pos,
                    unnest(joblist) AS job FROM click_rows) l
              LEFT JOIN (SELECT jobno AS rated, """
        + _join(f"coalesce(avg(rate) FILTER (action = '{a}'), 0.0) AS {a}" for a in ACTIONS)
        + """ FROM (SELECT jobno, action, sum(n) / (date_diff('day', min(date), max(date)) + 1) AS rate
                    FROM counts GROUP BY jobno, action) GROUP BY jobno) ON rated = job""",
        "keyword_impressions": """SELECT keyword, CAST(job AS VARCHAR) AS jobno, count(*) AS impression
            FROM (SELECT p_keyword AS keyword, unnest(joblist) AS job FROM click_rows WHERE p_keyword IS NOT NULL)
            GROUP BY ALL""",
        "testset_exploded": f"""SELECT k AS gid, {_list_text("tokens")} AS tokens, CAST(pos_in_list AS INTEGER)
            AS pos_in_list, job, CAST(0 AS BIGINT) AS rel, p_keyword AS keyword FROM test_labels""",
        "score_relevance": "SELECT gid, CAST(pos_in_list AS INTEGER) AS pos_in_list, rel FROM exploded",
        "job_date_range": "SELECT jobno, "
        + _dates(
            "action_date_start", "action_date_stop", "click_date_start", "click_date_stop", "date_start", "date_stop"
        )
        + " FROM job_ranges",
        "open_days": f"""SELECT jobno, {_dates("date_stop", "date_start")},
            CAST(date_diff('day', date_start, date_stop) + 1 AS INTEGER) AS open_days
            FROM (SELECT jobno, least(date_stop, DATE '2024-01-20') AS date_stop,
                         greatest(date_start, DATE '2024-01-03') AS date_start FROM job_ranges)""",
        "job_company": """SELECT j.custno, jobno, job, name, invoice
            FROM job_rows j LEFT JOIN company_rows c ON j.custno = c.custno""",
        "uuid_to_long": "SELECT CAST(jobno AS VARCHAR) AS jobno, custno_long AS custno FROM job_rows",
        "features": f"SELECT * REPLACE ({_FEATURE_REPLACE}, {_FEATURE_DATES}) FROM train_features",
        "features_with_ctr": "SELECT jobno, viewJob_total, open_days, "
        + _rounded(f'"CTR_{a}"' for a in ("clickApply", "clickSave", "clickJob"))
        + " FROM train_features LEFT JOIN ctr_columns USING (jobno)",
        "dataset": f"SELECT * REPLACE ({_SET_REPLACE}) FROM train_set",
        "testset_dataset": f"SELECT * REPLACE ({_SET_REPLACE}) FROM test_set",
        "to_halfwidth": f"""SELECT doc_id,
            md5(translate(translate(text, '{_NARROW}', '{_WIDE}'), '{_WIDE}', '{_NARROW}')) AS digest FROM documents""",
        "rm_repeat": """SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars FROM shrunk_out""",
        "simple_clean": f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars
            FROM (SELECT doc_id, regexp_replace(lower(t), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS t FROM cleaned_out)""",
        "tokenize": f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
            FROM (SELECT doc_id, {_tokens("text")} AS t FROM documents)""",
        "tokenize_signs": r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
            FROM (SELECT doc_id, regexp_extract_all(text, '\p{Han}|\.?[\p{L}\p{N}]+(?:[.&+#-][\p{L}\p{N}]+)*[+#]*') AS t
                  FROM documents)""",
        "postings": "SELECT field, CAST(job AS BIGINT) AS job, token FROM job_postings",
        "idf_table": "SELECT field, token, df, round(idf, 6) AS idf FROM idfs",
        "text_index": """SELECT CAST(job AS BIGINT) AS job, CAST(count(*) AS INTEGER) AS n_entries,
            CAST(count(DISTINCT token) AS INTEGER) AS n_tokens, round(sum(idf), 4) AS weight
            FROM job_postings JOIN idfs USING (field, token) GROUP BY job""",
        "text_field_scores": f"""SELECT gid, CAST(pos_in_list AS INTEGER) AS pos_in_list, job, {_rounded(_SCORES)}
            FROM test_labels""",
        "qs_parse_map": """SELECT page_id, kv.k AS k, kv.v AS v FROM (
            SELECT page_id, unnest(list_filter(e, lambda p, i:
              len(list_filter(e[i + 1:], lambda o: o.k = p.k)) = 0)) AS kv FROM page_entries)""",
        "qs_params": "SELECT k AS id, "
        + _join(f"{_list_text(f'p_{n}')} AS \"{n}\"" if n in LIST_PARAMS else f'p_{n} AS "{n}"' for n in PARAM_ORDER)
        + " FROM impressions",
        "qs_custom_param": f"""SELECT page_id, TRY_CAST({_param("page")} AS INTEGER) * 10 AS page,
            {_typed_param("order")} AS "order" FROM page_entries""",
        "dcg_at_k": f"""SELECT gid, round({_dcg("rel_list")}, 6) AS dcg, round({_dcg("rel_list", "3")}, 6) AS dcg_3,
            round({_dcg("rel_list", "3", 0)}, 6) AS dcg_3_m0 FROM rel_lists""",
        "ndcg_at_k": f"""SELECT gid, round({_ndcg("rel_list")}, 6) AS ndcg, round({_ndcg("rel_list", "3")}, 6) AS ndcg_3,
            round({_ndcg("rel_list", "3", 0)}, 6) AS ndcg_3_m0 FROM rel_lists""",
        "mean_ndcg": f"""SELECT round(avg({_ndcg("rel_list")}), 6) AS ndcg, 'impression' AS over FROM rel_lists
            UNION ALL SELECT round(avg({_ndcg("r")}), 6), 'click' FROM
            (SELECT list_transform(joblist, lambda j: CASE WHEN j = jobno THEN weight ELSE 0 END) AS r FROM click_rows)""",
        "rerank": "SELECT gid, rank, CAST(y AS BIGINT) AS y, pred FROM ranked",
        "ndcg_prediction": "SELECT gid, n, round(ndcg, 6) AS ndcg FROM group_scores",
        "ndcg_prediction_mean": "SELECT round(avg(ndcg_20), 6) AS ndcg FROM group_scores",
        "ndcg_empty_rules": "SELECT empty_group, round(ndcg_20, 6) AS ndcg FROM empty_rules",
        "ndcg_hot_group": """SELECT gid, count(*) AS n,
            round(sum(y / ln(rank + 1)) FILTER (rank <= 500) / sum(y / ln(best + 1)) FILTER (best <= 500), 6) AS ndcg
            FROM flag_ranks GROUP BY gid""",
        "mean_average_precision": "SELECT empty_group, round(ap, 6) AS ap FROM empty_rules",
        "metric_set": """SELECT 'ndcg' AS metric, round(ndcg, 6) AS value FROM empty_rules WHERE empty_group = 'one'
            UNION ALL SELECT 'map', round(ap, 6) FROM empty_rules WHERE empty_group = 'one'
            UNION ALL SELECT 'ndcg@20', round(ndcg_20, 6) FROM empty_rules WHERE empty_group = 'one'
            UNION ALL SELECT 'ndcg@20-', round(ndcg_20, 6) FROM empty_rules WHERE empty_group = 'zero'""",
        "chunk20_ndcg": "SELECT round(avg(truth), 6) AS ndcg FROM chunk_scores",
        "chunk20_ndcg_prediction": "SELECT round(avg(predicted), 6) AS ndcg FROM chunk_scores",
        "cv_folds": "SELECT * EXCLUDE (d0), "
        + _join(
            f"CAST(d0 + {n} AS VARCHAR) AS {n}_date" for n in ("train_start", "train_stop", "test_start", "test_stop")
        )
        + " FROM folds",
        "cv_assign": """SELECT fold, role, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_actions
            FROM (SELECT fold, c.n, CASE WHEN date BETWEEN d0 + train_start AND d0 + train_stop THEN 'train'
                                         WHEN date BETWEEN d0 + test_start AND d0 + test_stop THEN 'test' END AS role
                  FROM counts c, folds) WHERE role IS NOT NULL GROUP BY ALL""",
        "score_rows": f"""SELECT {_dates("date")}, jobno, viewJob_total, saveJob_total, applyJob_total,
            round(viewJob_total * 0.5 + saveJob_total * 2.0 + applyJob_total * 3.25, 6) AS pred FROM unstacked""",
        "score_trees": f"SELECT {_dates('date')}, jobno, "
        + _join(f"nullif({c}, 0) AS {c}" for c in model.FEATURES)
        + f", round({model.BASE}::DOUBLE + {' + '.join(map(_case, model.TREES))}, 6) AS pred FROM unstacked",
        "features_per_fold": "SELECT fold, f.jobno, "
        + _join(f"f.{c}" for c in COUNTS)
        + f""", CAST(r0 AS VARCHAR) AS date_start, CAST(r1 AS VARCHAR) AS date_stop,
            CAST(date_diff('day', r0, r1) + 1 AS INTEGER) AS open_days, j.custno_long AS custno,
            {_join(f"j.{n}" for n in JOB_COLUMNS)}, j.worktime, {_dates("start_date", "stop_date")}, """
        + _join(f"round({c} / nullif(date_diff('day', r0, r1) + 1, 0), 6) AS {c}_per_day" for c in COUNTS)
        + """, round(viewJob_total / nullif(saveJob_total, 0), 6) AS view_per_save,
            round(viewJob_total / nullif(applyJob_total, 0), 6) AS view_per_apply
            FROM (SELECT g.*, CASE WHEN r.jobno IS NOT NULL THEN greatest(r.date_start, g.start_date) END AS r0,
                         CASE WHEN r.jobno IS NOT NULL THEN least(r.date_stop, g.stop_date) END AS r1
                  FROM (SELECT fold, d0 + train_start AS start_date, d0 + train_stop AS stop_date, jobno, """
        + _join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
        + """ FROM unstacked JOIN folds ON date BETWEEN d0 + train_start AND d0 + train_stop
                        GROUP BY ALL) g LEFT JOIN job_ranges r ON r.jobno = g.jobno) f
            LEFT JOIN job_rows j ON j.jobno = f.jobno""",
        "udf_surface": f"""SELECT gid, round({_ndcg("rel_list", "5")}, 6) AS ndcg_5, CAST(len(tokens) AS INTEGER)
            AS n_tokens FROM rel_lists JOIN clicked USING (gid)""",
    }
    return {name: _sql(body) for name, body in bodies.items()}
