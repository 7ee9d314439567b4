"""The way from raw logs to training sets as stored stages, by day and by window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.querystring import DEFAULT_PARAMS
from rankmill.operators import actions, clicks, jobs, textscore
from rankmill.plans import dataset as ds
from rankmill.plans import export
from rankmill.plans.features import features
from rankmill.sources import catalog
from rankmill.sources.stages import WHOLE, Key, Stage, Store, days

Source = Callable[[], DataFrame]


def _on(days_: Sequence[Key]) -> Column:
    return F.col("date").isin([F.lit(day).cast("date") for (day,) in days_])


def _window(key: Key) -> list[Key]:
    return days(key[0], key[1])


def training_store(
    spark: SparkSession,
    base: str,
    sources: Mapping[str, Source],
    first_day: str,
    last_day: str,
    action_id: Column | None = None,
    click_id: Column | None = None,
) -> Store:
    """Stages over the raw tables ``actions``, ``clicks``, ``jobs`` and ``companies``, given as functions.

    The logs reach from ``first_day`` to ``last_day``. A later last day builds the days that came in and what is made
    of them: ranges of days a job was seen cover the whole logs, so features are made anew, counts are not.
    """
    whole_log = days(first_day, last_day)

    def action_rows(store: Store, keys: Sequence[Key]) -> DataFrame:
        return actions.action_processed(sources["actions"](), row_id=action_id).where(_on(keys))

    def click_rows(store: Store, keys: Sequence[Key]) -> DataFrame:
        return clicks.click_processed(sources["clicks"](), row_id=click_id).where(_on(keys))

    def counts(store: Store, keys: Sequence[Key]) -> DataFrame:
        return actions.action_count(store.stored("action_processed", keys))

    def unstacked(store: Store, keys: Sequence[Key]) -> DataFrame:
        return actions.action_unstacked(store.stored("action_count", keys))

    def grouped(store: Store, keys: Sequence[Key]) -> DataFrame:
        return clicks.click_grouped(store.stored("click_processed", keys), DEFAULT_PARAMS)

    def rates(store: Store, keys: Sequence[Key]) -> DataFrame:
        return clicks.ctr(clicks.click_exploded(store.stored("click_grouped", keys)))

    def seen(store: Store, keys: Sequence[Key]) -> DataFrame:
        acted = store.stored("action_count", keys).select("jobno", "date").distinct()
        shown = clicks.shown_jobs(store.stored("click_processed", keys)).distinct()
        return acted.withColumn("log", F.lit("action")).unionByName(
            shown.select(F.col("job").alias("jobno"), "date").withColumn("log", F.lit("click"))
        )

    def ranges(store: Store) -> DataFrame:
        found = store.stored("job_days", whole_log)
        acted, shown = (found.where(F.col("log") == log) for log in ("action", "click"))
        return jobs.job_date_range(acted, shown.withColumnRenamed("jobno", "job"))

    def windowed_features(store: Store, keys: Sequence[Key]) -> DataFrame:
        made = [
            features(
                store.stored("action_unstacked", _window(key)),
                ranges(store),
                store.stored("job_processed", [WHOLE]),
                *key,
            )
            for key in keys
        ]
        return _union(made)

    def tokens(store: Store, keys: Sequence[Key]) -> DataFrame:
        joined = jobs.job_company(
            store.stored("job_processed", [WHOLE]), store.stored("company_processed", [WHOLE])
        )
        return textscore.field_tokens(joined)

    def index(store: Store, keys: Sequence[Key]) -> DataFrame:
        return textscore.weighted_index(store.stored("field_tokens", [WHOLE]))

    def datasets(store: Store, keys: Sequence[Key]) -> DataFrame:
        weights = store.stored("text_index", [WHOLE])
        made = []
        for start, stop, from_day, to_day in keys:
            labels = ds.impression_labels(store.stored("click_grouped", days(start, stop)), weights)
            items = store.stored("features", [(from_day, to_day)])
            made.append(ds.dataset(labels, items, start, stop, from_day, to_day))
        return _union(made)

    by_day = lambda *names: lambda key: {name: [key] for name in names}
    return Store(
        spark,
        base,
        {
            "action_processed": Stage(catalog.ACTION_PROCESSED, action_rows),
            "action_count": Stage(catalog.ACTION_COUNT, counts, by_day("action_processed")),
            "action_unstacked": Stage(catalog.ACTION_UNSTACKED, unstacked, by_day("action_count")),
            "click_processed": Stage(catalog.CLICK_PROCESSED, click_rows),
            "click_grouped": Stage(catalog.CLICK_GROUPED, grouped, by_day("click_processed")),
            "click_ctr": Stage(catalog.CLICK_CTR, rates, by_day("click_grouped")),
            "job_days": Stage(catalog.JOB_DAYS, seen, by_day("action_count", "click_processed")),
            "job_processed": Stage(catalog.JOB_PROCESSED, lambda store, keys: jobs.job_processed(sources["jobs"]())),
            "company_processed": Stage(
                catalog.COMPANY_PROCESSED, lambda store, keys: jobs.company_processed(sources["companies"]())
            ),
            "text_index": Stage(catalog.TEXT_INDEX, index, lambda key: {"field_tokens": [WHOLE]}),
            "field_tokens": Stage(
                catalog.FIELD_TOKENS, tokens, lambda key: {"job_processed": [WHOLE], "company_processed": [WHOLE]}
            ),
            "features": Stage(
                catalog.FEATURES,
                windowed_features,
                lambda key: {"action_unstacked": _window(key), "job_days": whole_log, "job_processed": [WHOLE]},
            ),
            "dataset": Stage(
                catalog.DATASET,
                datasets,
                lambda key: {"click_grouped": _window(key), "features": [key[2:]], "text_index": [WHOLE]},
            ),
        },
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dataset_key(start: str, stop: str, features_start: str | None = None, features_stop: str | None = None) -> Key:
    """The feature window is the label window unless given."""
    return (start, stop, features_start or start, features_stop or stop)


def export_sets(
    store: Store,
    path: str,
    train: Key,
    valid: Key | None = None,
    columns: Sequence[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **options,
) -> list[str]:
    """Build what is missing of one or two data sets and export them; without ``valid`` the model is the final one.

    Both sets share the stored index, and the features too if their feature windows are the same. ``prepare`` is
    applied to the stored rows before they are written as text.
    """
    wanted = [train] if valid is None else [train, valid]
    store.ensure("dataset", wanted)
    sets = dict(zip(("train", "valid"), (prepare(store.stored("dataset", [key])) for key in wanted), strict=False))
    names = columns or ds.feature_columns(sets["train"])
    return export.train_valid_export(sets, path, names, final_model=valid is None, **options)
