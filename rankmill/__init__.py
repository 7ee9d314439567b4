"""Learning-to-rank tables on Spark: logs in, labelled and featured ranking rows out."""

from rankmill.functions.metrics import (
    average_precision,
    dcg_at_k,
    ndcg_at_k,
    rerank,
    score_relevance,
)
from rankmill.functions.querystring import DEFAULT_PARAMS, ParamRegistry, query_map, with_query_params
from rankmill.functions.scalars import case_codes, day_span, epoch_to_ts, float_text, to_integer, uuid_to_long
from rankmill.functions.text import (
    rm_repeat,
    simple_clean,
    to_halfwidth,
    to_lower,
    tokenize,
    tokenize_to_struct,
)
from rankmill.operators.actions import (
    action_count,
    action_count_per_day,
    action_pivot,
    action_processed,
    action_unstacked,
    date_span,
)
from rankmill.operators.clicks import (
    cast_array,
    click_exploded,
    click_grouped,
    click_label_explode,
    click_lists,
    click_processed,
    ctr,
    ctr_by_job_action,
    ctr_features,
    ctr_report,
    impression_id,
    keyword_impressions,
    label_with_action,
    no_keyword_rows,
    shown_jobs,
    testset_exploded,
    testset_lists,
    testset_processed,
)
from rankmill.operators.folds import cv_assign, cv_folds, series_cv
from rankmill.operators.jobs import (
    company_processed,
    job_attributes,
    job_company,
    job_date_range,
    job_processed,
    open_days,
)
from rankmill.operators.ranking import (
    group_lengths,
    grouped_average_precision,
    grouped_ndcg,
    mean_by_rule,
    mean_list_ndcg,
    mean_metric,
    metric_set,
    ndcg_score_of_prediction,
    ndcg_score_of_truth,
    rank_rows,
)
from rankmill.operators.running import number_rows, running_totals
from rankmill.operators.scoring import score_rows
from rankmill.operators.textscore import (
    field_tokens,
    idf_table,
    postings,
    text_field_scores,
    weighted_index,
    with_position_scores,
    with_text_scores,
)
from rankmill.operators.trees import Ensemble, from_dump, score_trees
from rankmill.plans.dataset import click_labels, dataset, feature_columns, impression_labels, split_xy, testset_labels
from rankmill.plans.export import (
    read_group_file,
    read_libsvm,
    to_libsvm_lines,
    train_valid_export,
    write_aligned,
    write_libsvm,
)
from rankmill.plans.features import date_window, features, features_per_window, running_counts, window_counts
from rankmill.plans.training import dataset_key, export_sets, training_store
from rankmill.sources.stages import Stage, Store, days
from rankmill.sources.tables import TableSpec, read_table, read_through, write_table

__all__ = [
    "action_count",
    "action_count_per_day",
    "action_pivot",
    "action_processed",
    "action_unstacked",
    "average_precision",
    "case_codes",
    "cast_array",
    "click_exploded",
    "click_grouped",
    "click_label_explode",
    "click_labels",
    "click_lists",
    "click_processed",
    "company_processed",
    "ctr",
    "ctr_by_job_action",
    "ctr_features",
    "ctr_report",
    "cv_assign",
    "cv_folds",
    "dataset",
    "date_span",
    "date_window",
    "day_span",
    "dcg_at_k",
    "DEFAULT_PARAMS",
    "epoch_to_ts",
    "feature_columns",
    "features",
    "field_tokens",
    "float_text",
    "group_lengths",
    "grouped_average_precision",
    "grouped_ndcg",
    "idf_table",
    "impression_id",
    "job_attributes",
    "job_company",
    "job_date_range",
    "job_processed",
    "keyword_impressions",
    "label_with_action",
    "mean_list_ndcg",
    "mean_metric",
    "ndcg_at_k",
    "ndcg_score_of_prediction",
    "ndcg_score_of_truth",
    "no_keyword_rows",
    "number_rows",
    "open_days",
    "ParamRegistry",
    "postings",
    "query_map",
    "rank_rows",
    "read_group_file",
    "read_libsvm",
    "read_table",
    "read_through",
    "rerank",
    "rm_repeat",
    "running_totals",
    "score_relevance",
    "score_rows",
    "series_cv",
    "shown_jobs",
    "simple_clean",
    "split_xy",
    "TableSpec",
    "testset_exploded",
    "testset_labels",
    "testset_lists",
    "testset_processed",
    "text_field_scores",
    "to_halfwidth",
    "to_integer",
    "to_libsvm_lines",
    "to_lower",
    "tokenize",
    "tokenize_to_struct",
    "train_valid_export",
    "uuid_to_long",
    "with_query_params",
    "with_position_scores",
    "with_text_scores",
    "write_libsvm",
    "write_table",
    "Ensemble",
    "Stage",
    "Store",
    "dataset_key",
    "days",
    "export_sets",
    "features_per_window",
    "from_dump",
    "mean_by_rule",
    "metric_set",
    "running_counts",
    "score_trees",
    "training_store",
    "weighted_index",
    "window_counts",
    "write_aligned",
]
