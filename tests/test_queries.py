"""Every SQL text runs in DuckDB; a cross-section of queries must equal it on the small tables."""

import math

import duckdb
import pytest

from conftest import SMALL
from tabwright.suite import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["revenue_share_prepared", "deduplicate_first", "merge_columns_by_owner", "impute_median", "scale_robust", "bin_averaged_quantiles", "outliers_elliptic",
          "encode_target_cross_fit", "encode_woe", "rolling_whole_table_sliced", "lag_by_text_sliced", "rolling_tied_lead_sliced", "lag_whole_table_sliced", "split_stratified", "undersample_random", "hourly_timeline", "profile_numeric",
          "drift_report_rows", "tfidf_long", "impute_nearest", "undersample_tomek", "evaluate_areas", "stream_replay", "score_chi2_many_classes",
          "evaluate_confusion_many_classes", "box_plot_many_groups", "drift_many_categories", "read_schema_orders", "sample_head_orders", "oversample_random", "nearest_embeddings_by_pivots", "evaluate_areas_multiclass", "evaluate_clusters_all_rows", "evaluate_confusion", "full_profile", "oversample_smote", "oversample_svm_smote", "group_statistics_back", "slow_steps", "nearest_suppliers_by_tree", "score_neighbour_information", "model_birch_sums"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v
        return v
    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_names_are_plain():
    assert all("pipeline" not in k and not k.startswith("op") for k in REGISTRY)


@pytest.mark.parametrize("name", [k for k, v in REGISTRY.items() if v.sql])
def test_sql_runs(duck, name):
    assert duck.sql(REGISTRY[name].sql).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = REGISTRY[name].run(spark, SMALL)
    rel = duck.sql(REGISTRY[name].sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in cols]
    assert canon([tuple(r[c] for c in cols) for r in df.collect()]) == canon([tuple(r[i] for i in idx) for r in rel.fetchall()])
