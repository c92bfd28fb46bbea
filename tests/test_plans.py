"""What the registered queries may not contain, whatever Spark makes of them."""

import pytest

from gleaner.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# These run jobs while they are built (writers, streams, model fits); their parts are covered by other names.
EAGER = {n for n in QUERIES if n.startswith(("st_", "snk_csv", "snk_incremental", "src_reviews_csv", "src_products_csv"))} | {
    "ml_text_classifier", "pipe_validate", "tm_coherence_cv", "tm_fit_lda", "tm_select_k", "tm_top_words", "tm_doc_topics",
    "pipe_topics", "pipe_explorer", "tm_explorer_export", "tm_em_step", "tm_fit_learned", "tm_topic_map", "agg_exact_quantiles",
    "win_sample_sketch", "src_paged_search"}


@pytest.fixture(scope="module")
def plans(spark):
    return {n: f(spark, SF)._jdf.queryExecution() for n, f in QUERIES.items() if n not in EAGER}


def test_no_cross_or_nested_loop_joins(plans):
    bad = [n for n, q in plans.items() if any(
        x in q.executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))]
    assert bad == []


def test_no_broadcast_hints(plans):
    assert [n for n, q in plans.items() if "ResolvedHint" in q.analyzed().toString()] == []


def test_python_only_where_a_model_is_plugged_in(plans):
    python = {n for n, q in plans.items() if "ArrowEvalPython" in q.executedPlan().toString()
              or "BatchEvalPython" in q.executedPlan().toString() or "InPandas" in q.executedPlan().toString()}
    assert python == {"ml_batch_score", "ml_validate", "pipe_score_full", "join_predictions"}


def test_columns_are_pruned_and_filters_pushed(plans):
    pruned = plans["src_pruned_scan"].executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in pruned
    assert "GreaterThanOrEqual(l_quantity" in plans["flt_not_in_set"].executedPlan().toString()
    monthly = plans["agg_monthly_sentiment"].executedPlan().toString()
    assert "l_extendedprice" not in monthly and "l_partkey" not in monthly


@pytest.mark.parametrize("name", ["win_dedup_first", "win_recent_cap", "win_topic_exemplars", "src_page_slice", "win_dedup_products",
                                  "win_top_terms", "pipe_clean"])
def test_ranked_queries_limit_groups_before_the_shuffle(plans, name):
    assert plans[name].executedPlan().toString().count("WindowGroupLimit") >= 2


def test_texts_are_tokenised_once(plans):
    assert plans["flt_min_tokens"].optimizedPlan().toString().count("regexp_extract_all") <= 2
    assert plans["agg_doc_freq"].optimizedPlan().toString().count("regexp_extract_all") == 2  # the total reuses the shuffle


def test_text_tables_are_dealt_out_only_when_their_scan_is_narrow(spark, tmp_path):
    from gleaner.sources.scan import read_table
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 50) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(12).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        plan = lambda name: read_table(spark, str(tmp_path / name), 8)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan("one") and "Exchange" not in plan("many")
        assert read_table(spark, str(tmp_path / "one")).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
