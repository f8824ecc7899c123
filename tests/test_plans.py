"""Plan shape: no nested loops, no row-at-a-time Python, filters and columns reach the scan."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
JOINS = """registry_lookup tail_events or_key_join prefix_model_join ad_applicability_join
token_overlap_join context_or_join dimension_lookup reference_join serial_guarded_history match_tiers
event_match_tiers text_vocab_join prior_holder_split merge_metric_column fallback_candidates
compare_sources known_exclusion fleet_metrics severity_rollup group_runs rank_sources route_best
assess_all carrier_indicator detection_scorecard contract_catalog""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_nested_loop(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_pruning_and_pushdown(spark):
    text = QUERIES["counts_with_subset"](spark, SF)._jdf.queryExecution().toString()
    scan = [x for x in text.splitlines() if "FileScan" in x][-1]
    assert "l_shipdate" in scan and "l_comment" not in scan and "l_tax" not in scan


def test_contract_is_one_scan(spark):
    assert plan(QUERIES["run_contract"](spark, SF)).split("== Initial Plan ==")[0].count("FileScan") == 1


def test_assessment_joins_without_exchange(spark):
    """Marks and modules are stored by mark: nine scans of stored tables, no shuffle, no feed read again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["assess_all"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and text.count("FileScan") == 9 and SF not in text


def test_feed_is_grouped_once(spark):
    """Own and family figures come from one stored grouping of the reports."""
    text = plan(QUERIES["score_maintenance"](spark, SF))
    assert "part.parquet" in text and "lineitem.parquet" not in text
