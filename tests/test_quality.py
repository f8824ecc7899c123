"""Contracts, receipts, policies and drafting on small rows."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from recordlens.functions import shape
from recordlens.operators import aggregates, sequences
from recordlens.operators.ordered import nth_smallest
from recordlens.plans import quality

AS_OF = "2024-06-01"


def outcome(df, *checks, **kw):
    return [r["ok"] for r in quality.run_contract(df, checks, as_of=AS_OF, **kw).orderBy("check_idx").collect()]


def test_checks_on_a_table(spark):
    df = spark.createDataFrame([(1, "a", "5"), (2, "a", "-"), (3, None, "9")], "id int, k string, v string")
    assert outcome(
        df, {"type": "min_rows", "min": 3}, {"type": "min_rows", "min": 4},
        {"type": "unique_field", "field": "id"}, {"type": "unique_field", "field": "k"},
        {"type": "fields_present", "fields": ["id", "k"]}, {"type": "fields_present", "fields": ["zz"]},
        {"type": "field_pattern", "field": "k", "pattern": "^a$"},
        {"type": "value_range", "field": "v", "min": 0}, {"type": "value_range", "field": "v", "min": 0, "allow_values": ["-"]},
        {"type": "known_answer", "field": "v", "first_by": "id", "equals": "5"}, {"type": "mystery"},
    ) == [True, False, True, False, True, False, False, False, True, True, False]


def test_empty_table_fails_row_checks(spark):
    df = spark.createDataFrame([], "id int, ts string")
    assert outcome(df, {"type": "min_rows"}, {"type": "unique_field", "field": "id"},
                   {"type": "value_range", "field": "id"}, {"type": "freshness", "field": "ts", "max_age_hours": 1},
                   {"type": "known_answer", "field": "ts", "first_by": "id", "equals": "x"}) == [False] * 5


@pytest.mark.parametrize("value,unit,ok", [
    ("2024-05-31T12:00:00", None, True), ("2024-05-31T11:59:59", None, False), ("2025-01-01", None, True),
    ("1717156800000", "epoch_ms", True), ("1717156800", "epoch_s", True), ("soon", None, False)])
def test_freshness(spark, value, unit, ok):
    df = spark.createDataFrame([(value,)], "ts string")
    assert outcome(df, {"type": "freshness", "field": "ts", "unit": unit, "max_age_hours": 12}) == [ok]


def test_json_null_is_present(spark):
    df = spark.createDataFrame([('{"a": null}',), ('{"a": 1, "b": 2}',)], "j string").withColumn(
        "d", F.try_parse_json("j"))
    assert outcome(df, {"type": "fields_present", "fields": ["a"]}, {"type": "fields_present", "fields": ["b"]},
                   json_col="d") == [True, False]


def test_broken_response_fails_all_but_status(spark):
    r = spark.createDataFrame([("c", 1, 200, None, None, "reset")],
                              "capability_id string, probe_id int, status int, body_text string, latency_ms double, error string")
    got = quality.check_responses(r, {"c": [{"type": "status"}, {"type": "json"}, {"type": "max_latency"}]}, as_of=AS_OF)
    assert rows(got, "check_idx", "ok") == [(0, True), (1, False), (2, False)]


def test_rollup_completeness(spark):
    df = spark.createDataFrame([
        ("p", 0, "min_rows", "completeness", True, False, "few", 15, 20), ("p", 1, "json", "availability", False, False, "x", None, None),
        ("q", 0, "json", "availability", True, True, "x", None, None)],
        "probe_id string, check_idx int, type string, dimension string, critical boolean, ok boolean, detail string, "
        "rows_found long, rows_expected long")
    got = {r["probe_id"]: r for r in aggregates.check_rollup(df).collect()}
    assert got["p"]["completeness_score"] == 0.75 and not got["p"]["task_success"] and not got["p"]["available"]
    assert got["p"]["failures"] == ["min_rows [completeness]: few", "json [availability]: x"]
    assert got["q"]["task_success"] and got["q"]["schema_valid"] and got["q"]["completeness_score"] == 1.0


def test_case_outcomes(spark):
    rows_ = spark.createDataFrame(
        [("fine", 1, "x"), ("fine", 2, "y"), ("twice", 1, "x"), ("twice", 1, "y"), ("hollow", 1, "none"), ("hollow", 2, "y")],
        "case_id string, k int, name string")
    checks = quality.run_contract(
        rows_, [{"type": "unique_field", "field": "k"}, {"type": "field_pattern", "field": "name", "pattern": "^.$"}],
        as_of=AS_OF, keys=["case_id"]).withColumnRenamed("dimension", "check_dimension")
    wanted = spark.createDataFrame([("fine", None), ("twice", "completeness"), ("hollow", "completeness")],
                                   "case_id string, dimension string")
    got = quality.case_outcomes(checks, wanted)
    assert rows(got, "case_id", "actual", "dimension_flagged") == [
        ("fine", "verified", False), ("hollow", "failed_checks", False), ("twice", "failed_checks", True)]
    card = aggregates.detection_scorecard(got).first()
    assert (card["injected"], card["detected"], card["false_positives"], card["classified"], card["pass"]) == (2, 2, 0, 1, False)


def test_unknown_policy_rules_are_errors(spark):
    state = spark.createDataFrame([], "status string, fresh boolean, verified_at string, experimental boolean, "
                                      "streak int, success_rate_30d double, confidence double, eligible boolean")
    with pytest.raises(ValueError, match="min_passes"):
        quality.policy_gate(state, {"mine": {"min_passes": 3}}, as_of=AS_OF)
    with pytest.raises(ValueError, match="unknown policy"):
        quality.resolve_best(state, "strict", as_of=AS_OF)


def test_an_allowed_source_beyond_place_ten(spark):
    cols = ("capability_id int, eligible boolean, status string, fresh boolean, success_rate_30d double, "
            "match_score int, latency_ms double, verified_at string, experimental boolean, streak int, confidence double, "
            "receipt_id int")
    data = [(i, True, "failed_checks", True, 1.0, 9, 1.0, AS_OF, False, 5, 1.0, i) for i in range(12)]
    data.append((99, True, "failed_checks", True, 0.5, 1, 1.0, AS_OF, False, 5, 0.9, 99))
    data.append((50, True, "verified", True, 0.1, 0, 9.0, AS_OF, False, 5, 0.8, 50))
    frame = spark.createDataFrame(data, cols)
    got = {r.capability_id: r.decision for r in quality.resolve_best(frame, as_of=AS_OF).collect()}
    assert got[50] == "approved" and len(got) == 14
    catalog = frame.select("capability_id", F.array(F.lit(3), F.lit(99)).alias("fallback_ids"))
    best = quality.route_best(frame, catalog).first()
    assert best.capability_id == 50 and best.fallbacks == [3, 99, 0]


HISTORY = "source string, ts timestamp, event_id int, task_success boolean, latency_ms double, status string, schema_hash string, checks_passed int, checks_total int"


def history(spark, *data):
    import datetime as dt

    start = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([
        (s, start + dt.timedelta(hours=h), i, ok, 1.0, "verified" if ok else "failed_checks", sh, 2 if ok else 1, 2)
        for i, (s, h, ok, sh) in enumerate(data)], HISTORY)


def test_streak_and_drift(spark):
    h = history(spark, ("a", 1, True, "x"), ("a", 2, False, None), ("a", 300, True, "y"), ("a", 301, True, "y"),
                ("b", 1, True, "x"), ("c", 5, False, "x"))
    order = ["ts", "event_id"]
    assert rows(sequences.verified_streak(h, order), "source", "streak") == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(sequences.schema_changes(h, order, as_of="2024-05-31"), "source", "schema_changes_30d") == [
        ("a", 1), ("b", 0), ("c", 0)]
    # the probe without a hash breaks the comparison of neighbours but not the count over the window
    assert sequences.drift_events(h, order).count() == 0
    assert rows(sequences.status_changes(h, order), "event_id") == [(0,), (1,), (2,), (4,), (5,)]


def test_policy_levels(spark):
    h = history(spark, *[("good", i * 24, True, "x") for i in range(29)],
                *[("bad", i * 24, i % 2 == 0, "x") for i in range(30)])
    state = quality.source_state(h, ["ts", "event_id"], as_of="2024-05-29 03:00:00").withColumn(
        "experimental", F.col("source") == "bad")
    got = {(r["source"], r["policy"]): r["allowed"] for r in
           quality.policy_gate(state, as_of="2024-05-29 03:00:00").collect()}
    assert got[("good", "production")] and got[("good", "permissive")] and not got[("bad", "production")]


def test_order_statistics(spark):
    for values, median, p95 in (([4], 4, 4), ([1, 2, 3, 4], 3, 4), ([5, 5, 5, 1], 5, 5), (list(range(100)), 50, 95)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        r = nth_smallest(df, "v", {"m": 0.5, "p": 0.95}).first()
        assert (r["m"], r["p"]) == (median, p95)


def test_shape_hash():
    same = [shape.hash_text(x) for x in ('{"a": 1, "b": [1, "x"]}', '{"b": [2.5], "a": 7}')]
    assert same[0] == same[1]
    assert shape.hash_text('{"a": "1", "b": [1]}') != same[0]
    assert shape.hash_text("null") is None and shape.hash_text("{oops") is None
    assert shape.shape_of(json.loads('[[[[[[1]]]]]]')) == [[[[["any"]]]]]
    assert shape.shape_of({"t": True, "n": None, "e": []}) == {"e": ["empty"], "n": "null", "t": "boolean"}


def test_shape_hash_sees_all_keys_and_levels(spark, table):
    wide = [json.dumps({f"k{i:03}": v if i == 60 else 1 for i in range(80)}) for v in (1, "x")]
    deep = ['{"a":' * 9 + v + "}" * 9 for v in ("1", '"x"')]
    for a, b in (wide, deep):
        df = table("body", (a,), (b,))
        assert df.select(shape.schema_hash(F.col("body"))).distinct().count() == 2
        assert df.select(shape.schema_hash(F.col("body"), max_depth=4, max_keys=50)).distinct().count() == 1
    assert shape.hash_text("[" * 3000 + "1" + "]" * 3000) != shape.hash_text("[" * 3000 + "]" * 3000)


def test_columns_are_compared_with_the_last_day_before(table):
    cells = table("t d c", ("a", "1", "x"), ("a", "1", "y"), ("a", "1", "x"), ("a", "3", "x"), ("a", "4", "x"),
                  ("b", "1", "x"))
    daily = quality.daily_columns(cells, "t", "d", "c")
    assert rows(daily) == [("a", "1", ["x", "y"]), ("a", "3", ["x"]), ("a", "4", ["x"]), ("b", "1", ["x"])]
    assert rows(quality.saved_before(daily)) == [("a", "3", ["x", "y"]), ("a", "4", ["x"])]
