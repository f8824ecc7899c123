"""Carrier boundaries, session rules and streams on small rows."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from recordlens.functions import fixed, text
from recordlens.operators import sequences
from recordlens.plans import activity, carrier
from recordlens.streaming import jobs

AS_OF = "2026-07-07"


def assess(spark, table, census, crashes=0, inspections=(0, 0, 0), dot="1"):
    n, veh, drv = inspections
    cen = table("dot_number legal_name status_code power_units total_drivers add_date", census)
    cr = spark.range(crashes).selectExpr(
        "'1' dot_number", "string(id) crash_id", "'20260101' report_date", "'' fatalities", "'1x' injuries", "'N' tow_away")
    ins = spark.range(n).selectExpr(
        "'1' dot_number", "string(id) inspection_id", "'20260101' insp_date", "'1' viol_total", "'' oos_total",
        f"if(id < {veh}, '1', '') vehicle_oos_total", f"if(id < {drv}, '2', '0') driver_oos_total", "'' hazmat_oos_total")
    req = table("dot_number", (f"USDOT {dot}",))
    return carrier.carrier_indicator(req, cen, cr, ins, as_of=AS_OF)


OLD = ("1", "Alpha", "A", "10", "12", "19990101")


@pytest.mark.parametrize("census,crashes,inspections,indicator,decision", [
    (OLD, 0, (3, 0, 0), 8, fixed.DECISION_LOWER),
    (OLD, 0, (2, 2, 2), 14, fixed.DECISION_VERIFY),
    (OLD, 0, (25, 7, 2), 8, fixed.DECISION_LOWER),            # 28.0 % and 8.0 %
    (OLD, 0, (1000, 281, 90), 20, fixed.DECISION_VERIFY),     # 28.1 % and 9.0 %
    (OLD, 0, (1000, 280, 91), 18, fixed.DECISION_VERIFY),     # 28.0 % and 9.1 %
    (OLD, 4, (3, 0, 0), 8, fixed.DECISION_LOWER),             # 40 per 100
    (OLD, 5, (3, 0, 0), 18, fixed.DECISION_VERIFY),
    (("1", "Alpha", "A", "0", "12", "19990101"), 5, (3, 0, 0), 23, fixed.DECISION_VERIFY),
    (("1", "Alpha", "A", "2", "8", "19990101"), 0, (3, 0, 0), 8, fixed.DECISION_LOWER),   # ratio 4
    (("1", "Alpha", "A", "2", "9", "19990101"), 0, (3, 0, 0), 16, fixed.DECISION_LOWER),
    (("1", "Alpha", "A", "9", "2", "19990101"), 0, (3, 0, 0), 16, fixed.DECISION_LOWER),
    (("1", "Alpha", "A", "10", "12", "20260601"), 0, (3, 0, 0), 33, fixed.DECISION_VERIFY),
    (("1", "Alpha", "A", "10", "12", "20251001"), 0, (3, 0, 0), 20, fixed.DECISION_VERIFY),
    (("1", "Alpha", "A", "0", "12", "20260601"), 0, (3, 0, 0), 48, fixed.DECISION_ELEVATED),
    (("1", "Alpha", "I", "10", "12", "19990101"), 0, (3, 0, 0), 68, fixed.DECISION_STOP),
    (("1", "Alpha", "I", "0", "12", "20260601"), 0, (2, 0, 0), 100, fixed.DECISION_STOP),
])
def test_carrier_rules(spark, table, census, crashes, inspections, indicator, decision):
    r = assess(spark, table, census, crashes, inspections).first()
    assert (r["indicator"], r["decision"]) == (indicator, decision)


def test_unknown_carrier(spark, table):
    a = assess(spark, table, OLD, dot="77")
    assert a.first()["indicator"] is None and a.first()["decision"] == fixed.DECISION_VERIFY
    assert "No census record" in carrier.carrier_verdict(a).first()["verdict"]


def test_verdict_names_the_deciding_flag(spark, table):
    v = carrier.carrier_verdict(assess(spark, table, ("1", "", "I", "10", "12", "19990101"))).first()["verdict"]
    assert v.startswith("USDOT 1 shows a stop-and-resolve condition") and "operating status is i" in v


# ------------------------------------------------------------------ sessions
EVENT = "sessionId string, timestamp timestamp, event_id int, eventType string, filePath string, branchPath string, lines int, imports int, exports int"
ORDER = ["timestamp", "event_id"]


def events(spark, *data):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([
        ("s", start + dt.timedelta(milliseconds=ms), i, kind, path, path.rsplit("/", 1)[0] if "/" in path else ".", *m)
        for i, (ms, kind, path, *m) in enumerate((*d, 1, 0, 0)[:6] for d in data)], EVENT)


def test_tombstone_and_readd(spark):
    e = events(spark, (1, "add", "a/x"), (2, "unlink", "a/x"), (3, "add", "a/y"), (4, "unlink", "a/y"), (5, "add", "a/y"))
    assert rows(activity.latest_state(e, ORDER), "filePath") == [("a/y",)]


@pytest.mark.parametrize("m,expected", [
    ((300, 15, 10), ""), ((301, 16, 11), "oversized:yellow importHeavy:yellow highSurfaceArea:yellow"),
    ((500, 25, 10), "oversized:yellow importHeavy:yellow"), ((501, 26, 0), "oversized:red importHeavy:red")])
def test_badge_limits(spark, m, expected):
    b = activity.file_badges(events(spark, (1, "add", "x", *m))).first()["badges"]
    assert " ".join(f"{x['id']}:{x['severity']}" for x in b) == expected


def test_folder_limits_and_health(spark):
    data = [(i, "add", f"a/f{i}") for i in range(15)] + [(20, "add", "b/g/h", 501)]
    live = activity.latest_state(events(spark, *data), ORDER)
    assert dict(rows(activity.tree_health(live), "path", "health"))["."] == "red"
    more = activity.latest_state(events(spark, *data, (50, "add", "a/f99"), (51, "add", "1/2/3/4/5/6/f")), ORDER)
    badges = {r["path"]: [b["id"] for b in r["badges"]] for r in activity.branch_badges(more).collect()}
    assert badges["a"] == ["flatDump"] and badges["1/2/3/4/5"] == [] and badges["1/2/3/4/5/6"] == ["deepNesting"]
    health = dict(rows(activity.tree_health(more), "path", "health"))
    assert health["a"] == "yellow" and health["1"] == "yellow" and health["b/g"] == "red"


def test_own_badges_beat_children(spark):
    data = [(i, "add", f"a/f{i}") for i in range(16)] + [(99, "add", "a/deep/x", 501)]
    health = dict(rows(activity.tree_health(activity.latest_state(events(spark, *data), ORDER)), "path", "health"))
    # the crowded folder shows its own yellow although a red file lies below it, and passes yellow on
    assert health["a/deep"] == "red" and health["a"] == "yellow" and health["."] == "yellow"


@pytest.mark.parametrize("gaps,expected", [
    ((4999, 4999), [(2, 3)]), ((5000, 4999), [(0, 1), (1, 1), (2, 1)]), ((4999,), [(0, 1), (1, 1)])])
def test_run_boundaries(spark, gaps, expected):
    times = [0]
    for g in gaps:
        times.append(times[-1] + g)
    e = events(spark, *[(ms, "change", "a/x") for ms in times])
    assert rows(sequences.group_runs(e, ORDER), "event_id", "count") == expected


def test_interleaved_event_breaks_a_run(spark):
    e = events(spark, (0, "change", "a/x"), (1, "change", "a/x"), (2, "change", "b/x"), (3, "change", "a/x"))
    assert sequences.group_runs(e, ORDER).filter("grouped").count() == 0


def test_runs_across_time_chunks(spark):
    # a run that crosses the internal hour border stays one run
    e = events(spark, *[(3_595_000 + i * 3000, "change", "a/x") for i in range(5)])
    assert rows(sequences.group_runs(e, ORDER), "event_id", "count") == [(4, 5)]


def test_thrashing_limits(spark):
    e = events(spark, (0, "change", "a/x"), (1, "change", "a/x"), (2, "change", "b/y"), (3, "change", "b/y"), (4, "change", "b/y"))
    got = dict(rows(sequences.thrashing(e, ORDER, as_of="2024-01-01 00:00:30"), "path", "level"))
    assert got == {"a/x": "recent", "b/y": "thrashing", "a": "branch-active", "b": "thrashing"}
    assert sequences.thrashing(e, ORDER, as_of="2024-01-01 00:02:00").count() == 0


def test_hottest_tie_is_first_seen(spark):
    from recordlens.operators.aggregates import session_stats

    e = events(spark, (1, "add", "b/x"), (2, "add", "a/x"), (3, "change", "a/x"), (4, "change", "b/x"))
    assert session_stats(e, order=ORDER).first()["hottest_branch"] == "b"


def test_suggested_action(spark):
    pick = lambda *m: activity.file_badges(events(spark, (1, "add", "x", *m))).select(
        activity.suggested_action(F.col("badges"))).first()[0]
    assert [pick(1, 1, 1), pick(501, 16, 0), pick(501, 0, 0), pick(0, 16, 0), pick(301, 16, 0)] == [
        "continue", "secondOpinion", "splitFile", "refactor", "splitFile"]


def test_latest_stream_equals_batch(spark, tmp_path):
    e = events(spark, (1, "add", "a/x"), (2, "unlink", "a/x"), (3, "add", "b/y"), (9, "add", "a/x"), (10, "unlink", "b/y"))
    base = str(tmp_path)
    for i, cond in enumerate(("event_id < 2", "event_id >= 2 and event_id < 4", "event_id >= 4")):
        e.filter(cond).write.parquet(f"{base}/in/p{i}")
        jobs.stream_latest_state(spark.readStream.schema(e.schema).parquet(f"{base}/in/*"), ORDER, base).awaitTermination()
        seen = e.filter(f"event_id < {[2, 4, 9][i]}")
        assert rows(jobs.latest_state_now(spark, base), "filePath") == rows(
            activity.latest_state(seen, ORDER), "filePath")


def test_marks(spark, table):
    df = table("m", ("n-123 ab",), ("N0",), ("12345",), ("N123456",), ("N12I",), ("NAB",), ("N1Z",), (None,))
    got = [tuple(r) for r in df.select(text.normalize_mark(F.col("m")), text.is_valid_mark(F.col("m"))).collect()]
    assert got == [("N123AB", True), ("N0", False), ("N12345", True), ("N123456", False), ("N12I", False),
                   ("NAB", False), ("N1Z", True), ("", False)]


def test_edit_rate_stream_has_the_last_windows(spark):
    from recordlens.bindings import Tables, registered

    sf = "/root/testdata/sf0.001"
    events = Tables(spark, sf).v_files
    batch = jobs.edit_windows(events, window="1 hour").withColumn(
        "hour", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
    got = rows(registered()[0]["stream_edit_rate_all"](spark, sf), "hour", "filePath", "edits", "thrashing")
    assert got == rows(batch, "hour", "filePath", "edits", "thrashing")
    assert sum(r[2] for r in got) == events.count() and got[-1][0] >= "2024-01-30"
