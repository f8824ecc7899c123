"""Readers, registry bundle, JSON feeds and staged ingest on hand-made files."""

import json

import pytest
from conftest import rows

from recordlens.plans import quality
from recordlens.sources import documents, feeds, ingest, registry, store, tables
from recordlens.sources.tables import csv_scan, year_range

AS_OF = "2026-07-07"


def write(path, body, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body.encode(encoding))
    return str(path)


def test_csv_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿A , B,C\r\n"x, ""y""", two ,"l1\nl2"\r\n\r\n , ,\r\n1\r\n1,2,3,4\r\n')
    df = csv_scan(spark, path)
    assert df.columns == ["A", "B", "C"]
    assert rows(df) == [("1", "", ""), ("1", "2", "3"), ('x, "y"', "two", "l1\nl2")]


def test_header_rules():
    assert tables.header_form(" Other Names(1) ") == "OTHER_NAMES_1"
    mapping, missing = tables.build_mapping(["B", "C"], {"F": ["A", "B"], "G": ["C"], "H": ["Z"]})
    assert mapping == {"F": "B", "G": "C"} and missing == ["H"]


def test_equal_headers_keep_the_last(spark, table):
    df = table("A_B", ("1",)).selectExpr("A_B", "'2' AS `A B`", "'3' AS _c2")
    assert rows(tables.with_normal_headers(df)) == [("2",)]


def test_load_tables_absent_is_empty(spark, tmp_path):
    write(tmp_path / "flights.csv", "N_NUMBER,DATE\nN1,2020-01-01\n")
    t = tables.load_tables(spark, str(tmp_path))
    assert t["flights"].count() == 1 and t["registry"].count() == 0
    assert t["registry"].columns == feeds.REGISTRY


MASTER = ("ï»¿N-NUMBER,SERIAL NUMBER,MFR MDL CODE,ENG MFR MDL,YEAR MFR,TYPE REGISTRANT,NAME,CITY,STATE,"
          "CERT ISSUE DATE,CERTIFICATION,STATUS CODE,EXPIRATION DATE,MODE S CODE HEX,\n"
          "10A   ,00S-1 ,M1  ,E1 ,1999,3,Jørn AS,C,ST,20190314,1N,V ,20270331,ABC ,\n"
          "20B   ,       ,M9  ,   ,2001,6,X,C,ST,bad,4,Q,,,\n")
DEREG = ("N-NUMBER,SERIAL-NUMBER,MFR-MDL-CODE,STATUS-CODE,NAME,CANCEL-DATE,\n"
         "10A,S1,M1,C,OLD,20180101,\n10A,OTHER,M1,C,OLDER,19480101,\n20B,ANY,M1,,,20170101,\n"
         "30C,ANY,M1,,,20160101,\n10A,S-1,M1,C,NODATE,,\n")


@pytest.fixture
def bundle(tmp_path):
    write(tmp_path / "b/Master.TXT", MASTER, "latin-1")
    write(tmp_path / "b/ACFTREF.txt", "CODE,MFR,MODEL,\nM1  ,ACME   ,X-20 ,\n")
    write(tmp_path / "b/engine.txt", "CODE,MFR,MODEL,\nE1,MOTOR ,V8 ,\n")
    write(tmp_path / "b/DEREG.txt", DEREG)
    write(tmp_path / "b/dealer.txt", "DEALER-NO,NAME,\n1,A,\n")
    return str(tmp_path / "b")


def test_registry_bundle(spark, bundle):
    parts = registry.registry_bundle_scan(spark, bundle)
    out = registry.registry_tables(spark, parts)
    cols = ["N_NUMBER", "MFR", "ENG_MODEL", "REGISTRANT_TYPE", "REGISTRANT_NAME", "CERT_ISSUE_DATE",
            "AIRWORTHINESS_CLASS", "STATUS", "EXPIRATION_DATE"]
    assert rows(out["registry"], *cols) == [
        ("N10A", "ACME", "V8", "Corporation", "Jørn AS", "2019-03-14", "Standard", "Valid", "2027-03-31"),
        ("N20B", "", "", "6", "X", "", "Experimental", "Q", "")]
    assert rows(registry.registry_warnings(parts), "N_NUMBER") == [("N20B",)]
    # another serial is a recycled mark; a holder without serial or no holder keeps the row
    assert rows(out["registration_history"], "N_NUMBER", "DATE", "DETAILS") == [
        ("N10A", "2018-01-01", "Previous registrant: OLD (status C)"),
        ("N20B", "2017-01-01", "Previous registrant: unknown"),
        ("N30C", "2016-01-01", "Previous registrant: unknown")]
    assert "dealers" in out and "reserved_n_numbers" not in out


def test_event_documents(spark, table):
    plain = json.dumps({"results": [
        {"cm_ntsbNum": "E1", "cm_eventDate": "2020-01-02T00:00", "cm_vehicles": [{"registrationNumber": "1a"}]},
        {"ntsbNumber": "", "eventDate": "", "city": "no id"}, {"EventDate": "2021-01-01", "Make": None}]})
    got = rows(documents.ntsb_json(table("b", (plain,)), "b", "api"), "EVENT_ID", "DATE", "N_NUMBER")
    assert got == [("", "2021-01-01", ""), ("E1", "2020-01-02", "N1A")]
    eav = json.dumps({"Results": [
        {"Fields": [{"FieldName": "NtsbNo", "Values": ["E2", "x"]}, {"FieldName": "Mkey", "Values": ["7"]},
                    {"FieldName": "N#", "Values": "5b"}, {"FieldName": "Unknown", "Values": ["q"]}]},
        {"Fields": [{"FieldName": "City", "Values": ["nowhere"]}]}]})
    got = documents.eav_pivot_scan(table("b", (eav,)), "b", "api").collect()
    assert len(got) == 1 and got[0]["N_NUMBER"] == "N5B" and got[0]["REPORT_URL"].endswith("/7/pdf")


def test_directives_and_text(spark, table):
    from recordlens.operators import matching

    docs = json.dumps({"results": [
        {"document_number": "d1", "title": "Rule; Acme X-20 airplanes", "abstract": "AD 2024-08-12 applies",
         "effective_on": "2024-09-30", "regulation_id_numbers": ["a", "b"]},
        {"document_number": "d2", "title": "Acme only 87-20-03"}, {"document_number": "", "title": ""}]})
    d = documents.federal_register_transform(table("b", (docs,)), "b")
    assert rows(d, "AD_NUMBER", "RIN") == [("2024-08-12", "a;b"), ("87-20-03", "")]
    vocab = table("MFR MODEL", ("ACME", "X-20"), ("ACME", "Y9"), ("AC", "QQ-1"), ("", "Z"))
    hits = matching.text_vocab_join(
        d.selectExpr("AD_NUMBER", "concat(TITLE, ' ', ABSTRACT) AS txt"), vocab, id_col="AD_NUMBER", text_col="txt")
    assert rows(hits) == [
        ("2024-08-12", "AC", "", "MAKE_TEXT_MATCH"), ("2024-08-12", "ACME", "X-20", "TEXT_MATCH"),
        ("87-20-03", "AC", "", "MAKE_TEXT_MATCH"), ("87-20-03", "ACME", "", "MAKE_TEXT_MATCH")]


def test_contained_tokens_against_brute_force(spark, table):
    from recordlens.operators.matching import contained_tokens

    texts = [("1", "ABCABD_A_LONGWORD99"), ("2", ""), ("3", "XYZ"), ("4", "LONGWORD9"), ("5", "aLONGWORD")]
    tokens = ["A", "AB", "XYZ", "ABD_", "LONGWORD9", "LONGWORD99", "LONGWORD", "NOPE", "D_A"]
    want = sorted((i, t) for i, x in texts for t in tokens if t in x)
    got = contained_tokens(table("id x", *texts), "id", "x", table("TOKEN", *[(t,) for t in tokens]))
    assert rows(got) == want


def test_year_window():
    assert year_range(None, 2026) == (1995, 2026)
    assert year_range("2001:current", 2026) == (2001, 2026)
    assert year_range("2001:2003", 2026) == (2001, 2003)
    assert year_range("2001", 2026) == (2001, 2026) and year_range("x:y", 2026) == (1995, 2026)


def test_links(spark, table):
    html = ('<a href="/a/sdr_2001.csv">x</a><a HREF = \'b_2001.zip?x=1\'>y</a><a href="#top">z</a>'
            '<a href="//h.org/1994.csv">o</a><a href="https://q.org/2003.CSV">p</a>')
    links = documents.extract_links(table("id url html", ("1", "http://h.org/d/p.html?q", html)), "id", "url", "html")
    assert [r["link"] for r in links.orderBy("pos").collect()] == [
        "http://h.org/a/sdr_2001.csv", "http://h.org/d/b_2001.zip?x=1", "http://h.org/1994.csv",
        "https://q.org/2003.CSV"]
    assert rows(documents.year_links(links, ["pos"]), "year", "link") == [
        (2001, "http://h.org/a/sdr_2001.csv"), (2003, "https://q.org/2003.CSV")]


def test_artifacts(spark, table):
    from pyspark.sql import functions as F

    files = table("name date content", ("a", "1", "x"), ("a", "2", "x"), ("a", "3", "y"), ("a", "4", "x"), ("b", "2", "x"))
    got = store.artifact_dedupe(files, ["date"], F.lit(0))
    assert rows(got, "name", "date", "duplicate") == [
        ("a", "1", False), ("a", "2", True), ("a", "3", False), ("a", "4", False), ("b", "2", False)]
    assert rows(store.latest_artifacts(got, ["date"]), "name", "date") == [("a", "4"), ("b", "2")]


@pytest.fixture
def landed(tmp_path, bundle):
    src = tmp_path / "in"
    write(src / "sdr/sdr_2019.csv", "Control Number,Difficulty Date,Aircraft Registration Number,Aircraft Make,Aircraft Model,JASC Code,Remarks\n"
          "r1,2019-02-02,10A,ACME,X-20,3210,worn\nr2,2019-02-03,99Z,ACME,X-20,3210,worn\n")
    write(src / "sdr/2020.csv", "DATE,MAKE,MODEL,TEXT\n2020-01-01,NOBODY,Q,mentions X-20 here\n2020-01-02,NOBODY,Q,nothing\n")
    write(src / "sdr/odd_2021.csv", "WHAT,EVER\n1,2\n")
    write(src / "ntsb/one.csv", "NTSB_NO,EV_DATE,REGIST_NO,MAKE,MODEL\nE1,2020-01-01,10a,ACME,X-20\n")
    write(src / "ntsb/two.json", json.dumps({"results": [{"ntsbNumber": "E1", "eventDate": "2020-01-01", "City": "later wins"}]}))
    write(src / "ads/ads.csv", "AD_NUMBER,EFFECTIVE_DATE,SUBJECT,APPLIES_MFR,APPLIES_MODEL,COST_BAND\na1,2020-01-01,s,ACME,X,low\n")
    write(src / "enforcement/q1.csv", "CASE NO,CLOSED DATE,ENTITY,SANCTION,PENALTY,VIOLATION\n1,2025-01-01,ACME OPS,Suspension,,logbook entries\n"
          "2,2001-01-01,ACME OPS,civil penalty,$1,fatigue\n")
    write(src / "asrs/a.csv", "ACCESSION NUMBER,TIME/DATE,MAKE,MODEL,LOCALE REFERENCE,ANOMALY\n1,2024-01-01 00:00,ACME,X,ABC,\"fatigue, stress/noise\"\n")
    write(src / "incursions/i.csv", "LOCATION_ID,LOCAL_DATE,RI_CATEGORY\nabc,2025-03-01,C\nABC,2010-01-01,D\nABC,,D\nABC,2027-01-01,D\n")
    write(src / "strikes/s.csv", "AIRPORT,INCIDENT_DATE,SPECIES,INDICATED_DAMAGE\nABC,2025-05-01,Gull,None\nDEF,2025-05-01,Gull,Substantial\n")
    return {"registry": bundle, **{n: str(src / n) for n in
            ("sdr", "ntsb", "ads", "enforcement", "asrs", "incursions", "strikes")}}


def test_ingest_end_to_end(spark, landed, tmp_path):
    base = str(tmp_path / "db")
    records = ingest.run_ingest(spark, landed, base, as_of=AS_OF)
    assert [r["source_name"] for r in records] == list(ingest.FEEDS)
    by_name = {r["source_name"]: (r["status"], r["error_message"]) for r in records}
    assert {n: s for n, (s, _) in by_name.items()} == {
        "registry": "OK_WITH_WARNINGS", "sdr": "OK_WITH_WARNINGS", "ntsb": "OK", "ads": "OK", "enforcement": "OK",
        "asrs": "OK_WITH_WARNINGS", "incursions": "OK", "strikes": "OK"}, by_name
    s = store.TableStore(spark, base)
    assert rows(s.production("sdr_aircraft_matches"), "CONFIDENCE") == [
        ("EXACT_N_NUMBER",), ("MODEL_ONLY",), ("NO_MATCH",), ("WEAK_TEXT_MATCH",)]
    assert rows(s.production("sdr_source_files"), "YEAR", "ROWS") == [("2019", 2), ("2020", 2), ("2021", 1)]
    events = s.production("ntsb").collect()
    assert len(events) == 1 and events[0]["CITY"] == "later wins"
    assert rows(s.production("ad_applicability"), "APPLICABILITY_CONFIDENCE") == [("STRUCTURED",)]
    assert rows(s.production("enforcement_actions"), "CATEGORY", "RECENT") == [
        ("maintenance", "yes"), ("operational", "no")]
    assert rows(s.production("enforcement_entities"), "ACTION_COUNT", "CERTIFICATE_ACTIONS", "CIVIL_PENALTY_COUNT") == [
        (2, 1, 1)]
    assert rows(s.production("asrs"), "THEMES", "DATE") == [("fatigue;stress;noise", "2024-01-01")]
    # undated incursions count, old and future ones do not; both columns survive the second merge
    assert rows(s.production("airport_risk"), "AIRPORT", "RUNWAY_INCURSIONS_5YR", "WILDLIFE_STRIKES_5YR") == [
        ("ABC", "2", "1"), ("DEF", "", "1")]
    assert rows(s.production("airport_wildlife_risk"), "AIRPORT", "DAMAGING_STRIKES_5YR") == [("ABC", "0"), ("DEF", "1")]
    before = {t: rows(s.production(t)) for t in ("sdr", "ntsb", "airport_risk", "registry")}
    ingest.run_ingest(spark, landed, base, as_of=AS_OF)
    assert {t: rows(s.production(t)) for t in before} == before
    assert store.read_health(spark, base).count() == 16


def test_interleaved_promotions_take_different_numbers(spark, tmp_path, table):
    base = str(tmp_path)
    one, two = store.TableStore(spark, base), store.TableStore(spark, base)
    first, second = (s.stage("src", "t", table("a", (v,))) for s, v in ((one, "first"), (two, "second")))
    number = two._next_run
    two._next_run = lambda: (number(), one.promote([first]))[0]  # the other run promotes after this one has looked
    two.promote([second])
    assert rows(one.promotions(), "run", "path") == [(1, first["path"]), (2, second["path"])]
    assert rows(one.production("t")) == [("second",)]


def test_concurrent_promotions_lose_none(spark, tmp_path, table):
    from concurrent.futures import ThreadPoolExecutor

    stores = [store.TableStore(spark, str(tmp_path)) for _ in range(4)]
    staged = [s.stage("src", f"t{i}", table("a", (str(i),))) for i, s in enumerate(stores)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda p: p[0].promote([p[1]]), zip(stores, staged)))
    assert rows(stores[0].promotions(), "run") == [(1,), (2,), (3,), (4,)]
    assert [rows(s.production(f"t{i}")) for i, s in enumerate(stores)] == [[(str(i),)] for i in range(4)]


def test_changed_columns_are_not_promoted(spark, tmp_path, table):
    base, state = str(tmp_path / "db"), {"df": table("A B", ("1", "2"))}
    loaders = {"x": lambda *_: ({"x": state["df"]}, "high", [])}
    run = lambda **k: ingest.run_feed(spark, "x", "", base, as_of=AS_OF, feeds_by_name=loaders, **k)
    assert run()["status"] == "OK"
    state["df"] = table("B A", ("3", "4"))
    assert run()["status"] == "SCHEMA_CHANGED"
    s = store.TableStore(spark, base)
    assert rows(s.production("x")) == [("1", "2")]
    assert run(accept_schema_change=True)["status"] == "OK"
    assert rows(s.production("x")) == [("3", "4")]


def test_isolation(spark, tmp_path):
    def broken(*_):
        raise RuntimeError("boom")

    records = ingest.run_ingest(
        spark, {"a": "", "b": "", "c": ""}, str(tmp_path / "db"), as_of=AS_OF,
        feeds_by_name={"a": broken, "b": lambda sp, *_: ({"t": sp.range(2)}, "high", [])})
    assert [(r["source_name"], r["status"]) for r in records] == [
        ("a", "SOURCE_UNAVAILABLE"), ("b", "OK"), ("c", "SOURCE_UNAVAILABLE")]


def test_schema_drift_is_ordered(spark):
    cur = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("new", ["q"])], "table string, columns array<string>")
    old = spark.createDataFrame([("a", ["y", "x"]), ("b", ["x"])], "table string, columns array<string>")
    assert rows(quality.table_schema_drift(cur, old), "table") == [("a",)]


def test_yearly_overwrite(spark, tmp_path, table):
    path = str(tmp_path / "years")
    tables.write_years(table("v SOURCE_YEAR", ("1", "2019"), ("2", "2020")), path)
    tables.write_years(table("v SOURCE_YEAR", ("3", "2020")), path)
    assert rows(spark.read.parquet(path).selectExpr("v", "cast(SOURCE_YEAR as string)")) == [("1", "2019"), ("3", "2020")]


def test_files_left_out_are_reported(spark, tmp_path):
    src = tmp_path / "in"
    write(src / "sdr/sdr_2019.csv", "SDR NO,DIFFICULTY DATE,MAKE,MODEL,REGISTRATION NUMBER\n1,2019-01-01,ACME,X,10A\n"
          ",2019-01-02,ACME,X,\n,2019-01-02,ACME,X,\n")
    write(src / "sdr/sdr_2020.csv", "what,is,this\n1,2,3\n")
    write(src / "sdr/sdr_2021.csv", "SDR NO,DIFFICULTY DATE,MAKE,MODEL\n")
    write(src / "ntsb/one.csv", "NTSB_NO,EV_DATE,REGIST_NO,MAKE,MODEL\nE1,2020-01-01,10a,ACME,X-20\n")
    write(src / "ntsb/odd.csv", "what,is,this\n1,2,3\n")
    write(src / "ntsb/broken.json", "{oops")
    base = str(tmp_path / "db")
    records = ingest.run_ingest(spark, {n: str(src / n) for n in ("sdr", "ntsb")}, base, as_of=AS_OF)
    got = {r["source_name"]: (r["status"], r["error_message"].split(" | ")) for r in records}
    assert got["sdr"][0] == got["ntsb"][0] == "OK_WITH_WARNINGS"
    assert got["sdr"][1][0].startswith("sdr_2020.csv: no column for DATE") and "sdr_2021.csv: no rows" in got["sdr"][1]
    assert got["ntsb"][1][0].startswith("odd.csv: no column for") and "broken.json: not readable as JSON" in got["ntsb"][1][1]
    s = store.TableStore(spark, base)
    assert s.production("ntsb").count() == 1
    reports = s.production("sdr_reports").select("REPORT_ID").collect()
    assert len(reports) == len({r[0] for r in reports}) == 3
    assert s.production("sdr_source_files").filter("PATH LIKE '%sdr_2020.csv'").count() == 1


def test_streamed_files_without_columns_are_quarantined(spark, tmp_path):
    from recordlens.streaming import jobs

    src, base = tmp_path / "in", str(tmp_path / "out")
    write(src / "good.csv", "DATE,MFR,MODEL\n2020-01-01,ACME,X\n")
    write(src / "odd.csv", "what,is,this\n1,2,3\n")
    fields = {"DATE": ["DATE"], "MFR": ["MFR"], "MODEL": ["MODEL"]}

    def run(columns):
        jobs.stream_ingest(spark, str(src), columns, ["DATE", "MFR", "MODEL"], base).awaitTermination()

    run(fields)
    assert jobs.ingested(spark, base).count() == 1
    refused = jobs.quarantined(spark, base).collect()
    assert len(refused) == 1 and refused[0]["path"].endswith("odd.csv") and "DATE" in refused[0]["reason"]
    # The same content under another name, now with a known layout: good.csv is known, odd.csv is not.
    write(src / "again.csv", (src / "good.csv").read_text())
    write(src / "odd2.csv", (src / "odd.csv").read_text())
    run({"DATE": ["WHAT"], "MFR": ["IS"], "MODEL": ["THIS"]})
    assert jobs.ingested(spark, base).count() == 2


def sums(batch, carry):
    """Running sum per key; the output is the sum after each batch."""
    from pyspark.sql import functions as F

    total = batch.groupBy("k").agg(F.sum("v").alias("n"))
    if carry is not None:
        total = total.unionByName(carry).groupBy("k").agg(F.sum("n").alias("n"))
    return total, total


def run_sums(spark, tmp_path, name, lines, compact=3):
    from recordlens.streaming.carry import start_with_carry

    write(tmp_path / "in" / name, "".join(lines))
    stream = spark.readStream.schema("k string, v int").json(str(tmp_path / "in"))
    start_with_carry(stream, sums, str(tmp_path / "out"), ["k"], compact=compact).awaitTermination()


def test_the_carry_is_a_log_of_touched_keys(spark, tmp_path):
    from recordlens.streaming.carry import last_carry

    (tmp_path / "in").mkdir()
    base, want = str(tmp_path / "out"), {}
    for i in range(8):
        rows = [(f"k{j}", 1) for j in range(100)] if i == 0 else [("k1", 10), (None, 1), (f"n{i}", i)]
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        run_sums(spark, tmp_path, f"f{i}.json", [f'{{"k": {"null" if k is None else chr(34) + k + chr(34)}, "v": {v}}}\n'
                                                 for k, v in rows])
        # What a batch writes follows the batch, not the number of keys so far.
        assert spark.read.parquet(f"{base}/carry/batch={i}").count() == len(rows)
        assert {r.k: r.n for r in last_carry(spark, base, ["k"]).collect()} == want
    assert sorted(p.name for p in (tmp_path / "out" / "carry").iterdir()) == ["batch=6", "batch=7"]
    assert [p.name for p in (tmp_path / "out" / "compact").iterdir()] == ["batch=5"]
    # A batch that is run again reads the same log and writes the same rows.
    out = sorted(map(tuple, spark.read.parquet(f"{base}/out/batch=7").collect()), key=str)
    (tmp_path / "out" / "checkpoint" / "commits" / "7").unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / ".7.crc").unlink(missing_ok=True)
    run_sums(spark, tmp_path, "g.json", ['{"k": "k1", "v": 5}\n'])
    assert sorted(map(tuple, spark.read.parquet(f"{base}/out/batch=7").collect()), key=str) == out
    assert {r.k: r.n for r in last_carry(spark, base, ["k"]).collect()} == {**want, "k1": want["k1"] + 5}


def test_a_lost_carry_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        run_sums(spark, tmp_path, f"{name}.json", ['{"k": "x", "v": 1}\n'])
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()) == [1, 2]
    (tmp_path / "out" / "carry" / "batch=1").rename(tmp_path / "aside")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_sums(spark, tmp_path, "c.json", ['{"k": "x", "v": 1}\n'])


def test_edits_of_the_last_minute(spark, tmp_path):
    import datetime

    from recordlens.session import stream_session
    from recordlens.streaming import jobs

    start, base = datetime.datetime(2024, 1, 1, 12), str(tmp_path / "out")
    # Across the border of a span, at the same time, exactly a minute apart, out of order, folders, no time.
    seconds = [570, 580, 590, 600, 640, 640, 650, 700, 760, 1199, 1201, 595]
    rows = [(i, start + datetime.timedelta(seconds=s), "change", "a/b") for i, s in enumerate(seconds)]
    rows += [(50, start + datetime.timedelta(seconds=600), "addDir", "a/b"), (51, None, "change", "a/b"),
             (52, start + datetime.timedelta(seconds=601), "change", None)]
    for part in (rows[:7], rows[7:], [(99, start + datetime.timedelta(hours=2), "change", "z")]):
        frame = spark.createDataFrame(part, "event_id long, timestamp timestamp, eventType string, filePath string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_session(spark).readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        jobs.stream_recent_edits(stream, base, watermark="20 minutes").awaitTermination()
    got = {r.event_id: (r.edits, r.thrashing) for r in spark.read.parquet(f"{base}/out").collect()}
    want = {i: sum(s - 60 < x <= s for x in seconds) for i, s in enumerate(seconds)} | {52: 1}
    assert got == {i: (n, n >= 3) for i, n in want.items()}


def test_part_files_of_a_csv_folder_are_one_source(spark, tmp_path):
    from recordlens.sources import ingest, store, tables as csv_tables

    base = f"file:{tmp_path}"
    report = spark.range(40).selectExpr(
        "string(id) `SDR No`", "'2019-01-01' `Difficulty Date`", "concat('N', id) `Registration Number`",
        "'Maker' `ACFT MAKE`", "'M1' `Model`")
    for name, part in (("sdr_2019", report), ("sdr_2020", report.toDF("a", "b", "c", "d", "e"))):
        csv_tables.csv_sink(part.repartition(4), part.columns, f"{base}/in/{name}.csv")
    assert len(list(tmp_path.glob("in/sdr_2019.csv/part-*"))) == 4
    ingest.run_ingest(spark, {"sdr": f"{base}/in"}, f"{base}/db", as_of="2024-06-01")
    health = store.read_health(spark, f"{base}/db").first()
    assert (health["status"], health["records_loaded"]) == ("OK_WITH_WARNINGS", "82")  # 40 reports twice, two files
    assert health["error_message"].startswith("sdr_2020.csv: no column for DATE, MFR, MODEL")


def test_files_of_one_layout_are_one_scan(spark, tmp_path):
    heads = ["DATE,MFR,MODEL", '"Difficulty Date", ACFT MAKE ,Model,SDR No', "Report Date,Make,Model\n", "A,B"]
    for i in range(40):
        head = heads[i % 4]
        body = "" if i == 37 else f"\n{head}\n2020-01-01,m{i},x,r{i}\n" if "No" in head else f"{head}\n2020-01-01,m{i},x\n"
        write(tmp_path / f"sdr+ {1990 + i}%.csv", body)
    write(tmp_path / "none_2050.csv", "")
    write(tmp_path / "sdr_2060.csv" / "part-0.csv", "DATE,MFR,MODEL\n2020-01-01,last,x\n")
    write(tmp_path / "sdr_2060.csv" / "part-1.csv", "")
    landed = ingest.landed_files(spark, str(tmp_path))  # Spark lists no empty files
    files = sorted(f"file:{p}" for p in tmp_path.rglob("*.csv") if p.is_file())
    assert set(landed) <= set(files) and len(landed) == len(files) - 3
    got, lineage, skipped = tables.yearly_files(spark, files, feeds.SDR_HEADERS, feeds.SDR_ESSENTIAL)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] csv") <= 2 * 3, plan  # rows with and without an id of each layout
    have = {(r.SOURCE_YEAR, r.MFR) for r in got.collect()}
    assert have == {(str(1990 + i), f"m{i}") for i in range(40) if i % 4 != 3 and i != 37} | {("2060", "last")}
    assert {r.REPORT_ID for r in got.collect() if r.MFR.startswith("m") and int(r.MFR[1:]) % 4 == 1} == {
        f"r{i}" for i in range(1, 40, 4) if i != 37}
    ids = [r.REPORT_ID for r in got.collect()]
    assert len(set(ids)) == len(ids)
    counted = {r.FILE: r.ROWS for r in lineage.collect()}
    assert len(counted) == 42 and sum(counted.values()) == len(ids) + 10  # ten files of A,B
    assert sorted(f for f, _ in skipped) == sorted(
        [f"sdr+ {1990 + i}%.csv" for i in range(40) if i % 4 == 3 or i == 37] + ["none_2050.csv"])


def test_a_hanging_feed_is_cancelled_alone(spark, tmp_path):
    import threading
    import time

    def hanging(spark, folder, store, as_of):
        return {"slow": spark.range(0, 10**15, 1, 4).selectExpr(
            "count_if(sha2(cast(id as string), 256) > 'a') AS n")}, "high", []

    def quick(spark, folder, store, as_of):
        return {"quick": spark.range(5)}, "high", []

    def broken(spark, folder, store, as_of):
        raise ingest.FeedProblem("ZERO_ROWS", "nothing")

    other = []
    beside = threading.Thread(target=lambda: other.append(spark.range(100).filter("id % 2 = 0").count()))
    began = time.monotonic()
    beside.start()
    records = ingest.run_ingest(spark, {"hanging": "", "quick": "", "broken": ""}, str(tmp_path / "db"), as_of=AS_OF,
                                feeds_by_name={"hanging": hanging, "broken": broken, "quick": quick}, seconds=8)
    beside.join()
    assert time.monotonic() - began < 60 and other == [50]
    assert [(r["source_name"], r["status"]) for r in records] == [
        ("hanging", "SOURCE_UNAVAILABLE"), ("broken", "ZERO_ROWS"), ("quick", "OK")]
    assert "within 8 s" in records[0]["error_message"]
    found = store.TableStore(spark, str(tmp_path / "db"))
    assert found.production("slow") is None and found.production("quick").count() == 5


def test_days_are_replaced_and_read_alone(spark, tmp_path):
    from pyspark.sql import functions as F

    from recordlens.operators import aggregates

    def probes(first, days):
        return spark.range(first, first + days * 12).select(
            (F.col("id") % 3).alias("source"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 2 * id)").alias("ts"),
            F.col("id").alias("event_id"), (F.col("id") % 5 > 0).alias("task_success"),
            F.when(F.col("id") % 4 > 0, F.concat(F.lit("h"), F.floor(F.col("id") / 50))).alias("schema_hash"))

    path = str(tmp_path / "days")
    store_days = lambda rows: aggregates.store_days(aggregates.daily_history(rows, ["ts", "event_id"]), path)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "days").glob("day=*/*.parquet")}
    store_days(probes(0, 60))
    before = files()
    store_days(probes(60 * 12, 1))  # a new day
    store_days(probes(59 * 12, 1))  # a day again
    after = files()
    assert {d for d in after if after[d] != before.get(d)} == {"day=2024-02-29", "day=2024-03-01"} and len(after) == 61
    daily = spark.read.schema(aggregates.DAY_SCHEMA).parquet(path)
    for as_of in ("2024-01-20", "2024-02-25", "2024-03-02"):
        got = aggregates.stats_of_days(daily, as_of=as_of)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan
        want = aggregates.history_stats(probes(0, 61), as_of=as_of)
        assert rows(got.drop("schema_changes_30d"), *want.columns) == rows(want)
