"""Small cases of single rules."""

from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import exprs as X
from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import evaluate, extract, history, numbering, report, tolerance
from gaugeworks.sources import projects
from gaugeworks.streaming import live


def values(df):
    return [tuple(r) for r in df.collect()]


def test_verdicts(spark):
    rows = [(D("10.2"), None, D("9.8"), D("10.2")), (D("10.201"), None, D("9.8"), D("10.2")), (D("9.8"), None, D("9.8"), None), (D("5"), None, None, None), (None, "ok", D("1"), D("2")), (None, "not_ok", None, None), (None, None, D("1"), D("2")), (D("12.000"), None, D("12"), D("12"))]
    df = spark.createDataFrame(rows, f"v {DEC}, a string, lo {DEC}, hi {DEC}")
    got = values(df.select(X.verdict(F.col("v"), F.col("a"), F.col("lo"), F.col("hi")), X.limit_position(F.col("v"), F.col("lo"), F.col("hi"))))
    assert got == [("pass", "on_upper"), ("fail", "above"), ("pass", "on_lower"), ("not_evaluated", None), ("pass", None), ("fail", None), ("missing", None), ("pass", "on_lower")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50), st.integers(0, 30)), min_size=1, max_size=200))
def test_verdict_agrees_with_position(spark, cases):
    df = spark.createDataFrame([(D(v), D(lo), D(lo + w)) for v, lo, w in cases], f"v {DEC}, lo {DEC}, hi {DEC}")
    got = values(df.select("v", "lo", "hi", X.verdict(F.col("v"), F.lit(None), F.col("lo"), F.col("hi")), X.limit_position(F.col("v"), F.col("lo"), F.col("hi"))))
    for v, lo, hi, verdict, position in got:
        assert (verdict == "pass") == (lo <= v <= hi) == (position in ("on_lower", "inside", "on_upper"))


@pytest.mark.parametrize(("text", "value", "attribute", "ok"), [("1,50", D("1.50"), None, True), ("−.5", D("-0.5"), None, True), ("+1", None, None, False), ("1e3", None, None, False), ("1.000,5", None, None, False), (" OK ", None, "ok", True), ("n.i.o.", None, "not_ok", True), ("", None, None, True)])
def test_typed_results(spark, text, value, attribute, ok):
    got = spark.createDataFrame([(text,)], "t string").select(X.parsed_result(F.col("t")).alias("p")).select("p.value", "p.attribute", "p.ok").first()
    assert tuple(got) == (value, attribute, ok)


def test_numbers_sort(spark):
    texts = ["13", "12.2", "12.1A", "12", "12A", "12.1", "12AA"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", X.number_parts(F.col("t"))).orderBy("n")
    assert [r["t"] for r in df.collect()] == ["12", "12A", "12AA", "12.1", "12.1A", "12.2", "13"]


def test_anchored_lines(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1), (1, 0.0, 5.0, 2), (1, 0.0, 9.0, 3)], "g int, x double, y double, item long")
    got = {r["item"]: r["line"] for r in numbering.reading_order(df, ["g"], 7.0).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_scalars(spark):
    row = spark.createDataFrame([("-1.50", "1234567890123456", "2024-02-30", "2024-02-29")], "a string, b string, c string, d string")
    got = row.select(X.strict_decimal(F.col("a")), X.written_scale(F.col("a")), X.spreadsheet_number(F.col("b")), X.signed(F.lit("0.2")), X.signed(F.lit("-0.0")), X.localized(F.lit("1.5")), X.date_ok(F.col("c")), X.date_ok(F.col("d")), X.date_ok(F.lit(""))).first()
    assert tuple(got)[:6] == (D("-1.5"), 2, None, "+0.2", "0.0", "1,5") and not got[6] and got[7] and got[8]
    assert row.select(X.in_box(F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(0.5), F.lit(45.0))).first()[0]
    assert row.select(X.projected(F.array(*[F.lit(float(v)) for v in (1, 0, 5, 0, 1, 0, 0, 0, 1)]), F.lit(1.0), F.lit(2.0)).alias("q")).first()["q"] == (6.0, 2.0)


def test_range_lookup_bounds(spark):
    cells = tolerance.table_cells(spark, tolerance.GENERAL)
    sizes = [("0.49", "out_of_range"), ("0.5", "value"), ("3", "value"), ("3.001", "value"), ("4000", "value"), ("4000.1", "out_of_range"), ("0", "out_of_range"), ("-1", "out_of_range")]
    df = spark.createDataFrame([("iso-2768-1", "linear", "m", D(s)) for s, _ in sizes], f"table_id string, part_id string, column string, size {DEC}")
    assert {str(r["size"].normalize()): r["c_found"] for r in tolerance.looked_up(df, cells, "c").collect()} == {str(D(s).normalize()): f for s, f in sizes}
    odd = spark.createDataFrame([("iso-2768-1", "linear", "v", D(2)), ("iso-2768-1", "linear", "q", D(2)), ("iso-2768-1", "none", "m", D(2))], f"table_id string, part_id string, column string, size {DEC}")
    assert {r["column"]: r["c_found"] for r in tolerance.looked_up(odd, cells, "c").collect()} == {"v": "not_defined", "q": "unknown_column", "m": "no_such_part"}


def test_general_angle_and_tables(spark):
    cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)
    df = spark.createDataFrame([("angle", D(30), D(20)), ("angle", D(30), None)], f"kind string, nominal {DEC}, shorter_leg {DEC}")
    assert [r["tolerance"] for r in tolerance.general_tolerance(df, cells).orderBy("shorter_leg").collect()] == [None, D("0.5")]
    assert tolerance.table_issues(cells).count() == 0
    bad = {"table": tolerance.GENERAL["table"], "part": [{"id": "x", "kind": "symmetric", "columns": ["m"], "rows": [{"max_inclusive": "3", "values": ["-1"]}, {"min_exclusive": "4", "max_inclusive": "5", "values": ["1"]}, {"min_inclusive": "5", "values": ["1"]}]}]}
    assert {(r["row_no"], r["reason"]) for r in tolerance.table_issues(tolerance.table_cells(spark, bad)).collect()} == {(0, "negative_value"), (1, "not_contiguous"), (2, "bound_not_in_one_row")}
    assert {r["table_id"]: r["classes"] for r in tolerance.catalogue(cells).collect()} == {"iso-2768-1": ["f", "m", "c", "v"], "iso-286": None}


def test_fits_and_conversion(spark):
    cells = tolerance.table_cells(spark, tolerance.FITS)
    want = {("H7", 25): ("0.021", "0"), ("g6", 25): ("-0.007", "-0.020"), ("js6", 8): ("0.0045", "-0.0045"), ("P7", 25): ("-0.014", "-0.035"), ("N7", 10): ("-0.004", "-0.019"), ("h7/g6", 5): (None, None), ("H99", 5): (None, None)}
    df = spark.createDataFrame([(f, D(n)) for f, n in want], f"fit string, nominal {DEC}")
    for r in tolerance.expanded_fits(df, cells).collect():
        up, low = want[(r["fit"], int(r["nominal"]))]
        assert (r["fit_upper"], r["fit_lower"]) == (D(up) if up else None, D(low) if low else None), r["fit"]
    got = spark.createDataFrame([(D("1.00007"),)], f"v {DEC}").select(*[tolerance.converted(F.col("v"), 3, h) for h in ("upper", "lower", "nominal")]).first()
    assert tuple(got) == (D("25.401"), D("25.402"), D("25.402"))


@pytest.mark.parametrize(("text", "want"), [("2x 30°", (1, "note_or_other", None)), ("4X Ø6,5", (4, "diameter", None)), ("20 +0,2 -0,1", (1, "linear", "deviations")), ("10 MIN", (1, "linear", "min")), ("9.8/10.2", (1, "linear", "limits")), ("[25]", (1, "linear", None)), ("(12) ", (1, "linear", None)), ("see note", (1, "note", None)), ("##", (1, "other", None)), (".5\"", (1, "linear", None))])
def test_callouts(spark, text, want):
    r = extract.callouts(spark.createDataFrame([(text,)], "requirement_text string")).first()
    if want[1] != "note_or_other":
        assert (r["quantity"], r["kind"], r["tol_kind"]) == want
    else:
        assert r["quantity"] == 1


def test_locked_numbers_and_moves(spark):
    present = spark.createDataFrame([(1, "1"), (1, "2.1"), (1, "3A")], "project_id int, number string")
    given_ = spark.createDataFrame([(1, "9")], "project_id int, number string")
    ins = spark.createDataFrame([(1, 1, 1, "next_free", None), (1, 2, 2, "next_free", None), (1, 3, 3, "sub_number", "2"), (1, 4, 4, "letter_suffix", "3")], "project_id int, item int, seq int, policy string, anchor string")
    assert {r["item"]: r["number"] for r in numbering.locked_inserts(present, given_, ins).collect()} == {1: "10", 2: "11", 3: "2.2", 4: "3B"}
    rows = spark.createDataFrame([(1, i, i, i in (1, 4), i == 3) for i in range(1, 6)], "project_id int, item int, pos int, m boolean, t boolean")
    assert [r["item"] for r in numbering.moved_before(rows, "m", "t").orderBy("pos").collect()] == [2, 1, 4, 3, 5]
    assert spark.createDataFrame([(1, 3)], "project_id int, quantity int").transform(numbering.split_quantity).count() == 3


def test_points_and_strategies(spark):
    chars = spark.createDataFrame([(1, 1, None), (1, 2, [("s", 5.0, 6.0)])], "project_id int, char_id int, sources array<struct<sheet_id: string, cx: double, cy: double>>")
    balls = spark.createDataFrame([(1, 1, 2, "s", 9.0, 9.0), (1, 1, 1, "s", 1.0, 2.0)], "project_id int, char_id int, pos int, sheet_id string, anchor_x double, anchor_y double")
    assert {r["char_id"]: (r["x"], r["y"]) for r in numbering.reference_points(chars, balls).collect()} == {1: (1.0, 2.0), 2: (5.0, 6.0)}
    pts = spark.createDataFrame([(1, 1, 1, "note", 1, 0.0, -1.0, 0), (1, 2, 2, "linear", 1, 1.0, 0.0, 0), (1, 3, 3, "linear", None, None, None, 0)], "project_id int, item long, pos int, kind string, ordinal int, x double, y double, zone_rank int").withColumn("centre_x", F.lit(0.0)).withColumn("centre_y", F.lit(0.0))
    order = lambda s: [r["item"] for r in numbering.strategy_order(pts, s).orderBy("order").collect()]
    assert order("kind") == [2, 1, 3] and order("clockwise") == [1, 2, 3] and order("manual") == [1, 2, 3] and order("zone") == [1, 2, 3]
    shown = spark.range(1).select(numbering.shown_point(F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(20.0), F.lit(90)).alias("p")).first()["p"]
    assert shown == (18.0, 1.0)


def test_history(spark):
    audit = spark.createDataFrame([(1, 1, [("a", None, "1")]), (1, 2, [("a", "1", "2"), ("b", None, "5")]), (2, 1, [("c", None, "1")]), (2, 2, [("c", "9", "2")])], "project_id int, entry_no int, changes array<struct<entity: string, before: string, after: string>>")
    audit = audit.withColumn("timestamp", F.timestamp_seconds("entry_no")).withColumn("user", F.lit("u"))
    ch = history.exploded(audit)
    assert {r["project_id"]: r["broken"] for r in history.broken_projects(ch, "entity").collect()} == {1: False, 2: True}
    snap = spark.createDataFrame([(1, "z", "7")], "project_id int, entity string, after string")
    assert {(r["entity"], r["after"]) for r in history.current_state(snap, ch.where("project_id = 1"), "entity").collect()} == {("a", "2"), ("b", "5"), ("z", "7")}
    assert history.entity_history(ch, "entity").where("created").count() == 3
    diff = history.changed_fields(spark.sql("select struct(1 a, 2 b) before, struct(1 a, 3 b) after"), ["a", "b"]).first()["fields"]
    assert diff == ["b"]


def test_reports(spark):
    got = report.header_filled(spark.createDataFrame([(1, " ", None, "kim", "a" * 64)], "project_id int, date string, company string, inspector string, sha string"), "2024-01-01", "acme", "x").first()
    assert tuple(got) == (1, "2024-01-01", "acme", "kim", "a" * 16)
    assert report.check_sheet(spark.createDataFrame([(1, 1)], "project_id int, char_id int"), 99).count() == 10


def test_sources(spark, tmp_path):
    docs = ['{"schema_version": 1, "id": "p1", "characteristics": [{"id": "c1", "number": "1", "upper_limit": "2", "inspect": true}, {"id": "c2", "number": "2", "status": "rejected"}]}', '{"schema_version": 4, "id": "p2", "characteristics": [], "numbering": {"strategy": "zone"}}', '{"schema_version": 9, "id": "p9"}']
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(d)
    good, refused = projects.read_projects(spark, str(tmp_path))
    assert [tuple(r) for r in refused.collect()] == [("p9", 9, "newer_version")]
    chars = projects.part_table(good, "characteristics")
    assert {(r["id"], r["pos"], r["derivation"] and r["derivation"]["rule"], r["result_type"]) for r in chars.collect()} == {("c1", 0, "manual", "auto"), ("c2", 1, None, "auto")}
    projects.write_list(chars, str(tmp_path / "list"))
    assert spark.read.option("header", True).csv(str(tmp_path / "list")).count() == 1
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"entry_no": 1, "user": "u", "changes": []}\n{"entry_no": 2, "us')
    assert projects.read_audit(spark, str(tmp_path / "log")).count() == 1


def test_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    src = str(tmp_path / "in")
    spark.read.parquet(path).repartition(3).write.parquet(src)
    for name, df, mode in (("latest_q", live.latest(live.event_stream(spark, src).select("user_id", "event_id", "value"), ["user_id"], "event_id"), "complete"), ("activity_q", live.activity(live.event_stream(spark, src), late="3650 days").drop("window"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    events = spark.read.parquet(path)
    want = {r[0]: r[1] for r in events.groupBy("user_id").agg(F.max("event_id")).collect()}
    assert {r["user_id"]: r["event_id"] for r in spark.table("latest_q").collect()} == want
    assert spark.table("activity_q").agg(F.sum("n")).first()[0] == events.count()


def test_orphans_and_conflicts(spark):
    res = spark.createDataFrame([(1, 1, 1), (1, 2, 9), (1, 8, 1)], "project_id int, sample_id int, char_id int")
    chars, samples = spark.createDataFrame([(1, 1)], "project_id int, char_id int"), spark.createDataFrame([(1, 1), (1, 2)], "project_id int, sample_id int")
    assert sorted(r["reason"] for r in evaluate.orphans(res, chars, samples).collect()) == ["unknown_characteristic", "unknown_sample"]


def test_whole_grid(spark):
    cells = spark.createDataFrame([(1, 10, 2, "pass"), (1, 17, 2, "fail")], "project_id int, sample_id int, char_id int, verdict string")
    columns = spark.createDataFrame([(1, 10 + i, i + 1, i // 6) for i in range(8)], "project_id int, sample_id int, index int, block int")
    chars = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "project_id int, char_id int")
    none, m = (None,) * 6, "missing"
    want = [(1, 2, 0, "pass", m, m, m, m, m), (1, 2, 1, m, "fail", None, None, None, None), (1, 3, 0, m, m, m, m, m, m), (1, 3, 1, m, m, None, None, None, None), (4, 5, 0, *none)]
    assert sorted(values(report.whole_grid(cells, columns, chars)), key=lambda r: r[:3]) == want


def test_first_change_fits_the_snapshot(spark):
    rows = [(1, "a", 1, "7", "8"), (1, "a", 2, "8", None), (2, "a", 1, "6", "8"), (3, "a", 1, None, "8"), (4, "b", 1, None, "1"), (5, "b", 1, "0", "1")]
    ch = spark.createDataFrame(rows, "project_id int, entity string, seq int, before string, after string")
    snap = spark.createDataFrame([(1, "a", "7"), (2, "a", "7"), (3, "a", "7")], "project_id int, entity string, after string")
    assert {r["project_id"]: r["broken"] for r in history.broken_projects(ch, "entity", snap).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert {r["project_id"]: r["broken"] for r in history.broken_projects(ch, "entity").collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
