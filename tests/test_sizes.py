"""Ties, and plans that stay small as tables grow."""

import duckdb
from pyspark.sql import functions as F

from gaugeworks.operators import evaluate, explain, extract, quality, tolerance
from gaugeworks.plans import base
from gaugeworks.registry import QUERIES, SQL


def test_first_balloon_of_equal_places_is_the_first_row(spark, tmp_path):
    rows = ", ".join(f"(7, 1, {p}, {s})" for p, s in ((1, 30), (1, 10), (1, 20), (2, 5), (2, 9)))
    db = duckdb.connect()
    db.sql(f"copy (select l_orderkey::bigint as l_orderkey, l_linenumber, l_partkey::bigint as l_partkey, l_suppkey::bigint as l_suppkey from (values {rows}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey)) to '{tmp_path}/lineitem.parquet'")
    db.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet'")
    got = sorted(tuple(r) for r in QUERIES["j3_first_balloon"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(SQL["j3_first_balloon"]).fetchall()) == [(1, 30), (2, 5)]


def cells_of(spark):
    chars = spark.createDataFrame([(1, 2, 2, True, "open", 1.0, 3.0), (1, 3, 3, True, "open", None, None), (1, 4, 4, True, "rejected", 1.0, 3.0), (9, 5, 5, True, "open", 1.0, 3.0)], "project_id long, char_id long, pos long, inspect boolean, status string, lower_limit double, upper_limit double")
    samples = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "project_id long, sample_id long, pos int")
    # a cell with two results, one of a rejected characteristic, one of a sample that is not known
    results = spark.createDataFrame([(1, 10, 2, 2.0, None), (1, 10, 2, 9.0, None), (1, 11, 3, 5.0, None), (1, 11, 4, 2.0, None), (1, 77, 3, None, "ok")], "project_id long, sample_id long, char_id long, value double, attribute string")
    return chars, samples, results


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_grid_is_made_in_rows_that_project_dealt(spark):
    got = evaluate.grid(*cells_of(spark))
    rows = sorted((tuple(r) for r in got.select("char_id", "sample_id", "sample_pos", "verdict").collect()), key=str)
    assert rows == [(2, 10, 1, "fail"), (2, 10, 1, "pass"), (2, 11, 2, "missing"), (3, 10, 1, "missing"), (3, 11, 2, "not_evaluated")]
    assert exchanges(got) and not any("sample_id" in e.split("]")[0] or "char_id" in e.split(")")[0] for e in exchanges(got))


def test_state_is_dealt_by_project_once(spark):
    got = evaluate.measurement_state(*cells_of(spark))
    assert len(exchanges(got)) == 1
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [
        ("characteristic", 1, 2, 1, 1, 0, 0, "fail"), ("characteristic", 1, 3, 1, 0, 1, 0, "open"), ("project", 1, -1, 2, 1, 1, 0, "fail"), ("project", 2, -1, 0, 0, 0, 0, "open"),
        ("sample", 1, 10, 1, 1, 0, 0, "fail"), ("sample", 1, 11, 0, 0, 1, 1, "open"), ("sample", 2, 12, 0, 0, 0, 0, "open"),
    ]


def test_report_reads_the_state_once(spark):
    state = evaluate.measurement_state(*cells_of(spark))
    info = spark.createDataFrame([(1, "p", "", "c", None), (3, "p", "r", "c", "i")], "project_id long, part_number string, report_number string, company_name string, inspected_by string")
    marks = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "project_id long, char_id long")
    got = quality.report_checks(state, info, marks(2, 2, 4), marks(3, 2))
    rows = sorted(tuple(r) for r in got.select("project_id", "samples", "rows", "missing_values", "not_evaluated", "draft_rows", "changed_rows").collect())
    assert rows == [(1, 2, 2, 0, 1, 1, 2), (3, 0, 0, 0, 0, 0, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n_samples#") and plan.count("Window [") == 2


def test_sorts_by_project_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(base, "SORTED", 100, raising=False)
    for name in ("n12_display_numbers", "n13_preview"):
        dealt = exchanges(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert len(dealt) == 1 and ", 60)" in dealt[0]  # 6,000 lines, all windows in one dealing


def test_prose_is_known_without_being_read(spark, monkeypatch):
    texts = ["see drawing with books", "brown ox", "bow ⌀× 1,5 back wing", "a⌀×", "Ø30 H7/g6", "M8x1.25-6H6g", "10 ZB7/zb6", "10 ZB7/zb6 K", "THRU ALL DEEP TYP PLACES " * 9, "ÄÖÜßé 12", "4X Ø6 THRU\nTYP", "", "Größe über 12 mm " * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, requirement_text string")
    known = rows.select(F.col("requirement_text").rlike(extract._PROSE)).collect()
    assert [r[0] for r in known] == [True, False, True, False, False, False, False, True, False, True, False, False, True]
    read = lambda: sorted(tuple(map(str, r)) for r in extract.callouts(rows).collect())
    short = read()
    monkeypatch.setattr(extract, "_PROSE", "^\u0002$")
    assert short == read()


def test_sentences_are_made_of_distinct_texts(spark):
    rows = spark.createDataFrame([(1, "12"), (2, "12"), (3, None), (4, "(5)")], "k long, requirement_text string")
    cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)
    got = explain.explained_once(rows, cells)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    whole = explain.explained(explain.derivations(extract.callouts(rows), cells)).select("k", "explanation")
    assert sorted(map(tuple, got.select("k", "explanation").collect())) == sorted(map(tuple, whole.collect()))



def test_issues_meet_samples_once(spark, monkeypatch):
    chars, samples, _ = cells_of(spark)
    results = spark.createDataFrame([(1, 11, 2, 1), (1, 77, 2, 2), (1, 10, 3, 3), (1, 10, 99, 4), (2, 12, 5, 1), (2, 12, 5, 2)], "project_id long, sample_id long, char_id long, pos long")
    for tasks in (None, 3):
        got = quality.measurement_issues(samples, chars, results, tasks)
        assert sorted(tuple(r) for r in got.collect()) == [(1, "results_not_sorted"), (1, "unknown_characteristic"), (1, "unknown_sample"), (2, "duplicate_result"), (2, "unknown_characteristic")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    monkeypatch.setattr(base, "SORTED", 100)
    plan = QUERIES["c2_measurement_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all(int(e.rsplit(")", 1)[0].split(",")[-1].split(")")[0]) > 8 for e in plan.splitlines() if "Exchange hashpartitioning" in e and "REPARTITION_BY_NUM" in e)
