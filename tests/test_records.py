"""Small cases of lists, folds, edits and texts."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from gaugeworks.functions import exprs as X
from gaugeworks.functions.folds import folded
from gaugeworks.operators import evaluate, extract, history, lists, numbering, report
from gaugeworks.sources import projects

CHANGE = "project_id long, seq long, kind string, entity long, index int, before array<bigint>, after array<bigint>"


def test_fold_keeps_state_over_batches(spark):
    rows = [(g, i, float((i * 7919) % 13)) for g in range(3) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def step(s, v):
        total = (s or 0.0) + v
        return total, (total,)

    try:
        got = {(r["g"], r["i"]): r["total"] for r in folded(df, ["g"], ["i"], ["v"], step, "total double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        total = 0.0
        for i in range(500):
            total += float((i * 7919) % 13)
            assert got[g, i] == total
    assert folded(df.limit(0), ["g"], ["i"], ["v"], step, "total double").collect() == []


def test_reading_lines_against_a_plain_fold(spark):
    rnd = random.Random(3)
    points = [(rnd.randrange(4), float(rnd.randrange(40)), float(rnd.randrange(60)), i) for i in range(400)]
    got = {r["item"]: (r["line"], r["rank"]) for r in numbering.reading_order(spark.createDataFrame(points, "g int, x double, y double, item long"), ["g"], 7.0).collect()}
    for g in range(4):
        lines = []
        for _, x, y, i in sorted((p for p in points if p[0] == g), key=lambda p: (p[2], p[1], p[3])):
            if not lines or y > lines[-1][0] + 7.0:
                lines.append((y, []))
            lines[-1][1].append((x, y, i))
        want = [(i, n) for n, (_, members) in enumerate(lines) for _, _, i in sorted(members)]
        assert all(got[i] == (n, rank) for rank, (i, n) in enumerate(want))


def test_list_order_follows_the_log(spark):
    start = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 0), (4, 40, 0)], "project_id long, entity long, pos int")
    log = [
        (1, 1, "inserted", 12, 1, None, None), (1, 2, "ordered", None, None, [10, 12, 11], [11, 10, 12]), (1, 3, "removed", 10, 1, None, None), (2, 1, "removed", 21, 0, None, None),
        (3, 1, "inserted", 30, 0, None, None), (3, 2, "inserted", 31, 1, None, None), (4, 1, "ordered", None, None, [40], [40, 41]),
    ]
    got = sorted(map(tuple, lists.current_order(start, spark.createDataFrame(log, CHANGE)).collect()), key=str)
    assert got == [(1, 11, 0, True), (1, 12, 1, True), (2, None, None, False), (3, 30, 0, True), (3, 31, 1, True), (4, None, None, False)]


def test_undone_creation(spark):
    rows = [(1, 5, 1, 0, None, "a", "command"), (1, 5, 2, 0, "a", None, "undo"), (1, 5, 3, 0, None, "a", "redo")]
    got = history.entity_history(spark.createDataFrame(rows, "project_id int, e int, entry_no int, change_no int, before string, after string, action string"), "e").orderBy("entry_no").collect()
    assert [r["created"] for r in got] == [True, True, True]


def test_reasons_are_of_the_domain(spark):
    edits = spark.createDataFrame([(1, "quantity", "0"), (1, "date", "2024-02-30"), (1, "serial", None), (1, "rotation", "91"), (2, "serial", "x"), (1, "quantity", "3")], "entity long, field string, value string")
    got = [r["reason"] for r in history.refused_edits(edits, spark.createDataFrame([(1,), (1,)], "entity long")).orderBy("entity", "field", "value").collect()]
    assert got == ["invalid_date", "zero_quantity", None, "invalid_sheet_setting", "empty_serial", "unknown_characteristic"]
    assert {r for r in got if r} <= set(X.REASONS)


def test_numbers_of_too_many_places(spark):
    df = spark.createDataFrame([("1.123456789012345",), ("1.120000000000000",), ("12345678901234567890",)], "t string")
    assert [r[0] for r in df.select(X.strict_decimal(F.col("t"))).collect()] == [None, D("1.12"), None]


def test_letters_and_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 702, 703)], "n int")
    assert [r[0] for r in df.select(X.letters(F.col("n"))).collect()] == ["", "A", "Z", "AA", "ZZ", "AAA"]
    texts = ["12", "12.3", "7A", "7.1AB"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.number_text(X.number_parts(F.col("t")))).collect()] == texts


def test_zone_order_without_a_grid(spark):
    row = spark.range(1).select(numbering.zone_order(F.lit(0), F.lit(0), F.lit(0), F.lit(6), F.lit(0)), numbering.zone_order(F.lit(1), F.lit(2), F.lit(8), F.lit(6), F.lit(90))).first()
    assert tuple(row) == (0, 1 * 6 + 3)


def test_blocks_of_a_project_without_samples(spark):
    columns = spark.createDataFrame([(1, 0, i) for i in range(1, 6)], "project_id int, block int, index int")
    got = report.column_blocks(columns, spark.createDataFrame([(1,), (2,)], "project_id int")).orderBy("project_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 5), (2, 0, 0, 0)]


def test_rows_open_or_failed(spark):
    state = spark.createDataFrame([("characteristic", 1, 0, "fail"), ("characteristic", 2, 1, "open"), ("characteristic", 3, 1, "fail"), ("project", 4, 1, "fail")], "grain string, key int, missing int, verdict string")
    keys = lambda **k: sorted(r["key"] for r in evaluate.rows_open_or_failed(state, **k).collect())
    assert (keys(), keys(missing=True), keys(failed=True), keys(missing=True, failed=True)) == ([1, 2, 3], [2, 3], [1, 3], [3])


def test_exported_list(spark, tmp_path):
    have = {c: None for c in projects.EXPORT} | {"number": "2", "comment": 'a, "b"', "classification": "none", "status": "accepted", "inspect": True}
    rows = [{"project_id": 1, "pos": 0, **have}, {"project_id": 1, "pos": 1, **have, "number": "1.2"}, {"project_id": 1, "pos": 2, **have, "status": "rejected"}]
    schema = "project_id int, pos int, " + ", ".join(f"{c} {'boolean' if c == 'inspect' else 'string'}" for c in projects.EXPORT)
    projects.write_export(spark.createDataFrame(rows, schema), str(tmp_path / "out"), "de")
    lines = [line for f in (tmp_path / "out").glob("project_id=1/*.csv") for line in f.read_text().splitlines()]
    assert lines[0].startswith("Nr,Art,Anforderung,Nennmaß") and lines[0].count(",") == 20
    assert lines[1].startswith("1.2,,") and lines[2].startswith("2,,") and len(lines) == 3 and '""' not in lines[1].replace('\\"', "")


def test_commands_are_refused_with_the_first_reason(spark):
    columns = "project_id int, command_id int, type string, ids array<int>, what string, before int, x double, y double, size double, field string, value string, n int"
    inf, nan = float("inf"), float("nan")
    cases = [
        ("undo", {}, "nothing_to_undo"), ("redo", {}, "nothing_to_redo"), ("update_fields", {"ids": [1, 9], "what": "characteristic"}, "unknown_characteristic"), ("move_balloons", {"ids": [9], "what": "balloon", "x": nan, "y": 1.0}, "unknown_balloon"), ("update_sheet", {"ids": [9], "what": "sheet"}, "unknown_sheet"),
        ("update_sample", {"ids": [9], "what": "sample"}, "unknown_sample"), ("set_image_edit", {"ids": [9], "what": "revision"}, "unknown_revision"), ("renumber", {}, "numbering_locked"), ("move_samples", {"ids": [1, 2], "what": "sample", "before": 2}, "invalid_move_target"), ("move_balloons", {"ids": [1], "what": "balloon", "x": inf, "y": 1.0}, "invalid_geometry"),
        ("restyle_balloons", {"size": 0.0}, "invalid_style"), ("set_image_edit", {"ids": [1], "what": "revision", "value": "1"}, "not_an_image"), ("set_image_edit", {"ids": [2], "what": "revision", "value": "46"}, "invalid_image_edit"), ("set_image_edit", {"ids": [2], "what": "revision", "value": "-45"}, None),
        ("update_sheet", {"ids": [1], "what": "sheet", "field": "unit", "value": "deg"}, "invalid_sheet_setting"), ("update_settings", {"field": "places", "value": "11"}, "invalid_project_setting"), ("update_settings", {"field": "custom_table", "value": "t2"}, "missing_table"), ("update_settings", {"field": "custom_table", "value": "t1"}, None),
        ("update_fields", {"ids": [1], "what": "characteristic", "field": "quantity", "value": "0"}, "zero_quantity"), ("update_sample", {"ids": [1], "what": "sample", "field": "date", "value": "2024-02-30"}, "invalid_date"), ("update_sample", {"ids": [1], "what": "sample", "field": "serial", "value": " "}, "empty_serial"),
        ("update_sample", {"ids": [1], "what": "sample", "field": "serial", "value": "B"}, "duplicate_serial"), ("update_sample", {"ids": [2], "what": "sample", "field": "serial", "value": "B"}, None), ("add_samples", {"n": 101}, "invalid_sample_count"), ("add_samples", {"n": 100}, "too_many_samples"), ("add_samples", {"n": 99}, None),
        ("set_result", {"value": "1e3"}, "invalid_result"), ("set_result", {"value": "ok"}, None), ("set_result_type", {"ids": [1], "what": "characteristic", "value": "attribute"}, "result_type_conflict"), ("set_result_type", {"ids": [1], "what": "characteristic", "value": "variable"}, None),
    ]
    names = [c.split()[0] for c in columns.split(", ")]
    commands = spark.createDataFrame([tuple({"project_id": 1, "command_id": i, "type": t, **of}.get(c) for c in names) for i, (t, of, _) in enumerate(cases)], columns)
    entities = spark.createDataFrame(
        [(1, "characteristic", 1, None, "auto", 2, 0, None), (1, "balloon", 1, None, None, None, None, None), (1, "sheet", 1, None, None, None, None, None), (1, "sample", 1, None, None, None, None, "A"), (1, "sample", 2, None, None, None, None, "B"), (1, "revision", 1, False, None, None, None, None), (1, "revision", 2, True, None, None, None, None)],
        "project_id int, what string, id int, is_image boolean, result_type string, n_variable int, n_attribute int, serial string",
    )
    projects_ = spark.createDataFrame([(1, True, 401, 0, 0, ["t1"])], "project_id int, locked boolean, n_samples int, n_undo int, n_redo int, tables array<string>")
    got = {r["command_id"]: r["reason"] for r in history.refused_commands(commands, entities, projects_).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    assert {r for r in got.values() if r} | {"internal"} == set(X.REASONS)


def test_preview_of_locked_numbers(spark):
    rows = spark.createDataFrame([(1, "1", "2"), (1, "2", "2"), (2, "1", "1")], "project_id int, old_number string, number string")
    got = numbering.preview(rows, locked=spark.createDataFrame([(2,), (3,)], "project_id int"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, None), (2, None, None, "numbering_locked")}


def test_accepted_features(spark):
    rows = spark.createDataFrame([(1, 3, 0.0, 10.0), (1, 101, 0.0, 10.0), (1, 0, 0.0, 10.0), (2, 3, 0.0, 10.0), (9, None, None, None)], "project_id int, quantity int, place_x double, place_y double")
    settings = spark.createDataFrame([(1, "sub_number", None, 10.0), (2, "sub_number", True, 10.0)], "project_id int, multi_instance string, locked boolean, size_mm double")
    got = sorted((tuple(r) for r in numbering.accepted(rows, settings).collect()), key=str)
    assert got == sorted([(1, 1, 0.0, 10.0, 1, None), (1, 1, 0.0, 44.0, 2, None), (1, 1, 0.0, 78.0, 3, None), (1, 101, 0.0, 10.0, 1, None), (1, 0, 0.0, 10.0, 1, "zero_quantity"), (2, 3, 0.0, 10.0, 1, None), (9, 1, None, None, 1, None)], key=str)


def test_fonts_of_a_sheet(spark):
    rows = spark.createDataFrame([(1, "ABCDEF+Arial", True), (1, "Arial", False), (1, "Abcdef+X", False), (1, None, None), (2, "Arial", False)], "sheet_id int, font string, embedded boolean")
    assert {tuple(r) for r in extract.sheet_fonts(rows).collect()} == {(1, "Arial", True, 2), (1, "Abcdef+X", False, 1), (2, "Arial", False, 1)}
