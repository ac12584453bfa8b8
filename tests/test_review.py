"""Regions, maps and sentences against plain geometry and written-out texts."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import evaluate, explain, maps, regions, revise, tolerance

BOX = "sheet_id int, id long, cx double, cy double, w double, h double, angle double"


def corners(cx, cy, w, h, angle):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [(cx + i * c * w / 2 + j * s * h / 2, cy - i * s * w / 2 + j * c * h / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def clipped(a, b):
    """Area of the corners of b cut along the edges of a, one edge after the other."""
    points, edges = corners(*b), corners(*a)
    for p, q in zip(edges, edges[1:] + edges[:1]):
        side = lambda c: (q[0] - p[0]) * (c[1] - p[1]) - (q[1] - p[1]) * (c[0] - p[0])  # noqa: B023
        out = []
        for o, c in zip(points[-1:] + points[:-1], points):
            if (side(o) >= 0) != (side(c) >= 0):
                t = side(o) / (side(o) - side(c))
                out.append((o[0] + t * (c[0] - o[0]), o[1] + t * (c[1] - o[1])))
            if side(c) >= 0:
                out.append(c)
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def test_overlapping_boxes(spark):
    rng = random.Random(3)
    some = lambda n, k: [(rng.randrange(2), k + i, rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([5.0, 20.0, 250.0]), rng.choice([4.0, 30.0]), rng.choice([0.0, 90.0, 45.0, -30.0, 180.0, 12.5])) for i in range(n)]
    left, right = some(60, 0), some(80, 1000)
    right += [(0, 2000, *left[0][2:])] if left[0][0] == 0 else [(1, 2000, *left[0][2:])]
    odd = [(0, 3000, None, 1.0, 2.0, 2.0, 0.0), (0, 3001, 1.0, 1.0, 0.0, 2.0, 0.0), (None, 3002, 1.0, 1.0, 5.0, 2.0, 0.0)]
    got = regions.overlapping(spark.createDataFrame(left + odd, BOX), spark.createDataFrame(right + odd, BOX), ["sheet_id"], square=50.0).collect()
    found = {(r["l"]["id"], r["r"]["id"]): r["area"] for r in got}
    assert len(found) == len(got)
    for a in left:
        for b in right:
            if a[0] == b[0]:
                area = clipped(a[2:], b[2:])
                if area > 1e-6:
                    assert found.pop((a[1], b[1])) == pytest.approx(area, rel=1e-6, abs=1e-6)
                else:
                    assert found.pop((a[1], b[1]), 0.0) == pytest.approx(0.0, abs=1e-6)
    assert not found


def test_one_proposal_is_expected(spark):
    fields = "kind string, nominal decimal(28,12), upper_limit decimal(28,12), lower_limit decimal(28,12), rule string, inspect boolean"
    number = lambda n: None if n is None else Decimal(n)
    truth = spark.createDataFrame([(1, i, x, 100.0, 30.0, 8.0, 0.0, "linear", number(n), None, None, "general", True) for i, x, n in ((1, 100.0, 5), (2, 300.0, 5), (3, 500.0, None), (4, None, 5), (5, 700.0, 5))], f"{BOX}, {fields}")
    said = lambda x, n, kind="linear", ok=True, y=100.0: (1, x, y, 28.0, 8.0, 180.0, kind, number(n), None, None, "general", True, ok)
    read = spark.createDataFrame([said(101.0, 5), said(299.0, 5), said(301.0, 5), said(500.0, None, ok=False), said(700.0, 6, "diameter", False), said(100.0, 5, y=130.0)], f"sheet_id int, cx double, cy double, w double, h double, angle double, {fields}, parse_ok boolean")
    got = {r["id"]: (r["n_proposals"], r["wrong"], r["correct"]) for r in regions.compared_by_region(truth, read, ["sheet_id"]).collect()}
    assert got == {1: (1, [], True), 2: (2, ["proposals"], False), 3: (1, [], True), 4: (0, ["proposals"], False), 5: (1, ["kind", "nominal", "parse_error"], False)}


def test_evaluation_without_cases(spark):
    none = spark.createDataFrame([], "category string, traits array<string>, leg_entered boolean, correct boolean")
    rows = {(r["of"], r["name"]): r for r in regions.evaluation(none).collect()}
    assert len(rows) == 19 and not any(r["passes"] for r in rows.values()) and all(r["percent"] is None for r in rows.values())
    other = spark.createDataFrame([("other", ["rotated"], True, True), ("fit", ["rotated"], False, True)], none.schema)
    rows = {r["name"]: (r["n"], r["passes"]) for r in regions.evaluation(other, none).collect()}
    assert rows["strict"] == (1, True) and rows["rotated"] == (1, True) and rows["leg_entered"] == (1, True) and rows["other"] == (1, True)


QUAD = [(10.0, 20.0), (110.0, 10.0), (120.0, 90.0), (5.0, 100.0)]


def test_maps_of_corners(spark):
    rows = [(1, [{"x": x, "y": y} for x, y in QUAD], 50.0, 40.0), (2, [{"x": float(i), "y": float(i)} for i in range(4)], 1.0, 1.0), (3, None, 1.0, 1.0), (4, [{"x": 0.0, "y": 0.0}], 1.0, 1.0), (5, [{"x": x, "y": y} for x, y in QUAD], 0.0, 40.0)]
    df = spark.createDataFrame(rows, "id int, quad array<struct<x: double, y: double>>, w double, h double")
    df = df.withColumn("map", maps.quad_map(F.col("quad"), F.col("w"), F.col("h"))).withColumn("back", maps.inverse("map")).withColumn("both", maps.after("back", "map"))
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["map"] for i in (2, 3, 4, 5)] == [None] * 4 and got[2]["back"] is None and got[2]["both"] is None
    both = np.array(got[1]["both"])
    assert np.allclose(both / both[8], np.eye(3).ravel(), atol=1e-9)
    m = np.array(got[1]["map"]).reshape(3, 3)
    for (x, y), (u, v) in zip(QUAD, [(0, 0), (50, 0), (50, 40), (0, 40)], strict=True):
        p = m @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], (u, v), atol=1e-9)


def test_marks_of_a_turned_sheet(spark):
    """A quarter turn clockwise of a sheet of 100 x 50, one that loses points, and one without a map."""
    quarter, horizon = [0.0, -1.0, 50.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -10.0]
    of = spark.createDataFrame([(1, quarter, 50.0, 100.0), (2, horizon, 50.0, 100.0), (4, [0.0] * 9, 50.0, 100.0)], "sheet_id int, map array<double>, width double, height double")
    balloons = spark.createDataFrame([(1, 1, 0.0, 500.0, 20.0, 10.0), (2, 2, 10.0, 3.0, 10.0, 3.0), (3, 3, 7.0, 8.0, 9.0, 1.0), (4, 4, 7.0, 8.0, 9.0, 1.0)], "sheet_id int, id int, x double, y double, anchor_x double, anchor_y double")
    sources = spark.createDataFrame([(1, 1, 20.0, 10.0, 8.0, 2.0, 0.0), (2, 2, 10.0, 3.0, 8.0, 2.0, 0.0), (3, 3, 1.0, 1.0, 2.0, 2.0, 30.0)], "sheet_id int, id int, cx double, cy double, w double, h double, angle double")
    views = spark.createDataFrame([(1, 1, 10.0, 5.0, 20.0, 10.0), (1, 2, -500.0, 0.0, 10.0, 10.0), (3, 3, 1.0, 1.0, 2.0, 2.0)], "sheet_id int, id int, x double, y double, w double, h double")
    got = {(r["what"], r["id"]): r for r in maps.sheet_edits(balloons, sources, views, views, of).collect()}
    at = lambda what, i, *names: tuple(None if got[what, i][n] is None else round(got[what, i][n], 9) for n in names)
    assert at("balloon", 1, "x", "y", "anchor_x", "anchor_y") == (0.0, 0.0, 40.0, 20.0) and at("balloon", 2, "x", "y") == (25.0, 50.0)
    assert at("balloon", 3, "x", "y") == (7.0, 8.0) == at("balloon", 4, "x", "y")
    assert at("source", 1, "x", "y", "w", "h", "angle") == (40.0, 20.0, 8.0, 2.0, -90.0)
    assert not got["source", 2]["kept"] and got["source", 3]["kept"] and not got["source", 3]["changed"]
    assert at("view", 1, "x", "y", "w", "h") == (35.0, 10.0, 10.0, 20.0) and not got["view", 2]["kept"] and got["zone_frame", 1]["kept"]
    assert got["balloon", 1]["changed"] and not got["balloon", 3]["changed"]


def test_balloons_of_several_proposals_keep_their_offset(spark):
    rows = [(1, 1, 10.0, 10.0, 10.0, 10.0, 40.0, -20.0, 10.0, 10.0), (2, 1, 10.0, 6.0, 10.0, 10.0, 40.0, -20.0, 10.0, 10.0), (2, 2, 12.0, 14.0, 10.0, 10.0, 40.0, -20.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "box int, line int, x double, y double, box_x double, box_y double, place_x double, place_y double, anchor_x double, anchor_y double")
    got = {(r["box"], r["line"]): (r["place_x"], r["place_y"], r["anchor_x"], r["anchor_y"]) for r in maps.placed_balloons(df, ["box"]).collect()}
    assert got == {(1, 1): (40.0, -20.0, 10.0, 10.0), (2, 1): (40.0, -24.0, 10.0, 6.0), (2, 2): (42.0, -16.0, 12.0, 14.0)}


HINTS = explain.HINT.replace("struct<", "array<struct<") + ">"
SCHEMA = f"id int, rule string, table_id string, table_version int, part string, class string, fit string, range struct<lo: string, lo_incl: boolean, hi: string, hi_incl: boolean>, places int, tolerance string, hints {HINTS}, draft boolean, conversion struct<from: string, to: string, places: int>, nominal string, unit string, upper_dev string, lower_dev string, upper_limit string, lower_limit string, shorter_leg struct<value: string, unit: string>"


def row(i, rule, **of):
    names = [c.split()[0] for c in "id,rule,table_id,table_version,part,class,fit,range,places,tolerance,hints,draft,conversion,nominal,unit,upper_dev,lower_dev,upper_limit,lower_limit,shorter_leg".split(",")]
    return tuple({"id": i, "rule": rule, "hints": [], "draft": False, "unit": "mm", "nominal": "45", **of}.get(n) for n in names)


def test_sentences(spark):
    hint = lambda name, **of: {"name": name, "fit": None, "table_id": None, "table_version": None, "upper_dev": None, "lower_dev": None, **of}
    iso, mid = {"table_id": "iso-2768-1", "table_version": 1, "part": "linear", "class": "m"}, ("30", False, "120", True)
    rows = [
        row(1, "general", **iso, range=mid, upper_dev="0.3", lower_dev="-0.3"), row(2, "fit", table_id="iso-286", table_version=2, fit="H7", range=mid, upper_dev="0.025", lower_dev="0", unit="in", draft=True, conversion=("mm", "in", 4)),
        row(3, "explicit", upper_dev=None, lower_dev="0", lower_limit="10"), row(4, "explicit"), row(5, "no_tolerance_defined", hints=[hint("reference_dimension")]), row(6, "no_tolerance_defined", hints=[hint("size_outside_table", table_id="iso-2768-1", table_version=1)]),
        row(7, "decimal_places", places=2, tolerance="0.05"), row(8, "manual", hints=[hint("fit_deviations_differ", fit="H7", upper_dev="0.02", lower_dev="0")]), row(9, "general", **iso, unit="deg", range=("10", False, "50", True), upper_dev="0.5", lower_dev="-0.5", upper_limit="30.5", lower_limit="29.5", shorter_leg=("2", "in")),
        row(10, "custom_table", **iso, range=(None, None, None, None), upper_dev="0.1", lower_dev="-0.2"), row(11, "general", **iso, unit="deg", range=("10", True, "50", False), upper_dev="0.5", lower_dev="-0.5"), row(12, None), row(13, "drawing_rule", **iso),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    en = {r["id"]: r["explanation"] for r in explain.explained(df).collect()}
    de = {r["id"]: r["explanation"] for r in explain.explained(df, "de").collect()}
    assert en[1] == "No tolerance on the drawing. General tolerance iso-2768-1 version 1, class m, part linear. Nominal 45 mm is in the range over 30 up to and including 120 mm, so ±0.3 mm."
    assert de[1] == "Keine Toleranz in der Zeichnung. Allgemeintoleranz iso-2768-1 Version 1, Klasse m, Teil linear. Nennmaß 45 mm liegt im Bereich über 30 bis einschließlich 120 mm, daher ±0,3 mm."
    assert en[2] == "Fit H7 from table iso-286 version 2. Nominal 45 in is in the range over 30 up to and including 120 mm, so +0.025 / 0 in. The table is a draft and not verified yet. Values converted from mm to in and rounded to 4 decimal places."
    assert de[2].endswith("daher +0,025 / 0 Zoll. Die Tabelle ist ein Entwurf und noch nicht geprüft. Werte von mm in Zoll umgerechnet und auf 4 Nachkommastellen gerundet.")
    assert en[3] == "Tolerance written on the drawing: lower limit 10 mm." and de[4] == "Toleranz in der Zeichnung angegeben: keine Grenzmaße."
    assert en[5] == "Reference dimension: no tolerance and not inspected unless chosen."
    assert en[6] == "No rule gives limits for this dimension, so no limits. Check this characteristic. The size is outside the ranges of table iso-2768-1 version 1."
    assert en[7] == "No tolerance on the drawing. The nominal is written with 2 decimal places, so the decimal place rule gives ±0.05 mm."
    assert en[8] == "Limits entered by hand. The written deviations differ from fit H7 in the table (+0.02 / 0 mm). The written values are kept."
    assert en[9].endswith("The shorter leg is 2 in (50.8 mm), in the range over 10 up to and including 50 mm, so ±0.5°. Limits 29.5° to 30.5°.")
    assert en[10].endswith("Nominal 45 mm is in the range any size mm, so +0.1 / -0.2 mm.") and de[11].endswith("Der kürzere Schenkel liegt im Bereich ab 10 unter 50 mm, daher ±0,5°.")
    assert en[12] == "" and en[13].endswith("Deviations no limits.")


def test_common_range(spark):
    """The tighter bound counts; of equal ones the one that leaves the value out."""
    cell = "struct<lo: decimal(28,12), lo_incl: boolean, hi: decimal(28,12), hi_incl: boolean>"
    df = spark.createDataFrame([(1, (3, True, 6, True), (3, False, 6, False), None), (2, (3, True, 6, True), (3, True, 5, False), None), (3, None, None, (None, None, 4, True)), (4, (None, None, None, None), None, None)], f"id int, a {cell}, b {cell}, c {cell}".replace("decimal(28,12)", "int"))
    df = df.select("id", *[F.col(c).cast(cell).alias(c) for c in "abc"])
    got = {r["id"]: tuple(None if v is None else (v if isinstance(v, bool) else int(v)) for v in r["r"]) for r in df.select("id", tolerance.common_range([F.col(c) for c in "abc"]).alias("r")).collect()}
    assert got == {1: (3, False, 6, False), 2: (3, True, 5, False), 3: (None, None, 4, True), 4: (None, None, None, None)}


def test_cascade_counts_before_anything_goes(spark):
    roots = spark.createDataFrame([(1,), (1,), (2,), (3,)], "project_id int")
    samples = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (9, 90)], "project_id int, sample_id int")
    results = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (90, 1), (None, 1)], "sample_id int, char_id int")
    levels = [("samples", samples, ["project_id"]), ("results", results, ["sample_id"])]
    assert {tuple(r) for r in evaluate.cascade(roots, ["project_id"], levels).collect()} == {(1, 2, 3), (2, 1, 0), (3, 0, 0)}
    left = evaluate.removed(roots, levels)
    assert [tuple(r) for r in left["samples"].collect()] == [(9, 90)] and {tuple(r) for r in left["results"].collect()} == {(90, 1), (None, 1)}


def test_sources_of_nested_batches(spark):
    deep = '{"type": "update_fields", "ids": [7], "values": []}'
    for _ in range(9):
        deep = f'{{"type": "batch", "commands": [{{"type": "batch", "commands": []}}, {deep}]}}'
    texts = [(1, deep), (2, '{"type": "batch", "commands": [{"type": "batch", "commands": [{"type": "set_result_type", "ids": [7]}]}, {"type": "update_fields", "ids": [7], "values": [{"derivation": {"rule": {"type": "fit"}}}]}]}'), (3, '{"type": "batch", "commands": []}'), (4, None), (5, "7")]
    entries = spark.createDataFrame(texts, "entry_no long, text string").select(F.lit(1).alias("project_id"), "entry_no", F.parse_json("text").alias("command"))
    touched = spark.createDataFrame([(1, i, 7, False) for i in range(1, 6)], "project_id int, entry_no long, char_id long, created boolean")
    assert {r["entry_no"]: r["source"] for r in revise.change_sources(entries, touched).collect()} == {1: "manual", 2: "manual", 3: None, 4: None, 5: None}
