"""Small cases of characters, places and rules of stored data."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import assembly, place, quality

RUN = "project_id int, sheet_id int, box_id int, seq long, text string, cx double, cy double, w double, h double, angle double, framed boolean"


def lines(spark, *runs):
    """Runs of text, cx, cy, width, angle, 10 high."""
    return assembly.text_lines(spark.createDataFrame([(1, 1, 1, i, t, x, y, w, 10.0, a, False) for i, (t, x, y, w, a) in enumerate(runs)], RUN))


def texts(df):
    return [r["text"] for r in df.orderBy("direction", "line").collect()]


def test_stacked_deviations_are_read_top_down(spark):
    got = lines(spark, ("-0.1", 60.0, 7.0, 20.0, 0.0), ("20", 20.0, 0.0, 30.0, 0.0), ("+0.2", 60.0, -7.0, 20.0, 0.0))
    assert texts(got) == ["20 +0.2 -0.1"] and got.first()["stacked"]


def test_direction_with_most_characters_comes_first(spark):
    got = lines(spark, ("A", 0.0, 0.0, 5.0, 90.0), ("LONG", 50.0, 50.0, 30.0, 0.0), ("B", 80.0, 80.0, 5.0, 94.0))
    assert texts(got)[0] == "LONG" and got.count() == 3


def test_limit_pairs_are_taken_from_the_top(spark):
    got = assembly.limit_pairs(lines(spark, ("12.3", 0.0, 0.0, 30.0, 0.0), ("12.2", 0.0, 12.0, 30.0, 0.0), ("12.1", 0.0, 24.0, 30.0, 0.0)))
    assert texts(got) == ["12.3 12.2", "12.1"]
    apart = assembly.limit_pairs(lines(spark, ("12.3", 0.0, 0.0, 30.0, 0.0), ("12.2", 0.0, 30.0, 30.0, 0.0)))
    assert texts(apart) == ["12.3", "12.2"]
    assert texts(assembly.limit_pairs(lines(spark, ("12.1", 0.0, 0.0, 30.0, 0.0), ("12.2", 0.0, 12.0, 30.0, 0.0)))) == ["12.1", "12.2"]


def test_runs_break_and_blanks_go(spark):
    glyph = lambda i, ch, x, font="a", size=10.0: (1, 1, i, ch, x, -8.0, 5.0, 8.0, x, 0.0, 0.0, font, size)
    rows = [glyph(0, "1", 0.0), glyph(1, " ", 6.0), glyph(2, "2", 12.0), glyph(3, "3", 40.0), glyph(4, "4", 46.0, "b"), glyph(5, "5", 52.0, "b", 12.0), glyph(6, " ", 90.0, "c")]
    df = spark.createDataFrame(rows, "project_id int, sheet_id int, seq long, ch string, x double, y double, w double, h double, origin_x double, origin_y double, rotation double, font_name string, font_size double")
    assert [r["text"] for r in assembly.text_runs(df).orderBy("seq").collect()] == ["1 2", "3", "4", "5"]
    assert assembly.text_runs(df.limit(0)).count() == 0


def test_turned_frame(spark):
    runs = spark.createDataFrame([(1, 1, 1, 100.0, 100.0, 40.0, 10.0, 90.0, 10.0), (1, 1, 2, 199.9, 100.0, 40.0, 10.0, 0.0, 10.0)], "project_id int, sheet_id int, run_id int, cx double, cy double, w double, h double, angle double, em double")
    rect = lambda x, y, w, h: [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h)]
    rects = spark.createDataFrame([(1, 1, rect(100.0, 100.0, 8.0, 23.0)), (1, 1, rect(201.0, 100.0, 24.0, 8.0))], "project_id int, sheet_id int, corners array<struct<x: double, y: double>>")
    assert {r["run_id"]: r["framed"] for r in place.framed_runs(runs, rects).collect()} == {1: True, 2: True}
    assert not any(r["framed"] for r in place.framed_runs(runs, rects.withColumn("sheet_id", F.lit(2))).collect())


def test_paste_is_refused_whole(spark):
    axis = lambda name: spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], f"project_id int, pos int, {name} string")
    blocks = spark.createDataFrame([(1, 1, "1\t2\r\n3\t4\r\n", 1, 1), (1, 2, "1\t2\t3", 1, 1), (1, 3, "9", 2, 2)], "project_id int, block_id int, text string, row_pos int, column_pos int")
    got = place.pasted(blocks, axis("row_key"), axis("column_key"))
    assert sorted((r["block_id"], r["row_key"], r["column_key"], r["text"]) for r in got.collect()) == [(1, "a", "a", "1"), (1, "a", "b", "2"), (1, "b", "a", "3"), (1, "b", "b", "4"), (3, "b", "b", "9")]


def test_second_pass(spark):
    read = spark.createDataFrame([(1, 1, ["shorter_leg_unknown"], None), (1, 2, ["shorter_leg_unknown"], None), (1, 3, [], None)], f"project_id int, char_id int, hints array<string>, upper_limit {DEC}")
    truth = spark.createDataFrame([(1, 1, D(5)), (1, 2, None), (1, 3, D(5))], f"project_id int, char_id int, leg {DEC}")
    got = quality.second_pass(read, truth, lambda rows: rows.withColumn("upper_limit", F.col("shorter_leg") + 1))
    assert {r["char_id"]: (r["second"], r["upper_limit"]) for r in got.collect()} == {1: (True, D(6)), 2: (False, None), 3: (False, None)}
