"""Characters of a sheet to the texts of callouts.

Rows of one sheet, or of one box on it, are folded in order; sheets and boxes are dealt over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.folds import folded
from gaugeworks.operators.extract import callouts_once

# Shares of the font size, of a text's extent, and degrees
SIZE_SHARE, TURN, BASELINE, OVERLAP, GAP, SPACE = 0.05, 1.0, 0.2, 0.3, 0.8, 0.2
SAME_DIRECTION, LINE_SHARE, STACK_SHARE = 5.0, 0.25, 0.2
PAIR_GAP, PAIR_HEIGHT, PAIR_RATIO = 0.5, 0.8, "0.8"

SHEET = ["project_id", "sheet_id"]
BOX = [*SHEET, "box_id"]


def turned_by(a: Column, b: Column) -> Column:
    """The angle between two directions, 0 to 180 degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def text_runs(glyphs: DataFrame) -> DataFrame:
    """Runs of characters with text and frame (cx, cy, w, h, angle), in the order of the content.

    `glyphs`: project_id, sheet_id, seq, ch, x, y, w, h, origin_x, origin_y, rotation, font_name, font_size.
    A run is compared with its first character, so it is folded; a change of font ends it.
    Runs of blanks alone are dropped.
    """
    sides = [(F.col("x") + i * F.col("w"), F.col("y") + j * F.col("h")) for i in (0, 1) for j in (0, 1)]
    size_share, turn_by, baseline, overlap, gap_share, space = SIZE_SHARE, TURN, BASELINE, OVERLAP, GAP, SPACE

    def step(s, font, size, rotation, ox, oy, x, y, w, h):
        # the sine and cosine of a run's direction are kept with it; the corner that reaches farthest along it has the largest of either part
        run = -1
        if s:
            run, last, first_size, turn, cos, sin, base, far = s
            em = max(first_size, 1e-12)
            gap, d = ox * cos - oy * sin - far, abs(rotation - turn) % 360
            if last == font and abs(size - first_size) <= size_share * em and min(d, 360 - d) <= turn_by and abs(ox * sin + oy * cos - base) <= baseline * em and -overlap * em <= gap <= gap_share * em:
                reach = max(x * cos, (x + w) * cos) - min(y * sin, (y + h) * sin)
                return (run, font, first_size, turn, cos, sin, base, max(far, reach)), (run, gap >= space * em, turn)
        cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
        reach = max(x * cos, (x + w) * cos) - min(y * sin, (y + h) * sin)
        return (run + 1, font, size, rotation, cos, sin, ox * sin + oy * cos, reach), (run + 1, False, rotation)

    reads = ["font_name", "font_size", "rotation", "origin_x", "origin_y", "x", "y", "w", "h"]
    dealt = folded(glyphs.select(*SHEET, "seq", "ch", *[F.col(c) if c == "font_name" else F.col(c).cast("double").alias(c) for c in reads]), SHEET, ["seq"], reads, step, "run int, gap boolean, turn double")
    # the frame lies in the direction of the run's first character
    t = F.radians("turn")
    us = [x * F.cos(t) - y * F.sin(t) for x, y in sides]
    vs = [x * F.sin(t) + y * F.cos(t) for x, y in sides]
    seen = ~F.col("ch").rlike("^\\s*$")
    shown = lambda c: F.when(seen, c)
    runs = dealt.groupBy(*SHEET, "run").agg(
        F.min("seq").alias("seq"), F.first("font_name").alias("font_name"), F.min_by("font_size", "seq").alias("font_size"), F.min_by("turn", "seq").alias("rotation"),
        F.min(shown(F.least(*us))).alias("u0"), F.max(shown(F.greatest(*us))).alias("u1"), F.min(shown(F.least(*vs))).alias("v0"), F.max(shown(F.greatest(*vs))).alias("v1"),
        F.array_sort(F.collect_list(F.struct("seq", F.concat(F.when(F.col("gap"), " ").otherwise(""), F.col("ch")).alias("c")))).alias("c"),
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform("c", lambda x: x["c"]), ""), "\\s+", " "))
    u, v, r = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2, F.radians("rotation")
    runs = runs.withColumn("text", text).where("text <> ''").withColumn("cx", u * F.cos(r) + v * F.sin(r)).withColumn("cy", v * F.cos(r) - u * F.sin(r))
    return runs.withColumn("w", F.col("u1") - F.col("u0")).withColumn("h", F.col("v1") - F.col("v0")).withColumn("angle", F.pmod(-F.col("rotation"), F.lit(360.0))).select(*SHEET, "seq", "text", "font_name", "font_size", "rotation", "cx", "cy", "w", "h", "angle")


def reading_directions(runs: DataFrame) -> DataFrame:
    """`direction` of each run of a box: 0 for the one with the most characters, of equal ones the one seen first; `turn` is its angle.

    A run belongs to the first direction within five degrees. Only directions are folded, and a box has few.
    """
    angles = F.transform(F.array_sort(F.collect_list(F.struct("seq", "angle"))), lambda r: r["angle"])
    start = F.array().cast("array<double>")
    seen = lambda s, a: F.when(F.exists(s, lambda b: turned_by(a, b) <= SAME_DIRECTION), s).otherwise(F.concat(s, F.array(a)))
    found = runs.groupBy(*BOX).agg(angles.alias("a")).select(*BOX, F.aggregate("a", start, seen).alias("turns"))
    rows = runs.join(found, BOX).withColumn("turn", F.get(F.filter("turns", lambda b: turned_by(F.col("angle"), b) <= SAME_DIRECTION), F.lit(0)))
    rows = rows.withColumn("n", F.sum(F.length("text")).over(Window.partitionBy(*BOX, "turn"))).withColumn("k", F.array_position("turns", F.col("turn")))
    return rows.withColumn("direction", F.dense_rank().over(Window.partitionBy(*BOX).orderBy(F.desc("n"), "k")) - 1).drop("n", "k", "turns")


def chained(rows: DataFrame, group: list[str], lo: str, hi: str, share: float, out: str) -> DataFrame:
    """Rows of a group in order of `lo`; one joins the chain before it if they overlap by `share` of the smaller extent. The chain's range grows."""
    def step(s, low, high):
        start, end, at = s or (low, high, -1)
        least = max(min(high - low, end - start), 1e-12)
        if at >= 0 and min(end, high) - max(start, low) >= share * least:
            return (min(start, low), max(end, high), at), (at,)
        return (low, high, at + 1), (at + 1,)

    return folded(rows, group, [lo, "seq", hi], [lo, hi], step, f"{out} int")


def text_lines(runs: DataFrame) -> DataFrame:
    """Lines of each box, with direction, line, text, u0, u1, v0, v1 (along and across the direction), stacked and framed.

    `runs`: project_id, sheet_id, box_id, seq, text, cx, cy, w, h, angle, framed. Stacks are read from left to right, each from top to bottom.
    """
    r = F.radians("turn")
    u, v = F.col("cx") * F.cos(r) + F.col("cy") * F.sin(r), F.col("cy") * F.cos(r) - F.col("cx") * F.sin(r)
    rows = reading_directions(runs).withColumn("u0", u - F.col("w") / 2).withColumn("u1", u + F.col("w") / 2).withColumn("v0", v - F.col("h") / 2).withColumn("v1", v + F.col("h") / 2)
    rows = rows.select(*BOX, "direction", "turn", "seq", "text", "framed", "u0", "u1", "v0", "v1")
    rows = chained(rows, [*BOX, "direction"], "v0", "v1", LINE_SHARE, "line")
    rows = chained(rows, [*BOX, "direction", "line"], "u0", "u1", STACK_SHARE, "stack")
    pieces = F.array_sort(F.collect_list(F.struct("stack", (F.col("v0") + F.col("v1")).alias("v"), "u0", "seq", "text")))
    lines = rows.groupBy(*BOX, "direction", "line").agg(
        F.first("turn").alias("turn"), F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("text"), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.min("v0").alias("v0"), F.max("v1").alias("v1"),
        (F.count("*") > F.max("stack") + 1).alias("stacked"), F.bool_and("framed").alias("framed"),
    )
    return lines


def limit_pairs(lines: DataFrame) -> DataFrame:
    """Two lines, one above the other, that are an upper and a lower limit become one.

    Both are plain sizes with as many places, at least one; the lower is at least 0.8 of the upper; they are close and of like height.
    Pairs are taken from the top. A pair is no plain size, so in a row of lines that could all pair every second one ends a pair: windows find that.
    """
    read = callouts_once(lines.withColumn("requirement_text", F.col("text")))
    w = Window.partitionBy(*BOX, "direction").orderBy("line")
    plain = F.col("parse_ok") & F.col("nominal").isNotNull() & F.col("tol_kind").isNull() & F.col("fit").isNull() & F.col("marking").isNull() & (F.col("quantity") == 1) & ~F.col("text").rlike("[xX×] ?[0-9]| REF$")
    read = read.withColumn("size", F.when(plain & F.col("kind").isin("linear", "diameter", "radius"), F.struct("nominal", "scale", "kind", "u0", "u1", "v0", "v1")))
    up, low = F.lag("size").over(w), F.col("size")
    height = lambda s: s["v1"] - s["v0"]
    least, most = F.least(height(up), height(low)), F.greatest(height(up), height(low))
    over = F.least(up["u1"], low["u1"]) - F.greatest(up["u0"], low["u0"]) >= STACK_SHARE * F.greatest(F.least(up["u1"] - up["u0"], low["u1"] - low["u0"]), F.lit(1e-12))
    values = (low["kind"] == "linear") & (up["scale"] == low["scale"]) & (up["scale"] >= 1) & (up["nominal"] > low["nominal"]) & (low["nominal"] > 0) & (low["nominal"] >= up["nominal"] * F.lit(PAIR_RATIO).cast("decimal(2,1)"))
    fits = over & (low["v0"] - up["v1"] <= PAIR_GAP * least) & (least >= PAIR_HEIGHT * most) & values
    read = read.select(*lines.columns, F.coalesce(fits, F.lit(False)).alias("fits"))
    read = read.withColumn("island", F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(w))
    nth = F.row_number().over(Window.partitionBy(*BOX, "direction", "island").orderBy("line")) - 1
    read = read.withColumn("second", F.col("fits") & (nth % 2 == 1))
    read = read.withColumn("line", F.sum(F.when(F.col("second"), 0).otherwise(1)).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("second", "text"))), lambda t: t["text"]), " ")
    return read.groupBy(*BOX, "direction", "line").agg(
        F.first("turn").alias("turn"), text.alias("text"), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.min("v0").alias("v0"), F.max("v1").alias("v1"),
        (F.bool_or("stacked") | (F.count("*") > 1)).alias("stacked"), F.bool_and("framed").alias("framed"),
    )


def box_texts(lines: DataFrame) -> DataFrame:
    """A text for each line of a box if every line can be read, else one text for the box."""
    whole = Window.partitionBy(*BOX)
    read = callouts_once(lines.withColumn("requirement_text", F.col("text"))).select(*lines.columns, "parse_ok")
    rows = read.withColumn("apart", F.bool_and("parse_ok").over(whole)).withColumn("part", F.when(F.col("apart"), F.struct("direction", "line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("direction", "line", "text"))), lambda t: t["text"]), " ")
    rows = rows.groupBy(*BOX, "part").agg(text.alias("requirement_text"), F.bool_or("stacked").alias("stacked"), F.bool_and("framed").alias("framed"))
    return rows.withColumn("text_no", F.row_number().over(whole.orderBy("part")) - 1).drop("part")
