"""What lies where on a sheet: characters in boxes, frames, pasted cells, balloons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import box_corners, in_box, in_rect

SHEET = ["project_id", "sheet_id"]
#: Side of the squares, in points, by which sheets are cut so that one full sheet is no single join key.
CELL = 200.0
# A frame's alignment in degrees, its overlap and margin in font sizes; margin of a box drawn around a text
FRAME_TURN, FRAME_OVERLAP, FRAME_MARGIN, BOX_MARGIN = 2.0, 0.25, 1.2, 1.5


def _square(v: Column) -> Column:
    return F.floor(v / CELL).cast("int")


def _spread(rows: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """Rows once for each square (_i, _j) that the rectangle touches. Explodes of plain sequences are compiled, functions of arrays are not."""
    rows = rows.select("*", _square(y0).alias("_j0"), _square(y1).alias("_j1"), F.explode(F.sequence(_square(x0), _square(x1))).alias("_i"))
    return rows.select("*", F.explode(F.sequence("_j0", "_j1")).alias("_j")).drop("_j0", "_j1")


def text_in_regions(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """Characters (x, y, w, h) whose centre lies in an oriented box (box_id, cx, cy, bw, bh, angle) of their sheet, once for each such box.

    Joined by sheet and square; a character's centre is in one square, so no pair comes twice.
    """
    px, py = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    corners = box_corners(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"), F.col("angle"))
    side = lambda f, c: f(F.transform(corners, lambda p: p[c]))
    boxes = _spread(regions, side(F.array_min, "x") - 1e-6, side(F.array_max, "x") + 1e-6, side(F.array_min, "y") - 1e-6, side(F.array_max, "y") + 1e-6)
    at = glyphs.withColumn("_i", _square(px)).withColumn("_j", _square(py))
    return at.join(boxes, [*SHEET, "_i", "_j"]).where(in_box(px, py, F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"), F.col("angle"))).drop("_i", "_j")


def framed_runs(runs: DataFrame, rects: DataFrame) -> DataFrame:
    """`framed` for runs (run_id, cx, cy, w, h, angle, em): some closed rectangle (four corners, array<struct<x, y>>) of the sheet lies tightly around it.

    The centres of a run and of its frame are nearly one, so only squares about the run's centre are looked at. Of the pairs that meet there the
    join drops those whose left or upper margin is not right; the few others are looked at in full, once for each run. All of it is
    arithmetic on plain columns, as functions of arrays cost microseconds for each pair.
    """
    corners = [{c: F.col(f"_{c}{k}") for c in "xy"} for k in range(4)]
    # by a generator, below which no filter on the squares is pushed: it would make the corners again for each of its terms
    plain = F.struct(*[F.get("corners", F.lit(k))[c].alias(f"_{c}{k}") for k in range(4) for c in "xy"])
    frames = rects.select(*SHEET, F.inline(F.when(F.size("corners") == 4, F.array(plain))))
    mean = lambda c: sum((p[c] for p in corners[1:]), corners[0][c]) / 4
    frames = frames.select("*", _square(mean("x")).alias("_i"), _square(mean("y")).alias("_j"))
    reach = (FRAME_OVERLAP + FRAME_MARGIN) * F.col("em")
    near = runs.select(*SHEET, "run_id", "cx", "cy", "w", "h", "em", F.cos(F.radians("angle")).alias("_c"), F.sin(F.radians("angle")).alias("_s"))
    near = _spread(near, F.col("cx") - reach, F.col("cx") + reach, F.col("cy") - reach, F.col("cy") + reach)
    c, s = F.col("_c"), F.col("_s")
    u = lambda p: (p["x"] - F.col("cx")) * c + (p["y"] - F.col("cy")) * s
    v = lambda p: (p["y"] - F.col("cy")) * c - (p["x"] - F.col("cx")) * s
    right = lambda m: m.between(-FRAME_OVERLAP * F.col("em"), FRAME_MARGIN * F.col("em"))
    first = right(-F.col("w") / 2 - F.least(*map(u, corners))) & right(-F.col("h") / 2 - F.least(*map(v, corners)))
    tight = right(F.greatest(*map(u, corners)) - F.col("w") / 2) & right(F.greatest(*map(v, corners)) - F.col("h") / 2)
    for k in range(4):
        p, q = corners[k], corners[(k + 1) % 4]
        du, dv, length = F.abs(u(q) - u(p)), F.abs(v(q) - v(p)), F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        tight = tight & (length > 1e-12) & (F.least(du, dv) <= F.sin(F.radians(F.lit(FRAME_TURN))) * length)
    # merged: frames are a tenth of what they came from in Spark's estimate, which would broadcast them
    pairs = near.join(frames.hint("merge"), [*SHEET, "_i", "_j"]).where(first)
    hit = pairs.groupBy(*SHEET, "run_id").agg(F.bool_or(tight).alias("framed")).where("framed")
    return runs.join(hit, [*SHEET, "run_id"], "left").withColumn("framed", F.coalesce("framed", F.lit(False)))


def user_box(region: DataFrame) -> DataFrame:
    """Q1: bx, by, bw, bh of the box that a person draws around an oriented region (cx, cy, w, h, angle)."""
    turned = F.abs(F.pmod(F.col("angle"), F.lit(180.0)) - 90.0) < 1.0
    bw, bh = F.when(turned, F.col("h")).otherwise(F.col("w")) + 2 * BOX_MARGIN, F.when(turned, F.col("w")).otherwise(F.col("h")) + 2 * BOX_MARGIN
    return region.withColumn("bw", bw).withColumn("bh", bh).withColumn("bx", F.col("cx") - bw / 2).withColumn("by", F.col("cy") - bh / 2)


def pasted(blocks: DataFrame, row_axis: DataFrame, column_axis: DataFrame) -> DataFrame:
    """Cells (project_id, block_id, row_key, column_key, text) of pasted blocks (text, row_pos, column_pos); a block that overruns the grid is left out whole.

    `row_axis`: project_id, pos, row_key; `column_axis` likewise. A line break at the end adds no row.
    """
    lines = F.split(F.regexp_replace("text", "(\r\n|\r|\n)$", ""), "\r\n|\r|\n")
    rows = blocks.select("project_id", "block_id", "row_pos", "column_pos", F.posexplode(lines).alias("i", "line"))
    cells = rows.select("project_id", "block_id", (F.col("row_pos") + F.col("i")).alias("r"), F.posexplode(F.split("line", "\t")).alias("j", "text"), "column_pos").withColumn("c", F.col("column_pos") + F.col("j"))
    last = lambda axis, name: axis.groupBy("project_id").agg(F.max("pos").alias(name))
    over = cells.groupBy("project_id", "block_id").agg(F.max("r").alias("r"), F.max("c").alias("c")).join(last(row_axis, "last_r"), "project_id", "left").join(last(column_axis, "last_c"), "project_id", "left")
    refused = over.where(~F.coalesce((F.col("r") <= F.col("last_r")) & (F.col("c") <= F.col("last_c")), F.lit(False))).select("project_id", "block_id")
    kept = cells.join(refused, ["project_id", "block_id"], "left_anti")
    kept = kept.join(row_axis.select("project_id", F.col("pos").alias("r"), "row_key"), ["project_id", "r"]).join(column_axis.select("project_id", F.col("pos").alias("c"), "column_key"), ["project_id", "c"])
    return kept.select("project_id", "block_id", "row_key", "column_key", F.trim("text").alias("text"))


def overlay(balloons: DataFrame, characteristics: DataFrame, sheets: DataFrame, style: dict[str, object]) -> DataFrame:
    """Balloons to draw on current sheets: not of rejected characteristics, with `place` on the sheet; what a balloon's own style leaves null the project's gives.

    `balloons`: project_id, char_id, sheet_id, pos, and columns named as the keys of `style`.
    """
    shown = balloons.join(sheets.where("is_current").select(*SHEET), SHEET).join(characteristics.where("status <> 'rejected'").select("project_id", "char_id"), ["project_id", "char_id"])
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("pos"))
    return shown.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in style.items()}).withColumn("place", place)


def picked(balloons: DataFrame, boxes: DataFrame, selected: DataFrame) -> DataFrame:
    """Balloons (x, y) in a rectangle (bx, by, bw, bh, additive) of their sheet, with what was selected there if the rectangle adds to it."""
    keys = ["project_id", "balloon_id"]
    inside = balloons.join(boxes, SHEET).where(in_rect(F.col("x"), F.col("y"), F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"))).select(*keys)
    kept = selected.join(balloons.select(*keys, "sheet_id"), keys).join(boxes.where("additive").select(*SHEET).distinct(), SHEET, "left_semi").select(*keys)
    return inside.union(kept).distinct()
