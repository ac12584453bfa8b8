"""Projective maps of sheets (X10), and what stands on a sheet after its image was edited (G1): balloons, sources, views, zone frames.

The arithmetic is numpy over batches of rows; a map is 9 numbers row by row, a result that is not there is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gaugeworks.sources.scratch import ship

MAP, BOX = ArrayType(DoubleType()), StructType([StructField(n, DoubleType()) for n in ("x", "y", "w", "h", "angle")])


def _matrices(m: pd.Series) -> np.ndarray:
    """[row, 3, 3]; rows that are no map are not-a-number."""
    out = np.full((len(m), 9), np.nan)
    for i, v in enumerate(m):
        if v is not None and len(v) == 9:
            out[i] = np.array(v, np.float64)
    return out.reshape(-1, 3, 3)


def _lists(found: np.ndarray) -> pd.Series:
    """Maps as lists, null where a number is not finite."""
    flat = found.reshape(len(found), -1)
    good = np.isfinite(flat).all(1)
    return pd.Series([row.tolist() if ok else None for row, ok in zip(flat, good, strict=True)], dtype=object)


def _project(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where points go; not-a-number where a map sends them to infinity."""
    w = m[:, 2, 0] * x + m[:, 2, 1] * y + m[:, 2, 2]
    w = np.where(np.abs(w) >= 1e-12, w, np.nan)
    u, v = (m[:, 0, 0] * x + m[:, 0, 1] * y + m[:, 0, 2]) / w, (m[:, 1, 0] * x + m[:, 1, 1] * y + m[:, 1, 2]) / w
    good = np.isfinite(u) & np.isfinite(v)
    return np.where(good, u, np.nan), np.where(good, v, np.nan)


def _inverses(m: np.ndarray) -> np.ndarray:
    out = np.full_like(m, np.nan)
    good = np.isfinite(m).all((1, 2))
    good[good] = np.abs(np.linalg.det(m[good])) >= 1e-300
    out[good] = np.linalg.inv(m[good])
    return out


def _after(second: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.einsum("nij,njk->nik", second, first)


@pandas_udf(MAP)
def inverse(m: pd.Series) -> pd.Series:
    """The map back; null if there is none."""
    return _lists(_inverses(_matrices(m)))


@pandas_udf(MAP)
def after(second: pd.Series, first: pd.Series) -> pd.Series:
    """The map that applies `first`, then `second`."""
    return _lists(_after(_matrices(second), _matrices(first)))


@pandas_udf(MAP)
def _quad(corners: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    n = len(corners)
    p = np.full((n, 8), np.nan)
    for i, c in enumerate(corners):
        if c is not None and len(c) == 8:
            p[i] = np.array(c, np.float64)
    x, y = p[:, 0::2], p[:, 1::2]
    w, h = width.to_numpy(np.float64), height.to_numpy(np.float64)
    zero, one = np.zeros(n), np.ones(n)
    # corner k goes to (u, v): u * (g x + h y + 1) = a x + b y + c, and likewise v; eight unknowns, eight equations
    u, v = np.stack([zero, w, w, zero], 1), np.stack([zero, zero, h, h], 1)
    left, right = np.zeros((n, 8, 8)), np.zeros((n, 8))
    for k in range(4):
        left[:, 2 * k] = np.stack([x[:, k], y[:, k], one, zero, zero, zero, -u[:, k] * x[:, k], -u[:, k] * y[:, k]], 1)
        left[:, 2 * k + 1] = np.stack([zero, zero, zero, x[:, k], y[:, k], one, -v[:, k] * x[:, k], -v[:, k] * y[:, k]], 1)
        right[:, 2 * k], right[:, 2 * k + 1] = u[:, k], v[:, k]
    # twice the area of the triangle of each three corners
    area = np.stack([(x[:, b] - x[:, a]) * (y[:, c] - y[:, a]) - (x[:, c] - x[:, a]) * (y[:, b] - y[:, a]) for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))], 1)
    good = np.isfinite(left).all((1, 2)) & np.isfinite(right).all(1) & (np.abs(area) >= 1e-12).all(1) & (w > 0) & (h > 0)
    out = np.full((n, 9), np.nan)
    if good.any():
        out[good, :8] = np.linalg.solve(left[good], right[good][:, :, None])[:, :, 0]
        out[good, 8] = 1
    return _lists(out)


def quad_map(quad: Column, width: Column, height: Column) -> Column:
    """The map that sends four corners (array of struct x, y; clockwise from the top left) to the corners of a sheet of that size.

    Null if three of them lie on one line, with other than four corners, with a null, or for a sheet without area.
    """
    ship(SparkSession.active())
    return _quad(F.flatten(F.transform(quad, lambda c: F.array(c["x"], c["y"]))), width, height)


def _frame(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, angle: np.ndarray, sized: bool = True) -> pd.DataFrame:
    """Rows with a null in each field where one is not finite or a side not above 0."""
    good = np.isfinite(x) & np.isfinite(y)
    if sized:
        good &= np.isfinite(w) & np.isfinite(h) & (np.nan_to_num(w) > 0) & (np.nan_to_num(h) > 0)
    return pd.DataFrame({k: np.where(good, v, np.nan) for k, v in (("x", x), ("y", y), ("w", w), ("h", h), ("angle", angle))})


@pandas_udf(BOX)
def mapped_point(m: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """A point through a map; nulls where the map loses it."""
    u, v = _project(_matrices(m), x.to_numpy(np.float64), y.to_numpy(np.float64))
    none = np.full(len(u), np.nan)
    return _frame(u, v, none, none, none, sized=False)


@pandas_udf(BOX)
def point_on_sheet(m: pd.Series, x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """A mapped point held within the sheet; one that the map loses goes to the middle."""
    w, h = width.to_numpy(np.float64), height.to_numpy(np.float64)
    u, v = _project(_matrices(m), x.to_numpy(np.float64), y.to_numpy(np.float64))
    lost = np.isnan(u)
    none = np.full(len(u), np.nan)
    return _frame(np.where(lost, w / 2, np.clip(u, 0, w)), np.where(lost, h / 2, np.clip(v, 0, h)), none, none, none, sized=False)


@pandas_udf(BOX)
def mapped_rect(m: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Bounds of a mapped rectangle, cut to the sheet; nulls where nothing is left or the map loses a corner."""
    maps, (x, y, w, h, width, height) = _matrices(m), (s.to_numpy(np.float64) for s in (x, y, w, h, width, height))
    u, v = zip(*(_project(maps, a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))), strict=True)
    u, v = np.stack(u), np.stack(v)
    left, top, right, bottom = np.maximum(u.min(0), 0), np.maximum(v.min(0), 0), np.minimum(u.max(0), width), np.minimum(v.max(0), height)
    return _frame(left, top, right - left, bottom - top, np.full(len(left), np.nan))


@pandas_udf(BOX)
def mapped_box(m: pd.Series, cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series, angle: pd.Series) -> pd.DataFrame:
    """An oriented box (angle counterclockwise as seen, y down) through a map: its centre, and its sides along the mapped axes; nulls where the map loses it."""
    maps, (cx, cy, w, h, angle) = _matrices(m), (s.to_numpy(np.float64) for s in (cx, cy, w, h, angle))
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    at = lambda dx, dy, n: _project(maps, cx + dx * n / 2, cy + dy * n / 2)
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = at(c, -s, -w), at(c, -s, w), at(s, c, -h), at(s, c, h)
    turned = np.degrees(np.arctan2(y0 - y1, x1 - x0))
    turned = np.where(turned <= -180, turned + 360, turned)
    u, v = _project(maps, cx, cy)
    return _frame(u, v, np.hypot(x1 - x0, y1 - y0), np.hypot(x3 - x2, y3 - y2), turned)


def sheet_edits(balloons: DataFrame, sources: DataFrame, views: DataFrame, frames: DataFrame, maps: DataFrame) -> DataFrame:
    """G1: what stands on edited sheets, in one table: sheet_id, what, id, x, y, w, h, angle, anchor_x, anchor_y, kept and changed.

    `maps`: sheet_id, map, width, height (the new sheet), one small row for each edited sheet. `balloons`: sheet_id, id, x, y, anchor_x, anchor_y, held within
    the sheet. `sources`: sheet_id, id, cx, cy, w, h, angle, whose centre becomes x and y; `views` and `frames`: sheet_id, id, x, y, w, h, cut to the
    sheet. Lost ones are not kept. `changed` compares with what was there. Sheets without a map, or whose map can't be inverted or
    which have no area, keep everything as it is.
    """
    ship(maps.sparkSession)
    good = maps.where("width > 0 AND height > 0").withColumn("_back", inverse("map")).where("_back IS NOT NULL").select("sheet_id", "map", "width", "height")
    none = F.lit(None).cast("double")
    names = ("x", "y", "w", "h", "angle")

    def moved(df: DataFrame, what: str, box: dict[str, str], call: Column, anchor: Column | None = None) -> DataFrame:
        """`box`: what the columns of df are called; `call`: the box through the map."""
        rows = df.join(good, "sheet_id", "left").withColumn("_new", call)
        old = {n: F.col(box[n]).cast("double") if n in box else none for n in names}
        now = {n: F.when(F.col("map").isNull(), old[n]).otherwise(F.col(f"_new.{n}")).alias(n) for n in names}
        at = {f"anchor_{a}": none.alias(f"anchor_{a}") for a in "xy"}
        still = F.lit(True)
        if anchor is not None:
            rows = rows.withColumn("_anchor", anchor)
            at = {f"anchor_{a}": F.when(F.col("map").isNull(), F.col(f"anchor_{a}")).otherwise(F.col(f"_anchor.{a}")).alias(f"anchor_{a}") for a in "xy"}
            still = F.col("map").isNull() | (F.col("_anchor.x").eqNullSafe(F.col("anchor_x")) & F.col("_anchor.y").eqNullSafe(F.col("anchor_y")))
        same = F.col("map").isNull()
        alike = F.lit(True)
        for n in names:
            alike = alike & F.col(f"_new.{n}").eqNullSafe(old[n])
        return rows.select("sheet_id", F.lit(what).alias("what"), "id", *now.values(), *at.values(), (same | F.col("_new.x").isNotNull()).alias("kept"), (~(same | (alike & still))).alias("changed"))

    of = F.col
    point = lambda a, b: point_on_sheet(of("map"), of(a), of(b), of("width"), of("height"))
    rect = lambda: mapped_rect(of("map"), *[of(c) for c in ("x", "y", "w", "h", "width", "height")])
    out = moved(balloons, "balloon", {"x": "x", "y": "y"}, point("x", "y"), point("anchor_x", "anchor_y"))
    out = out.unionByName(moved(sources, "source", {"x": "cx", "y": "cy", "w": "w", "h": "h", "angle": "angle"}, mapped_box(of("map"), *[of(c) for c in ("cx", "cy", "w", "h", "angle")])))
    for df, what in ((views, "view"), (frames, "zone_frame")):
        out = out.unionByName(moved(df, what, {n: n for n in ("x", "y", "w", "h")}, rect()))
    return out


def placed_balloons(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """Of proposals (keys of their box; x, y of the text; box_x, box_y its box's centre; place_x, place_y, anchor_x, anchor_y of the box tool) where their balloons go.

    The only proposal of a box has its placement; several keep its offset, each from its own text. Null places stay null.
    """
    n = proposals.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = proposals.join(n, keys)
    off = {a: F.when(F.col("_n") > 1, F.col(a) - F.col(f"box_{a}")).otherwise(0.0) for a in ("x", "y")}
    return rows.withColumns({f"{p}_{a}": F.col(f"{p}_{a}") + off[a] for p in ("place", "anchor") for a in ("x", "y")}).drop("_n")
