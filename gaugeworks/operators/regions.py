"""Proposals against truth by where they stand (J13, Q4), and what the report of an evaluation counts (Q3, Q6, Q7)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gaugeworks.operators.extract import CATEGORIES, FIELDS
from gaugeworks.operators.place import user_box
from gaugeworks.sources.scratch import ship

#: Side of the squares by which boxes find each other, in sheet units.
SQUARE = 128.0
#: A proposal belongs to a truth region if so much of its area lies in the box that a person draws around that.
SHARE = 0.5
REQUIRED = 99


def _axes(angle: Column) -> list[tuple[Column, Column]]:
    """Along and across the reading direction; angles turn counterclockwise as seen, y goes down."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return [(c, -s), (s, c)]


def apart(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether some axis of one of two oriented boxes separates them."""

    def on(box: dict[str, Column], u: tuple[Column, Column]) -> Column:
        sides = zip((box["w"], box["h"]), _axes(box["angle"]), strict=True)
        return reduce(lambda x, y: x + y, [n / 2 * F.abs(v[0] * u[0] + v[1] * u[1]) for n, v in sides])

    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    return reduce(lambda x, y: x | y, [F.abs(dx * u[0] + dy * u[1]) > on(a, u) + on(b, u) for box in (a, b) for u in _axes(box["angle"])])


def _corners(cx: np.ndarray, cy: np.ndarray, w: np.ndarray, h: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """[corner, x or y, row], in the order in which the inside lies on the same side of each edge."""
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    return np.stack([np.stack([cx + i * c * w / 2 + j * s * h / 2, cy - i * s * w / 2 + j * c * h / 2]) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def _inner(of: np.ndarray, within: np.ndarray, closed: bool) -> np.ndarray:
    """Sum of the cross products of the parts of the edges of `of` that lie within the other shape; edges on its border count if it is closed."""
    total = np.zeros(of.shape[2])
    for k in range(4):
        p, q = of[k], of[(k + 1) % 4]
        first, last = np.zeros(of.shape[2]), np.ones(of.shape[2])
        for j in range(4):
            a, b = within[j], within[(j + 1) % 4]
            side = lambda c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])  # noqa: E731, B023
            d, e = side(p), side(q)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = d / (d - e)
            first = np.where((d < 0) & (e > d), np.maximum(first, t), first)
            last = np.where((e < 0) & (e < d), np.minimum(last, t), last)
            out = (d == e) & ((d < 0) if closed else (d <= 0))
            last = np.where(out, -1.0, last)
        u, v = p + first * (q - p), p + last * (q - p)
        total += np.where(last > first, u[0] * v[1] - v[0] * u[1], 0.0)
    return total


@pandas_udf(DoubleType())
def shared_area(ax: pd.Series, ay: pd.Series, aw: pd.Series, ah: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bw: pd.Series, bh: pd.Series, bt: pd.Series) -> pd.Series:
    """Area that two oriented boxes share, by Green's theorem: its border is what of each one's edges lies within the other."""
    # about the first box's centre, for the sake of digits
    cols = [s.to_numpy(np.float64) for s in (ax, ay, aw, ah, at, bx, by, bw, bh, bt)]
    zero = np.zeros(len(ax))
    a, b = _corners(zero, zero, *cols[2:5]), _corners(cols[5] - cols[0], cols[6] - cols[1], *cols[7:])
    return pd.Series(np.abs(_inner(a, b, True) + _inner(b, a, False)) / 2)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], square: float = SQUARE) -> DataFrame:
    """Pairs of oriented boxes (cx, cy, w, h, angle) of the same `keys` that overlap, as structs l and r, with their shared area.

    Boxes are dealt to the squares that their bounds touch and meet there; a pair counts in the first square that both touch, so
    it comes once. Separating axes decide, then the area is worked out. Boxes with a null, or without area, meet nothing.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        (ax, ay), (bx, by) = _axes(F.col("angle"))
        hx, hy = (F.col("w") * F.abs(ax) + F.col("h") * F.abs(bx)) / 2, (F.col("w") * F.abs(ay) + F.col("h") * F.abs(by)) / 2
        first = lambda c, half: F.floor((F.col(c) - half) / square)
        last = lambda c, half: F.floor((F.col(c) + half) / square)
        squares = F.flatten(F.transform(F.sequence(first("cx", hx), last("cx", hx)), lambda x: F.transform(F.sequence(first("cy", hy), last("cy", hy)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        rows = df.where("w > 0 AND h > 0 AND cx + cy + angle IS NOT NULL")
        rows = rows.select(*keys, *[F.col(c).alias(f"_{name}_{c}") for c in df.columns], first("cx", hx).alias(f"_{name}x"), first("cy", hy).alias(f"_{name}y"), F.explode(squares).alias("_at"))
        return rows.select("*", F.col("_at.x").alias("_sx"), F.col("_at.y").alias("_sy")).drop("_at")

    ship(left.sparkSession)
    box = lambda name: {k: F.col(f"_{name}_{k}") for k in ("cx", "cy", "w", "h", "angle")}
    met = dealt(left, "l").join(dealt(right, "r"), [*keys, "_sx", "_sy"])
    met = met.where("_sx = greatest(_lx, _rx) AND _sy = greatest(_ly, _ry)").where(~apart(box("l"), box("r")))
    row = lambda df, name: F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in df.columns]).alias(name)
    return met.select(*keys, row(left, "l"), row(right, "r"), shared_area(*box("l").values(), *box("r").values()).alias("area"))


def compared_by_region(truth: DataFrame, proposals: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """For each truth row how many proposals stand in its box, and what is wrong; other than one proposal is a failure.

    `truth`: keys, id, cx, cy, w, h, angle and FIELDS; `proposals`: keys, the box, FIELDS and parse_ok. A proposal belongs to each truth
    region whose box holds `share` of its area. A text that could not be read is wrong only where the truth has a nominal. Truth
    without a region has no proposal. `wrong` names the fields in their order.
    """
    boxes = user_box(truth.select(*keys, "id", "cx", "cy", "w", "h", "angle")).select(*keys, "id", "cx", "cy", F.col("bw").alias("w"), F.col("bh").alias("h"), F.lit(0.0).alias("angle"))
    met = overlapping(boxes, proposals, keys).where(F.col("area") >= share * F.col("r.w") * F.col("r.h"))
    one = met.groupBy(*keys, F.col("l.id").alias("id")).agg(F.count("*").alias("n"), F.first(F.struct(*[F.col(f"r.{f}") for f in (*FIELDS, "parse_ok")])).alias("p"))
    rows = truth.join(one, [*keys, "id"], "left").withColumn("n_proposals", F.coalesce("n", F.lit(0).cast("long")))
    unread = F.when(~F.col("p.parse_ok") & F.col("nominal").isNotNull(), F.lit("parse_error"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in FIELDS], unread))
    return rows.withColumn("wrong", F.when(F.col("n_proposals") != 1, F.array(F.lit("proposals"))).otherwise(wrong)).drop("n", "p").withColumn("correct", F.size("wrong") == 0)


# Categories of truth whose text stands on two lines
STACKED = ("asymmetric", "one_sided", "limit", "fit_printed")
TRAITS = ("decimal_comma", "rotated", "stacked")


def truth_traits(text: Column, angle: Column, category: Column) -> Column:
    """Q3: which of TRAITS a truth row has."""
    has = (text.rlike("[0-9],[0-9]"), F.abs(angle) > 1e-9, category.isin(*STACKED))
    return F.array_compact(F.array(*[F.when(h, F.lit(t)) for t, h in zip(TRAITS, has, strict=True)]))


def evaluation(*sets: DataFrame) -> DataFrame:
    """Q6, Q7: of one or more sets of cases (category, traits, leg_entered, correct) the rows of the report: of, name, n, n_correct, percent, passes.

    Every category has a row, one without cases has no percent and does not pass. Traits count common callouts only (all but `other`),
    `leg_entered` all cases. `strict`, the gate, is of common callouts; without any it fails.
    """
    cases = reduce(lambda a, b: a.unionByName(b), [s.select("category", "traits", "leg_entered", "correct") for s in sets])
    common = F.col("category") != "other"
    row = lambda of, name: F.struct(F.lit(of).alias("of"), name.alias("name"))
    groups = F.concat(
        F.array(row("category", F.col("category"))), F.when(common, F.transform("traits", lambda t: row("trait", t))).otherwise(F.array().cast("array<struct<of: string, name: string>>")),
        F.when(F.col("leg_entered"), F.array(row("trait", F.lit("leg_entered")))).otherwise(F.array().cast("array<struct<of: string, name: string>>")), F.when(common, F.array(row("total", F.lit("strict")))).otherwise(F.array().cast("array<struct<of: string, name: string>>")),
    )
    counted = cases.select(F.explode(groups).alias("g"), "correct").groupBy("g.of", "g.name").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    names = [("category", c) for c in CATEGORIES] + [("trait", t) for t in (*TRAITS, "leg_entered")] + [("total", "strict")]
    rows = cases.sparkSession.createDataFrame(names, "of string, name string").join(counted, ["of", "name"], "left").na.fill(0, ["n", "n_correct"])
    percent = F.when(F.col("n") > 0, F.expr("(n_correct * 1000 + n div 2) div n") / 10.0)
    return rows.select("of", "name", "n", "n_correct", percent.alias("percent"), ((F.col("n") > 0) & (F.col("n_correct") * 100 >= F.col("n") * REQUIRED)).alias("passes"))
