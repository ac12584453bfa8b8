"""Display numbers from places on sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import in_rect, number_parts
from gaugeworks.functions.folds import folded

# Kinds in the order of their declaration
KINDS = ("linear", "diameter", "radius", "spherical_radius", "angle", "chamfer", "thread", "counterbore", "countersink", "depth", "surface_texture", "geometric", "note", "flag_note", "material_process", "other")
MM = 72 / 25.4
#: Rows of one reading line are within so many mm of its first point.
ROW_TOLERANCE = 7 * MM


def first_balloons(balloons: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each characteristic the balloon that was placed first, of equal places the one with the least `ties`; min_by combines on the map side."""
    own = [c for c in balloons.columns if c not in ("project_id", "char_id", *ties)]
    place = F.when(F.col("pos").isNotNull(), F.struct("pos", *ties)) if ties else F.col("pos")
    return balloons.groupBy("project_id", "char_id").agg(F.min_by(F.struct(*own), place).alias("b")).select("project_id", "char_id", "b.*")


def reference_points(characteristics: DataFrame, balloons: DataFrame) -> DataFrame:
    """The anchor of the first balloon, else the centre of the first source; finite points only."""
    b = first_balloons(balloons).select("project_id", "char_id", F.col("sheet_id").alias("b_sheet"), "anchor_x", "anchor_y")
    rows = characteristics.join(b, ["project_id", "char_id"], "left")
    src = F.get("sources", F.lit(0))
    pick = lambda a, s: F.when(F.col("b_sheet").isNotNull(), F.col(a)).otherwise(s)
    rows = rows.withColumn("sheet_id", F.coalesce("b_sheet", src["sheet_id"])).withColumn("x", pick("anchor_x", src["cx"])).withColumn("y", pick("anchor_y", src["cy"]))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return rows.withColumn("x", finite("x")).withColumn("y", finite("y")).drop("b_sheet", "anchor_x", "anchor_y")


def shown_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A point of a sheet as the turned sheet shows it."""
    return F.when(rotation == 90, F.struct((height - y).alias("x"), x.alias("y"))).when(rotation == 180, F.struct((width - x).alias("x"), (height - y).alias("y"))).when(rotation == 270, F.struct(y.alias("x"), (width - x).alias("y"))).otherwise(F.struct(x.alias("x"), y.alias("y")))


def sheet_ordinals(sheets: DataFrame) -> DataFrame:
    """The current revision's sheets first, then others in their order."""
    w = Window.partitionBy("project_id").orderBy(F.col("is_current").desc(), "rev_pos", "index")
    return sheets.withColumn("ordinal", F.row_number().over(w))


def reading_order(points: DataFrame, group: list[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Points of each group with `line` and `rank`: a line holds what is within the tolerance of its first point, then x counts.

    The line hangs on its first point, not on the one before, so an ordered fold carries it.
    """
    def step(s, y):
        first, line = s or (None, -1)
        if first is None or not y <= first + tolerance:
            first, line = y, line + 1
        return (first, line), (line,)

    rows = folded(points.select(*group, "x", "y", "item"), group, ["y", "x", "item"], ["y"], step, "line int")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("line", "x", "y", "item")) - 1
    return rows.select(*group, rank.alias("rank"), "line", "x", "y", "item")


def zone_cell(v: Column, start: Column, length: Column, n: Column) -> Column:
    """The clamped number of the grid cell."""
    return F.least(F.greatest(F.floor((v - start) / length * n), F.lit(0)), n - 1).cast("int")


def zone_order(column: Column, row: Column, columns: Column, rows: Column, rotation: Column) -> Column:
    """The place of a cell in reading order of the turned sheet; 0 for all without a grid of at least one cell."""
    left, up = columns - 1 - column, rows - 1 - row
    turned = F.when(rotation == 90, column * rows + up).when(rotation == 180, up * columns + left).when(rotation == 270, left * rows + row).otherwise(row * columns + column)
    return F.when((columns > 0) & (rows > 0), turned).otherwise(0)


def sheets_of(characteristics: DataFrame, balloons: DataFrame, sheets: DataFrame) -> DataFrame:
    """`page` (from 1) of the first source, else of the first balloon; `sheet_unit` of the first balloon's sheet, else the first source's, else mm.

    `characteristics` have `sources` array<struct<sheet_id, ...>>, `sheets` sheet_id, index (from 0) and unit. A sheet that is not there counts as none.
    """
    b = first_balloons(balloons).select("project_id", "char_id", F.col("sheet_id").alias("_b"))
    rows = characteristics.select("project_id", "char_id", F.get("sources", F.lit(0))["sheet_id"].alias("_s")).join(b, ["project_id", "char_id"], "left")
    at = lambda key, out: sheets.select("project_id", F.col("sheet_id").alias(key), F.struct("index", "unit").alias(out))
    rows = rows.withColumn("_p", F.coalesce("_s", "_b")).withColumn("_u", F.coalesce("_b", "_s")).join(at("_p", "p"), ["project_id", "_p"], "left").join(at("_u", "u"), ["project_id", "_u"], "left")
    return rows.select("project_id", "char_id", (F.col("p.index") + 1).alias("page"), F.coalesce("u.unit", F.lit("mm")).alias("sheet_unit"))


def zone_label(column: Column, row: Column, column_labels: Column, row_labels: Column) -> Column:
    """N6."""
    return F.concat(F.element_at(row_labels, row + 1), F.element_at(column_labels, column + 1))


def clockwise_key(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Angle from twelve o'clock, clockwise, then distance."""
    dx, dy = x - cx, y - cy
    a = F.atan2(dx, -dy)
    return F.struct(F.when(a < 0, a + 2 * 3.141592653589793).otherwise(a).alias("angle"), F.hypot(dx, dy).alias("distance"))


def view_of(points: DataFrame, sheets: DataFrame) -> DataFrame:
    """Of the views that hold a point the smallest, of equal ones the first; null outside of all."""
    views = sheets.select("project_id", "sheet_id", F.posexplode("views").alias("view_no", "v"))
    inside = points.join(views, ["project_id", "sheet_id"]).where(in_rect(F.col("x"), F.col("y"), F.col("v.x"), F.col("v.y"), F.col("v.w"), F.col("v.h")))
    best = inside.groupBy("project_id", "sheet_id", "item").agg(F.min_by("view_no", F.struct(F.col("v.w") * F.col("v.h"), "view_no")).alias("view_no"))
    return points.join(best, ["project_id", "sheet_id", "item"], "left")


def strategy_order(points: DataFrame, strategy: str, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """`order` of each item in its project: by sheet, then as the strategy says; items without a place last, as they stand.

    `points`: project_id, item, pos, kind, ordinal, x, y, and zone, view_no or centre_x/centre_y as the strategy needs.
    """
    if strategy == "manual":
        keys = ["pos"]
        rows = points
    elif strategy in ("zone", "view", "kind"):
        key = {"zone": "zone_rank", "view": "view_no", "kind": "zone_rank"}[strategy]
        placed = points.where("x is not null and ordinal is not null").withColumn("_g", F.coalesce(F.col(key), F.lit(2**31 - 1)))
        lines = reading_order(placed.select("project_id", "ordinal", "_g", "x", "y", F.col("item")), ["project_id", "ordinal", "_g"], tolerance)
        rows = points.join(lines.select("project_id", "item", "_g", "rank"), ["project_id", "item"], "left")
        kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(99)) if strategy == "kind" else F.lit(0)
        rows = rows.withColumn("_k", F.struct(F.when(F.col("rank").isNull(), 1).otherwise(0).alias("a"), kind.alias("k"), "ordinal", "_g", "rank"))
        keys = ["_k", "pos"]
    elif strategy == "clockwise":
        rows = points.withColumn("_k", F.struct(F.col("x").isNull().alias("a"), "ordinal", clockwise_key(F.col("x"), F.col("y"), F.col("centre_x"), F.col("centre_y")).alias("c")))
        keys = ["_k", "pos"]
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return rows.withColumn("order", F.row_number().over(Window.partitionBy("project_id").orderBy(*keys))).drop("_k", "_g", "rank")


def gathered(rows: DataFrame, order: str = "order", group: str = "group_key") -> DataFrame:
    """Members of a group move behind its first one."""
    lead = F.when(F.col(group).isNotNull(), F.min(order).over(Window.partitionBy("project_id", group))).otherwise(F.col(order))
    return rows.withColumn("_lead", lead).withColumn(order, F.row_number().over(Window.partitionBy("project_id").orderBy("_lead", order))).drop("_lead")


def display_numbers(rows: DataFrame, sub_numbers: bool, order: str = "order", group: str = "group_key") -> DataFrame:
    """Base and sub for rows in order: 1..n, or with `sub_numbers` one base for each run of two and more of one group."""
    w = Window.partitionBy("project_id").orderBy(order)
    joined = (F.col(group) == F.lag(group).over(w)) if sub_numbers else F.lit(False)
    rows = rows.withColumn("base", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w).cast("int"))
    run = Window.partitionBy("project_id", "base")
    sub = F.when(F.count("*").over(run) > 1, F.row_number().over(run.orderBy(order)))
    number = F.concat_ws(".", F.col("base").cast("string"), F.col("sub").cast("string"))
    return rows.withColumn("sub", sub).withColumn("number", number)


def preview(rows: DataFrame, old: str = "old_number", new: str = "number", locked: DataFrame | None = None) -> DataFrame:
    """How many numbers a renumbering would change. With `locked` (project_id of those whose numbers are), these are refused: they have a `reason` and no counts."""
    found = rows.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("n_changed"))
    if locked is None:
        return found
    found = found.join(locked.select("project_id").distinct().withColumn("_locked", F.lit(True)), "project_id", "left")
    free = F.col("_locked").isNull()
    return found.select("project_id", F.when(free, F.col("n")).alias("n"), F.when(free, F.col("n_changed")).alias("n_changed"), F.when(~free, "numbering_locked").alias("reason"))


def locked_inserts(present: DataFrame, given: DataFrame, inserts: DataFrame) -> DataFrame:
    """Numbers for new rows (project_id, item, seq, policy, anchor) while numbers are locked; numbers ever given are not used again.

    `next_free` goes on after the highest base, `sub_number` after the anchor's highest sub, `letter_suffix` after the highest letter of its base and sub.
    """
    used = present.select("project_id", "number").union(given.select("project_id", "number")).select("project_id", number_parts(F.col("number")).alias("n")).distinct()
    top = used.groupBy("project_id").agg(F.max("n.base").alias("top_base"))
    sub = used.groupBy("project_id", F.col("n.base").alias("base")).agg(F.coalesce(F.max("n.sub"), F.lit(0)).alias("top_sub"))
    letter = used.groupBy("project_id", F.col("n.base").alias("base"), F.coalesce("n.sub", F.lit(0)).alias("sub0")).agg(F.coalesce(F.max("n.letter"), F.lit(0)).alias("top_letter"))
    a = number_parts(F.col("anchor"))
    rows = inserts.withColumn("a", a).withColumn("base", F.col("a.base")).withColumn("sub0", F.coalesce("a.sub", F.lit(0)))
    rows = rows.join(top, "project_id", "left").join(sub, ["project_id", "base"], "left").join(letter, ["project_id", "base", "sub0"], "left")
    key = F.when(F.col("policy") == "next_free", F.lit("")).when(F.col("policy") == "sub_number", F.col("base").cast("string")).otherwise(F.col("anchor"))
    nth = F.row_number().over(Window.partitionBy("project_id", "policy", key).orderBy("seq"))
    rows = rows.withColumn("nth", nth)
    code = F.coalesce("top_letter", F.lit(0)) + F.col("nth")
    letters = F.when(code > 26, F.concat(F.char(F.lit(64) + F.floor((code - 1) / 26)), F.char(F.lit(65) + (code - 1) % 26))).otherwise(F.char(F.lit(64) + code))
    number = (
        F.when(F.col("policy") == "next_free", (F.coalesce("top_base", F.lit(0)) + F.col("nth")).cast("string"))
        .when(F.col("policy") == "sub_number", F.concat_ws(".", F.col("base").cast("string"), (F.coalesce("top_sub", F.lit(0)) + F.col("nth")).cast("string")))
        .otherwise(F.concat(F.col("base").cast("string"), F.when(F.col("sub0") > 0, F.concat(F.lit("."), F.col("sub0").cast("string"))).otherwise(""), letters))
    )
    return rows.select("project_id", "item", number.alias("number"))


def moved_before(rows: DataFrame, moved: str, target: str, pos: str = "pos") -> DataFrame:
    """Rows flagged `moved` go before the row flagged `target` of their project, in their order; the target is not among them."""
    at = F.max(F.when(F.col(target), F.col(pos))).over(Window.partitionBy("project_id"))
    key = F.when(F.col(moved) & at.isNotNull(), F.struct(at.alias("p"), F.lit(0).alias("f"), F.col(pos).alias("q"))).otherwise(F.struct(F.col(pos).alias("p"), F.lit(1).alias("f"), F.col(pos).alias("q")))
    return rows.withColumn("_k", key).withColumn(pos, F.row_number().over(Window.partitionBy("project_id").orderBy("_k"))).drop("_k")


def new_serials(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each project `n` serials on from its highest one that is all digits and fits 64 bits."""
    value = F.when(F.col("serial").rlike("^[0-9]+$"), F.col("serial").try_cast("decimal(20,0)"))
    top = samples.groupBy("project_id").agg(F.max(F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)).alias("top"))
    rows = wanted.join(top, "project_id", "left").where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("project_id", (F.coalesce("top", F.lit(0).cast("decimal(20,0)")) + F.col("i")).cast("decimal(20,0)").cast("string").alias("serial"))


def split_quantity(characteristics: DataFrame) -> DataFrame:
    """A row for each feature of 2 to 100; others stay one."""
    n = F.when(F.col("quantity").between(2, 100), F.col("quantity")).otherwise(1)
    return characteristics.withColumn("feature", F.explode(F.sequence(F.lit(1), n)))


#: Sheet units of a millimetre, and the most features that a callout is split into.
UNITS_PER_MM, MOST_FEATURES = 72 / 25.4, 100


def accepted(proposals: DataFrame, settings: DataFrame) -> DataFrame:
    """Proposals (project_id, quantity, place_x, place_y and others) as they are accepted, with `feature` and a `reason` for those refused.

    `settings`: project_id, multi_instance (sub_number or quantity), locked, size_mm (of balloons). With sub-numbers a callout for 2 to 100 features becomes
    one row for each, of quantity 1, whose balloons are stacked downwards, a little more than their size apart, in whole units. While
    numbers are locked, and with more features, it stays one row with its quantity. A quantity of 0 is refused; a null one is 1.
    """
    rows = proposals.join(settings, "project_id", "left").withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    split = F.coalesce((F.col("multi_instance") == "sub_number") & ~F.coalesce("locked", F.lit(False)) & F.col("quantity").between(2, MOST_FEATURES), F.lit(False))
    step = F.round(F.col("size_mm") * UNITS_PER_MM * 1.2)
    rows = rows.withColumn("reason", F.when(F.col("quantity") <= 0, "zero_quantity")).withColumn("feature", F.explode(F.sequence(F.lit(1), F.when(split, F.col("quantity")).otherwise(1))))
    rows = rows.withColumn("place_y", F.when(F.col("feature") > 1, F.col("place_y") + step * (F.col("feature") - 1)).otherwise(F.col("place_y")))
    return rows.withColumn("quantity", F.when(split, 1).otherwise(F.col("quantity"))).select(*proposals.columns, "feature", "reason")
