"""Tolerance tables, range lookups and the derivation cascade."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import fits

# ISO 2768-1 general tolerances (mm; angular in minutes of arc by the shorter leg). None: not defined
GENERAL: dict[str, Any] = {
    "table": {"id": "iso-2768-1", "version": 1, "kind": "general", "status": "verified"},
    "part": [
        {"id": "linear", "kind": "symmetric", "applies_to": "linear", "value_unit": "mm", "columns": ["f", "m", "c", "v"], "rows": [
            {"min_inclusive": "0.5", "max_inclusive": "3", "values": ["0.05", "0.1", "0.2", "-"]},
            {"min_exclusive": "3", "max_inclusive": "6", "values": ["0.05", "0.1", "0.3", "0.5"]},
            {"min_exclusive": "6", "max_inclusive": "30", "values": ["0.1", "0.2", "0.5", "1"]},
            {"min_exclusive": "30", "max_inclusive": "120", "values": ["0.15", "0.3", "0.8", "1.5"]},
            {"min_exclusive": "120", "max_inclusive": "400", "values": ["0.2", "0.5", "1.2", "2.5"]},
            {"min_exclusive": "400", "max_inclusive": "1000", "values": ["0.3", "0.8", "2", "4"]},
            {"min_exclusive": "1000", "max_inclusive": "2000", "values": ["0.5", "1.2", "3", "6"]},
            {"min_exclusive": "2000", "max_inclusive": "4000", "values": ["-", "2", "4", "8"]},
        ]},
        {"id": "radius_chamfer", "kind": "symmetric", "applies_to": "radius_chamfer", "value_unit": "mm", "columns": ["f", "m", "c", "v"], "rows": [
            {"min_inclusive": "0.5", "max_inclusive": "3", "values": ["0.2", "0.2", "0.4", "0.4"]},
            {"min_exclusive": "3", "max_inclusive": "6", "values": ["0.5", "0.5", "1", "1"]},
            {"min_exclusive": "6", "values": ["1", "1", "2", "2"]},
        ]},
        {"id": "angular", "kind": "symmetric", "applies_to": "angular", "range_of": "shorter_leg", "value_unit": "arcmin", "columns": ["f", "m", "c", "v"], "rows": [
            {"max_inclusive": "10", "values": ["60", "60", "90", "180"]},
            {"min_exclusive": "10", "max_inclusive": "50", "values": ["30", "30", "60", "120"]},
            {"min_exclusive": "50", "max_inclusive": "120", "values": ["20", "20", "30", "60"]},
            {"min_exclusive": "120", "max_inclusive": "400", "values": ["10", "10", "15", "30"]},
            {"min_exclusive": "400", "values": ["5", "5", "10", "20"]},
        ]},
    ],
}

#: The table of fits to 500 mm. Others are read from a file, see read_table()
FITS: dict[str, Any] = fits.table()

CELLS = "table_id string, version int, kind string, status string, part_id string, part_kind string, applies_to string, range_of string, feature string, deviation string, value_unit string, part_no int, row_no int, col_no int, column string, lo_text string, lo_incl boolean, hi_text string, hi_incl boolean, value_text string"
#: Tolerance tables are broadcast; a table file has far fewer cells.
MOST_CELLS = 1_000_000


def table_cells(spark: SparkSession, *tables: dict[str, Any]) -> DataFrame:
    """Table files as one long table, a row for each cell; `-` is a cell without a value."""
    rows = []
    for t in tables:
        head = t["table"]
        for p, part in enumerate(t["part"]):
            for r, row in enumerate(part["rows"]):
                lo, hi = row.get("min_inclusive", row.get("min_exclusive")), row.get("max_inclusive", row.get("max_exclusive"))
                for c, (column, value) in enumerate(zip(part["columns"], row["values"], strict=True)):
                    rows.append((head["id"], head["version"], head["kind"], head["status"], part["id"], part["kind"], part.get("applies_to"), part.get("range_of", "size"), part.get("feature"), part.get("deviation"), part.get("value_unit", "mm"), p, r, c, column, lo, "min_inclusive" in row, hi, "max_inclusive" in row, None if value == "-" else value))
    if len(rows) > MOST_CELLS:
        raise ValueError(f"{len(rows)} cells; at most {MOST_CELLS} can be broadcast")
    cells = spark.createDataFrame(rows, CELLS)
    number = lambda c: F.col(c).cast(DEC)
    return cells.select("*", number("lo_text").alias("lo"), number("hi_text").alias("hi"), number("value_text").alias("value"))


def read_table(path: str) -> dict[str, Any]:
    """A table file in TOML, which is small, on the driver."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def holds(size: Column, of: Column) -> Column:
    """Sizes above 0 within the bounds of a struct as the table gives them; a bound that is missing is open."""
    above = of["lo"].isNull() | (size > of["lo"]) | (of["lo_incl"] & (size == of["lo"]))
    below = of["hi"].isNull() | (size < of["hi"]) | (of["hi_incl"] & (size == of["hi"]))
    return (size > 0) & above & below


def by_part(cells: DataFrame) -> DataFrame:
    """One row for each part of each table: a map of its columns to their ranges, in the order of rows."""
    cell = F.struct("row_no", "lo", "lo_incl", "hi", "hi_incl", "value", "value_unit", "version")
    columns = cells.groupBy("table_id", "part_id", "column").agg(F.sort_array(F.collect_list(cell)).alias("ranges"))
    return columns.groupBy("table_id", "part_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "ranges"))).alias("columns"))


def looked_up(sizes: DataFrame, cells: DataFrame, out: str) -> DataFrame:
    """For (table_id, part_id, column, size) the cell, as struct `out`, with `found`: value, not_defined, out_of_range, no_such_part or unknown_column.

    A hash join with the few parts of the tables, broadcast; column and range are found in the part's row. Where ranges overlap, the first one counts.
    """
    hit = sizes.join(F.broadcast(by_part(cells)), ["table_id", "part_id"], "left")
    ranges = F.try_element_at("columns", F.col("column"))
    hit = hit.withColumn("_ranges", ranges).withColumn(out, F.get(F.filter("_ranges", lambda x: holds(F.col("size"), x)), F.lit(0)))
    found = F.when(F.col(f"{out}.value").isNotNull(), "value").when(F.col(out).isNotNull(), "not_defined").when(F.col("columns").isNull(), "no_such_part").when(F.col("_ranges").isNull(), "unknown_column").otherwise("out_of_range")
    return hit.withColumn(f"{out}_found", found).drop("columns", "_ranges")


def applies_to(kind: Column) -> Column:
    """T6."""
    return F.when(kind.isin("linear", "diameter", "spherical_diameter", "depth"), "linear").when(kind.isin("radius", "spherical_radius", "chamfer"), "radius_chamfer").when(kind == "angle", "angular")


def size_in_mm(rows: DataFrame) -> Column:
    """By what tables are looked up: the nominal without its sign; inches, where rows have a unit, as mm."""
    size = F.abs("nominal")
    return F.when(F.col("unit") == "in", size * F.lit("25.4").cast("decimal(3,1)")).otherwise(size).cast(DEC) if "unit" in rows.columns else size


def general_tolerance(rows: DataFrame, cells: DataFrame, table_id: str = "iso-2768-1", klass: str = "m") -> DataFrame:
    """Rows with kind, nominal (and shorter_leg, in mm) get `tolerance` and `found`; degrees are minutes / 60 cut to six places."""
    leg = F.col("shorter_leg") if "shorter_leg" in rows.columns else F.lit(None).cast(DEC)
    part = applies_to(F.col("kind"))
    asked = rows.withColumns({"part_id": part, "table_id": F.lit(table_id), "column": F.lit(klass), "size": F.when(part == "angular", leg).otherwise(size_in_mm(rows))})
    got = looked_up(asked, cells, "cell")
    value = F.when(F.col("cell.value_unit") == "arcmin", F.floor(F.col("cell.value") / 60, F.lit(6))).otherwise(F.col("cell.value")).cast(DEC)
    return got.withColumn("tolerance", value).withColumnRenamed("cell_found", "found").drop("part_id", "table_id", "column", "size", "cell")


def span_table(cells: DataFrame) -> DataFrame:
    """Cells with the range widened over adjacent rows of one value (gaps and islands within a part's column)."""
    w = Window.partitionBy("table_id", "part_id", "column").orderBy("row_no")
    new = F.when(F.col("value").eqNullSafe(F.lag("value").over(w)) & (F.col("row_no") > 0), 0).otherwise(1)
    spans = cells.withColumn("island", F.sum(new).over(w))
    whole = Window.partitionBy("table_id", "part_id", "column", "island")
    first, last = F.min_by(F.struct("lo", "lo_incl"), "row_no").over(whole), F.max_by(F.struct("hi", "hi_incl"), "row_no").over(whole)
    return spans.withColumn("f", first).withColumn("l", last).select(*[c for c in cells.columns], F.col("f.lo").alias("span_lo"), F.col("f.lo_incl").alias("span_lo_incl"), F.col("l.hi").alias("span_hi"), F.col("l.hi_incl").alias("span_hi_incl"))


# Deviation letters of fits
LETTERS = ("A", "B", "C", "CD", "D", "E", "EF", "F", "FG", "G", "H", "J", "JS", "K", "M", "N", "P", "R", "S", "T", "U", "V", "X", "Y", "Z", "ZA", "ZB", "ZC")
A_TO_H = LETTERS[:11]


def fit_parts(fit: Column) -> Column:
    """struct<feature, letter, written, grade> of a tolerance class such as H7 or js6, else null. Case tells holes from shafts."""
    letters, digits = F.regexp_extract(fit, "^([A-Z]+|[a-z]+)(01|0|[1-9][0-9]?)$", 1), F.regexp_extract(fit, "^([A-Z]+|[a-z]+)(01|0|[1-9][0-9]?)$", 2)
    grade = F.when(digits == "01", -1).otherwise(digits.try_cast("int"))
    ok = F.upper(letters).isin(*LETTERS) & (grade <= 18)
    return F.when(ok, F.struct(F.when(letters == F.upper(letters), "hole").otherwise("shaft").alias("feature"), F.upper(letters).alias("letter"), letters.alias("written"), digits.alias("digits"), grade.alias("grade")))


def expanded_fits(rows: DataFrame, cells: DataFrame, table_id: str = "iso-286") -> DataFrame:
    """Rows with fit and nominal get fit_upper, fit_lower, fit_found, and the range that the deviations hold for (range_lo, range_lo_incl, range_hi, range_hi_incl).

    Up to four range lookups: standard tolerance, fundamental deviation, delta, and a special case that replaces the deviation. Each range is
    widened over the rows beside it that give the same value (J7).
    """
    spans = {"lo": "span_lo", "lo_incl": "span_lo_incl", "hi": "span_hi", "hi_incl": "span_hi_incl"}
    cells = span_table(cells).withColumns({k: F.col(v) for k, v in spans.items()}).drop(*spans.values())
    p = fit_parts(F.col("fit"))
    rows = rows.withColumns({"p": p, "table_id": F.lit(table_id), "size": size_in_mm(rows)})
    letter, grade, hole = F.col("p.letter"), F.col("p.grade"), F.col("p.feature") == "hole"
    upper_half = letter.isin(*A_TO_H)
    delta_to = F.when(letter.isin("K", "M", "N"), 8).when(letter == "J", -2).otherwise(7)
    with_delta = hole & ~upper_half & (letter != "JS") & (grade <= delta_to)
    column = (
        F.when(upper_half, F.col("p.written")).when(letter == "J", F.col("fit"))
        .when(hole & letter.isin("K", "M", "N") & ~with_delta, F.concat(letter, F.lit("_above_IT8")))
        .when(~hole & (letter == "K"), F.when(grade.between(4, 7), "k").otherwise("k_other")).otherwise(F.col("p.written"))
    )
    part = F.when(hole, F.when(upper_half, "hole_lower").otherwise("hole_upper")).otherwise(F.when(upper_half, "shaft_upper").otherwise("shaft_lower"))
    it = looked_up(rows.withColumns({"part_id": F.lit("standard_tolerance"), "column": F.concat(F.lit("IT"), F.col("p.digits"))}), cells, "it")
    dev = looked_up(it.withColumns({"part_id": F.when(letter != "JS", part), "column": column}), cells, "dev")
    delta = looked_up(dev.withColumns({"part_id": F.when(with_delta, "delta"), "column": F.concat(F.lit("IT"), grade)}), cells, "delta")
    got = looked_up(delta.withColumns({"part_id": F.lit("special_cases"), "column": F.col("fit")}), cells, "special")
    js = letter == "JS"
    delta_value = F.when(with_delta & (grade >= 3), F.col("delta.value")).when(with_delta, F.lit(0).cast(DEC)).otherwise(F.lit(0).cast(DEC))
    base = F.coalesce("special.value", F.col("dev.value") + delta_value)
    is_upper = F.when(hole, ~upper_half).otherwise(upper_half)
    t = F.col("it.value")
    upper = F.when(js, t / 2).when(is_upper, base).otherwise(base + t).cast(DEC)
    lower = F.when(js, -t / 2).when(is_upper, base - t).otherwise(base).cast(DEC)
    found = F.when(F.col("p").isNull(), "no_fit").when(F.col("it_found") != "value", F.col("it_found")).when(js | F.col("special.value").isNotNull(), "value").when(F.col("dev_found") != "value", F.col("dev_found")).when(with_delta & (grade >= 3) & (F.col("delta_found") != "value"), F.col("delta_found")).otherwise("value")
    ok = found == "value"
    cell = lambda c, needed: F.when(needed, F.col(c))
    used = [cell("it", ok), cell("dev", ~js & F.col("special.value").isNull()), cell("delta", with_delta & (grade >= 3) & F.col("special.value").isNull()), cell("special", F.col("special.value").isNotNull())]
    bounds = common_range(used)
    got = got.withColumns({"_range": F.when(ok, bounds), "fit_found": found, "fit_upper": F.when(ok, upper), "fit_lower": F.when(ok, lower)})
    return got.withColumns({f"range_{k}": F.col(f"_range.{k}") for k in ("lo", "lo_incl", "hi", "hi_incl")}).drop(
        "p", "table_id", "size", "part_id", "column", "it", "it_found", "dev", "dev_found", "delta", "delta_found", "special", "special_found", "_range"
    )


def common_range(cells: list[Column]) -> Column:
    """T5: struct<lo, lo_incl, hi, hi_incl> that the ranges of some cells (null: not asked) have in common. The tighter bound counts; of equal ones the one that leaves the value out."""
    # among equal lower bounds the exclusive one is the larger, among equal upper bounds the smaller
    lower = F.greatest(*[F.when(c["lo"].isNotNull(), F.struct(c["lo"].alias("v"), (~c["lo_incl"]).alias("out"))) for c in cells])
    upper = F.least(*[F.when(c["hi"].isNotNull(), F.struct(c["hi"].alias("v"), c["hi_incl"].alias("incl"))) for c in cells])
    return F.struct(lower["v"].alias("lo"), (~lower["out"]).alias("lo_incl"), upper["v"].alias("hi"), upper["incl"].alias("hi_incl"))


def explicit_deviations(kind: Column, a: Column, b: Column, nominal: Column) -> Column:
    """struct<upper, lower> of a written tolerance; each may be null."""
    pair = lambda u, lo: F.struct(u.cast(DEC).alias("upper"), lo.cast(DEC).alias("lower"))
    zero, none = F.lit(0).cast(DEC), F.lit(None).cast(DEC)
    d = b - nominal
    return (
        F.when(kind == "symmetric", pair(F.abs(a), -F.abs(a))).when(kind == "deviations", pair(F.greatest(a, b), F.least(a, b)))
        .when(kind == "limits", pair(F.greatest(d, zero), F.least(d, zero))).when(kind == "min", pair(none, zero)).when(kind == "max", pair(zero, none))
    )


def converted(value: Column, places: int, how: str) -> Column:
    """Inches to mm, exact, then rounded inward: an upper limit down, a lower one up, a nominal half away from zero."""
    mm = value * F.lit("25.4").cast("decimal(3,1)")
    return {"upper": F.floor(mm, F.lit(places)), "lower": F.ceil(mm, F.lit(places)), "nominal": F.round(mm, places)}[how].cast(DEC)


def inches(value: Column, places: int, how: str) -> Column:
    """Mm to inches, rounded as converted() rounds. The quotient is put right by products, which are exact where a division is not."""
    step, mm = F.lit(10**-places).cast(f"decimal({places + 1},{places})"), lambda c: c * F.lit("25.4").cast("decimal(3,1)")
    near = F.floor(value / F.lit("25.4").cast("decimal(3,1)"), F.lit(places)).cast(DEC)
    low = F.when(mm(near) > value, near - step).when(mm(near + step) <= value, near + step).otherwise(near).cast(DEC)
    high = F.when(mm(low) == value, low).otherwise(low + step)
    half = F.when(mm(low + high) == 2 * value, F.when(value < 0, low).otherwise(high)).when(mm(low + high) > 2 * value, low).otherwise(high)
    return {"upper": low, "lower": high, "nominal": half}[how].cast(DEC)


def in_unit(value: Column, of: Column, to: Column, mm_places: int, inch_places: int, how: str) -> Column:
    """A value of one unit in another; as it is where both are the same."""
    return F.when((of == "in") & (to == "mm"), converted(value, mm_places, how)).when((of == "mm") & (to == "in"), inches(value, inch_places, how)).otherwise(value).cast(DEC)


def derived(
    rows: DataFrame, cells: DataFrame, general_class: str | None = "m", decimal_rules: list[tuple[int, str]] = (), general_table: str = "iso-2768-1",
    drawing_rule: tuple[str, str] | None = None, output_unit: str | None = None, mm_places: int = 3, inch_places: int = 4,
) -> DataFrame:
    """Rule, upper_dev, lower_dev, upper_limit, lower_limit, inspect_now, hint, hints, note, out_nominal and out_unit for rows with kind, nominal, scale, fit, tol_kind, tol_a, tol_b, marking (and unit, mm if there is none).

    Written tolerance, fit, drawing rule (table, class), general or custom table, decimal places: the first that is there counts. A fit ends the
    search even if it can't be expanded; so does an angle without a known shorter leg where a table has angles (note, T7). A size outside a table is a
    hint, and the search goes on. Printed deviations of a fit that are not the table's are a hint (T3; mm only). Threads, reference and basic dimensions get
    no limits; the last two are not inspected. Tables are in mm: limits of inch sizes, and all with another `output_unit`, are converted and rounded inward (T8).
    """
    unit = F.when(F.col("kind") == "angle", "deg").otherwise(F.coalesce("unit", F.lit("mm"))) if "unit" in rows.columns else F.when(F.col("kind") == "angle", "deg").otherwise("mm")
    rows = rows.withColumn("_unit", unit)
    if "shorter_leg" not in rows.columns:
        rows = rows.withColumn("shorter_leg", F.lit(None).cast(DEC))
        given = False
    else:
        given = True
    levels = [("drawing_rule", *drawing_rule)] if drawing_rule else []
    levels += [("general", general_table, general_class)] if general_class else []
    for name, table, klass in levels:
        rows = general_tolerance(rows, cells, table, klass).withColumnsRenamed({"tolerance": f"_{name}", "found": f"_{name}_found"})
    rows = expanded_fits(rows, cells)
    kinds = F.broadcast(cells.groupBy("table_id").agg(F.max(F.col("kind") == "custom").alias("_custom")).where(F.col("table_id") == general_table).drop("table_id"))
    rows = rows.join(kinds, how="left") if general_table != "iso-2768-1" else rows.withColumn("_custom", F.lit(False))
    by_places = F.create_map(*[F.lit(x).cast(t) for p, v in decimal_rules for x, t in ((p, "int"), (v, DEC))]) if decimal_rules else None
    decimal = F.try_element_at(by_places, F.col("scale")) if by_places is not None else F.lit(None).cast(DEC)
    angle = F.col("kind") == "angle"
    none = F.col("kind").isin("thread") | F.coalesce(F.col("marking").isin("reference", "basic"), F.lit(False))
    written, has_fit = F.col("tol_kind").isNotNull(), F.col("fit").isNotNull()
    open_ = ~none & ~written & ~has_fit
    rule = F.when(none, "no_tolerance_defined").when(written, "explicit").when(has_fit, "fit")
    stopped, outside = F.lit(False), []
    for name, *_ in levels:
        found, label = F.col(f"_{name}_found"), F.when(F.col("_custom"), "custom_table").otherwise(name) if name == "general" else F.lit(name)
        no_leg = angle & F.col("shorter_leg").isNull() & (found != "no_such_part")
        rule = rule.when(no_leg, "no_tolerance_defined").when(found == "value", label)
        outside.append(F.when(open_ & ~stopped & ~no_leg & found.isin("out_of_range", "not_defined", "unknown_column"), F.concat(F.lit(f"{name}_"), found)))
        stopped = stopped | no_leg | (found == "value")
    rule = rule.when(~angle & decimal.isNotNull(), "decimal_places").otherwise("no_tolerance_defined")
    rows = rows.withColumns({"rule": rule, "_e": explicit_deviations(F.col("tol_kind"), F.col("tol_a"), F.col("tol_b"), F.col("nominal")), "_decimal": decimal})
    at_level = {name: F.col("rule").isin(name, "custom_table") if name == "general" else F.col("rule") == name for name, *_ in levels}
    symmetric = F.coalesce(*[F.when(is_, F.col(f"_{name}")) for name, is_ in at_level.items()], F.when(F.col("rule") == "decimal_places", F.col("_decimal")))
    pick = lambda e, f, sign: F.when(F.col("rule") == "explicit", F.col(e)).when(F.col("rule") == "fit", F.col(f)).otherwise(symmetric * sign).cast(DEC)
    # what deviations are in: as written, or mm where a table gave them; angles stay degrees
    tables = F.col("rule").isin("fit", "drawing_rule", "general", "custom_table") & (F.col("_unit") != "deg")
    out_unit = F.when(F.col("_unit") == "deg", "deg").otherwise(F.lit(output_unit) if output_unit else F.col("_unit"))
    rows = rows.withColumns({"_up": pick("_e.upper", "fit_upper", 1), "_low": pick("_e.lower", "fit_lower", -1), "_source": F.when(tables, "mm").otherwise(F.col("_unit")), "out_unit": out_unit})
    exact = F.when((F.col("_unit") == "in") & (F.col("_source") == "mm"), F.col("nominal") * F.lit("25.4").cast("decimal(3,1)")).otherwise(F.col("nominal")).cast(DEC)
    to = lambda c, of, how: in_unit(c, F.col(of), F.col("out_unit"), mm_places, inch_places, how)
    rows = rows.withColumns({"_exact": exact, "out_nominal": to(F.col("nominal"), "_unit", "nominal")})
    rows = rows.withColumns({"upper_limit": to((F.col("_exact") + F.col("_up")).cast(DEC), "_source", "upper"), "lower_limit": to((F.col("_exact") + F.col("_low")).cast(DEC), "_source", "lower")})
    changed = (F.col("_unit") != F.col("out_unit")) | (F.col("_source") != F.col("out_unit"))
    rows = rows.withColumns({"upper_dev": F.when(changed, F.col("upper_limit") - F.col("out_nominal")).otherwise(F.col("_up")).cast(DEC), "lower_dev": F.when(changed, F.col("lower_limit") - F.col("out_nominal")).otherwise(F.col("_low")).cast(DEC)})
    printed = ~none & (F.col("tol_kind") == "deviations") & fit_parts(F.col("fit")).isNotNull() & (F.col("_unit") == "mm")
    differ = (F.col("fit_found") == "value") & ~(F.col("fit_upper").eqNullSafe(F.col("_e.upper")) & F.col("fit_lower").eqNullSafe(F.col("_e.lower")))
    fit_hint = F.when(((F.col("rule") == "fit") | printed) & (F.col("fit_found") != "value"), F.concat(F.lit("fit_"), F.col("fit_found"))).when(printed & differ, "fit_deviations_differ")
    marked = F.when(F.col("marking").isin("reference", "basic"), F.concat("marking", F.lit("_dimension")))
    legs = [angle & open_ & F.col("shorter_leg").isNull() & (F.col(f"_{name}_found") != "no_such_part") for name, *_ in levels]
    note = F.coalesce(*[F.when(x, "shorter_leg_unknown") for x in legs], F.lit(None).cast("string"))
    rows = rows.withColumns({"note": note, "inspect_now": ~F.coalesce(F.col("marking").isin("reference", "basic"), F.lit(False)), "_table_hints": F.array_compact(F.array(fit_hint, *outside)), "_marked": marked})
    rows = rows.withColumns({"hint": F.get("_table_hints", F.lit(0)), "_had_hints": F.concat(F.array_compact(F.array("_marked")), F.col("_table_hints"))})
    read = [F.col("hints")] if "hints" in rows.columns else []
    rows = rows.withColumn("hints", F.concat(*read, F.col("_had_hints")))
    own = [c for c in rows.columns if c.startswith("_")] + ["fit_upper", "fit_lower", "fit_found", "range_lo", "range_lo_incl", "range_hi", "range_hi_incl"]
    return rows.drop(*own, *([] if given else ["shorter_leg"]))


def derived_once(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """derived() of callouts that say all by their requirement_text, read and derived once for each distinct text."""
    from gaugeworks.operators import extract

    return extract.once(rows, lambda texts: derived(extract.callouts(texts, "callout_text"), cells))


def table_issues(cells: DataFrame) -> DataFrame:
    """Rows of a part that leave a gap or overlap, bounds in two rows or none, and negative magnitudes."""
    rows = cells.select("table_id", "part_id", "part_kind", "row_no", "lo", "lo_incl", "hi", "hi_incl").distinct()
    w = Window.partitionBy("table_id", "part_id").orderBy("row_no")
    gap = (F.col("row_no") > 0) & ~(F.col("lo").eqNullSafe(F.lag("hi").over(w)) & F.col("lo").isNotNull())
    twice = (F.col("row_no") > 0) & (F.col("lo_incl") == F.lag("hi_incl").over(w))
    empty = F.coalesce(F.col("lo") >= F.col("hi"), F.lit(False))
    found = rows.withColumn("reason", F.when(empty, "empty_range").when(gap, "not_contiguous").when(twice, "bound_not_in_one_row")).where("reason is not null").select("table_id", "part_id", "row_no", "reason")
    negative = cells.where("part_kind in ('symmetric', 'standard_tolerance', 'delta') and value < 0").select("table_id", "part_id", "row_no", F.lit("negative_value").alias("reason"))
    return found.union(negative)


def catalogue(cells: DataFrame) -> DataFrame:
    """One row for each table, with the classes of its symmetric parts in the order in which they first come."""
    first = cells.where("part_kind = 'symmetric'").groupBy("table_id", "column").agg(F.min(F.struct("part_no", "col_no")).alias("at"))
    classes = first.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("at", "column"))).alias("c")).select("table_id", F.transform("c", lambda x: x["column"]).alias("classes"))
    heads = cells.groupBy("table_id", "version", "kind").agg((F.max("status") != "verified").alias("draft"))
    return heads.join(classes, "table_id", "left")
