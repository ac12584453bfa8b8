"""Scalar rules of measurement, notation and geometry as Spark columns (X, V1-V3, V7-V8, F4-F9, C4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(28,12)"

# Words for attribute results
OK_WORDS = ("ok", "o", "+", "io", "i.o.")
NOT_OK_WORDS = ("not ok", "not_ok", "nok", "n", "x", "nio", "n.i.o.")

# C5, reasons of refused edits
REASONS = (
    "unknown_characteristic", "unknown_balloon", "unknown_sheet", "numbering_locked", "invalid_geometry", "invalid_style", "invalid_sheet_setting", "invalid_project_setting", "invalid_move_target",
    "zero_quantity", "unknown_sample", "unknown_revision", "not_an_image", "invalid_image_edit", "empty_serial", "duplicate_serial", "too_many_samples", "invalid_sample_count", "invalid_date",
    "invalid_result", "result_type_conflict", "missing_table", "nothing_to_undo", "nothing_to_redo", "internal",
)


def strict_decimal(text: Column) -> Column:
    """Digits with an optional sign and point; anything else is null, and so is what DEC can't hold exactly (more than 12 places)."""
    return F.when(F.regexp_like(text, F.lit("^-?[0-9]+(\\.[0-9]{1,12}0*)?$")), text.try_cast(DEC))


def written_scale(text: Column) -> Column:
    """Digits after the point as written."""
    return F.length(F.regexp_extract(text, "\\.([0-9]+)$", 1))


def spreadsheet_number(text: Column) -> Column:
    """A double if at most 15 digits matter, else null."""
    digits = F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+", "")
    return F.when(strict_decimal(text).isNotNull() & (F.length(digits) <= 15), text.try_cast("double"))


def localized(text: Column, comma: bool = True) -> Column:
    """With the decimal comma."""
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


def signed(text: Column) -> Column:
    """Deviations carry a plus, zero has no sign."""
    v = strict_decimal(text)
    return F.when(v > 0, F.concat(F.lit("+"), text)).when(v == 0, F.regexp_replace(text, "^-", "")).otherwise(text)


def number_parts(text: Column) -> Column:
    """A display number as struct<base, sub, letter>; structs of it sort as numbers do, parts that are missing first."""
    part = lambda i: F.regexp_extract(text, "^([0-9]+)(?:\\.([0-9]+))?([A-Z]*)$", i)
    letters = F.aggregate(F.split(part(3), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s * 26 + F.ascii(c) - 64))
    return F.struct(part(1).try_cast("int").alias("base"), part(2).try_cast("int").alias("sub"), F.nullif(letters, F.lit(0)).alias("letter"))


def letters(n: Column) -> Column:
    """Letters of a count up to 26^6: 1 is A, 26 is Z, 27 is AA; empty for 0 and null."""
    start = F.struct(F.coalesce(n, F.lit(0)).cast("bigint").alias("rest"), F.lit("").alias("text"))

    def step(s: Column, _: Column) -> Column:
        more = s["rest"] > 0
        text = F.when(more, F.concat(F.char(F.lit(65) + (s["rest"] - 1) % 26), s["text"])).otherwise(s["text"])
        return F.struct(F.when(more, F.floor((s["rest"] - 1) / 26)).otherwise(F.lit(0)).cast("bigint").alias("rest"), text.alias("text"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda s: s["text"])


def number_text(parts: Column) -> Column:
    """A display number as it is written, of what number_parts gives."""
    return F.concat(parts["base"].cast("string"), F.when(parts["sub"].isNotNull(), F.concat(F.lit("."), parts["sub"].cast("string"))).otherwise(""), letters(parts["letter"]))


def table_name(table_id: Column) -> Column:
    """The printed name of a tolerance table."""
    return F.regexp_replace(table_id, "^iso-", "ISO ")


def rule_detail(rule: Column, table_id: Column, klass: Column, fit: Column, tolerance: Column) -> Column:
    """Table and class or fit behind a rule, or its tolerance; empty for what is written, typed or absent."""
    return (
        F.when(rule == "fit", F.concat(table_name(table_id), F.lit(" "), fit)).when(rule.isin("drawing_rule", "general", "custom_table"), F.concat(table_name(table_id), F.lit(" "), klass))
        .when(rule == "decimal_places", F.concat(F.lit("±"), tolerance)).otherwise("")
    )


def unit_symbol(unit: Column) -> Column:
    """As printed; empty without a unit."""
    return F.when(unit == "deg", "°").otherwise(F.coalesce(unit, F.lit("")))


def typed_length(text: Column, unit: Column) -> Column:
    """A length above 0 as typed, with a point or comma; null for anything else, and where the unit is no length."""
    value = strict_decimal(F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit(".")), "^\\.", "0."))
    return F.when(unit.isin("mm", "in") & (value > 0), value)


def to_mm(value: Column, unit: Column) -> Column:
    """Inches times 25.4, exactly; null for degrees."""
    return F.when(unit == "in", value * F.lit("25.4").cast("decimal(3,1)")).when(unit == "mm", value)


def in_rect(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """edges belong to the rectangle."""
    return (x >= left) & (x <= left + width) & (y >= top) & (y <= top + height)


def in_box(x: Column, y: Column, cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """in a box turned by `angle` degrees about its centre, counterclockwise as seen on the sheet, whose y goes down."""
    c, s = F.cos(F.radians(angle)), -F.sin(F.radians(angle))
    dx, dy = x - cx, y - cy
    return (F.abs(dx * c + dy * s) <= w / 2 + 1e-9) & (F.abs(dy * c - dx * s) <= h / 2 + 1e-9)


def box_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners of an oriented box, turned as in in_box()."""
    c, s = F.cos(F.radians(angle)), -F.sin(F.radians(angle))
    at = lambda a, b: F.struct((cx + a * w / 2 * c - b * h / 2 * s).alias("x"), (cy + a * w / 2 * s + b * h / 2 * c).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def valid_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """finite, with sides above 0."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return finite(x) & finite(y) & finite(w) & finite(h) & (w > 0) & (h > 0)


def projected(m: Column, x: Column, y: Column) -> Column:
    """A point through a 3 x 3 map given row by row; null where the map loses it."""
    e = lambda i: F.element_at(m, i)
    d = e(7) * x + e(8) * y + e(9)
    return F.when(F.abs(d) > 1e-12, F.struct(((e(1) * x + e(2) * y + e(3)) / d).alias("x"), ((e(4) * x + e(5) * y + e(6)) / d).alias("y")))


def effective_type(result_type: Column, upper: Column, lower: Column) -> Column:
    """what `auto` means."""
    return F.when(result_type != "auto", result_type).when(upper.isNotNull() | lower.isNotNull(), "variable").otherwise("attribute")


def follows_general(rule: Column, upper: Column, lower: Column) -> Column:
    """F8: limits that a change of the general tolerance may replace."""
    return F.coalesce(rule.isin("no_tolerance_defined", "general", "custom_table"), upper.isNull() & lower.isNull())


def manual_limits(rule: Column, upper: Column, lower: Column) -> Column:
    """limits that a person has set."""
    return F.coalesce(rule == "manual", upper.isNotNull() | lower.isNotNull())


def verdict(value: Column, attribute: Column, lower: Column, upper: Column) -> Column:
    """V1: by what was measured, not by the type; limits belong to the range."""
    return (
        F.when(attribute == "ok", "pass").when(attribute == "not_ok", "fail").when(value.isNull(), "missing")
        .when(lower.isNull() & upper.isNull(), "not_evaluated")
        .when(F.coalesce(value < lower, F.lit(False)) | F.coalesce(value > upper, F.lit(False)), "fail").otherwise("pass")
    )


def limit_position(value: Column, lower: Column, upper: Column) -> Column:
    """V2: null without a value or without limits."""
    return F.when(value.isNotNull() & (lower.isNotNull() | upper.isNotNull()), F.when(value < lower, "below").when(value > upper, "above").when(value == lower, "on_lower").when(value == upper, "on_upper").otherwise("inside"))


def group_verdict(passed: Column, failed: Column, total: Column) -> Column:
    """V3."""
    return F.when(failed > 0, "fail").when((passed > 0) & (passed == total), "pass").otherwise("open")


def parsed_result(text: Column) -> Column:
    """V7: struct<value, scale, attribute, cleared, ok> of what was typed."""
    t = F.trim(text)
    number = F.regexp_replace(F.replace(F.replace(t, F.lit("−"), F.lit("-")), F.lit(","), F.lit(".")), "^(-?)\\.", "$10.")
    value, word = strict_decimal(number), F.lower(t)
    attribute = F.when(word.isin(*OK_WORDS), "ok").when(word.isin(*NOT_OK_WORDS), "not_ok")
    cleared = F.coalesce(t, F.lit("")) == ""
    return F.struct(value.alias("value"), F.when(value.isNotNull(), written_scale(number)).alias("scale"), attribute.alias("attribute"), cleared.alias("cleared"), (cleared | value.isNotNull() | attribute.isNotNull()).alias("ok"))


def same_digits(a: Column, a_scale: Column, b: Column, b_scale: Column) -> Column:
    """V8: equal as written."""
    return a.eqNullSafe(b) & a_scale.eqNullSafe(b_scale)


def date_ok(text: Column) -> Column:
    """C4: empty, or a day of the calendar."""
    return (text == "") | (F.regexp_like(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & ~text.startswith("0000") & F.try_to_date(text, "yyyy-MM-dd").isNotNull())
