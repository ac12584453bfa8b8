"""Sentences that explain a derivation, in English and German."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences and words of explanations
TEXTS: dict[str, dict[str, str]] = {
    "en": {
        "blocked": "No rule gives limits for this dimension, so no limits. Check this characteristic.",
        "explicit": "Tolerance written on the drawing: {devs}.",
        "fit": "Fit {fit} from table {table}. {in_range}",
        "drawing_rule": "No tolerance on the drawing. Drawing rule from table {lookup}. {in_range}",
        "general": "No tolerance on the drawing. General tolerance {lookup}. {in_range}",
        "custom_table": "No tolerance on the drawing. Custom table {lookup}. {in_range}",
        "decimal_places": "No tolerance on the drawing. The nominal is written with {places} decimal places, so the decimal place rule gives {tolerance}.",
        "no_tolerance_defined": "No tolerance on the drawing and no general tolerance defined, so no limits. Check this characteristic.",
        "manual": "Limits entered by hand.",
        "fit_deviations_differ": "The written deviations differ from fit {fit} in the table ({printed}). The written values are kept.",
        "unknown_fit": "Fit {fit} is not in the fit table, so it gives no limits.",
        "size_outside_table": "The size is outside the ranges of table {table}.",
        "reference_dimension": "Reference dimension: no tolerance and not inspected unless chosen.",
        "basic_dimension": "Theoretically exact dimension: no tolerance and not inspected unless chosen.",
        "draft": "The table is a draft and not verified yet.",
        "conversion": "Values converted from {from} to {to} and rounded to {conversion_places} decimal places.",
        "table": "{id} version {version}",
        "lookup": "{id} version {version}, class {class}, part {part}",
        "no_range": "Deviations {devs}.",
        "in_range": "Nominal {nominal} is in the range {range}, so {devs}.",
        "leg": "The shorter leg is {leg}, in the range {range} mm, so {devs}.",
        "no_leg": "The shorter leg is in the range {range} mm, so {devs}.",
        "leg_limits": " Limits {lower} to {upper}.",
        "from": "from", "over": "over", "upto": "up to and including", "below": "below", "any": "any size",
        "upper_limit": "upper limit", "lower_limit": "lower limit", "no_limits": "no limits", "in": "in",
    },
    "de": {
        "blocked": "Keine Regel ergibt Grenzmaße für dieses Maß, daher keine Grenzmaße. Dieses Merkmal prüfen.",
        "explicit": "Toleranz in der Zeichnung angegeben: {devs}.",
        "fit": "Passung {fit} aus Tabelle {table}. {in_range}",
        "drawing_rule": "Keine Toleranz in der Zeichnung. Zeichnungsregel aus Tabelle {lookup}. {in_range}",
        "general": "Keine Toleranz in der Zeichnung. Allgemeintoleranz {lookup}. {in_range}",
        "custom_table": "Keine Toleranz in der Zeichnung. Eigene Tabelle {lookup}. {in_range}",
        "decimal_places": "Keine Toleranz in der Zeichnung. Das Nennmaß hat {places} Nachkommastellen, daher gilt nach der Regel für Nachkommastellen {tolerance}.",
        "no_tolerance_defined": "Keine Toleranz in der Zeichnung und keine Allgemeintoleranz festgelegt, daher keine Grenzmaße. Dieses Merkmal prüfen.",
        "manual": "Grenzmaße von Hand eingegeben.",
        "fit_deviations_differ": "Die angegebenen Abmaße weichen von der Passung {fit} in der Tabelle ab ({printed}). Die angegebenen Werte gelten.",
        "unknown_fit": "Die Passung {fit} ist nicht in der Passungstabelle, daher keine Grenzmaße daraus.",
        "size_outside_table": "Das Maß liegt außerhalb der Bereiche von Tabelle {table}.",
        "reference_dimension": "Hilfsmaß: keine Toleranz und nur auf Wunsch geprüft.",
        "basic_dimension": "Theoretisch genaues Maß: keine Toleranz und nur auf Wunsch geprüft.",
        "draft": "Die Tabelle ist ein Entwurf und noch nicht geprüft.",
        "conversion": "Werte von {from} in {to} umgerechnet und auf {conversion_places} Nachkommastellen gerundet.",
        "table": "{id} Version {version}",
        "lookup": "{id} Version {version}, Klasse {class}, Teil {part}",
        "no_range": "Abmaße {devs}.",
        "in_range": "Nennmaß {nominal} liegt im Bereich {range}, daher {devs}.",
        "leg": "Der kürzere Schenkel ist {leg} lang und liegt im Bereich {range} mm, daher {devs}.",
        "no_leg": "Der kürzere Schenkel liegt im Bereich {range} mm, daher {devs}.",
        "leg_limits": " Grenzmaße {lower} bis {upper}.",
        "from": "ab", "over": "über", "upto": "bis einschließlich", "below": "unter", "any": "jede Größe",
        "upper_limit": "Höchstmaß", "lower_limit": "Mindestmaß", "no_limits": "keine Grenzmaße", "in": "Zoll",
    },
}

#: What hints() of a derivation may name, in the words of TEXTS; the text behind the colon is a fit or a table.
HINT = "struct<name: string, fit: string, table_id: string, table_version: int, upper_dev: string, lower_dev: string>"


def explained(rows: DataFrame, language: str = "en", out: str = "explanation") -> DataFrame:
    """Adds the sentences about each row's derivation, in `language` (en or de), separated by one blank.

    Rows have rule (as derived() gives it, or manual), table_id, table_version, part, class, fit, range (struct lo, lo_incl, hi, hi_incl, or null),
    places, tolerance, hints (array of HINT), draft, conversion (struct from, to, places, or null), nominal, unit (mm, in, deg or null),
    upper_dev, lower_dev, upper_limit, lower_limit, shorter_leg (struct value, unit, or null). Numbers are text as they are written. A null rule has no sentence of its own.
    """
    t = TEXTS[language]

    def said(key: str, **parts: Column) -> Column:
        """The sentence with its parts put in; null if one is null."""
        return F.concat(*[parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", t[key]) if p])

    def num(c: Column) -> Column:
        text = F.when(c.try_cast("decimal(38,12)") == 0, "0").otherwise(c)
        return F.replace(text, F.lit("."), F.lit(",")) if language == "de" else text

    def with_unit(text: Column, unit: Column) -> Column:
        return F.when(unit == "deg", F.concat(text, F.lit("°"))).when(unit == "in", F.concat(text, F.lit(f" {t['in']}"))).when(unit == "mm", F.concat(text, F.lit(" mm"))).otherwise(text)

    def signed(c: Column) -> Column:
        v = c.try_cast("decimal(38,12)")
        return F.when(v == 0, "0").when(v > 0, F.concat(F.lit("+"), num(c))).otherwise(num(c))

    of = F.col
    unit = of("unit")
    up, low = of("upper_dev"), of("lower_dev")
    one_sided = F.array_compact(F.array(*[F.when(of(c).isNotNull(), F.concat(F.lit(t[c] + " "), with_unit(num(of(c)), unit))) for c in ("lower_limit", "upper_limit")]))
    split = F.when(up.isNotNull() & low.isNotNull(), with_unit(F.concat(signed(up), F.lit(" / "), signed(low)), unit)).when(F.size(one_sided) > 0, F.array_join(one_sided, ", ")).otherwise(F.lit(t["no_limits"]))
    both = (up.try_cast("decimal(38,12)") > 0) & (up.try_cast("decimal(38,12)") == -low.try_cast("decimal(38,12)"))
    devs = F.when(F.coalesce(both, F.lit(False)), with_unit(F.concat(F.lit("±"), num(up)), unit)).otherwise(split)
    lo, hi = of("range.lo"), of("range.hi")
    word = lambda incl, yes, no, v: F.when(v.isNotNull(), F.concat(F.when(incl, t[yes]).otherwise(t[no]), F.lit(" "), num(v)))
    range_ = F.array_join(F.array_compact(F.array(word(of("range.lo_incl"), "from", "over", lo), word(of("range.hi_incl"), "upto", "below", hi))), " ")
    range_ = F.when(range_ == "", t["any"]).otherwise(range_)
    table = said("table", id=of("table_id"), version=of("table_version").cast("string"))
    lookup = said("lookup", id=of("table_id"), version=of("table_version").cast("string"), **{"class": of("class"), "part": of("part")})
    leg_unit, leg_value = of("shorter_leg.unit"), of("shorter_leg.value")
    mm = F.regexp_replace((leg_value.try_cast("decimal(28,12)") * F.lit("25.4").cast("decimal(3,1)")).cast("string"), r"\.?0+$", "")
    leg = F.when(leg_unit == "in", F.concat(with_unit(num(leg_value), leg_unit), F.lit(" ("), with_unit(num(mm), F.lit("mm")), F.lit(")"))).otherwise(with_unit(num(leg_value), leg_unit))
    rows = rows.withColumns({"_devs": devs, "_split": split, "_range": range_, "_leg": leg})
    limits = said("leg_limits", lower=with_unit(num(of("lower_limit")), F.lit("deg")), upper=with_unit(num(of("upper_limit")), F.lit("deg")))

    def in_range(d: str) -> Column:
        with_leg = F.when(of("_leg").isNotNull(), said("leg", leg=of("_leg"), range=of("_range"), devs=of(d))).otherwise(said("no_leg", range=of("_range"), devs=of(d)))
        sized = F.when(unit == "in", F.concat(of("_range"), F.lit(" mm"))).otherwise(with_unit(of("_range"), unit))
        nominal = F.coalesce(with_unit(num(of("nominal")), unit), F.lit(""))
        return F.when(of("range").isNull(), said("no_range", devs=of(d))).when(unit == "deg", F.concat(with_leg, F.coalesce(limits, F.lit("")))).otherwise(said("in_range", nominal=nominal, range=sized, devs=of(d)))

    rows = rows.withColumns({"_in_range": in_range("_devs"), "_in_range_split": in_range("_split")})
    has = lambda *names: F.coalesce(F.exists("hints", lambda h: h["name"].isin(*names)), F.lit(False))
    none = of("rule") == "no_tolerance_defined"
    tolerance = with_unit(F.concat(F.lit("±"), num(of("tolerance"))), unit)
    rule = (
        F.when(none & has("reference_dimension", "basic_dimension"), None).when(none & has("unknown_fit", "size_outside_table"), said("blocked")).when(of("rule") == "explicit", said("explicit", devs=of("_devs")))
        .when(of("rule") == "fit", said("fit", fit=of("fit"), table=table, in_range=of("_in_range_split")))
    )
    for name in ("drawing_rule", "general", "custom_table"):
        rule = rule.when(of("rule") == name, said(name, lookup=lookup, in_range=of("_in_range")))
    rule = rule.when(of("rule") == "decimal_places", said("decimal_places", places=of("places").cast("string"), tolerance=tolerance)).when(none, said("no_tolerance_defined")).when(of("rule") == "manual", said("manual"))

    def hint(h: Column) -> Column:
        printed = with_unit(F.concat(F.coalesce(signed(h["upper_dev"]), F.lit("?")), F.lit(" / "), F.coalesce(signed(h["lower_dev"]), F.lit("?"))), F.lit("mm"))
        of_table = said("table", id=h["table_id"], version=h["table_version"].cast("string"))
        out = F.when(h["name"] == "fit_deviations_differ", said("fit_deviations_differ", fit=h["fit"], printed=printed)).when(h["name"] == "unknown_fit", said("unknown_fit", fit=h["fit"])).when(h["name"] == "size_outside_table", said("size_outside_table", table=of_table))
        return out.when(h["name"] == "reference_dimension", said("reference_dimension")).when(h["name"] == "basic_dimension", said("basic_dimension"))

    draft = F.when(of("draft"), said("draft"))
    name = lambda c: F.when(c == "in", t["in"]).when(c == "deg", "°").otherwise(c)
    conversion = F.when(of("conversion").isNotNull(), said("conversion", **{"from": name(of("conversion.from")), "to": name(of("conversion.to")), "conversion_places": of("conversion.places").cast("string")}))
    parts = F.concat(F.array(rule), F.coalesce(F.transform("hints", hint), F.array().cast("array<string>")), F.array(draft, conversion))
    return rows.withColumn(out, F.array_join(F.array_compact(parts), " ")).drop("_devs", "_split", "_range", "_leg", "_in_range", "_in_range_split")


def explained_once(rows: DataFrame, cells: DataFrame, language: str = "en") -> DataFrame:
    """`explanation` of callouts that say all by their requirement_text, worked out once for each distinct text."""
    from gaugeworks.operators import extract

    return extract.once(rows, lambda texts: explained(derivations(extract.callouts(texts, "callout_text"), cells), language).select("callout_text", "explanation"))


def derivations(rows: DataFrame, cells: DataFrame, general_class: str = "m", general_table: str = "iso-2768-1", fit_table: str = "iso-286", output_unit: str | None = None, mm_places: int = 3, inch_places: int = 4, decimal_rules: list[tuple[int, str]] = (), drawing_rule: tuple[str, str] | None = None) -> DataFrame:
    """What explained() asks for, of rows with kind, nominal, scale and so on, through derived(); numbers without zeros at their end.

    The range is that of the cell which gave the deviations: for general tolerances and rules of the part that the kind belongs to,
    for fits the range that all their lookups have in common.
    """
    from gaugeworks.operators import tolerance as T

    got = T.derived(rows, cells, general_class, decimal_rules, general_table, drawing_rule, output_unit, mm_places, inch_places)
    leg = F.col("shorter_leg") if "shorter_leg" in rows.columns else F.lit(None).cast(T.DEC)
    if "shorter_leg" not in got.columns:
        got = got.withColumn("shorter_leg", leg)
    part = T.applies_to(F.col("kind"))
    by_rule = F.col("rule") == "drawing_rule"
    table = F.when(F.col("rule") == "fit", fit_table).when(by_rule, F.lit(drawing_rule[0] if drawing_rule else None)).otherwise(general_table)
    klass = F.when(by_rule, F.lit(drawing_rule[1] if drawing_rule else None)).otherwise(general_class)
    unit = F.when(F.col("kind") == "angle", "deg").otherwise(F.coalesce("unit", F.lit("mm"))) if "unit" in rows.columns else F.when(F.col("kind") == "angle", "deg").otherwise("mm")
    ruled = F.col("rule").isin("drawing_rule", "general", "custom_table")
    asked = got.withColumns({"part_id": F.when(ruled, part), "table_id": table, "column": klass, "_unit": unit}).withColumn("size", F.when(part == "angular", F.col("shorter_leg")).otherwise(T.size_in_mm(got)))
    asked = T.looked_up(asked, cells, "_cell")
    fits = T.expanded_fits(asked.withColumnsRenamed({"table_id": "_table", "part_id": "_part", "column": "_class"}), cells, fit_table).withColumnRenamed("_table", "table_id")
    heads = F.broadcast(cells.groupBy("table_id").agg(F.max("version").alias("table_version"), F.max(F.col("status") != "verified").alias("draft")))
    fits = fits.join(heads, "table_id", "left")
    plain = lambda c: F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    number = lambda c: F.regexp_replace(plain(c), r"\.$", "")
    range_ = F.when(F.col("rule") == "fit", F.when(F.col("fit_found") == "value", F.struct(number(F.col("range_lo")).alias("lo"), F.coalesce("range_lo_incl", F.lit(False)).alias("lo_incl"), number(F.col("range_hi")).alias("hi"), F.coalesce("range_hi_incl", F.lit(False)).alias("hi_incl"))))
    range_ = range_.when(ruled, F.struct(number(F.col("_cell.lo")).alias("lo"), F.col("_cell.lo_incl").alias("lo_incl"), number(F.col("_cell.hi")).alias("hi"), F.col("_cell.hi_incl").alias("hi_incl")))
    none = F.lit(None).cast("string")

    def hint(name: str, fit: Column = none, table_id: Column = none, version: Column = F.lit(None).cast("int"), up: Column = none, low: Column = none) -> Column:
        return F.struct(F.lit(name).alias("name"), fit.alias("fit"), table_id.alias("table_id"), version.alias("table_version"), up.alias("upper_dev"), low.alias("lower_dev")).cast(HINT)

    fit_outside = F.col("hint").isin("fit_out_of_range", "fit_not_defined")
    versions = {r: F.lit(v).cast("int") for r, v in ((h["table_id"], h["v"]) for h in cells.groupBy("table_id").agg(F.max("version").alias("v")).collect())}
    at = lambda t: versions.get(t, F.lit(None).cast("int"))
    marked = lambda m: F.coalesce(F.col("marking") == m, F.lit(False)) if "marking" in rows.columns else F.lit(False)
    hints = F.array_compact(F.array(
        F.when(marked("reference"), hint("reference_dimension")), F.when(marked("basic"), hint("basic_dimension")),
        F.when(fit_outside, hint("size_outside_table", table_id=F.lit(fit_table), version=at(fit_table))), F.when(F.col("hint").startswith("fit_") & ~fit_outside & (F.col("hint") != "fit_deviations_differ"), hint("unknown_fit", F.col("fit"))),
        F.when(F.col("hint") == "fit_deviations_differ", hint("fit_deviations_differ", F.col("fit"), up=number(F.col("fit_upper")), low=number(F.col("fit_lower")))),
        F.when(F.array_contains("hints", "general_out_of_range"), hint("size_outside_table", table_id=F.lit(general_table), version=at(general_table))),
        *([F.when(F.array_contains("hints", "drawing_rule_out_of_range"), hint("size_outside_table", table_id=F.lit(drawing_rule[0]), version=at(drawing_rule[0])))] if drawing_rule else []),
    ))
    by_places = F.create_map(*[F.lit(x) for p, v in decimal_rules for x in (p, v)]) if decimal_rules else None
    conversion = F.when((F.col("_unit") != F.col("out_unit")) & F.col("upper_limit").isNotNull(), F.struct(F.col("_unit").alias("from"), F.col("out_unit").alias("to"), F.when(F.col("out_unit") == "in", inch_places).otherwise(mm_places).alias("places")))
    return fits.select(
        *[c for c in rows.columns if c not in ("nominal", "fit", "unit", "hints", "shorter_leg")], "rule", "table_id", "table_version", F.col("_part").alias("part"), F.col("_class").alias("class"), "fit", range_.alias("range"),
        F.col("scale").alias("places"), (F.try_element_at(by_places, F.col("scale")) if by_places is not None else none).alias("tolerance"), hints.alias("hints"), (F.coalesce("draft", F.lit(False)) & (ruled | (F.col("rule") == "fit"))).alias("draft"), conversion.alias("conversion"),
        number(F.col("out_nominal")).alias("nominal"), F.col("out_unit").alias("unit"), *[number(F.col(c)).alias(c) for c in ("upper_dev", "lower_dev", "upper_limit", "lower_limit")],
        F.when(F.col("shorter_leg").isNotNull(), F.struct(number(F.col("shorter_leg")).alias("value"), F.lit("mm").alias("unit"))).alias("shorter_leg"),
    )
