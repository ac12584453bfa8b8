"""Callout text to typed columns (E8-E13, E15), quality of extraction (Q2-Q7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC, strict_decimal, written_scale
from gaugeworks.operators.tolerance import fit_parts
from gaugeworks.sources.scratch import written

# Numbers as drawings have them: decimals with point or comma, inch fractions of a power of two, degrees with minutes and seconds
_PLAIN = "(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)"
_PART = "(?:1/2|[1-3]/4|[1-7]/8|(?:1[0-5]|[1-9])/16|(?:[12][0-9]|3[01]|[1-9])/32|(?:[1-5][0-9]|6[0-3]|[1-9])/64|(?:1[01][0-9]|12[0-7]|[1-9][0-9]|[1-9])/128)"
_FRACTION = f"(?:[0-9]+ )?{_PART}(?![0-9])"
_DMS = "[0-9]+° ?[0-5]?[0-9]'(?: ?[0-5]?[0-9]\")?"
_VALUE = f"(?:{_DMS}|{_FRACTION}|{_PLAIN}°?)"
_SIZE = f"(?:{_DMS}|[0-5]?[0-9]'|{_FRACTION}|{_PLAIN}°?)"
_CLASS = "[A-Za-z]{1,2}[0-9]{1,2}"
_ZERO = "0(?:[.,]0+)?°?"
#: value, fit, its shaft, symmetric tolerance, two deviations, second limit, MIN or MAX. A deviation has a sign, or is a zero after a blank or a stroke; not both are zeros without one.
_BODY = f"(?i)^({_VALUE})(?: ?({_CLASS})(?:/({_CLASS}))?)?(?: ?± ?({_SIZE})|(?! {_ZERO} ?/? ?{_ZERO}$)( ?[+-] ?{_SIZE}| {_ZERO}) ?/? ?([+-] ?{_SIZE}|(?<=[ /]){_ZERO})|(?: ?[/-] ?| )({_VALUE})| ?(MIN|MAX)\\.?)?$"
_CHAMFER = f"^({_PLAIN}) ?[xX] ?({_PLAIN})°$"
_THREAD = f"^({_PLAIN})(?: ?[xX] ?{_PLAIN})?(?: ?- ?(?:[0-9]{{1,2}}[A-Za-z]{{1,2}}){{1,2}})?$"
_PREFIX = "^(SØ|SR|Ø|R|M|C|↧) ?"
#: A number before x is a quantity, unless only an angle follows: that is a chamfer's leg
_FRONT, _BACK = "^([0-9]+) ?(?:[xX]|(?i:PL(?:ACES)?)) ?+(?![0-9.,]+ ?°)", " ([0-9]+) ?(?i:PL(?:ACES)?)$"
_SUFFIX = f"((?: ?(?:THRU(?: ALL)?|DEEP|TYP|↧ ?{_PLAIN}))+)$"
_SPLIT = "\u0001"
#: Letters of the words that a callout may have. Others come only in the classes of a fit or a thread, four in all; a text with a fifth one can't be read.
_WORDS = "THRUALDEPYSCIMNXFthrualdepyscimnxfØø"
_PROSE = f"^(?:[\\P{{L}}{_WORDS}]*+[\\p{{L}}&&[^{_WORDS}]]){{5}}"


def _number(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "^([+-]?)\\.", "$10.")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. Columns named step by step would do, but Catalyst weighs each against all others, which takes minutes here.

    element_at() keeps its type; an index would work the types of all nested bodies out again for each row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def written_value(text: Column) -> Column:
    """A decimal, an inch fraction or degrees, minutes and seconds as a number; null if it is none of them."""
    fraction, dms = "^(?:([0-9]+) )?([0-9]+)/([0-9]+)$", "^(?:([0-9]+)° ?)?([0-9]{1,2})'(?: ?([0-9]{1,2})\")?$"
    places = lambda n: F.lit(n).cast(f"decimal({len(str(n))},0)")

    def size(t: Column) -> Column:
        part = lambda p, i: F.coalesce(F.regexp_extract(t, p, i).try_cast("long"), F.lit(0))
        # denominators are powers of two up to 128: ten million divides by them without rest
        inches = part(fraction, 1) * 10_000_000 + F.floor(part(fraction, 2) * 10_000_000 / part(fraction, 3)).cast("long")
        seconds = part(dms, 1) * 3600 + part(dms, 2) * 60 + part(dms, 3)
        return (
            F.when(t.contains("/"), (inches.cast("decimal(18,0)") / places(10_000_000)).cast(DEC)).when(t.contains("'"), (seconds.cast("decimal(20,12)") / places(3600)).cast(DEC))
            .otherwise(let(_number(F.replace(t, F.lit("°"), F.lit(""))), strict_decimal))
        )

    unsigned = let(F.regexp_replace(text, "^[+-] ?", ""), size)
    return F.when(F.startswith(text, F.lit("-")), -unsigned).otherwise(unsigned).cast(DEC)


def callout(text: Column, drawing_unit: str = "mm") -> Column:
    """What callouts() reads of a text, as a struct."""
    strip = lambda c, p: F.trim(F.regexp_replace(c, p, ""))
    tidy = F.regexp_replace(text, "\\s+", " ")
    for way, of in (("-", "−"), ("'", "′"), ('"', "″"), ("Ø", "⌀"), ("x", "×")):
        tidy = F.replace(tidy, F.lit(of), F.lit(way))
    some = lambda c: let(c, lambda x: F.when(x != "", x))

    def bare(t: Column) -> Column:
        reference = t.rlike("^\\(.*\\)$|^[0-9]+ ?[xX] ?\\(.*\\)$| REF$")
        marking = F.when(reference, "reference").when(t.rlike("^\\[.*\\]$"), "basic")
        b = F.regexp_replace(F.regexp_replace(t, "\\+ ?/? ?-(?= ?[0-9.,])", "±"), "(^| )DIA ?|ø", "$1Ø")
        return let(marking, lambda m: let(F.when(m.isNotNull(), F.trim(F.regexp_replace(strip(b, "[()\\[\\]]| REF$"), " +", " "))).otherwise(b), lambda b: counted(t, m, b)))

    def counted(t: Column, m: Column, b: Column) -> Column:
        many = F.coalesce(F.regexp_extract(b, _FRONT, 1).try_cast("int"), F.regexp_extract(b, _BACK, 1).try_cast("int"))
        tail = f"(?i)(?<=[^ ]){_SUFFIX}"
        return let(many, lambda q: let(strip(strip(b, _FRONT), _BACK), lambda b: let(F.trim(F.regexp_extract(b, tail, 1)), lambda s: let(strip(b, tail), lambda b: measured(t, m, q, s, b)))))

    def measured(t: Column, m: Column, q: Column, s: Column, b: Column) -> Column:
        turned = b.contains("°")
        mark = ~turned & b.rlike('"| ?in$')
        rest = F.when(turned, b).otherwise(strip(b, '"| ?(in|mm)$'))
        return let(mark, lambda mark: let(rest, lambda b: let(F.regexp_extract(b, _PREFIX, 1), lambda p: let(F.regexp_replace(b, _PREFIX, ""), lambda r: parted(t, m, q, s, mark, p, r)))))

    def parted(t: Column, m: Column, q: Column, s: Column, mark: Column, p: Column, r: Column) -> Column:
        found = F.transform(F.split(F.regexp_replace(r, _BODY, _SPLIT.join(f"${i}" for i in range(1, 9))), _SPLIT), lambda x: some(F.trim(x)))
        thread, chamfer = (p == "M") & r.rlike(_THREAD), (p == "") & r.rlike(_CHAMFER)

        def how(f: Column) -> Column:
            classes = F.get(f, F.lit(1)).isNull() | (fit_parts(F.get(f, F.lit(1))).isNotNull() & (F.get(f, F.lit(2)).isNull() | fit_parts(F.get(f, F.lit(2))).isNotNull()))
            return F.when(thread, "thread").when(chamfer, "chamfer").when((F.size(f) == 8) & classes & (p != "M"), "body")

        return let(found, lambda f: let(how(f), lambda h: read(t, m, q, s, mark, p, r, f, h)))

    def read(t: Column, m: Column, q: Column, s: Column, mark: Column, p: Column, r: Column, f: Column, h: Column) -> Column:
        own = lambda c: F.when(h == "body", c)
        part = lambda i: own(F.get(f, F.lit(i)))
        value = F.coalesce(part(0), F.when(h.isNotNull(), F.regexp_extract(r, f"^{_PLAIN}", 0)))
        form = F.when(part(3).isNotNull(), "symmetric").when(part(4).isNotNull(), "deviations").when(part(6).isNotNull(), "limits").otherwise(F.lower(part(7)))
        return let(value, lambda v: let(form, lambda k: finished(t, m, q, s, mark, p, r, h, v, k, part)))

    def finished(t: Column, m: Column, q: Column, s: Column, mark: Column, p: Column, r: Column, h: Column, v: Column, k: Column, part: Callable[[int], Column]) -> Column:
        known = h.isNotNull()
        degrees = (h == "body") & v.rlike("[°']")
        kind = (
            F.when(~known, F.when(t.rlike("[\\p{L}]{3,}"), "note").otherwise("other")).when(h != "body", h).when(p.isin("Ø", "SØ"), "diameter").when(p == "R", "radius")
            .when(p == "SR", "spherical_radius").when(p == "C", "chamfer").when(p == "↧", "depth").when(degrees, "angle").otherwise("linear")
        )
        whole_limits = v.rlike("^[0-9]+$") & F.coalesce(k == "limits", F.lit(False))
        notation = F.coalesce((h == "body") & r.rlike(f"(^|[^0-9])[.,][0-9]|{_PART}") & ~r.contains("°") & ~whole_limits, F.lit(False))
        first = F.when(k == "symmetric", part(3)).when(k == "deviations", part(4)).when(k == "limits", v)
        second = F.when(k == "deviations", part(5)).when(k == "limits", part(6))
        pair = F.when(part(2).isNotNull(), F.concat(part(1), F.lit("/"), part(2))).otherwise(part(1))
        hints = lambda n: F.array_compact(F.array(F.when(n & ~mark, "inch_notation"), F.when(t.rlike("[0-9],[0-9]"), "decimal_comma"), F.when(part(2).isNotNull(), "fit_pair")))
        unit = lambda kd, n: F.when(known, F.when(kd == "angle", "deg").when(mark | n, "in").otherwise(F.lit(drawing_unit)))
        number = lambda c: let(c, written_value)
        scale = F.when(known, let(_number(F.replace(v, F.lit("°"), F.lit(""))), written_scale))
        return let(notation, lambda n: let(kind, lambda kd: F.struct(
            F.when(known, F.greatest(F.coalesce(q, F.lit(1)), F.lit(1))).otherwise(1).alias("quantity"), kd.alias("kind"), F.when(known, m).alias("marking"), number(v).alias("nominal"), scale.alias("scale"), pair.alias("fit"), k.alias("tol_kind"),
            number(first).alias("tol_a"), number(second).alias("tol_b"), unit(kd, n).alias("unit"), hints(n).alias("hints"), known.alias("parse_ok"), F.when(known & (s != ""), s).alias("suffixes"),
        )))

    # a page of prose is known by its first words; signs that tidy text has as letters count as letters
    null = lambda kind: F.lit(None).cast(kind)
    unread = F.struct(
        F.lit(1).alias("quantity"), F.when(text.rlike("[\\p{L}⌀×]{3,}"), "note").otherwise("other").alias("kind"), null("string").alias("marking"), null(DEC).alias("nominal"), null("int").alias("scale"), null("string").alias("fit"), null("string").alias("tol_kind"),
        null(DEC).alias("tol_a"), null(DEC).alias("tol_b"), null("string").alias("unit"), F.array_compact(F.array(F.when(text.rlike("[0-9],[0-9]"), "decimal_comma"))).alias("hints"), F.lit(False).alias("parse_ok"), null("string").alias("suffixes"),
    )
    return F.when(text.rlike(_PROSE), unread).otherwise(let(F.trim(F.coalesce(tidy, F.lit(""))), bare))


def callouts(rows: DataFrame, text: str = "requirement_text", drawing_unit: str = "mm") -> DataFrame:
    """Quantity, kind, marking, nominal, scale, fit, tol_kind, tol_a, tol_b, unit, hints, parse_ok and suffixes of each text.

    Brackets, quantity, suffixes and unit are taken off in turn; one pattern, anchored at both ends, reads what is left. A text that fits
    none is a note (a word of three letters) or other. Lengths without a unit are inches if a number is written as in inches (no zero
    before the point, a fraction), else in `drawing_unit`. A null text is other.
    """
    fields = ("quantity", "kind", "marking", "nominal", "scale", "fit", "tol_kind", "tol_a", "tol_b", "unit", "hints", "parse_ok", "suffixes")
    return rows.withColumn("_callout", callout(F.col(text), drawing_unit)).select(*[c for c in rows.columns if c not in fields], "_callout.*")


def callouts_once(rows: DataFrame, text: str = "requirement_text", drawing_unit: str = "mm") -> DataFrame:
    """callouts() for texts that repeat, as a drawing's do: each distinct text is read once, into a table that rows then meet.

    What follows starts from that table, so that its plan does not hold the reading. A null text is read as an empty one.
    """
    return once(rows, lambda texts: callouts(texts, "callout_text", drawing_unit), text)


def once(rows: DataFrame, of: Callable[[DataFrame], DataFrame], text: str = "requirement_text") -> DataFrame:
    """Columns that follow from a text alone: `of` makes them of distinct texts (column callout_text), and rows meet its table. A column that rows had of the same name is replaced."""
    key = F.coalesce(F.col(text).cast("string"), F.lit(""))
    made = written(of(rows.select(key.alias("callout_text")).distinct()), "callouts")
    return rows.drop(*[c for c in made.columns if c != "callout_text"]).withColumn("callout_text", key).join(made, "callout_text", "left").drop("callout_text")


def sheet_kinds(objects: DataFrame) -> DataFrame:
    """Of counts for each sheet (readable, unmapped, image_cover): vector_text, raster or outlined."""
    text = (F.col("readable") >= 10) & (F.col("unmapped") * 2 <= F.col("readable") + F.col("unmapped"))
    return objects.withColumn("sheet_kind", F.when(text, "vector_text").when(F.least("image_cover", F.lit(1.0)) >= 0.5, "raster").otherwise("outlined"))


def sheet_fonts(objects: DataFrame) -> DataFrame:
    """sheet_id, name, embedded and text_objects of each font that text objects (sheet_id, font, embedded) use, without the tag of a subset (six capitals and a plus). Objects without a font are left out."""
    name = F.regexp_replace("font", "^[A-Z]{6}[+]", "")
    return objects.where("font IS NOT NULL").groupBy("sheet_id", name.alias("name")).agg(F.max("embedded").alias("embedded"), F.count("*").alias("text_objects"))


FIELDS = ("kind", "nominal", "upper_limit", "lower_limit", "rule", "inspect")


def compared(truth: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """For each truth row its wrong fields; not exactly one proposal is a failure too."""
    one = proposals.groupBy(key).agg(F.count("*").alias("n"), F.first(F.struct(*FIELDS)).alias("p"))
    rows = truth.join(one, key, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in FIELDS]))
    return rows.withColumn("wrong", F.when(F.coalesce("n", F.lit(0)) != 1, F.array(F.lit("proposals"))).otherwise(wrong)).drop("n", "p").withColumn("correct", F.size("wrong") == 0)


# Categories of extraction, in the order of reports
CATEGORIES = ("linear_general", "diameter_general", "radius_general", "angle_general", "chamfer_general", "symmetric", "asymmetric", "one_sided", "limit", "fit", "fit_printed", "thread", "reference", "other")


def category(kind: Column, tol_kind: Column, fit: Column, marking: Column) -> Column:
    """By what a text says alone."""
    return F.coalesce(marking, F.when(fit.isNotNull(), "fit"), tol_kind, kind)


def truth_category(text: Column, kind: Column, nominal: Column, upper: Column, lower: Column, fit: Column, rule: Column, inspect: Column) -> Column:
    """Q2: one of CATEGORIES, from the fields of a truth row and its text."""
    explicit = F.coalesce(rule == "explicit", F.lit(False))
    signed = text.rlike("\\s(?:[+−-]\\S*|0(?=\\s|$))")
    general = [F.when(kind == k, f"{k}_general") for k in ("linear", "diameter", "radius", "angle", "chamfer")]
    return (
        F.when(nominal.isNull(), "other").when(~inspect, F.when(text.startswith("(") | text.contains("REF"), "reference").otherwise("other")).when(kind == "thread", "thread")
        .when(fit.isNotNull(), F.when(explicit, "fit_printed").otherwise("fit")).when(explicit & text.contains("±"), "symmetric").when(explicit & (text.contains("MIN") | text.contains("MAX")), "other")
        .when(explicit & ~signed, "limit").when(explicit & (upper.isNull() | lower.isNull()), "other").when(explicit & ((upper == nominal) | (lower == nominal)), "one_sided").when(explicit, "asymmetric")
        .otherwise(F.coalesce(*general, F.lit("other")))
    )


def tally(cases: DataFrame) -> DataFrame:
    """Q6, Q7: count, correct, percent to one decimal, rounded half up by integers, and the 99 percent gate, by category and in all."""
    rows = cases.groupingSets([["category"], []], "category").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return rows.select(F.coalesce("category", F.lit("total")).alias("category"), "n", "n_correct", (F.expr("(n_correct * 2000 + n) div (2 * n)") / 10.0).alias("percent"), (F.col("n_correct") * 100 >= F.col("n") * 99).alias("passes"))


def tally_by_trait(cases: DataFrame) -> DataFrame:
    """Q6: counts as in tally(), by category, by each trait of the array `traits`, and in all, in one pass: a case is given to each group that it is in."""
    groups = F.concat(F.array(F.struct(F.lit("category").alias("of"), F.col("category").alias("name")), F.struct(F.lit("total").alias("of"), F.lit("total").alias("name"))), F.transform("traits", lambda t: F.struct(F.lit("trait").alias("of"), t.alias("name"))))
    rows = cases.select(F.explode(groups).alias("g"), "correct").groupBy("g.of", "g.name").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return rows.select("of", "name", "n", "n_correct", (F.expr("(n_correct * 2000 + n) div (2 * n)") / 10.0).alias("percent"), (F.col("n_correct") * 100 >= F.col("n") * 99).alias("passes"))
