"""Callouts in the forms that drawings have."""

from decimal import Decimal as D

from gaugeworks.operators import extract

# text: quantity, kind, nominal, fit, tolerance form, its two numbers, unit
FORMS = {
    "100": (1, "linear", "100", None, None, None, None, "mm"), "400": (1, "linear", "400", None, None, None, None, "mm"), "Ø200": (1, "diameter", "200", None, None, None, None, "mm"), "100 mm": (1, "linear", "100", None, None, None, None, "mm"),
    ".500": (1, "linear", "0.5", None, None, None, None, "in"), '1.000"': (1, "linear", "1", None, None, None, None, "in"), "12.00": (1, "linear", "12", None, None, None, None, "mm"), "S⌀10": (1, "diameter", "10", None, None, None, None, "mm"),
    "DIA 12": (1, "diameter", "12", None, None, None, None, "mm"), "4XØ6.6": (4, "diameter", "6.6", None, None, None, None, "mm"), "4 × Ø6,6 THRU": (4, "diameter", "6.6", None, None, None, None, "mm"), "2 PL R5": (2, "radius", "5", None, None, None, None, "mm"),
    "R5 3 PLACES": (3, "radius", "5", None, None, None, None, "mm"), "4X 12.5": (4, "linear", "12.5", None, None, None, None, "mm"), "4X 1x45°": (4, "chamfer", "1", None, None, None, None, "mm"), "0.5 x 30°": (1, "chamfer", "0.5", None, None, None, None, "mm"),
    "2X 30°": (1, "chamfer", "2", None, None, None, None, "mm"), "C 0.5": (1, "chamfer", "0.5", None, None, None, None, "mm"), "M8x1.25-6H": (1, "thread", "8", None, None, None, None, "mm"), "M10x1-5H6H": (1, "thread", "10", None, None, None, None, "mm"),
    "4X M6 THRU": (4, "thread", "6", None, None, None, None, "mm"), "Ø30H7": (1, "diameter", "30", "H7", None, None, None, "mm"), "Ø30 H7/g6": (1, "diameter", "30", "H7/g6", None, None, None, "mm"), "Ø25 H7 +0.021 0": (1, "diameter", "25", "H7", "deviations", "0.021", "0", "mm"),
    "Ø8 f7-0.0127-0.0279": (1, "diameter", "8", "f7", "deviations", "-0.0127", "-0.0279", "mm"), "20 h9": (1, "linear", "20", "h9", None, None, None, "mm"), "50 +/-0.1": (1, "linear", "50", None, "symmetric", "0.1", None, "mm"), "50 +-0.1": (1, "linear", "50", None, "symmetric", "0.1", None, "mm"),
    "25+0.1-0.05": (1, "linear", "25", None, "deviations", "0.1", "-0.05", "mm"), "25 +0.1/-0.05": (1, "linear", "25", None, "deviations", "0.1", "-0.05", "mm"), "25 +0.1 −0.05": (1, "linear", "25", None, "deviations", "0.1", "-0.05", "mm"), "100 0 -0.6": (1, "linear", "100", None, "deviations", "0", "-0.6", "mm"),
    "100 +0 -0.6": (1, "linear", "100", None, "deviations", "0", "-0.6", "mm"), "12.02-11.98": (1, "linear", "12.02", None, "limits", "12.02", "11.98", "mm"), "10-12": (1, "linear", "10", None, "limits", "10", "12", "mm"), "12/11": (1, "linear", "12", None, "limits", "12", "11", "mm"),
    "12.02 11.98": (1, "linear", "12.02", None, "limits", "12.02", "11.98", "mm"), "R0.5 MAX": (1, "radius", "0.5", None, "max", None, None, "mm"), "12 max": (1, "linear", "12", None, "max", None, None, "mm"), "1/4": (1, "linear", "0.25", None, None, None, None, "in"), '1/2"': (1, "linear", "0.5", None, None, None, None, "in"),
    "1 1/4": (1, "linear", "1.25", None, None, None, None, "in"), '1 127/128"': (1, "linear", "1.9921875", None, None, None, None, "in"), '1.250" ±.005"': (1, "linear", "1.25", None, "symmetric", "0.005", None, "in"), "Ø.500 ±.005": (1, "diameter", "0.5", None, "symmetric", "0.005", None, "in"), "2.5in": (1, "linear", "2.5", None, None, None, None, "in"),
    "12°30'15\"": (1, "angle", "12.504166666667", None, None, None, None, "deg"), "30° 15'": (1, "angle", "30.25", None, None, None, None, "deg"), "30° ±30'": (1, "angle", "30", None, "symmetric", "0.5", None, "deg"), "30° ±0.5": (1, "angle", "30", None, "symmetric", "0.5", None, "deg"), "90.0° +0.0° −0.1°": (1, "angle", "90", None, "deviations", "0", "-0.1", "deg"),
    "(4X Ø6)": (4, "diameter", "6", None, None, None, None, "mm"), "( 42 )": (1, "linear", "42", None, None, None, None, "mm"), "42 REF": (1, "linear", "42", None, None, None, None, "mm"), "[30°]": (1, "angle", "30", None, None, None, None, "deg"), "Ø30 H7\n+0.0203\n-0": (1, "diameter", "30", "H7", "deviations", "0.0203", "0", "mm"),
    "Ø30 H99": (1, "other", None, None, None, None, None, None), "12 0 0": (1, "other", None, None, None, None, None, None), "Ø": (1, "other", None, None, None, None, None, None), "1.2.3": (1, "other", None, None, None, None, None, None), "deburr all edges": (1, "note", None, None, None, None, None, None), "": (1, "other", None, None, None, None, None, None),
}


def test_forms(spark):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(FORMS)], "requirement_text string, _q int")
    got = {r["requirement_text"]: r for r in extract.callouts(df.drop("_q")).collect()}
    number = lambda x: None if x is None else D(x)
    bad = {}
    for text, (quantity, kind, nominal, fit, form, a, b, unit) in FORMS.items():
        r = got[text]
        have = tuple(r[c] for c in ("quantity", "kind", "nominal", "fit", "tol_kind", "tol_a", "tol_b", "unit", "parse_ok"))
        want = (quantity, kind, number(nominal), fit, form, number(a), number(b), unit, nominal is not None)
        if have != want:
            bad[text] = (have, want)
    assert not bad, "\n".join(f"{t!r}: {h}\n    {w}" for t, (h, w) in bad.items())
    marks = {t: got[t]["marking"] for t in ("(4X Ø6)", "( 42 )", "42 REF", "[30°]", "100")}
    assert marks == {"(4X Ø6)": "reference", "( 42 )": "reference", "42 REF": "reference", "[30°]": "basic", "100": None}
    assert got["1/4"]["hints"] == ["inch_notation"] and got['1/2"']["hints"] == [] and got["Ø30 H7/g6"]["hints"] == ["fit_pair"] and got["4X M6 THRU"]["suffixes"] == "THRU" and got["90.0° +0.0° −0.1°"]["scale"] == 1


def test_null_text(spark):
    r = extract.callouts(spark.createDataFrame([(None,)], "requirement_text string")).first()
    assert (r["quantity"], r["nominal"], r["parse_ok"], r["hints"]) == (1, None, False, [])
