"""The levels of the tolerance cascade, units and hints."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import extract, tolerance

SHOP = {"table": {"id": "shop", "version": 1, "kind": "custom", "status": "draft"}, "part": [{"id": "linear", "kind": "symmetric", "applies_to": "linear", "columns": ["a"], "rows": [{"min_exclusive": "0", "max_inclusive": "50", "values": ["0.07"]}, {"min_exclusive": "50", "max_exclusive": "100", "values": ["-"]}]}]}


def run(spark, texts, **options):
    cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS, SHOP)
    df = spark.createDataFrame([(t, leg) for t, leg in texts], "requirement_text string, leg string").withColumn("shorter_leg", F.col("leg").cast(DEC))
    rows = tolerance.derived(extract.callouts(df), cells, **options).collect()
    return {r["requirement_text"]: r for r in rows}


def limits(r):
    return r["rule"], r["lower_limit"], r["upper_limit"]


def test_levels(spark):
    got = run(spark, [(t, None) for t in ("100", "Ø25 H7", "Ø25 H7 +0.021 0", "Ø25 H7 +0.02 0", "Ø25 Z18", "60", "M8", "(42)", "12.5", "R3", "Ø30 H7/g6")], general_class="m", drawing_rule=("shop", "a"), decimal_rules=[(1, "0.25")])
    assert limits(got["100"]) == ("general", D("99.7"), D("100.3")) and got["100"]["hints"] == ["drawing_rule_out_of_range"]
    assert limits(got["Ø25 H7"]) == ("fit", D("25"), D("25.021"))
    assert limits(got["Ø25 H7 +0.021 0"]) == ("explicit", D("25"), D("25.021")) and got["Ø25 H7 +0.021 0"]["hint"] is None
    assert got["Ø25 H7 +0.02 0"]["hint"] == "fit_deviations_differ" and got["Ø25 Z18"]["rule"] == "fit" and got["Ø25 Z18"]["upper_limit"] is None and got["Ø25 Z18"]["hint"].startswith("fit_")
    assert got["60"]["hint"] == "drawing_rule_not_defined" and limits(got["60"])[0] == "general"
    assert got["M8"]["rule"] == "no_tolerance_defined" and got["M8"]["inspect_now"] and not got["(42)"]["inspect_now"] and got["(42)"]["hints"] == ["reference_dimension"]
    assert limits(got["12.5"]) == ("drawing_rule", D("12.43"), D("12.57")) and limits(got["R3"]) == ("general", D("2.8"), D("3.2"))
    assert got["Ø30 H7/g6"]["rule"] == "fit" and got["Ø30 H7/g6"]["upper_limit"] is None and "fit_pair" in got["Ø30 H7/g6"]["hints"]


def test_custom_table_and_decimal_rule(spark):
    got = run(spark, [("12", None), ("200.5", None), ("200.55", None)], general_class="a", general_table="shop", decimal_rules=[(1, "0.25")])
    assert limits(got["12"]) == ("custom_table", D("11.93"), D("12.07")) and limits(got["200.5"]) == ("decimal_places", D("200.25"), D("200.75"))
    assert limits(got["200.55"]) == ("no_tolerance_defined", None, None) and got["200.55"]["hints"] == ["general_out_of_range"]


def test_angles_need_their_shorter_leg(spark):
    got = run(spark, [("30°", None), ("45°", "20")], decimal_rules=[(0, "1")])
    assert limits(got["30°"]) == ("no_tolerance_defined", None, None) and got["30°"]["note"] == "shorter_leg_unknown" and got["30°"]["hints"] == []
    assert limits(got["45°"]) == ("general", D("44.5"), D("45.5")) and got["45°"]["note"] is None and got["45°"]["out_unit"] == "deg"


def test_units(spark):
    inch = run(spark, [('1.000"', None), ('1.250" ±.005"', None), ('Ø1.000" H7', None)])
    # one inch is 25.4 mm: 0.2 mm of the table, and limits rounded inward to four places
    assert limits(inch['1.000"']) == ("general", D("0.9922"), D("1.0078")) and (inch['1.000"']["upper_dev"], inch['1.000"']["out_unit"]) == (D("0.0078"), "in")
    assert limits(inch['1.250" ±.005"']) == ("explicit", D("1.245"), D("1.255")) and limits(inch['Ø1.000" H7']) == ("fit", D("1"), D("1.0008"))
    mm = run(spark, [('1.250" ±.005"', None), ("20 ±0.1", None)], output_unit="mm")
    r = mm['1.250" ±.005"']
    assert (r["out_nominal"], *limits(r)) == (D("31.75"), "explicit", D("31.623"), D("31.877")) and limits(mm["20 ±0.1"])[1:] == (D("19.9"), D("20.1"))
    back = run(spark, [("25.4", None), ("50.8 +0.0254 -0.00254", None)], output_unit="in")
    assert back["25.4"]["out_nominal"] == D("1") and limits(back["50.8 +0.0254 -0.00254"])[1:] == (D("1.9999"), D("2.001"))


def test_inches_are_exact(spark):
    values = ["25.4", "25.39999", "-25.4", "-25.39999", "0", "0.00127", "-0.00127", "0.00126", "12345.678901"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v"), F.col("v").cast(DEC).alias("d"))
    for r in df.select("v", *[tolerance.inches(F.col("d"), 4, h).alias(h) for h in ("upper", "lower", "nominal")]).collect():
        q = D(r["v"]) / D("25.4") * 10_000
        floor = q.to_integral_value(rounding="ROUND_FLOOR")
        assert (r["upper"], r["lower"]) == (floor / 10_000, q.to_integral_value(rounding="ROUND_CEILING") / 10_000), r
        assert r["nominal"] == q.to_integral_value(rounding="ROUND_HALF_UP") / 10_000, r
