"""Fits of all sizes against published limit deviations (mm)."""

from decimal import Decimal

from gaugeworks.operators import tolerance

# Class, size, upper and lower deviation; `-` is none
VECTORS = """
h7 120 0 -0.035;h8 250 0 -0.072;h9 400 0 -0.14;g6 80 -0.01 -0.029;f7 180 -0.043 -0.083;e8 315 -0.11 -0.191;d9 500 -0.23 -0.385;m6 120 0.035 0.013;n6 250 0.06 0.031;p6 400 0.098 0.062;
js7 80 0.015 -0.015;JS7 180 0.02 -0.02;JS8 315 0.0405 -0.0405;h6 400.001 0 -0.04;JS7 80.001 0.0175 -0.0175;k6 180.001 0.033 0.004;p6 315.001 0.098 0.062;M6 315.001 -0.01 -0.046;C8 140 0.263 0.2;C8 315 0.411 0.33;
E8 50.001 0.106 0.06;D7 400 0.267 0.21;F6 250 0.079 0.05;G6 250 0.044 0.015;JS8 500 0.0485 -0.0485;K8 180 0.02 -0.043;K6 500 0.008 -0.032;N11 250 0 -0.29;P8 80 -0.032 -0.078;R8 50.001 -0.041 -0.087;
R7 225 -0.063 -0.109;R6 500 -0.119 -0.159;S8 180 -0.108 -0.171;S6 450 -0.219 -0.259;U6 100 -0.117 -0.139;U8 140.001 -0.19 -0.253;T6 250 -0.187 -0.216;U7 315.001 -0.369 -0.426;c8 80 -0.15 -0.196;c8 315 -0.33 -0.411;
d8 400 -0.21 -0.299;f8 80 -0.03 -0.076;g7 80.001 -0.012 -0.047;js8 400.001 0.0485 -0.0485;n7 315.001 0.094 0.037;r7 100 0.086 0.051;r7 355 0.165 0.108;s6 180 0.133 0.108;s8 450 0.329 0.232;u7 100 0.159 0.124;
u9 140.001 0.29 0.19;u6 250 0.313 0.284;u8 315.001 0.479 0.39;js9 120 0.0435 -0.0435;K9 2 0 -0.025;K9 4 - -;M6 18 -0.004 -0.015;M6 250 -0.008 -0.037;M6 250.001 -0.009 -0.041;M6 300 -0.009 -0.041;M6 315 -0.009 -0.041;
N9 18 0 -0.043;N9 1 - -;N9 2 -0.004 -0.029;M6 6 -0.001 -0.009;N9 6.001 0 -0.036;M6 50 -0.004 -0.02;H6 120 0.022 0;H7 180 0.04 0;H8 120 0.054 0;H9 180 0.1 0;H10 120 0.14 0;H7 600 - -;x6 20 - -;e8 10 -0.025 -0.047;K7 20 0.006 -0.015
"""


def test_published_deviations(spark):
    rows = [(i, *v.split()) for i, v in enumerate(VECTORS.replace("\n", "").split(";"))]
    df = spark.createDataFrame([(i, f, Decimal(n)) for i, f, n, _, _ in rows], "id int, fit string, nominal decimal(28,12)")
    got = {r["id"]: (r["fit_upper"], r["fit_lower"]) for r in tolerance.expanded_fits(df, tolerance.table_cells(spark, tolerance.FITS)).collect()}
    for i, f, n, up, low in rows:
        assert got[i] == (None if up == "-" else Decimal(up), None if low == "-" else Decimal(low)), (f, n, got[i])


def test_table_has_no_issue(spark):
    assert tolerance.table_issues(tolerance.table_cells(spark, tolerance.FITS)).collect() == []


def test_range_of_a_fit(spark):
    """The grade's range counts where the deviation is the same beyond it; rows of one value are one range."""
    df = spark.createDataFrame([("N9", Decimal(20)), ("M6", Decimal(300))], "fit string, nominal decimal(28,12)")
    got = {r["fit"]: (int(r["range_lo"]), r["range_lo_incl"], int(r["range_hi"]), r["range_hi_incl"]) for r in tolerance.expanded_fits(df, tolerance.table_cells(spark, tolerance.FITS)).collect()}
    assert got == {"N9": (18, False, 30, True), "M6": (250, False, 315, True)}
