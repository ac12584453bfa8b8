"""Queries on verdicts, tolerances, numbers, extraction, history and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import exprs as X
from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import evaluate, extract, history, numbering, report, tolerance
from gaugeworks.plans import base
from gaugeworks.plans.base import CTE, STATE, load
from gaugeworks.streaming import live

QUERIES = {}
SQL: dict[str, str] = {}


def _item() -> Column:
    """A number for each line."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.measurement_state(base.characteristics(spark, sf), base.samples(spark, sf), base.results(spark, sf))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judged(base.characteristics(spark, sf), base.results(spark, sf))


# --- verdicts

query("v4_measurement_state", f"WITH {STATE} SELECT grain, project_id, key, pass, fail, not_evaluated, missing, verdict FROM st")(_state)
query("v5_progress", f"WITH {STATE} SELECT project_id, count(*) FILTER (grain = 'characteristic') AS n_characteristics, count(*) FILTER (grain = 'sample') AS n_samples, CASE WHEN count(*) FILTER (grain = 'characteristic') > 0 THEN count(*) FILTER (grain = 'sample' AND missing = 0) ELSE 0 END AS n_complete FROM st GROUP BY project_id")(
    lambda s, sf: evaluate.progress(_state(s, sf))
)
query("j1_grid", f"WITH {CTE} SELECT project_id, char_id, sample_id, pos AS sample_pos, verdict, position FROM dense")(
    lambda s, sf: evaluate.grid(base.characteristics(s, sf), base.samples(s, sf), base.results(s, sf)).select("project_id", "char_id", "sample_id", "sample_pos", "verdict", "position")
)
query("v1_judged_cells", f"WITH {CTE} SELECT project_id, sample_id, char_id, verdict, position FROM dense WHERE verdict <> 'missing'")(
    lambda s, sf: _judged(s, sf).select("project_id", "sample_id", "char_id", "verdict", "position")
)


@query("v6_type_conflicts", f"WITH {CTE} SELECT c.project_id, c.char_id, CASE WHEN c.char_id % 2 = 0 THEN 'attribute' ELSE 'variable' END AS wanted, CASE WHEN c.char_id % 2 = 0 THEN count(value) ELSE count(attribute) END AS n_against, CASE WHEN count(value) > 0 THEN 'variable' WHEN count(attribute) > 0 THEN 'attribute' WHEN c.char_id % 2 = 0 THEN 'attribute' ELSE 'variable' END AS effective FROM ch c LEFT JOIN res r ON c.project_id = r.project_id AND c.char_id = r.char_id GROUP BY c.project_id, c.char_id")
def type_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.type_conflicts(base.characteristics(spark, sf), base.results(spark, sf), F.when(F.col("char_id") % 2 == 0, "attribute").otherwise("variable"))


TYPED = "CASE l_partkey % 5 WHEN 0 THEN '1' || replace(CAST(CAST(l_discount AS DECIMAL(12,2)) AS VARCHAR), '.', ',') WHEN 1 THEN ' OK ' WHEN 2 THEN 'n.i.o.' WHEN 3 THEN '1e3' ELSE '' END"


@query(
    "v7_typed_results",
    f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS m, l_discount AS d, {TYPED} AS text FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN m = 0 THEN CAST(replace(text, ',', '.') AS DECIMAL(28,12)) END AS value, CASE WHEN m = 0 THEN 2 END AS scale, CASE m WHEN 1 THEN 'ok' WHEN 2 THEN 'not_ok' END AS attribute, m = 4 AS cleared, m <> 3 AS ok FROM t",
)
def typed_results(spark: SparkSession, sf: str) -> DataFrame:
    m, d = F.col("l_partkey") % 5, F.replace(F.col("l_discount").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    text = F.when(m == 0, F.concat(F.lit("1"), d)).when(m == 1, " OK ").when(m == 2, "n.i.o.").when(m == 3, "1e3").otherwise("")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.parsed_result(text).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("h9_result_upsert", "WITH e AS (SELECT l_suppkey AS project_id, l_orderkey AS sample_id, l_partkey AS char_id, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS q FROM lineitem WHERE l_partkey % 3 < 2 GROUP BY 1, 2, 3), r AS (SELECT l_suppkey AS project_id, l_orderkey AS sample_id, l_partkey AS char_id, max(l_linenumber) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT r.project_id, r.sample_id, r.char_id, CAST(CASE WHEN e.q IS NULL THEN r.v ELSE CAST(q AS INT) END AS DECIMAL(28,12)) AS value FROM r LEFT JOIN e USING (project_id, sample_id, char_id) WHERE NOT (char_id % 3 = 0)")
def result_upsert(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("char_id"), "l_linenumber", "l_quantity")
    key = ["project_id", "sample_id", "char_id"]
    have = lines.groupBy(*key).agg(F.max("l_linenumber").cast(DEC).alias("value")).select(*key, "value", F.lit(0).alias("value_scale"), F.lit(None).cast("string").alias("attribute"), F.lit("").alias("comment"))
    typed = F.when(F.col("char_id") % 3 == 0, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    entries = lines.where("char_id % 3 < 2").select(*key, typed.alias("text"), F.lit(None).cast("string").alias("comment"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq"))
    return evaluate.upserted(have, entries)[0].select(*key, "value")


query("j16_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 97 = 0")(
    lambda s, sf: load(s, sf, "lineitem").join(load(s, sf, "part").where("p_partkey % 97 <> 0"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_orderkey", "l_linenumber")
)
query("c1_serial_issues", "SELECT project_id, sample_id, unnest(reasons) AS reason FROM (SELECT o_custkey AS project_id, o_orderkey AS sample_id, list_filter([CASE WHEN trim(serial) = '' THEN 'empty_serial' END, CASE WHEN trim(serial) <> serial THEN 'untrimmed_serial' END, CASE WHEN count(*) OVER (PARTITION BY o_custkey, serial) > 1 THEN 'duplicate_serial' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' a' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS serial FROM orders))")(
    lambda s, sf: evaluate.serial_issues(load(s, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, " a").otherwise((F.col("o_orderkey") % 7).cast("string")).alias("serial")))
)

# --- tolerances

_M = "CASE WHEN s < 0.5 OR s > 4000 THEN NULL WHEN s <= 6 THEN 0.1 WHEN s <= 30 THEN 0.2 WHEN s <= 120 THEN 0.3 WHEN s <= 400 THEN 0.5 WHEN s <= 1000 THEN 0.8 WHEN s <= 2000 THEN 1.2 ELSE 2 END"


@query("j6_general_tolerance", f"WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) / 100 AS s FROM orders) SELECT o_orderkey, CAST({_M} AS DECIMAL(28,12)) AS tolerance, CASE WHEN s >= 0.5 AND s <= 4000 THEN 'value' ELSE 'out_of_range' END AS found FROM t")
def general(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", F.lit("linear").alias("kind"), (F.col("o_totalprice").cast("decimal(12,2)") / 100).cast(DEC).alias("nominal"))
    return tolerance.general_tolerance(rows, tolerance.table_cells(spark, tolerance.GENERAL)).select("o_orderkey", "tolerance", "found")


_IT = {6: (6, 8, 9, 11, 13, 16), 7: (10, 12, 15, 18, 21, 25)}
_STEP = lambda v: "CASE " + " ".join(f"WHEN p_size <= {s} THEN {x}" for s, x in zip((3, 6, 10, 18, 30, 50), v, strict=True)) + " END"


@query(
    "t4_fit_expansion",
    f"""WITH f AS (SELECT p_partkey, ['H7', 'g6', 'js7', 'k6', 'N7', 'x9'][p_partkey % 6 + 1] AS fit, {_STEP(_IT[6])} AS i6, {_STEP(_IT[7])} AS i7, {_STEP((-2, -4, -5, -6, -7, -9))} AS g, {_STEP((0, 1, 1, 1, 2, 2))} AS k, {_STEP((-4, -4, -4, -5, -7, -8))} AS n FROM part)
    SELECT p_partkey, fit, CAST(CASE fit WHEN 'H7' THEN i7 WHEN 'g6' THEN g WHEN 'js7' THEN i7 / 2.0 WHEN 'k6' THEN k + i6 WHEN 'N7' THEN n END / 1000.0 AS DECIMAL(28,12)) AS fit_upper,
    CAST(CASE fit WHEN 'H7' THEN 0 WHEN 'g6' THEN g - i6 WHEN 'js7' THEN -i7 / 2.0 WHEN 'k6' THEN k WHEN 'N7' THEN n - i7 END / 1000.0 AS DECIMAL(28,12)) AS fit_lower, CASE WHEN fit = 'x9' THEN 'unknown_column' ELSE 'value' END AS fit_found FROM f""",
)
def fits(spark: SparkSession, sf: str) -> DataFrame:
    fit = F.element_at(F.array(*map(F.lit, ("H7", "g6", "js7", "k6", "N7", "x9"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = load(spark, sf, "part").select("p_partkey", fit.alias("fit"), F.col("p_size").cast(DEC).alias("nominal"))
    return tolerance.expanded_fits(rows, tolerance.table_cells(spark, tolerance.FITS)).select("p_partkey", "fit", "fit_upper", "fit_lower", "fit_found")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """A callout for each part, of a form that its key chooses."""
    s = F.col("p_size").cast("string")
    forms = [s, F.concat(F.lit("Ø"), s), F.concat(F.lit("2x R"), s), F.concat(s, F.lit(" ±0,1")), F.concat(s, F.lit(" +0.2 -0.1")), F.concat(F.lit("Ø"), s, F.lit(" H7")), F.concat(F.lit("("), s, F.lit(")")), F.concat(F.lit("M"), s)]
    return load(spark, sf, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("requirement_text"))


@query(
    "e8_callouts",
    """SELECT p_partkey, CAST(CASE WHEN m = 2 THEN 2 ELSE 1 END AS INT) AS quantity, ['linear', 'diameter', 'radius', 'linear', 'linear', 'diameter', 'linear', 'thread'][m + 1] AS kind, CASE WHEN m = 6 THEN 'reference' END AS marking, CAST(p_size AS DECIMAL(28,12)) AS nominal, 0 AS scale,
    CASE WHEN m = 5 THEN 'H7' END AS fit, CASE m WHEN 3 THEN 'symmetric' WHEN 4 THEN 'deviations' END AS tol_kind, CAST(CASE m WHEN 3 THEN 0.1 WHEN 4 THEN 0.2 END AS DECIMAL(28,12)) AS tol_a, CAST(CASE m WHEN 4 THEN -0.1 END AS DECIMAL(28,12)) AS tol_b, 'mm' AS unit, true AS parse_ok FROM (SELECT *, p_partkey % 8 AS m FROM part)""",
)
def callouts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.callouts(_texts(spark, sf)).drop("requirement_text", "hints", "suffixes")


query("e12_free_text", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\p{L}]{3,}') THEN 'note' ELSE 'other' END AS kind, false AS parse_ok FROM documents")(
    lambda s, sf: extract.callouts(load(s, sf, "documents").select("doc_id", F.col("text").alias("requirement_text"))).select("doc_id", "kind", "parse_ok")
)

_CASCADE = f"""d AS (SELECT p_partkey, p_size, m, CASE WHEN m IN (6, 7) THEN 'no_tolerance_defined' WHEN m IN (3, 4) THEN 'explicit' WHEN m = 5 THEN 'fit' ELSE 'general' END AS rule,
  CAST(CASE m WHEN 3 THEN 0.1 WHEN 4 THEN 0.2 WHEN 5 THEN ({_STEP(_IT[7])}) / 1000.0 WHEN 2 THEN CASE WHEN p_size <= 3 THEN 0.2 WHEN p_size <= 6 THEN 0.5 ELSE 1 END WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE CASE WHEN p_size <= 6 THEN 0.1 WHEN p_size <= 30 THEN 0.2 ELSE 0.3 END END AS DECIMAL(28,12)) AS up FROM (SELECT *, p_partkey % 8 AS m FROM part)),
e AS (SELECT *, CAST(CASE m WHEN 4 THEN -0.1 WHEN 5 THEN 0 ELSE -up END AS DECIMAL(28,12)) AS low FROM d)"""


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)
    return tolerance.derived_once(_texts(spark, sf), cells)


query("t1_cascade", f"WITH {_CASCADE} SELECT p_partkey, rule, up AS upper_dev, low AS lower_dev, CAST(p_size + up AS DECIMAL(28,12)) AS upper_limit, CAST(p_size + low AS DECIMAL(28,12)) AS lower_limit, m <> 6 AS inspect_now FROM e")(
    lambda s, sf: _derived(s, sf).select("p_partkey", "rule", "upper_dev", "lower_dev", "upper_limit", "lower_limit", "inspect_now")
)


@query(
    "q6_extraction_tally",
    f"WITH {_CASCADE}, c AS (SELECT ['linear', 'diameter', 'radius', 'symmetric', 'deviations', 'fit', 'reference', 'thread'][m + 1] AS category, p_partkey % 50 <> 0 AS ok FROM e), g AS (SELECT coalesce(category, 'total') AS category, count(*) AS n, count(*) FILTER (ok) AS n_correct FROM c GROUP BY GROUPING SETS ((category), ())) SELECT *, ((n_correct * 2000 + n) // (2 * n)) / 10.0 AS percent, n_correct * 100 >= n * 99 AS passes FROM g",
)
def extraction_tally(spark: SparkSession, sf: str) -> DataFrame:
    """What the cascade proposes against itself, every fiftieth truth with another kind."""
    rows = _derived(spark, sf).withColumn("inspect", F.col("inspect_now"))
    truth = rows.withColumn("category", extract.category(F.col("kind"), F.col("tol_kind"), F.col("fit"), F.col("marking"))).withColumn("kind", F.when(F.col("p_partkey") % 50 == 0, "surface").otherwise(F.col("kind")))
    return extract.tally(extract.compared(truth.select("p_partkey", "category", *extract.FIELDS), rows.select("p_partkey", *extract.FIELDS), "p_partkey"))


@query(
    "t8_unit_conversion",
    "SELECT l_orderkey, l_linenumber, CAST(floor(v * 25.4 * 1000) / 1000 AS DECIMAL(28,12)) AS upper_mm, CAST(ceil(v * 25.4 * 1000) / 1000 AS DECIMAL(28,12)) AS lower_mm FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax AS DECIMAL(12,2)) + 0.0007 AS DECIMAL(28,12)) AS v FROM lineitem)",
)
def conversion(spark: SparkSession, sf: str) -> DataFrame:
    v = (F.col("l_tax").cast("decimal(12,2)") + F.lit("0.0007").cast("decimal(12,4)")).cast(DEC)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tolerance.converted(v, 3, "upper").alias("upper_mm"), tolerance.converted(v, 3, "lower").alias("lower_mm"))


@query("j7_span_lookup", "SELECT p_partkey, CAST(CASE WHEN p_size <= 6 THEN 0.5 WHEN p_size <= 30 THEN 6 ELSE 30 END AS DECIMAL(28,12)) AS span_lo, CAST(CASE WHEN p_size <= 6 THEN 6 WHEN p_size <= 30 THEN 30 ELSE 120 END AS DECIMAL(28,12)) AS span_hi FROM part")
def spans(spark: SparkSession, sf: str) -> DataFrame:
    cells = tolerance.span_table(tolerance.table_cells(spark, tolerance.GENERAL)).where("part_id = 'linear' and column = 'm'")
    sizes = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast(DEC).alias("size"), F.lit("m").alias("column"))
    bounds = F.struct("c.lo", "c.lo_incl", "c.hi", "c.hi_incl")
    return sizes.alias("s").join(F.broadcast(cells).alias("c"), (F.col("c.table_id") == "iso-2768-1") & (F.col("c.part_id") == "linear") & (F.col("s.column") == F.col("c.column")) & tolerance.holds(F.col("s.size"), bounds)).select("p_partkey", "span_lo", "span_hi")


# --- numbers

_XY = "(l_partkey * 37 + l_linenumber * 211) % 1190 AS x, (l_orderkey * 53 + l_linenumber * 97) % 842 AS y"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """A place for each line; suppliers are projects of one sheet, with a grid of 8 by 6 zones."""
    x, y = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 211) % 1190).cast("double"), ((F.col("l_orderkey") * 53 + F.col("l_linenumber") * 97) % 842).cast("double")
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("project_id"), _item().alias("item"), x.alias("x"), y.alias("y"), F.col("l_partkey").alias("group_key"))
    col = numbering.zone_cell(F.col("x"), F.lit(20.0), F.lit(1150.0), F.lit(8))
    row = numbering.zone_cell(F.col("y"), F.lit(20.0), F.lit(802.0), F.lit(6))
    return rows.withColumn("zone_rank", row * 8 + col).withColumn("pos", F.col("item")).withColumn("ordinal", F.lit(1)).withColumn("kind", F.lit("linear"))


_ZONES = f"""z AS (SELECT l_suppkey AS project_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS item, l_partkey AS group_key, {_XY} FROM lineitem),
zz AS (SELECT *, greatest(0, least(5, CAST(floor((y - 20) / 802.0 * 6) AS INT))) * 8 + greatest(0, least(7, CAST(floor((x - 20) / 1150.0 * 8) AS INT))) AS zone FROM z)"""
query("n5_zones", f"WITH {_ZONES} SELECT project_id, item, CAST(zone AS INT) AS zone_rank FROM zz")(lambda s, sf: _points(s, sf).select("project_id", "item", "zone_rank"))
query(
    "n4_reading_order",
    f"""WITH RECURSIVE {_ZONES}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id, zone ORDER BY y, x, item) AS k FROM zz),
    f AS (SELECT project_id, zone, k, item, x, y, y AS first_y, 0 AS line FROM o WHERE k = 1
      UNION ALL SELECT o.project_id, o.zone, o.k, o.item, o.x, o.y, CASE WHEN o.y <= f.first_y + 7 * 72 / 25.4 THEN f.first_y ELSE o.y END, CASE WHEN o.y <= f.first_y + 7 * 72 / 25.4 THEN f.line ELSE f.line + 1 END FROM f JOIN o ON o.project_id = f.project_id AND o.zone = f.zone AND o.k = f.k + 1)
    SELECT project_id, CAST(zone AS INT) AS zone_rank, item, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY project_id, zone ORDER BY line, x, y, item) - 1 AS INT) AS rank FROM f""",
)(lambda s, sf: numbering.reading_order(_points(s, sf).select("project_id", "zone_rank", "item", "x", "y"), ["project_id", "zone_rank"]).select("project_id", "zone_rank", "item", "line", "rank"))


@query("n10_zone_order", SQL["n4_reading_order"].replace("SELECT project_id, CAST(zone AS INT) AS zone_rank, item, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY project_id, zone ORDER BY line, x, y, item) - 1 AS INT) AS rank FROM f", "SELECT project_id, item, CAST(row_number() OVER (PARTITION BY project_id ORDER BY zone, line, x, y, item) AS INT) AS \"order\" FROM f"))
def zone_order(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.strategy_order(_points(spark, sf), "zone").select("project_id", "item", "order")


@query(
    "n12_display_numbers",
    """WITH o AS (SELECT l_suppkey AS project_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS item, l_partkey % 3 AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem),
    i AS (SELECT *, sum(CASE WHEN g = pg THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY k) AS base FROM (SELECT *, lag(g) OVER (PARTITION BY project_id ORDER BY k) AS pg FROM o)),
    r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project_id, base) > 1 THEN row_number() OVER (PARTITION BY project_id, base ORDER BY k) END AS sub FROM i)
    SELECT project_id, item, CAST(base AS INT) AS base, CAST(sub AS INT) AS sub, concat_ws('.', CAST(CAST(base AS INT) AS VARCHAR), CAST(sub AS VARCHAR)) AS number FROM r""",
)
def display_numbers(spark: SparkSession, sf: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    lines = load(spark, sf, "lineitem")
    rows = base.dealt(lines.select(F.col("l_suppkey").alias("project_id"), _item().alias("item"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), lines, "project_id")
    rows = rows.select("project_id", "item", (F.col("l_partkey") % 3).alias("group_key"), order.alias("order"))
    return numbering.display_numbers(rows, True).select("project_id", "item", "base", "sub", "number")


@query(
    "n11_gathered",
    "WITH o AS (SELECT l_suppkey AS project_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS item, l_partkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem), m AS (SELECT *, min(k) OVER (PARTITION BY project_id, g) AS lead FROM o) SELECT project_id, item, CAST(row_number() OVER (PARTITION BY project_id ORDER BY lead, k) AS INT) AS \"order\" FROM m",
)
def gathered(spark: SparkSession, sf: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("project_id"), _item().alias("item"), F.col("l_partkey").alias("group_key"), order.alias("order"))
    return numbering.gathered(rows).select("project_id", "item", "order")


@query("j3_first_balloon", "SELECT l_partkey AS char_id, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS sheet_id FROM lineitem GROUP BY 1")
def first_balloon(spark: SparkSession, sf: str) -> DataFrame:
    """Of lines with the same number in one order the one that stands first in the table."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = load(spark, sf, "lineitem").select(F.lit(1).alias("project_id"), F.col("l_partkey").alias("char_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").alias("sheet_id"), *place)
    return numbering.first_balloons(rows, ("file", "row")).select("char_id", "sheet_id")


@query("j10_views", f"WITH {_ZONES} SELECT project_id, item, CASE WHEN x BETWEEN 100 AND 400 AND y BETWEEN 100 AND 300 THEN 1 WHEN x BETWEEN 50 AND 800 AND y BETWEEN 50 AND 700 THEN 0 END AS view_no FROM zz")
def views(spark: SparkSession, sf: str) -> DataFrame:
    view = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    sheets = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit(1).alias("sheet_id"), F.array(view(50.0, 50.0, 750.0, 650.0), view(100.0, 100.0, 300.0, 200.0)).alias("views"))
    return numbering.view_of(_points(spark, sf).withColumn("sheet_id", F.lit(1)), sheets).select("project_id", "item", "view_no")


@query("n16_new_serials", "WITH t AS (SELECT o_custkey AS project_id, max(o_orderkey) AS top, count(*) % 4 AS n FROM orders GROUP BY 1) SELECT project_id, CAST(top + i AS VARCHAR) AS serial FROM t, generate_series(1, 3) g(i) WHERE i <= n")
def new_serials(spark: SparkSession, sf: str) -> DataFrame:
    wanted = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg((F.count("*") % 4).alias("n"))
    return numbering.new_serials(base.samples(spark, sf), wanted)


# --- log


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = load(spark, sf, "events").select((F.col("user_id") % 50).alias("project_id"), k.alias("cell"), F.struct(F.col("event_id").alias("entry_no"), F.lit(0).alias("change_no")).alias("seq"), F.col("event_id").alias("entry_no"), F.lit(0).alias("change_no"), F.col("value").alias("after"), "event_type")
    return rows.withColumn("before", F.lag("after").over(Window.partitionBy("project_id", "cell").orderBy("entry_no")))


_EV = "ev AS (SELECT user_id % 50 AS project_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cell, event_id, value, event_type FROM events)"


@query("h2_current_state", f"WITH {_EV} SELECT project_id, cell, arg_max(value, event_id) AS after FROM ev GROUP BY 1, 2")
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    empty = changes.limit(0).select("project_id", "cell", "after")
    return history.current_state(empty, changes, "cell")


query("h3_replay_integrity", f"WITH {_EV} SELECT project_id, false AS broken FROM ev GROUP BY 1")(lambda s, sf: history.broken_projects(_changes(s, sf), "cell"))


@query(
    "h3_broken_logs",
    f"WITH {_EV}, b AS (SELECT *, lag(value) OVER (PARTITION BY project_id, cell ORDER BY event_id) AS was FROM ev), n AS (SELECT project_id, cell, arg_max(value, event_id) AS kept FROM ev WHERE event_id % 40 <> 7 AND event_id < 300 GROUP BY 1, 2), l AS (SELECT b.project_id, CASE WHEN event_id % 1997 = 301 THEN NULL ELSE was END AS before, CASE WHEN row_number() OVER w = 1 THEN kept ELSE lag(value) OVER w END AS state FROM b LEFT JOIN n USING (project_id, cell) WHERE event_id >= 300 WINDOW w AS (PARTITION BY b.project_id, b.cell ORDER BY event_id)) SELECT project_id, bool_or(before IS DISTINCT FROM state) AS broken FROM l GROUP BY 1",
)
def broken_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The log from entry 300 on; the snapshot before it lost every 40th entry, and every 1997th entry its `before`."""
    changes = _changes(spark, sf)
    kept = changes.where("entry_no % 40 <> 7 and entry_no < 300").groupBy("project_id", "cell").agg(F.max_by("after", "entry_no").alias("after"))
    return history.broken_projects(changes.where("entry_no >= 300").withColumn("before", F.when(F.col("entry_no") % 1997 != 301, F.col("before"))), "cell", kept)


@query(
    "h7_changed_since_issue",
    f"WITH {_EV}, i AS (SELECT project_id, max(event_id) AS issued FROM ev WHERE event_id % 10 = 0 GROUP BY 1), b AS (SELECT *, lag(value) OVER (PARTITION BY project_id, cell ORDER BY event_id) AS before FROM ev), l AS (SELECT b.* FROM b JOIN i USING (project_id) WHERE event_id > issued), e AS (SELECT project_id, cell, arg_min(struct_pack(v := before), event_id).v AS at_issue, arg_max(value, event_id) AS now FROM l GROUP BY 1, 2) SELECT * FROM e WHERE at_issue IS DISTINCT FROM now",
)
def changed_since_issue(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    return history.changed_since_issue(changes, changes.where("entry_no % 10 = 0").select("project_id", "entry_no"), "cell")


@query("h8_merged_edits", f"WITH {_EV}, l AS (SELECT project_id, cell, arg_max(value, event_id) FILTER (event_type = 'click') AS a, arg_max(value, event_id) FILTER (event_type = 'view') AS b FROM ev GROUP BY 1, 2) SELECT project_id, cell, coalesce(a, 0) AS click, coalesce(b, 0) AS view FROM l WHERE coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0")
def merged_edits(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    state = changes.select("project_id", "cell").distinct().select("project_id", "cell", F.lit(0.0).alias("click"), F.lit(0.0).alias("view"))
    edits = changes.select("project_id", "cell", F.col("event_type").alias("field"), F.col("after").alias("value"), F.col("entry_no").alias("seq"))
    return history.merged_edits(state, edits, ["project_id", "cell"], ["click", "view"])


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return live.activity(load(spark, sf, "events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


query("h11_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(_hourly)

# --- reports

query("r6_summary", f"WITH {STATE} SELECT project_id, pass, fail, not_evaluated, missing, verdict, missing + not_evaluated > 0 AS open_results FROM st WHERE grain = 'project'")(lambda s, sf: report.summary(_state(s, sf)))


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return report.sample_columns(base.samples(spark, sf), _state(spark, sf))


query("r2_sample_columns", f"WITH {STATE} SELECT s.project_id, s.sample_id, CAST(s.pos AS INT) AS index, CAST((s.pos - 1) // 6 AS INT) AS block, pass, fail, not_evaluated, missing, verdict FROM sa s JOIN st ON grain = 'sample' AND st.project_id = s.project_id AND key = sample_id")(
    lambda s, sf: _columns(s, sf).select("project_id", "sample_id", "index", "block", "pass", "fail", "not_evaluated", "missing", "verdict")
)
query("r3_column_blocks", f"WITH {CTE} SELECT project_id, CAST((pos - 1) // 6 AS INT) AS block, CAST(min(pos) AS INT) AS first_index, CAST(max(pos) AS INT) AS last_index FROM sa GROUP BY 1, 2")(lambda s, sf: report.column_blocks(report.numbered_columns(base.samples(s, sf))))
_WIDE = ", ".join(f"max(verdict) FILTER ((pos - 1) % 6 = {i}) AS s{i + 1}" for i in range(6))
query("r4_wide_grid", f"WITH {CTE} SELECT project_id, char_id, CAST((pos - 1) // 6 AS INT) AS block, {_WIDE} FROM dense WHERE verdict <> 'missing' GROUP BY 1, 2, 3")(
    lambda s, sf: report.wide_grid(_judged(s, sf), report.numbered_columns(base.samples(s, sf)))
)
query("r4_whole_grid", f"WITH {CTE} SELECT project_id, char_id, CAST((pos - 1) // 6 AS INT) AS block, {_WIDE} FROM dense GROUP BY 1, 2, 3")(
    lambda s, sf: report.whole_grid(_judged(s, sf), report.numbered_columns(base.samples(s, sf)), evaluate.measured(base.characteristics(s, sf)))
)


@query("e15_sheet_kinds", "WITH p AS (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS t, len(regexp_extract_all(html, '<img')) AS i FROM pages) SELECT page_id, CASE WHEN t >= 10 THEN 'vector_text' WHEN i > 0 THEN 'raster' ELSE 'outlined' END AS sheet_kind FROM p")
def sheet_kinds(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("readable"), F.lit(0).alias("unmapped"), F.regexp_count("html", F.lit("<img")).cast("double").alias("image_cover"))
    return extract.sheet_kinds(rows).select("page_id", "sheet_kind")


def _map(spark: SparkSession, sf: str) -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 30, 0, 1, -20, 0, 0, 1)])
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet_id"), m.alias("map"), F.lit(1190.0).alias("width"), F.lit(842.0).alias("height"))


query("g1_reregistered", f"WITH {_ZONES} SELECT project_id, item, CAST(least(greatest(x + 30, 0), 1190) AS DOUBLE) AS new_x, CAST(least(greatest(y - 20, 0), 842) AS DOUBLE) AS new_y FROM zz")(
    lambda s, sf: report.reregistered(_points(s, sf).withColumn("sheet_id", F.col("project_id")), _map(s, sf)).select("project_id", "item", "new_x", "new_y")
)
query("g2_off_sheet", f"WITH {_ZONES} SELECT project_id AS sheet_id, count(*) AS n, count(*) FILTER (x + 30 > 1190 OR y - 20 < 0) AS n_off FROM zz GROUP BY 1")(
    lambda s, sf: report.off_sheet(_points(s, sf).withColumn("sheet_id", F.col("project_id")), _map(s, sf))
)


def _number(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit("."), (n % 7 + 1).cast("string"))).otherwise(""), F.when(n % 3 == 0, "B").otherwise(""))


query("x7_number_parts", "SELECT p_partkey, CAST(p_partkey AS INT) AS base, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 7 + 1 AS INT) END AS sub, CASE WHEN p_partkey % 3 = 0 THEN 2 END AS letter FROM part")(
    lambda s, sf: load(s, sf, "part").select("p_partkey", X.number_parts(_number(F.col("p_partkey"))).alias("n")).select("p_partkey", "n.*")
)
