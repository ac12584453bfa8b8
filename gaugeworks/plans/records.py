"""Queries on places and numbers, log entries, edits, and the texts of lists and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import exprs as X
from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import evaluate, extract, history, lists, numbering, report, tolerance
from gaugeworks.plans import base
from gaugeworks.plans.base import CTE, STATE, load
from gaugeworks.plans.inspection import _CASCADE, _EV, _ZONES, SQL, TYPED, _changes, _number, _points, _state, _texts, query
from gaugeworks.sources import projects
from gaugeworks.streaming import live

_POS = "l_orderkey * 10 + l_linenumber"

# --- places and numbers


def _balloons(spark: SparkSession, sf: str) -> DataFrame:
    """A balloon for every line of each third part; its sheet and anchor follow from its place."""
    pos = F.expr(_POS)
    rows = load(spark, sf, "lineitem").where("l_partkey % 3 = 0").select((F.col("l_partkey") % 50).alias("project_id"), F.col("l_partkey").alias("char_id"), pos.alias("pos"), (pos % 4).alias("sheet_id"))
    return rows.withColumn("anchor_x", F.when(F.col("pos") % 13 == 0, float("nan")).otherwise((F.col("pos") % 1190).cast("double"))).withColumn("anchor_y", (F.col("pos") % 842).cast("double"))


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    source = F.struct((F.col("p_partkey") % 5 + 10).alias("sheet_id"), F.col("p_size").cast("double").alias("cx"), (F.col("p_size") * 2).cast("double").alias("cy"))
    none = F.array().cast("array<struct<sheet_id: bigint, cx: double, cy: double>>")
    return load(spark, sf, "part").select((F.col("p_partkey") % 50).alias("project_id"), F.col("p_partkey").alias("char_id"), F.when(F.col("p_partkey") % 11 == 0, none).otherwise(F.array(source)).alias("sources"))


_B = f"b AS (SELECT l_partkey AS c, min({_POS}) AS pos FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1), p AS (SELECT p_partkey % 50 AS project_id, p_partkey AS char_id, p_size, p_partkey % 11 <> 0 AS src, p_partkey % 5 + 10 AS s, pos FROM part LEFT JOIN b ON c = p_partkey)"
query(
    "n1_reference_points",
    f"WITH {_B} SELECT project_id, char_id, CASE WHEN pos IS NOT NULL THEN pos % 4 WHEN src THEN s END AS sheet_id, CASE WHEN pos % 13 = 0 THEN NULL WHEN pos IS NOT NULL THEN CAST(pos % 1190 AS DOUBLE) WHEN src THEN CAST(p_size AS DOUBLE) END AS x, CASE WHEN pos IS NOT NULL THEN CAST(pos % 842 AS DOUBLE) WHEN src THEN CAST(2 * p_size AS DOUBLE) END AS y FROM p",
)(lambda s, sf: numbering.reference_points(_sourced(s, sf), _balloons(s, sf)).select("project_id", "char_id", "sheet_id", "x", "y"))


@query(
    "j4_sheets",
    f"WITH {_B}, u AS (SELECT *, CASE WHEN src THEN s ELSE pos % 4 END AS a, CASE WHEN pos IS NOT NULL THEN pos % 4 WHEN src THEN s END AS k FROM p) SELECT project_id, char_id, CASE WHEN a <> 12 THEN CAST(a * 2 + 1 AS INT) END AS page, CASE WHEN k % 2 = 1 AND k <> 12 THEN 'in' ELSE 'mm' END AS sheet_unit FROM u",
)
def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen sheets for each project, of which one is not there."""
    of = load(spark, sf, "part").select((F.col("p_partkey") % 50).alias("project_id")).distinct().select("project_id", F.explode(F.sequence(F.lit(0), F.lit(14)).cast("array<bigint>")).alias("sheet_id")).where("sheet_id <> 12")
    of = of.withColumn("index", (F.col("sheet_id") * 2).cast("int")).withColumn("unit", F.when(F.col("sheet_id") % 2 == 1, "in").otherwise("mm"))
    return numbering.sheets_of(_sourced(spark, sf), _balloons(spark, sf), of)


query(
    "n2_shown_points",
    f"WITH {_ZONES} SELECT project_id, item, CAST(CASE item % 4 WHEN 1 THEN 842 - y WHEN 2 THEN 1190 - x WHEN 3 THEN y ELSE x END AS DOUBLE) AS x, CAST(CASE item % 4 WHEN 1 THEN x WHEN 2 THEN 842 - y WHEN 3 THEN 1190 - x ELSE y END AS DOUBLE) AS y FROM zz",
)(lambda s, sf: _points(s, sf).select("project_id", "item", numbering.shown_point(F.col("x"), F.col("y"), F.lit(1190.0), F.lit(842.0), F.col("item") % 4 * 90).alias("q")).select("project_id", "item", "q.*"))
query("n3_sheet_ordinals", "SELECT s_nationkey AS project_id, s_suppkey AS sheet_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 2, s_suppkey % 3, s_suppkey) AS INT) AS ordinal FROM supplier")(
    lambda s, sf: numbering.sheet_ordinals(load(s, sf, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("sheet_id"), (F.col("s_suppkey") % 3).alias("rev_pos"), F.col("s_suppkey").alias("index"), (F.col("s_suppkey") % 3 == 2).alias("is_current"))).select("project_id", "sheet_id", "ordinal")
)


@query(
    "n6_zone_labels",
    f"WITH {_ZONES}, q AS (SELECT *, zone % 8 AS c, zone // 8 AS r, item % 4 AS t FROM zz) SELECT project_id, item, ['A', 'B', 'C', 'D', 'E', 'F'][r + 1] || CAST(c + 1 AS VARCHAR) AS label, CAST(CASE t WHEN 1 THEN c * 6 + 5 - r WHEN 2 THEN (5 - r) * 8 + 7 - c WHEN 3 THEN (7 - c) * 6 + r ELSE r * 8 + c END AS INT) AS zone_order FROM q",
)
def zone_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).withColumn("c", F.col("zone_rank") % 8).withColumn("r", F.floor(F.col("zone_rank") / 8).cast("int"))
    label = numbering.zone_label(F.col("c"), F.col("r"), F.array(*[F.lit(str(i)) for i in range(1, 9)]), F.array(*map(F.lit, "ABCDEF")))
    order = numbering.zone_order(F.col("c"), F.col("r"), F.lit(8), F.lit(6), F.col("item") % 4 * 90)
    return rows.select("project_id", "item", label.alias("label"), order.cast("int").alias("zone_order"))


_TAIL = "SELECT project_id, CAST(zone AS INT) AS zone_rank, item, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY project_id, zone ORDER BY line, x, y, item) - 1 AS INT) AS rank FROM f"
_ORDER = 'SELECT project_id, item, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {}) AS INT) AS "order" FROM {}'


def _ordered(rows: DataFrame, strategy: str) -> DataFrame:
    return numbering.strategy_order(rows, strategy).select("project_id", "item", "order")


_VIEWS = "CASE WHEN x BETWEEN 100 AND 400 AND y BETWEEN 100 AND 300 THEN 1 WHEN x BETWEEN 50 AND 800 AND y BETWEEN 50 AND 700 THEN 0 ELSE 2147483647 END AS zone FROM z)"
_BY_VIEW = SQL["n4_reading_order"].replace(_TAIL, _ORDER.format("zone, line, x, y, item", "f"))
_ZONE_EXPR = _ZONES[_ZONES.index("greatest(0, least(5") :]


@query("n7_view_order", _BY_VIEW.replace(_ZONE_EXPR, _VIEWS))
def view_order(spark: SparkSession, sf: str) -> DataFrame:
    view = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    of = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit(1).alias("sheet_id"), F.array(view(50.0, 50.0, 750.0, 650.0), view(100.0, 100.0, 300.0, 200.0)).alias("views"))
    return _ordered(numbering.view_of(_points(spark, sf).withColumn("sheet_id", F.lit(1)), of), "view")


query("n8_clockwise_order", f"WITH {_ZONES}, a AS (SELECT *, atan2(x - 600.5, -(y - 400.5)) AS t, sqrt((x - 600.5) * (x - 600.5) + (y - 400.5) * (y - 400.5)) AS d FROM zz) " + _ORDER.format("CASE WHEN t < 0 THEN t + 2 * 3.141592653589793 ELSE t END, d, item", "a"))(
    lambda s, sf: _ordered(_points(s, sf).withColumn("centre_x", F.lit(600.5)).withColumn("centre_y", F.lit(400.5)), "clockwise")
)
query("n9_kind_order", SQL["n4_reading_order"].replace(_TAIL, _ORDER.format("item % 16, zone, line, x, y, item", "f")))(
    lambda s, sf: _ordered(_points(s, sf).withColumn("kind", F.element_at(F.array(*map(F.lit, numbering.KINDS)), (F.col("item") % 16 + 1).cast("int"))), "kind")
)


@query(
    "n14_locked_inserts",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 50 AS project_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 + 1 ELSE 0 END AS sub FROM part), t AS (SELECT project_id, max(k) AS top FROM p GROUP BY 1)
    SELECT project_id, k AS item, CASE k % 3 WHEN 0 THEN CAST(top + row_number() OVER (PARTITION BY project_id, k % 3 ORDER BY k) AS VARCHAR) WHEN 1 THEN k || '.' || (sub + 1) ELSE k || CASE WHEN sub > 0 THEN '.' || sub ELSE '' END || 'A' END AS number FROM p JOIN t USING (project_id) WHERE k % 5 = 0""",
)
def locked_inserts(spark: SparkSession, sf: str) -> DataFrame:
    """A new row behind every fifth part's, by each of the policies; half of the numbers are gone by now, but were given."""
    k = F.col("p_partkey")
    rows = load(spark, sf, "part").select((k % 50).alias("project_id"), k.alias("item"), k.alias("seq"), _number(k).alias("number"))
    inserts = rows.where("item % 5 = 0").select("project_id", "item", "seq", F.when(F.col("item") % 3 == 0, "next_free").when(F.col("item") % 3 == 1, "sub_number").otherwise("letter_suffix").alias("policy"), F.col("number").alias("anchor"))
    return numbering.locked_inserts(rows.where("item % 4 < 2"), rows.where("item % 4 >= 2"), inserts)


query("x7_printed_numbers", "SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.' || (p_partkey % 7 + 1) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'B' ELSE '' END AS number, CASE WHEN p_partkey % 703 = 0 THEN '' WHEN p_partkey % 703 <= 26 THEN chr(CAST(64 + p_partkey % 703 AS INT)) ELSE chr(CAST(64 + (p_partkey % 703 - 1) // 26 AS INT)) || chr(CAST(65 + (p_partkey % 703 - 1) % 26 AS INT)) END AS letters FROM part")(
    lambda s, sf: load(s, sf, "part").select("p_partkey", X.number_text(X.number_parts(_number(F.col("p_partkey")))).alias("number"), X.letters(F.col("p_partkey") % 703).alias("letters"))
)

# --- texts


@query(
    "x3_written_numbers",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS m, CAST(CAST(l_tax AS DECIMAL(12,2)) AS VARCHAR) AS d FROM lineitem), u AS (SELECT *, CASE m WHEN 0 THEN d WHEN 1 THEN '-' || d WHEN 2 THEN '12345678901234' || d ELSE d || 'x' END AS text FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN m < 2 THEN CAST(text AS DOUBLE) END AS number, replace(text, '.', ',') AS comma, CASE WHEN m = 3 OR (m = 0 AND d = '0.00') THEN text WHEN m = 1 THEN CASE WHEN d = '0.00' THEN d ELSE text END ELSE '+' || text END AS signed FROM u",
)
def written_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d, m = F.col("l_tax").cast("decimal(12,2)").cast("string"), F.col("l_partkey") % 4
    text = F.when(m == 0, d).when(m == 1, F.concat(F.lit("-"), d)).when(m == 2, F.concat(F.lit("12345678901234"), d)).otherwise(F.concat(d, F.lit("x")))
    return load(spark, sf, "lineitem").withColumn("t", text).select("l_orderkey", "l_linenumber", X.spreadsheet_number(F.col("t")).alias("number"), X.localized(F.col("t")).alias("comma"), X.signed(F.col("t")).alias("signed"))


query("x8_typed_lengths", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_size + 0.5 AS DECIMAL(28,12)) WHEN p_partkey % 5 = 2 THEN 0.25 END AS length FROM part")(
    lambda s, sf: load(s, sf, "part").select(
        "p_partkey",
        X.typed_length(
            F.element_at(F.array(F.concat("p_size", F.lit(".5")), F.concat(F.lit(" "), "p_size", F.lit(",50 ")), F.lit(".25"), F.concat(F.lit("-"), "p_size"), F.lit("0.0")), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("mm")
        ).alias("length"),
    )
)
query("v8_same_digits", "SELECT l_orderkey, l_linenumber, l_partkey % 3 = 0 AND l_suppkey % 2 = 0 AS same FROM lineitem")(
    lambda s, sf: load(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        X.same_digits(F.col("l_tax").cast(DEC), F.lit(2), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_tax").cast(DEC)), F.when(F.col("l_partkey") % 3 == 0, 2).otherwise(3)).alias("same"),
    )
)
_DATE = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '' WHEN 2 THEN '2023-02-' || (25 + o_orderkey % 7) ELSE strftime(o_orderdate, '%Y/%m/%d') END"
query("c4_dates", f"SELECT o_orderkey, {_DATE} AS date, o_orderkey % 4 < 2 OR (o_orderkey % 4 = 2 AND o_orderkey % 7 < 4) AS ok FROM orders")(
    lambda s, sf: load(s, sf, "orders").withColumn("date", _date()).select("o_orderkey", "date", X.date_ok(F.col("date")).alias("ok"))
)


def _date() -> Column:
    m = F.col("o_orderkey") % 4
    return F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, "").when(m == 2, F.concat(F.lit("2023-02-"), (F.col("o_orderkey") % 7 + 25).cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))


@query(
    "c5_refused_edits",
    f"""WITH e AS (SELECT o_orderkey, o_custkey AS entity, ['quantity', 'date', 'serial', 'rotation'][o_orderkey % 4 + 1] AS field, o_orderkey % 3 AS v, {_DATE.replace("% 4 WHEN", "// 4 % 4 WHEN")} AS d, o_orderkey // 4 % 4 AS w FROM orders)
    SELECT o_orderkey, CASE WHEN entity % 10 = 3 THEN 'unknown_characteristic' WHEN field = 'quantity' AND v = 0 THEN 'zero_quantity' WHEN field = 'date' AND (w = 3 OR (w = 2 AND o_orderkey % 7 >= 4)) THEN 'invalid_date' WHEN field = 'serial' AND v = 1 THEN 'empty_serial' WHEN field = 'rotation' AND v = 2 THEN 'invalid_sheet_setting' END AS reason FROM e""",
)
def refused_edits(spark: SparkSession, sf: str) -> DataFrame:
    v, w = F.col("o_orderkey") % 3, F.floor(F.col("o_orderkey") / 4) % 4
    date = F.when(w == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(w == 1, "").when(w == 2, F.concat(F.lit("2023-02-"), (F.col("o_orderkey") % 7 + 25).cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    field = F.element_at(F.array(*map(F.lit, ("quantity", "date", "serial", "rotation"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    value = F.when(F.col("field") == "quantity", v.cast("string")).when(F.col("field") == "date", date).when(F.col("field") == "serial", F.when(v == 1, " ").otherwise("S1")).otherwise(F.when(v == 2, "45").otherwise("90"))
    edits = load(spark, sf, "orders").withColumn("field", field).withColumn("value", value).withColumn("entity", F.col("o_custkey"))
    return history.refused_edits(edits, load(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("entity"))).select("o_orderkey", "reason")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the list has them; every 29th is rejected."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda c, s: F.when(k % c == 0, s)
    return load(spark, sf, "part").select(
        (k % 50).alias("project_id"), k.alias("pos"), k.cast("string").alias("number"), F.lit("linear").alias("kind"), size.alias("requirement_text"), F.concat(size, F.lit(".10")).alias("nominal"), text(2, "0.1").alias("upper_dev"),
        text(2, "-0.1").alias("lower_dev"), text(2, F.concat(size, F.lit(".2"))).alias("upper_limit"), text(2, F.concat(size, F.lit(".0"))).alias("lower_limit"), F.lit("mm").alias("unit"), text(5, "H7").alias("fit"),
        F.when(k % 2 == 0, "explicit").alias("rule"), (k % 4 + 1).cast("int").alias("quantity"), F.element_at(F.array(F.lit("none"), F.lit("critical"), F.lit("key")), (k % 3 + 1).cast("int")).alias("classification"), text(7, "gauge").alias("method"),
        F.lit(None).cast("string").alias("gauge"), F.lit("").alias("sampling"), text(3, "1/10").alias("frequency"), (k % 31 != 0).alias("inspect"), F.when(k % 29 == 0, "rejected").otherwise("accepted").alias("status"), (k % 6).cast("int").alias("page"), text(13, "see, \"note\"").alias("comment"),
    )


query(
    "s6_list_rows",
    """SELECT p_partkey % 50 AS project_id, p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS number, 'linear' AS kind, CAST(p_size AS VARCHAR) AS requirement_text, p_size || '.10' AS nominal, CASE WHEN p_partkey % 2 = 0 THEN '0.1' ELSE '' END AS upper_dev, CASE WHEN p_partkey % 2 = 0 THEN '-0.1' ELSE '' END AS lower_dev,
    CASE WHEN p_partkey % 2 = 0 THEN p_size || '.2' ELSE '' END AS upper_limit, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0' ELSE '' END AS lower_limit, 'mm' AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'H7' ELSE '' END AS fit, CASE WHEN p_partkey % 2 = 0 THEN 'explicit' ELSE '' END AS rule, CAST(p_partkey % 4 + 1 AS VARCHAR) AS quantity,
    ['', 'critical', 'key'][p_partkey % 3 + 1] AS classification, CASE WHEN p_partkey % 7 = 0 THEN 'gauge' ELSE '' END AS method, '' AS gauge, '' AS sampling, CASE WHEN p_partkey % 3 = 0 THEN '1/10' ELSE '' END AS frequency, CASE WHEN p_partkey % 31 = 0 THEN 'no' ELSE 'yes' END AS inspect, 'accepted' AS status,
    CAST(p_partkey % 6 AS VARCHAR) AS page, CASE WHEN p_partkey % 13 = 0 THEN 'see, "note"' ELSE '' END AS comment FROM part WHERE p_partkey % 29 <> 0""",
)(lambda s, sf: projects.export_rows(_listed(s, sf)))


@query(
    "x5_rule_details",
    f"WITH {_CASCADE} SELECT p_partkey, rule, CASE rule WHEN 'fit' THEN 'ISO 286 H7' WHEN 'general' THEN 'ISO 2768-1 m' ELSE '' END AS rule_detail, 'mm' AS unit FROM e",
)
def rule_details(spark: SparkSession, sf: str) -> DataFrame:
    rows = tolerance.derived(extract.callouts_once(_texts(spark, sf)), tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS))
    table = F.when(F.col("rule") == "fit", "iso-286").otherwise("iso-2768-1")
    return rows.select("p_partkey", "rule", X.rule_detail(F.col("rule"), table, F.lit("m"), F.col("fit"), F.lit(None).cast("string")).alias("rule_detail"), X.unit_symbol(F.col("unit")).alias("unit"))


@query(
    "q6_tally_by_trait",
    f"""WITH {_CASCADE}, c AS (SELECT ['linear', 'diameter', 'radius', 'symmetric', 'deviations', 'fit', 'reference', 'thread'][m + 1] AS category, p_partkey % 50 <> 0 AS ok, p_partkey AS k FROM e),
    x AS (SELECT 'category' AS "of", category AS name, ok FROM c UNION ALL SELECT 'total', 'total', ok FROM c UNION ALL SELECT 'trait', 'even', ok FROM c WHERE k % 2 = 0 UNION ALL SELECT 'trait', 'third', ok FROM c WHERE k % 3 = 0),
    g AS (SELECT "of", name, count(*) AS n, count(*) FILTER (ok) AS n_correct FROM x GROUP BY 1, 2) SELECT *, ((n_correct * 2000 + n) // (2 * n)) / 10.0 AS percent, n_correct * 100 >= n * 99 AS passes FROM g""",
)
def tally_by_trait(spark: SparkSession, sf: str) -> DataFrame:
    """What the cascade proposes against itself, every fiftieth truth with another kind; traits follow from the key."""
    rows = tolerance.derived(extract.callouts_once(_texts(spark, sf)), tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)).withColumn("inspect", F.col("inspect_now"))
    k = F.col("p_partkey")
    traits = F.array_compact(F.array(F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "third")))
    truth = rows.withColumn("category", extract.category(F.col("kind"), F.col("tol_kind"), F.col("fit"), F.col("marking"))).withColumn("kind", F.when(k % 50 == 0, "note").otherwise(F.col("kind"))).withColumn("traits", traits)
    return extract.tally_by_trait(extract.compared(truth.select("p_partkey", "category", "traits", *extract.FIELDS), rows.select("p_partkey", *extract.FIELDS), "p_partkey"))


# --- log


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    """One to three changes for each event."""
    change = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda i: F.struct((F.col("event_id") % 20 + i).alias("entity"), (i + F.col("user_id")).alias("after")))
    return load(spark, sf, "events").select((F.col("user_id") % 50).alias("project_id"), F.col("event_id").alias("entry_no"), F.col("ts").alias("timestamp"), F.col("user_id").alias("user"), change.alias("changes"))


query("h1_changes", "SELECT user_id % 50 AS project_id, event_id AS entry_no, CAST(i AS INT) AS change_no, event_id % 20 + i AS entity, i + user_id AS after FROM events, generate_series(0, 2) g(i) WHERE i <= event_id % 3")(
    lambda s, sf: history.exploded(_audit(s, sf)).select("project_id", "entry_no", "change_no", "entity", "after")
)
_H4 = f"{_EV}, b AS (SELECT *, lag(value) OVER (PARTITION BY project_id, cell ORDER BY event_id) AS before FROM ev), g AS (SELECT project_id, cell, event_id // 500 AS entry_no, arg_min(struct_pack(v := before), event_id).v AS before, arg_max(value, event_id) AS after, count(*) AS n_changes FROM b GROUP BY 1, 2, 3)"
query("h4_entity_history", f"WITH {_H4} SELECT project_id, cell, entry_no, before, after, n_changes, CASE WHEN entry_no % 7 = 3 THEN 'undo' ELSE 'command' END AS action, CASE WHEN entry_no % 7 = 3 THEN after IS NULL ELSE before IS NULL END AS created FROM g")(
    lambda s, sf: history.entity_history(_changes(s, sf).withColumn("change_no", F.col("entry_no")).withColumn("entry_no", F.floor(F.col("entry_no") / 500)).withColumn("action", F.when(F.col("entry_no") % 7 == 3, "undo").otherwise("command")), "cell")
)


@query(
    "h5_changed_fields",
    "WITH b AS (SELECT event_id, user_id % 3 AS a, event_type AS b, lag(user_id % 3) OVER w AS a0, lag(event_type) OVER w AS b0, lag(event_id) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)) SELECT event_id, concat_ws(',', CASE WHEN a <> a0 THEN 'shift' END, CASE WHEN b <> b0 THEN 'kind' END) AS fields FROM b WHERE e IS NOT NULL",
)
def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").withColumn("after", F.struct((F.col("user_id") % 3).alias("shift"), F.col("event_type").alias("kind")))
    rows = rows.withColumn("before", F.lag("after").over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id"))).where("before is not null")
    return history.changed_fields(rows, ["shift", "kind"]).select("event_id", F.array_join("fields", ",").alias("fields"))


@query(
    "h2_from_snapshot",
    f"WITH {_EV}, k AS (SELECT project_id, cell, arg_max(value, event_id) AS v FROM ev WHERE event_id < 300 GROUP BY 1, 2), l AS (SELECT project_id, cell, arg_max(struct_pack(v := CASE WHEN event_type = 'error' THEN NULL ELSE value END), event_id) AS s FROM ev WHERE event_id >= 300 GROUP BY 1, 2) SELECT project_id, cell, CASE WHEN s IS NOT NULL THEN s.v ELSE v END AS after FROM k FULL JOIN l USING (project_id, cell) WHERE CASE WHEN s IS NOT NULL THEN s.v ELSE v END IS NOT NULL",
)
def from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of the first 300 entries, and changes after it of which errors remove."""
    changes = _changes(spark, sf)
    kept = changes.where("entry_no < 300").groupBy("project_id", "cell").agg(F.max_by("after", "entry_no").alias("after"))
    return history.current_state(kept, changes.where("entry_no >= 300").withColumn("after", F.when(F.col("event_type") != "error", F.col("after"))), "cell")


@query(
    "h2_list_order",
    """WITH n AS (SELECT s_suppkey // 5 AS project_id, s_suppkey AS entity, 1 AS late, s_suppkey AS k FROM supplier UNION ALL SELECT event_id // 1000, event_id + 10000000, 0, -event_id FROM events),
    bad AS (SELECT DISTINCT event_id // 1000 AS project_id FROM events WHERE event_id // 1000 % 10 = 3 AND event_id % 1000 >= 500)
    SELECT project_id, entity, CAST(row_number() OVER (PARTITION BY project_id ORDER BY late, k) - 1 AS INT) AS pos, true AS sound FROM n WHERE project_id NOT IN (SELECT project_id FROM bad) UNION ALL SELECT project_id, NULL, NULL, false FROM bad""",
)
def list_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of five suppliers; each event inserts one in front, a thousand events to a list. From its entry 500 on every tenth log has inserts in a place that is not there."""
    start = load(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 5).alias("project_id"), F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") % 5).alias("pos"))
    none, project = F.lit(None).cast("array<bigint>"), F.floor(F.col("event_id") / 1000)
    index = F.when((project % 10 == 3) & (F.col("event_id") % 1000 >= 500), 1000000).otherwise(0).cast("int")
    changes = load(spark, sf, "events").select(project.alias("project_id"), F.col("event_id").alias("seq"), F.lit("inserted").alias("kind"), (F.col("event_id") + 10000000).alias("entity"), index.alias("index"), none.alias("before"), none.alias("after"))
    return lists.current_order(start, changes)


@query("h13_last_modified", "SELECT s_suppkey AS project_id, strftime(coalesce(max(ts), TIMESTAMP '2020-02-03 04:05:06'), '%Y-%m-%d %H:%M:%S') AS modified FROM supplier LEFT JOIN events ON user_id % 50 = s_suppkey GROUP BY 1")
def last_modified(spark: SparkSession, sf: str) -> DataFrame:
    of = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.to_timestamp_ntz(F.lit("2020-02-03 04:05:06")).alias("created"))
    return history.last_modified(_audit(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), of).select("project_id", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


query("h10_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")(lambda s, sf: live.latest(load(s, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").select("user_id", "event_type", "value"))
query(
    "h11_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)(lambda s, sf: live.sessions(load(s, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))

# --- cells and reports


@query("h9_refused", f"SELECT l_suppkey AS project_id, l_orderkey AS sample_id, l_partkey AS char_id, CASE WHEN l_partkey % 5 = 3 THEN 'unreadable_value' ELSE 'out_of_range' END AS reason, count(*) AS n FROM (SELECT *, {TYPED} AS text FROM lineitem) WHERE l_partkey % 5 = 3 OR (l_partkey % 5 = 0 AND l_partkey % 2 = 0) GROUP BY ALL")
def refused(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth part is typed as what can't be read, every tenth with thirteen places."""
    k = F.col("l_partkey")
    text = F.when(k % 5 == 3, "1e3").when(k % 10 == 0, "1,1234567890123").when(k % 5 == 0, "1,12").otherwise("ok")
    entries = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("sample_id"), k.alias("char_id"), text.alias("text"), F.lit(None).cast("string").alias("comment"), F.expr(_POS).alias("seq"))
    have = base.results(spark, sf).limit(0).withColumn("value_scale", F.lit(0)).withColumn("comment", F.lit(""))
    return evaluate.upserted(have, entries)[1].groupBy("project_id", "sample_id", "char_id", "reason").agg(F.count("*").alias("n"))


query("j16_unknown_cells", f"WITH {CTE} SELECT project_id, sample_id, char_id, 'unknown_characteristic' AS reason FROM res WHERE char_id % 97 = 0 AND (value IS NOT NULL OR attribute IS NOT NULL) UNION ALL SELECT project_id, sample_id, char_id, 'unknown_sample' FROM res WHERE sample_id % 89 = 0 AND (value IS NOT NULL OR attribute IS NOT NULL)")(
    lambda s, sf: evaluate.orphans(base.results(s, sf), base.characteristics(s, sf).where("char_id % 97 <> 0"), base.samples(s, sf).where("sample_id % 89 <> 0")).select("project_id", "sample_id", "char_id", "reason")
)
query("f3_open_or_failed", f"WITH {STATE} SELECT project_id, key, true AS failed, missing > 0 AS open FROM st WHERE grain = 'characteristic' AND verdict = 'fail'")(
    lambda s, sf: evaluate.rows_open_or_failed(_state(s, sf), failed=True).select("project_id", "key", F.lit(True).alias("failed"), (F.col("missing") > 0).alias("open"))
)
query("r3_all_blocks", f"WITH {CTE} SELECT c_custkey AS project_id, coalesce(CAST((pos - 1) // 6 AS INT), 0) AS block, coalesce(CAST(min(pos) AS INT), 0) AS first_index, coalesce(CAST(max(pos) AS INT), 0) AS last_index FROM customer LEFT JOIN sa ON project_id = c_custkey GROUP BY 1, 2")(
    lambda s, sf: report.column_blocks(report.numbered_columns(base.samples(s, sf)), load(s, sf, "customer").select(F.col("c_custkey").alias("project_id")))
)
query("r5_check_sheet", f'WITH {CTE} SELECT project_id, char_id, CAST(i AS INT) AS "index", \'missing\' AS verdict FROM mc, generate_series(1, 3) g(i)')(lambda s, sf: report.check_sheet(evaluate.measured(base.characteristics(s, sf)), 3))
query("r6_flags", f"WITH {STATE} SELECT project_id, verdict, missing + not_evaluated > 0 AS open_results, project_id IN (SELECT project_id FROM mc WHERE char_id % 17 = 0) AS draft_limits FROM st WHERE grain = 'project'")(
    lambda s, sf: report.summary(_state(s, sf), evaluate.measured(base.characteristics(s, sf)).where("char_id % 17 = 0")).select("project_id", "verdict", "open_results", "draft_limits")
)


@query(
    "r1_report_rows",
    f"""WITH {CTE}, c AS (SELECT project_id, char_id, string_agg(CASE WHEN attribute IS NOT NULL THEN attribute WHEN value IS NULL THEN '' ELSE replace(CAST(CAST(value AS DECIMAL(12,1)) AS VARCHAR), '.', ',') END || ':' || verdict, '|' ORDER BY pos) AS cells FROM (SELECT dense.*, value, attribute FROM dense LEFT JOIN res USING (project_id, sample_id, char_id)) GROUP BY 1, 2)
    SELECT project_id, char_id, CAST(char_id AS VARCHAR) AS number, CAST(nominal AS INT) || ',0' AS nominal, CASE WHEN tol IS NULL THEN '' ELSE '+' || replace(CAST(CAST(tol AS DECIMAL(12,1)) AS VARCHAR), '.', ',') END AS upper_deviation, CASE WHEN tol IS NULL THEN '' ELSE replace(CAST(CAST(nominal - tol AS DECIMAL(12,1)) AS VARCHAR), '.', ',') END AS lower_limit,
    CASE WHEN kind = 'angle' THEN '°' ELSE 'mm' END AS unit, CASE WHEN tol IS NULL THEN '' ELSE 'ISO 2768-1 m' END AS rule_detail, cells FROM mc JOIN c USING (project_id, char_id)""",
)
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    one, none = lambda c: F.col(c).cast("decimal(12,1)").cast("string"), F.lit(None).cast("string")
    texts = {
        "number": F.col("char_id").cast("string"), "requirement_text": F.col("nominal").cast("int").cast("string"), "quantity": F.lit(1), "upper_dev": one("tolerance"), "lower_dev": F.concat(F.lit("-"), one("tolerance")), "lower_limit_text": one("lower_limit"),
        "upper_limit_text": one("upper_limit"), "unit": F.when(F.col("kind") == "angle", "deg").otherwise("mm"), "fit": none, "rule": F.when(F.col("tolerance").isNull(), "no_tolerance_defined").otherwise("general"), "table_id": F.lit("iso-2768-1"), "class": F.lit("m"), "rule_tolerance": none, "draft": F.lit(False),
    }
    chars = base.characteristics(spark, sf).withColumns(texts).withColumn("nominal", one("nominal"))
    rows = report.report_rows(chars, base.samples(spark, sf), base.results(spark, sf).withColumn("value_text", one("value")), comma=True)
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c["value"], F.lit(":"), c["verdict"])), "|")
    return rows.select("project_id", "char_id", "number", "nominal", "upper_deviation", "lower_limit", "unit", "rule_detail", cells.alias("cells"))
