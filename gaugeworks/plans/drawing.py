"""Queries on characters and places of sheets, readings again, rules of stored data and checks before reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import assembly, extract, numbering, place, quality, report, revise, tolerance
from gaugeworks.plans import base
from gaugeworks.plans.base import CTE, STATE, load
from gaugeworks.plans.inspection import _CASCADE, _EV, _ZONES, QUERIES, SQL, _changes, _derived, _points, _state, _texts, query

# --- characters to callouts

_EM = 10.0


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """One to two written lines for each part, its sheet being the part's; limits above each other, a note below a size, two sizes apart."""
    s = F.col("p_size").cast("string")
    rows = load(spark, sf, "part").join(_texts(spark, sf), "p_partkey").withColumn("m", F.col("p_partkey") % 8)
    first = F.when(F.col("m") == 0, F.concat(s, F.lit(".2"))).otherwise(F.col("requirement_text"))
    second = F.when(F.col("m") == 0, F.concat(s, F.lit(".1"))).when(F.col("m") == 1, "ABC").when(F.col("m") == 3, "R2")
    lines = F.filter(F.array(F.struct(first.alias("t"), F.lit(0.0).alias("v")), F.struct(second.alias("t"), F.when(F.col("m") == 0, 12.0).otherwise(40.0).alias("v"))), lambda x: x["t"].isNotNull())
    return rows.select("p_partkey", F.posexplode(lines).alias("line_no", "l")).select("p_partkey", "line_no", "l.t", "l.v")


def _glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of the lines; every third part reads upward, and every second one has no characters for its spaces."""
    rows = _lines(spark, sf).select("p_partkey", "line_no", "v", F.posexplode(F.split("t", "")).alias("i", "ch")).where("ch <> '' and not (ch = ' ' and p_partkey % 2 = 0)")
    u, up = 100.0 + 6.0 * F.col("i"), F.col("p_partkey") % 3 == 1
    rows = rows.withColumn("origin_x", F.when(up, 200.0 + F.col("v")).otherwise(u)).withColumn("origin_y", F.when(up, -u + 900.0).otherwise(200.0 + F.col("v")))
    rows = rows.withColumn("x", F.when(up, F.col("origin_x") - 8.0).otherwise(F.col("origin_x"))).withColumn("y", F.when(up, F.col("origin_y") - 5.0).otherwise(F.col("origin_y") - 8.0))
    rows = rows.withColumn("w", F.when(up, 8.0).otherwise(5.0)).withColumn("h", F.when(up, 5.0).otherwise(8.0)).withColumn("rotation", F.when(up, 90.0).otherwise(0.0))
    seq = (F.col("line_no") * 1000 + F.col("i")).cast("bigint")
    return rows.select((F.col("p_partkey") % 50).alias("project_id"), F.col("p_partkey").alias("sheet_id"), seq.alias("seq"), "ch", "x", "y", "w", "h", "origin_x", "origin_y", "rotation", F.lit("sans").alias("font_name"), F.lit(_EM).alias("font_size"))


_FORMS = "['', 'Ø' || p_size, '2x R' || p_size, p_size || ' ±0,1', p_size || ' +0.2 -0.1', 'Ø' || p_size || ' H7', '(' || p_size || ')', 'M' || p_size][p_partkey % 8 + 1]"


@query(
    "e1_text_runs",
    f"""WITH f AS (SELECT p_partkey, p_size, p_partkey % 8 AS m, {_FORMS} AS t FROM part), l AS (SELECT p_partkey, 0 AS line_no, CASE WHEN m = 0 THEN p_size || '.2' ELSE t END AS text FROM f
    UNION ALL SELECT p_partkey, 1, CASE m WHEN 0 THEN p_size || '.1' WHEN 1 THEN 'ABC' WHEN 3 THEN 'R2' END FROM f WHERE m IN (0, 1, 3))
    SELECT p_partkey AS sheet_id, CAST(line_no * 1000 AS BIGINT) AS seq, text, CAST(6 * length(text) - 1 AS DOUBLE) AS w, 8.0::DOUBLE AS h, CASE WHEN p_partkey % 3 = 1 THEN 270.0 ELSE 0.0 END::DOUBLE AS angle FROM l""",
)
def text_runs(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.text_runs(_glyphs(spark, sf)).select("sheet_id", "seq", "text", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "angle")


def _box_texts(spark: SparkSession, sf: str) -> DataFrame:
    runs = assembly.text_runs(_glyphs(spark, sf)).withColumn("box_id", F.lit(1)).withColumn("framed", F.lit(False))
    return assembly.box_texts(assembly.limit_pairs(assembly.text_lines(runs)))


query(
    "e7_box_texts",
    f"""WITH f AS (SELECT p_partkey, p_size, p_partkey % 8 AS m, {_FORMS} AS t FROM part)
    SELECT p_partkey AS sheet_id, 0 AS text_no, CASE m WHEN 0 THEN p_size || '.2 ' || p_size || '.1' WHEN 1 THEN t || ' ABC' ELSE t END AS requirement_text, m = 0 AS stacked FROM f UNION ALL SELECT p_partkey, 1, 'R2', false FROM f WHERE m = 3""",
)(lambda s, sf: _box_texts(s, sf).select("sheet_id", "text_no", "requirement_text", "stacked"))


@query(
    "e14_proposals",
    f"""WITH {_CASCADE} SELECT p_partkey AS sheet_id, 0 AS text_no, CASE WHEN m = 0 THEN 'explicit' WHEN m = 1 THEN 'no_tolerance_defined' ELSE rule END AS rule, CAST(CASE WHEN m = 0 THEN p_size + 0.2 WHEN m <> 1 THEN p_size + up END AS DECIMAL(28,12)) AS upper_limit,
    CAST(CASE WHEN m = 0 THEN p_size + 0.1 WHEN m <> 1 THEN p_size + low END AS DECIMAL(28,12)) AS lower_limit FROM e UNION ALL SELECT p_partkey, 1, 'general', CAST(2.2 AS DECIMAL(28,12)), CAST(1.8 AS DECIMAL(28,12)) FROM e WHERE m = 3""",
)
def proposals(spark: SparkSession, sf: str) -> DataFrame:
    cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)
    return tolerance.derived_once(_box_texts(spark, sf), cells).select("sheet_id", "text_no", "rule", "upper_limit", "lower_limit")


# --- places


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    n = load(spark, sf, "supplier").agg(F.max("s_suppkey").alias("n"))
    rows = load(spark, sf, "customer").join(F.broadcast(n))
    return rows.select((k % F.col("n") + 1).alias("project_id"), F.lit(1).alias("sheet_id"), k.alias("box_id"), ((k * 71) % 1190 + 0.25).alias("cx"), ((k * 37) % 842 + 0.25).alias("cy"), F.lit(120.0).alias("bw"), F.lit(60.0).alias("bh"), F.when(k % 2 == 0, 90.0).otherwise(0.0).alias("angle"))


@query(
    "j11_text_in_regions",
    f"""WITH {_ZONES}, b AS (SELECT c_custkey % n + 1 AS project_id, c_custkey AS box_id, (c_custkey * 71) % 1190 + 0.25 AS cx, (c_custkey * 37) % 842 + 0.25 AS cy, CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 60 END AS hx, CASE WHEN c_custkey % 2 = 0 THEN 60 ELSE 30 END AS hy FROM customer, (SELECT max(s_suppkey) AS n FROM supplier))
    SELECT project_id, box_id, item FROM zz JOIN b USING (project_id) WHERE abs(x + 1 - cx) <= hx AND abs(y + 2 - cy) <= hy""",
)
def text_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    glyphs = _points(spark, sf).select("project_id", F.lit(1).alias("sheet_id"), "item", "x", "y", F.lit(2.0).alias("w"), F.lit(4.0).alias("h"))
    return place.text_in_regions(glyphs, _regions(spark, sf)).select("project_id", "box_id", "item")


@query(
    "j12_framed_runs",
    f"""WITH {_ZONES}, r AS (SELECT project_id, x, y, CASE group_key % 3 WHEN 0 THEN 2 WHEN 1 THEN 20 ELSE -5 END AS m FROM zz WHERE group_key % 2 = 0)
    SELECT project_id, item AS run_id, EXISTS (SELECT 1 FROM r WHERE r.project_id = zz.project_id AND least(r.x - r.m, r.x + r.m + 40, r.x + 1e9) IS NOT NULL AND zz.x - (r.x - r.m) BETWEEN -2.5 AND 12 AND (r.x + 40 + r.m) - (zz.x + 40) BETWEEN -2.5 AND 12
      AND zz.y - least(r.y - r.m, r.y + 10 + r.m) BETWEEN -2.5 AND 12 AND greatest(r.y - r.m, r.y + 10 + r.m) - (zz.y + 10) BETWEEN -2.5 AND 12 AND r.m <> -5) AS framed FROM zz""",
)
def framed_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).withColumn("sheet_id", F.lit(1))
    runs = rows.select("project_id", "sheet_id", F.col("item").alias("run_id"), (F.col("x") + 20).alias("cx"), (F.col("y") + 5).alias("cy"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"), F.lit(0.0).alias("angle"), F.lit(10.0).alias("em"))
    m = F.when(F.col("group_key") % 3 == 0, 2.0).when(F.col("group_key") % 3 == 1, 20.0).otherwise(-5.0)
    at = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    rects = rows.where("group_key % 2 = 0").select("project_id", "sheet_id", F.array(at(-m, -m), at(m + 40, -m), at(m + 40, m + 10), at(-m, m + 10)).alias("corners"))
    return place.framed_runs(runs, rects).select("project_id", "run_id", "framed")


@query(
    "j17_pasted",
    f"""WITH {CTE}, rw AS (SELECT project_id, char_id, row_number() OVER (PARTITION BY project_id ORDER BY char_id) AS p FROM ch), n AS (SELECT project_id, (SELECT count(*) FROM rw WHERE rw.project_id = sa.project_id) AS nr, count(*) AS nc FROM sa GROUP BY project_id),
    c AS (SELECT project_id, i, j, t FROM (SELECT DISTINCT project_id FROM sa), (VALUES (0, 0, 'a'), (0, 1, 'b'), (1, 0, 'c')) v(i, j, t))
    SELECT project_id, char_id AS row_key, sample_id AS column_key, project_id || t AS text FROM c JOIN n USING (project_id) JOIN rw USING (project_id) JOIN sa USING (project_id) WHERE 3 <= nr AND project_id % 15 + 2 <= nc AND p = i + 2 AND pos = j + project_id % 15 + 1""",
)
def pasted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("project_id").cast("string")
    columns = base.samples(spark, sf).select("project_id", "pos", F.col("sample_id").alias("column_key"))
    rows = base.pairs(spark, sf).select("project_id", F.row_number().over(Window.partitionBy("project_id").orderBy("char_id")).alias("pos"), F.col("char_id").alias("row_key"))
    blocks = columns.select("project_id").distinct().select("project_id", F.lit(1).alias("block_id"), F.lit(2).alias("row_pos"), (F.col("project_id") % 15 + 1).alias("column_pos"), F.concat(k, F.lit("a\t "), k, F.lit("b\r\n"), k, F.lit("c\n")).alias("text"))
    return place.pasted(blocks, rows, columns).select("project_id", "row_key", "column_key", "text")


def _balloons(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("project_id", F.col("item").alias("balloon_id"), F.lit(1).alias("sheet_id"), F.col("item").alias("pos"), F.col("group_key").alias("char_id"), "x", "y", F.when(F.col("item") % 5 == 0, 12.0).alias("size"), F.lit(None).cast("string").alias("shape"))


@query(
    "j18_overlay",
    f"WITH {_ZONES} SELECT project_id, item AS balloon_id, CASE WHEN item % 5 = 0 THEN 12.0 ELSE 8.0 END::DOUBLE AS size, 'circle' AS shape, CAST(row_number() OVER (PARTITION BY project_id ORDER BY item) AS INT) AS place FROM zz WHERE group_key % 29 <> 0 AND project_id % 4 <> 0",
)
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    balloons = _balloons(spark, sf)
    sheets = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit(1).alias("sheet_id"), (F.col("s_suppkey") % 4 != 0).alias("is_current"))
    chars = balloons.select("project_id", "char_id").distinct().withColumn("status", F.when(F.col("char_id") % 29 == 0, "rejected").otherwise("open"))
    return place.overlay(balloons, chars, sheets, {"size": 8.0, "shape": "circle"}).select("project_id", "balloon_id", "size", "shape", "place")


@query(
    "j19_picked",
    f"WITH {_ZONES} SELECT DISTINCT project_id, item AS balloon_id FROM zz WHERE (x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 300) OR (item % 7 = 0 AND project_id % 2 = 0)",
)
def picked(spark: SparkSession, sf: str) -> DataFrame:
    balloons = _balloons(spark, sf).select("project_id", "balloon_id", "sheet_id", "x", "y")
    boxes = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit(1).alias("sheet_id"), F.lit(100.0).alias("bx"), F.lit(50.0).alias("by"), F.lit(300.0).alias("bw"), F.lit(250.0).alias("bh"), (F.col("s_suppkey") % 2 == 0).alias("additive"))
    return place.picked(balloons, boxes, balloons.where("balloon_id % 7 = 0").select("project_id", "balloon_id"))


@query("q1_user_boxes", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 63.0 ELSE 123.0 END::DOUBLE AS bw, CASE WHEN c_custkey % 2 = 0 THEN 123.0 ELSE 63.0 END::DOUBLE AS bh FROM customer")
def user_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _regions(spark, sf).select(F.col("box_id").alias("c_custkey"), "cx", "cy", F.col("bw").alias("w"), F.col("bh").alias("h"), "angle")
    return place.user_box(rows).select("c_custkey", "bw", "bh")


query("q3_traits", "SELECT p_partkey, p_partkey % 8 = 3 AS comma, p_partkey % 5 = 0 AS rotated, p_partkey % 8 = 4 AS stacked FROM part")(
    lambda s, sf: extract.callouts(_texts(s, sf)).select("p_partkey", quality.traits(F.col("requirement_text"), F.when(F.col("p_partkey") % 5 == 0, 90.0).otherwise(0.0), F.col("tol_kind")).alias("t")).select("p_partkey", "t.*")
)

# --- numbers


@query(
    "n13_preview",
    f"""WITH r AS ({SQL["n12_display_numbers"]}) SELECT project_id, count(*) AS n, count(*) FILTER (number <> CAST(k AS VARCHAR)) AS n_changed FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY base, coalesce(sub, 0)) AS k FROM r) GROUP BY 1""",
)
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """Of numbers 1..n, how many a change to sub-numbers would change."""
    new = QUERIES["n12_display_numbers"](spark, sf)
    old = F.row_number().over(Window.partitionBy("project_id").orderBy("base", F.coalesce("sub", F.lit(0)))).cast("string")
    return numbering.preview(new.withColumn("old_number", old))


# --- readings again


def _read_before(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as they were read with class m; by key some are set by hand, never read, or unreadable now."""
    k = F.col("p_partkey")
    rows = _derived(spark, sf).withColumn("inspect", F.col("inspect_now"))
    never = k % 11 == 1
    cleared = {c: F.when(~never, F.col(c)) for c in revise.READ}
    rows = rows.withColumns(cleared).withColumn("rule", F.when(k % 11 == 0, "manual").otherwise(F.col("rule"))).withColumn("requirement_text", F.when(k % 13 == 0, "see note").otherwise(F.col("requirement_text")))
    return rows.select(F.lit(1).alias("project_id"), k.alias("char_id"), "requirement_text", F.lit(None).cast(DEC).alias("shorter_leg"), F.lit(False).alias("basic"), "kind", "quantity", "inspect", *revise.READ)


def _cells(spark: SparkSession) -> DataFrame:
    return tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)


_STATUS = "CASE WHEN p_partkey % 11 = 0 THEN 'manual' WHEN p_partkey % 13 = 0 THEN 'unreadable' ELSE 'reinterpreted' END"
query("t11_reinterpreted", f"WITH {_CASCADE} SELECT p_partkey AS char_id, {_STATUS} AS status, CASE WHEN p_partkey % 11 = 0 THEN 'manual' WHEN p_partkey % 13 = 0 AND p_partkey % 11 = 1 THEN NULL ELSE rule END AS rule, CAST(CASE WHEN p_partkey % 13 = 0 AND p_partkey % 11 = 1 THEN NULL ELSE p_size + up END AS DECIMAL(28,12)) AS upper_limit FROM e")(
    lambda s, sf: revise.reinterpreted(_read_before(s, sf), _cells(s)).select("char_id", "status", "rule", "upper_limit")
)
_C = "CASE WHEN m = 2 THEN CASE WHEN p_size <= 3 THEN 0.4 WHEN p_size <= 6 THEN 1 ELSE 2 END ELSE CASE WHEN p_size <= 3 THEN 0.2 WHEN p_size <= 6 THEN 0.3 WHEN p_size <= 30 THEN 0.5 ELSE 0.8 END END"
query("t12_general_update", f"WITH {_CASCADE} SELECT p_partkey AS char_id, 'general' AS rule, CAST(p_size + {_C} AS DECIMAL(28,12)) AS upper_limit FROM e WHERE rule = 'general' AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0")(
    lambda s, sf: revise.general_update(_read_before(s, sf), _cells(s), "c").select("char_id", "rule", "upper_limit")
)


@query("t13_shorter_leg", f"SELECT p_partkey AS char_id, {_STATUS.replace(chr(39) + 'manual' + chr(39), chr(39) + 'manual_kept' + chr(39)).replace('reinterpreted', 'interpreted')} AS outcome, CAST(p_size AS DECIMAL(28,12)) AS shorter_leg FROM part WHERE p_partkey % 2 = 0")
def shorter_leg(spark: SparkSession, sf: str) -> DataFrame:
    legs = load(spark, sf, "part").where("p_partkey % 2 = 0").select(F.lit(1).alias("project_id"), F.col("p_partkey").alias("char_id"), F.col("p_size").cast(DEC).alias("leg"))
    return revise.shorter_leg_set(_read_before(spark, sf), legs, _cells(spark)).select("char_id", "outcome", "shorter_leg")


query("t10_callout_only", f"WITH {_CASCADE} SELECT p_partkey, CASE WHEN m IN (3, 4) THEN 'explicit' ELSE 'no_tolerance_defined' END AS rule, CAST(CASE WHEN m IN (3, 4) THEN p_size + up END AS DECIMAL(28,12)) AS upper_limit, CAST(CASE WHEN m IN (3, 4) THEN p_size + low END AS DECIMAL(28,12)) AS lower_limit FROM e")(
    lambda s, sf: revise.callout_only(extract.callouts(_texts(s, sf))).select("p_partkey", "rule", "upper_limit", "lower_limit")
)


@query(
    "t9_units",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'deg' WHEN p_partkey % 3 = 1 THEN 'in' WHEN p_partkey % 5 = 0 THEN 'in' ELSE 'mm' END AS written, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 3 THEN 'deg' WHEN p_partkey % 3 = 1 THEN 'in' ELSE 'mm' END AS filled FROM part",
)
def units(spark: SparkSession, sf: str) -> DataFrame:
    """As written, and filled in where it is missing or wrong."""
    k = F.col("p_partkey")
    kind, marker = F.when(k % 4 == 3, "angle").otherwise("linear"), F.when(k % 3 == 1, "in")
    unit = F.when(k % 3 == 1, "in").when(k % 3 == 2, "deg")
    filled = revise.filled_unit(kind, F.when(k % 6 != 0, F.col("p_size")), F.when(k % 6 != 0, unit), F.lit("mm"))
    return load(spark, sf, "part").select("p_partkey", revise.written_unit(kind, marker, k % 5 == 0, F.lit("mm")).alias("written"), filled.alias("filled"))


@query(
    "t14_limits_follow",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 = 3 THEN 99 WHEN l_partkey % 3 = 0 THEN l_quantity + 0.1 WHEN l_partkey % 3 = 1 THEN NULL WHEN l_linenumber % 4 = 1 THEN NULL ELSE 50 END AS DECIMAL(28,12)) AS upper_limit,
    CASE WHEN l_linenumber % 4 = 3 THEN 'manual' WHEN l_partkey % 3 = 0 THEN 'manual' WHEN l_partkey % 3 = 1 THEN NULL WHEN l_linenumber % 4 = 1 THEN NULL ELSE 'general' END AS rule FROM lineitem""",
)
def limits_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Both deviations, one or none by part; by line the nominal, a deviation or a limit was edited."""
    p, n = F.col("l_partkey") % 3, F.col("l_linenumber") % 4
    dec = lambda c: c.cast(DEC)
    old = dec(F.lit(50))
    rows = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", dec(F.col("l_quantity")).alias("nominal"), dec(F.when(p == 0, F.lit("0.1"))).alias("upper_dev"), dec(F.when(p != 2, F.lit("-0.1"))).alias("lower_dev"),
        F.when(n == 3, dec(F.lit(99))).otherwise(old).alias("upper_limit"), old.alias("lower_limit"), old.alias("old_upper_limit"), old.alias("old_lower_limit"), F.lit("general").alias("rule"),
        (n != 1).alias("nominal_touched"), (n == 1).alias("deviation_touched"), (n == 3).alias("limit_touched"), F.lit(False).alias("rule_set"),
    )
    return revise.limits_follow(rows).select("l_orderkey", "l_linenumber", "upper_limit", "rule")


@query(
    "t19_tables_put",
    f"WITH {_EV}, g AS (SELECT project_id, 't' || cell AS table_id, arg_max(event_id, event_id) AS version FROM ev WHERE event_type = 'click' GROUP BY 1, 2), o AS (SELECT DISTINCT project_id, 't' || cell AS table_id, CAST(0 AS BIGINT) AS version FROM ev WHERE cell < 20), a AS (SELECT project_id, table_id, max(version) AS version FROM (SELECT * FROM g UNION ALL SELECT * FROM o) GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY table_id) AS INT) AS place FROM a",
)
def tables_put(spark: SparkSession, sf: str) -> DataFrame:
    ev = _changes(spark, sf).withColumn("table_id", F.concat(F.lit("t"), F.col("cell").cast("string")))
    given = ev.select("project_id", "table_id", F.col("entry_no").alias("version"), F.when(F.col("event_type") == "click", "custom").otherwise("fit").alias("kind"), F.col("entry_no").alias("seq"))
    return revise.tables_put(ev.where("cell < 20").select("project_id", "table_id", F.lit(0).cast("bigint").alias("version")).distinct(), given)


@query(
    "h6_change_source",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'rule' END WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'rule' ELSE 'manual' END END WHEN event_type = 'view' THEN 'manual' ELSE 'recognition' END AS source FROM events",
)
def change_sources(spark: SparkSession, sf: str) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id")
    ids = F.array(F.when(user % 2 == 0, user).otherwise(user + 1))
    none = F.lit(None).cast("array<string>")
    leaf = "struct<type: string, ids: array<bigint>, rules: array<string>>"
    inner = F.array(F.struct(F.lit("set_header").alias("type"), ids.alias("ids"), none.alias("rules")), F.struct(F.lit("update_fields").alias("type"), ids.alias("ids"), F.array(F.lit("general")).alias("rules")))
    name = F.when(k % 7 == 0, "batch").when(F.col("event_type") == "click", "update_fields").when(F.col("event_type") == "view", "add_characteristic").otherwise("accept_proposals")
    rules = F.array(F.when(k % 3 == 0, "general").otherwise("manual"))
    command = F.struct(name.alias("type"), ids.alias("ids"), rules.alias("rules"), F.when(k % 7 == 0, inner).otherwise(F.lit(None).cast(f"array<{leaf}>")).alias("commands"))
    return load(spark, sf, "events").select("event_id", revise.change_source(command, user, F.lit(True)).alias("source"))


# --- rules of stored data, checks before reports


@query(
    "c2_measurement_issues",
    """WITH r AS (SELECT o_custkey AS project_id, l_orderkey AS s, l_partkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey), ps AS (SELECT o_custkey AS project_id, o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
    k AS (SELECT project_id, (s, c)::STRUCT(a BIGINT, b BIGINT) AS n, (pos, c)::STRUCT(a BIGINT, b BIGINT) AS v FROM r JOIN ps USING (project_id, s)), g AS (SELECT *, lag(v) OVER (PARTITION BY project_id ORDER BY n) AS p FROM k)
    SELECT DISTINCT project_id, 'duplicate_result' AS reason FROM (SELECT project_id FROM r GROUP BY project_id, s, c HAVING count(*) > 1) UNION ALL SELECT DISTINCT project_id, 'results_not_sorted' FROM g WHERE p > v""",
)
def measurement_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Results in the order of their keys, samples in the order of their days."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    n = base.tasks(lines)
    lines = lines.repartition(n, "l_orderkey").join(load(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_custkey").alias("project_id"), F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("char_id")).repartition(n, "project_id")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("project_id").orderBy("sample_id", "char_id")))
    chars = rows.select("project_id", "char_id").distinct().withColumn("pos", F.col("char_id"))
    return quality.measurement_issues(base.samples(spark, sf, n), chars, rows, n)


@query(
    "c3_settings_issues",
    """SELECT project_id, unnest(list_filter([CASE WHEN project_id % 2 = 0 THEN 'decimal_rules_order' END, CASE WHEN project_id % 3 = 0 THEN 'decimal_rule_value' END, CASE WHEN project_id % 5 = 0 THEN 'unit_rounding' END, CASE WHEN project_id % 7 = 0 THEN 'custom_table_id' END,
    CASE WHEN project_id % 7 <> 0 AND project_id % 11 = 0 THEN 'custom_tables_order' END, CASE WHEN project_id % 13 = 0 THEN 'custom_table_twice' END, CASE WHEN project_id % 17 = 0 THEN 'table_setting' END, CASE WHEN project_id % 19 = 0 THEN 'drawing_rule_not_custom' END], lambda x: x IS NOT NULL)) AS reason FROM (SELECT c_custkey AS project_id FROM customer)""",
)
def settings_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rule = lambda p, v: F.struct(F.lit(p).alias("places"), v.cast(DEC).alias("tolerance"))
    rules = F.when(k % 2 == 0, F.array(rule(2, F.lit("0.1")), rule(1, F.when(k % 3 == 0, "0").otherwise("0.2")))).otherwise(F.array(rule(1, F.lit("0.2")), rule(2, F.when(k % 3 == 0, "0").otherwise("0.1"))))
    first = F.when(k % 7 == 0, "A table").when(k % 11 == 0, "zz").otherwise("a-1")
    tables = F.array(F.struct(first.alias("id"), F.lit("x").alias("sha256")), F.struct(F.lit("b-2").alias("id"), F.when(k % 13 == 0, "x").otherwise("y").alias("sha256")))
    named = lambda i, c: F.struct(i.alias("id"), c.alias("class"))
    rows = load(spark, sf, "customer").select(
        k.alias("project_id"), rules.alias("decimal_rules"), F.lit(3).alias("mm_places"), F.when(k % 5 == 0, 11).otherwise(4).alias("inch_places"), tables.alias("custom_tables"),
        named(F.lit("iso-2768-1"), F.when(k % 17 == 0, " ").otherwise("m")).alias("general"), named(F.when(k % 19 == 0, "c-3").otherwise("b-2"), F.lit("m")).alias("drawing_rule"),
    )
    return quality.settings_issues(rows)


@query(
    "q8_truth_issues",
    """WITH t AS (SELECT p_brand AS drawing, CASE WHEN p_partkey % 40 = 1 THEN -1 ELSE p_partkey END AS id, p_partkey AS k, p_size, row_number() OVER () FROM part), d AS (SELECT *, count(*) OVER (PARTITION BY drawing, id) AS n FROM t)
    SELECT drawing, id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN p_size > 45 OR p_size < 4 THEN 'region_off_sheet' END, CASE WHEN k % 9 = 0 THEN 'limits_not_in_order' END, CASE WHEN k % 10 = 3 THEN 'limits_without_rule' END, CASE WHEN k % 10 = 4 THEN 'fit_missing' END, CASE WHEN k % 6 = 0 THEN 'unit_of_kind' END, CASE WHEN k % 8 = 0 THEN 'text_not_normalized' END], lambda x: x IS NOT NULL)) AS reason FROM d""",
)
def truth_issues(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    truth = load(spark, sf, "part").select(
        F.col("p_brand").alias("drawing"), F.when(k % 40 == 1, -1).otherwise(k).alias("id"), F.lit(0).alias("sheet"), F.when(k % 6 == 0, "angle").otherwise("linear").alias("kind"), F.when(k % 8 == 0, "12  mm").otherwise("12 mm").alias("requirement_text"),
        (size * 20).cast("double").alias("cx"), F.lit(50.0).alias("cy"), F.lit(40.0).alias("w"), F.lit(160.0).alias("h"), F.lit(90.0).alias("angle"), F.lit("mm").alias("unit"), F.lit(None).cast("string").alias("fit"),
        F.when(k % 10 == 4, "fit").when(k % 10 != 3, "explicit").alias("rule"), F.when(k % 9 == 0, size).otherwise(size + 1).cast(DEC).alias("upper_limit"), size.cast(DEC).alias("lower_limit"),
    )
    sheets = truth.select("drawing", "sheet").distinct().select("drawing", "sheet", F.lit(980.0).alias("width"), F.lit(100.0).alias("height"))
    return quality.truth_issues(truth, sheets)


@query(
    "r7_report_checks",
    f"""WITH {STATE}, rw AS (SELECT project_id, key FROM st WHERE grain = 'characteristic'), p AS (SELECT * FROM st WHERE grain = 'project')
    SELECT c_custkey AS project_id, coalesce((SELECT count(*) FROM st s WHERE s.grain = 'sample' AND s.project_id = c_custkey), 0) AS samples, coalesce((SELECT count(*) FROM rw WHERE rw.project_id = c_custkey), 0) AS rows, CAST(coalesce(p.missing, 0) AS BIGINT) AS missing_values, CAST(coalesce(p.not_evaluated, 0) AS BIGINT) AS not_evaluated,
    coalesce((SELECT count(*) FROM rw WHERE rw.project_id = c_custkey AND key % 4 = 1), 0) AS draft_rows, coalesce((SELECT count(*) FROM rw WHERE rw.project_id = c_custkey AND key % 7 = 0), 0) AS changed_rows,
    CASE WHEN c_custkey % 3 = 0 THEN 'part_number,' ELSE '' END || 'report_number' || CASE WHEN c_custkey % 2 = 0 THEN ',inspected_by' ELSE '' END AS missing_fields FROM customer LEFT JOIN p ON p.project_id = c_custkey""",
)
def report_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    info = load(spark, sf, "customer").select(k.alias("project_id"), F.when(k % 3 == 0, " ").otherwise("p").alias("part_number"), F.lit(None).cast("string").alias("report_number"), F.col("c_name").alias("company_name"), F.when(k % 2 == 0, "").otherwise("kim").alias("inspected_by"))
    chars = base.pairs(spark, sf)
    got = quality.report_checks(_state(spark, sf), info, chars.where("char_id % 4 = 1"), chars.where("char_id % 7 = 0"))
    return got.withColumn("missing_fields", F.array_join("missing_fields", ","))


query("x11_state_hash", "SELECT p_partkey, sha256('{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}') AS hash FROM part")(lambda s, sf: load(s, sf, "part").select("p_partkey", quality.state_hash("p_partkey", "p_size").alias("hash")))


@query(
    "r9_issue_records",
    f"WITH {_EV}, l AS (SELECT project_id, max(event_id) AS entry_no FROM ev GROUP BY 1) SELECT doc_id AS project_id, source AS report_number, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, ''))[1:16] AS sha_short, coalesce(entry_no, 0) AS entry_no, true AS locks_numbers FROM documents LEFT JOIN l ON project_id = doc_id",
)
def issue_records(spark: SparkSession, sf: str) -> DataFrame:
    contents = load(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), F.col("source").alias("report_number"), F.coalesce("text", F.lit("")).alias("content"))
    return quality.issue_records(contents, _changes(spark, sf).select("project_id", "entry_no"))


# --- as streams, logs and lists use them

_KEEP = "SELECT o_orderkey AS project_id, CASE WHEN o_orderdate IS NULL THEN '2024-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'acme' ELSE o_orderpriority END AS company, o_orderstatus AS inspector, sha256(CAST(o_orderkey AS VARCHAR))[1:16] AS sha_short FROM orders"


@query("r8_header_filled", _KEEP)
def header_filled(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(k.alias("project_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderpriority")).alias("company"), F.col("o_orderstatus").alias("inspector"), F.sha2(k.cast("string"), 256).alias("sha"))
    return report.header_filled(rows, "2024-01-01", "acme", "x")


query("n17_split_quantity", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(i AS INT) AS feature FROM lineitem, generate_series(1, 50) g(i) WHERE i <= CASE WHEN l_quantity BETWEEN 2 AND 100 THEN l_quantity ELSE 1 END")(
    lambda s, sf: numbering.split_quantity(load(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))).drop("quantity")
)
query("n15_moved_before", "WITH o AS (SELECT o_custkey AS project_id, o_orderkey AS item, o_orderkey % 3 = 0 AS m FROM orders), t AS (SELECT *, max(item) FILTER (NOT m) OVER (PARTITION BY project_id) AS last FROM o) SELECT project_id, item, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN m AND last IS NOT NULL THEN last ELSE item END, CASE WHEN m AND last IS NOT NULL THEN 0 ELSE 1 END, item) AS INT) AS pos FROM t")(
    lambda s, sf: _moved(load(s, sf, "orders"))
)


def _moved(orders: DataFrame) -> DataFrame:
    """Every third order goes before the last one of the others."""
    rows = orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 3 == 0).alias("m"))
    last = F.max(F.when(~F.col("m"), F.col("pos"))).over(Window.partitionBy("project_id"))
    return numbering.moved_before(rows.withColumn("t", F.coalesce(F.col("pos") == last, F.lit(False))), "m", "t").select("project_id", "item", "pos")


# --- callouts as drawings have them


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    """A callout for each part, of one of fourteen forms: sizes that end in zeros, inches, minutes of arc, limits, pairs and printed fits, chamfers, threads."""
    around = (("", "00"), ("Ø", "00"), None, ("", '.000"'), ("", "00 mm"), ("", ' 1/4"'), ("", "°30'15\""), ("", "00 0 -0.6"), None, ("Ø", " H7/g6"), ("Ø", " H7 +0.021 0"), ("", "x45°"), ("M", "x1.25-6H"), ("4X Ø", "00 THRU"))
    s = F.col("p_size").cast("string")
    own = {2: F.concat(F.lit("."), F.lpad(s, 3, "0")), 8: F.concat(s, F.lit(".02-"), s, F.lit(".01"))}
    forms = [own[i] if a is None else F.concat(F.lit(a[0]), s, F.lit(a[1])) for i, a in enumerate(around)]
    return load(spark, sf, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 14 + 1).cast("int")).alias("requirement_text"))


query(
    "e8_drawn_forms",
    """SELECT p_partkey, CAST(CASE m WHEN 13 THEN 4 ELSE 1 END AS INT) AS quantity, ['linear', 'diameter', 'linear', 'linear', 'linear', 'linear', 'angle', 'linear', 'linear', 'diameter', 'diameter', 'chamfer', 'thread', 'diameter'][m + 1] AS kind,
    CAST(CASE WHEN m IN (0, 1, 4, 7, 13) THEN s * 100 WHEN m = 2 THEN s / 1000 WHEN m = 5 THEN s + 0.25 WHEN m = 6 THEN s + 0.504166666667 WHEN m = 8 THEN s + 0.02 ELSE s END AS DECIMAL(28,12)) AS nominal, CAST(CASE WHEN m IN (2, 3) THEN 3 WHEN m = 8 THEN 2 ELSE 0 END AS INT) AS scale,
    CASE m WHEN 9 THEN 'H7/g6' WHEN 10 THEN 'H7' END AS fit, CASE m WHEN 7 THEN 'deviations' WHEN 8 THEN 'limits' WHEN 10 THEN 'deviations' END AS tol_kind, CAST(CASE m WHEN 7 THEN 0 WHEN 8 THEN s + 0.02 WHEN 10 THEN 0.021 END AS DECIMAL(28,12)) AS tol_a,
    CAST(CASE m WHEN 7 THEN -0.6 WHEN 8 THEN s + 0.01 WHEN 10 THEN 0 END AS DECIMAL(28,12)) AS tol_b, CASE WHEN m IN (2, 3, 5) THEN 'in' WHEN m = 6 THEN 'deg' ELSE 'mm' END AS unit, CASE m WHEN 13 THEN 'THRU' END AS suffixes, true AS parse_ok
    FROM (SELECT p_partkey, p_partkey % 14 AS m, CAST(p_size AS DECIMAL(28,12)) AS s FROM part)""",
)(lambda s, sf: extract.callouts(_drawn(s, sf)).drop("requirement_text", "hints", "marking"))


@query(
    "t1_units",
    """WITH b AS (SELECT p_partkey, p_partkey % 14 AS m, CAST(p_size AS DECIMAL(28,12)) * CASE WHEN p_partkey % 14 = 3 THEN 25.4 ELSE 100 END AS mm FROM part WHERE p_partkey % 14 IN (0, 3)),
    t AS (SELECT *, CASE WHEN mm <= 30 THEN 0.2 WHEN mm <= 120 THEN 0.3 WHEN mm <= 400 THEN 0.5 WHEN mm <= 1000 THEN 0.8 WHEN mm <= 2000 THEN 1.2 WHEN mm <= 4000 THEN 2 END AS d FROM b)
    SELECT p_partkey, CASE WHEN d IS NULL THEN 'no_tolerance_defined' ELSE 'general' END AS rule, CAST(mm AS DECIMAL(28,12)) AS out_nominal, CAST(mm + d AS DECIMAL(28,12)) AS upper_limit, CAST(mm - d AS DECIMAL(28,12)) AS lower_limit, 'mm' AS out_unit, CASE WHEN d IS NULL THEN 'general_out_of_range' END AS hint FROM t""",
)
def limits_in_mm(spark: SparkSession, sf: str) -> DataFrame:
    """Plain sizes in inches and in mm, with limits in mm by the general table, its end at 4000 mm included."""
    rows = extract.callouts_once(_drawn(spark, sf).where("p_partkey % 14 in (0, 3)"))
    got = tolerance.derived(rows, tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS), output_unit="mm")
    return got.select("p_partkey", "rule", "out_nominal", "upper_limit", "lower_limit", "out_unit", "hint")


@query("n9_kind_order", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 0 ELSE 3 END, p_partkey) AS INT) AS place FROM part WHERE p_size = 7")
def kind_order(spark: SparkSession, sf: str) -> DataFrame:
    """One project's parts by the rank of their kinds."""
    kinds = F.array(*[F.lit(k) for k in ("diameter", "surface_texture", "other", "linear", "spherical_radius")])
    rows = load(spark, sf, "part").where("p_size = 7").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"), F.lit(1).alias("project_id"))
    rank = F.array_position(F.array(*[F.lit(k) for k in numbering.KINDS]), F.col("kind"))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("project_id").orderBy(rank, "p_partkey")).alias("place"))


@query(
    "q2_truth_categories",
    """SELECT p_partkey, ['linear_general', 'diameter_general', 'linear_general', 'linear_general', 'linear_general', 'linear_general', 'angle_general', 'one_sided', 'limit', 'fit', 'fit_printed', 'chamfer_general', 'thread', 'diameter_general'][p_partkey % 14 + 1] AS category FROM part""",
)
def truth_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Truth rows as the cascade makes them of the drawn forms."""
    rows = tolerance.derived(extract.callouts_once(_drawn(spark, sf)), tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS))
    return rows.select("p_partkey", extract.truth_category(*[F.col(c) for c in ("requirement_text", "kind", "nominal", "upper_limit", "lower_limit", "fit", "rule", "inspect_now")]).alias("category"))
