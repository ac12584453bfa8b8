"""Queries on streams of results, lists after their logs, sentences, regions and maps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators import evaluate, explain, extract, fits, history, maps, numbering, quality, regions, revise, tolerance
from gaugeworks.operators.explain import TEXTS
from gaugeworks.plans.base import load
from gaugeworks.plans.inspection import _CASCADE, _texts, query
from gaugeworks.sources import folders, scratch
from gaugeworks.streaming import state

# --- streams


@query(
    "h10_verdict_changes",
    """WITH e AS (SELECT user_id % 50 AS project_id, user_id % 7 AS sample_id, event_id % 3 AS char_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'missing' WHEN event_type = 'click' AND event_id % 3 = 2 THEN 'pass' WHEN event_id % 3 = 2 THEN 'not_evaluated' WHEN value BETWEEN 10 AND 60 THEN 'pass' ELSE 'fail' END AS verdict FROM events),
    w AS (SELECT *, lag(verdict, 1, 'missing') OVER (PARTITION BY project_id, sample_id, char_id ORDER BY seq) AS was FROM e) SELECT project_id, sample_id, char_id, seq, was, verdict, 'changed' AS status FROM w WHERE was <> verdict""",
)
def verdict_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries of cells; errors clear them, and one of three characteristics has no limits. The stream's operator, over the table as one batch."""
    for k, v in state.PROVIDER.items():
        spark.conf.set(k, v)
    events = load(spark, sf, "events")
    free = F.col("event_id") % 3 == 2
    attribute = F.when((F.col("event_type") == "click") & free, "ok")
    entries = events.select(
        (F.col("user_id") % 50).alias("project_id"), (F.col("user_id") % 7).alias("sample_id"), (F.col("event_id") % 3).alias("char_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "error", F.col("value").cast(DEC)).alias("value"), attribute.alias("attribute"),
    )
    limits = spark.range(150).select((F.col("id") % 50).alias("project_id"), F.expr("id div 50").alias("char_id")).withColumns({c: F.when(F.col("char_id") < 2, F.lit(v).cast(DEC)) for c, v in (("lower_limit", 10), ("upper_limit", 60))})
    return state.verdict_changes(entries, limits)


# --- regions and maps

# Callouts of eight forms on sheets of 24 columns, turned by the key; what the drawing says follows from the same key, never from a reading.
_TRUTH = """SELECT p_partkey, CAST(p_partkey % 5 AS INT) AS sheet_id, m, CAST(p_partkey // 5 % 24 * 48 + 24 AS DOUBLE) AS cx, CAST(p_partkey // 120 * 30 + 15 AS DOUBLE) AS cy, 30.0::DOUBLE AS w, 8.0::DOUBLE AS h, CASE WHEN p_partkey % 3 = 0 THEN 90.0 ELSE 0.0 END::DOUBLE AS angle,
  ['linear', 'diameter', 'radius', 'linear', 'linear', 'diameter', 'linear', 'thread'][m + 1] AS kind, CAST(p_size AS DECIMAL(28,12)) AS nominal, rule, up, low, m NOT IN (6) AS inspect,
  ['linear_general', 'diameter_general', 'radius_general', 'symmetric', 'asymmetric', 'fit', 'reference', 'thread'][m + 1] AS category FROM e"""


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Truth of each part's callout from its key alone."""
    m = F.col("p_partkey") % 8
    one_of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (m + 1).cast("int"))
    size, step = F.col("p_size"), F.lit
    general = F.when(size <= 6, step("0.1")).when(size <= 30, step("0.2")).otherwise(step("0.3"))
    radius = F.when(size <= 3, step("0.2")).when(size <= 6, step("0.5")).otherwise(step("1"))
    fit = F.when(size <= 3, step("0.010")).when(size <= 6, step("0.012")).when(size <= 10, step("0.015")).when(size <= 18, step("0.018")).when(size <= 30, step("0.021")).otherwise(step("0.025"))
    up = F.when(m < 2, general).when(m == 2, radius).when(m == 3, "0.1").when(m == 4, "0.2").when(m == 5, fit).cast(DEC)
    low = F.when(m == 4, F.lit("-0.1").cast(DEC)).when(m == 5, F.lit(0).cast(DEC)).otherwise(-up)
    nominal = size.cast(DEC)
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(
        "p_partkey", (k % 5).cast("int").alias("sheet_id"), k.alias("id"), (F.expr("p_partkey div 5") % 24 * 48 + 24).cast("double").alias("cx"), (F.expr("p_partkey div 120") * 30 + 15).cast("double").alias("cy"), F.lit(30.0).alias("w"), F.lit(8.0).alias("h"),
        F.when(k % 3 == 0, 90.0).otherwise(0.0).alias("angle"), one_of("linear", "diameter", "radius", "linear", "linear", "diameter", "linear", "thread").alias("kind"), nominal.alias("nominal"), (nominal + up).cast(DEC).alias("upper_limit"), (nominal + low).cast(DEC).alias("lower_limit"),
        one_of("general", "general", "general", "explicit", "explicit", "fit", "no_tolerance_defined", "no_tolerance_defined").alias("rule"), (m != 6).alias("inspect"),
        one_of("linear_general", "diameter_general", "radius_general", "symmetric", "asymmetric", "fit", "reference", "thread").alias("category"),
    )


def _read(spark: SparkSession, sf: str) -> DataFrame:
    """What reading gives for the same callouts: every eleventh stands apart from its place, every thirteenth twice, every seventeenth is misprinted."""
    k = F.col("p_partkey")
    texts = _texts(spark, sf).withColumn("requirement_text", F.when(k % 17 == 0, F.concat("requirement_text", F.lit(" §"))).otherwise(F.col("requirement_text")))
    rows = tolerance.derived_once(texts, tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)).withColumn("inspect", F.col("inspect_now"))
    at = _truth(spark, sf).select("p_partkey", "sheet_id", (F.col("cx") + 1 + F.when(k % 11 == 0, 5000.0).otherwise(0.0)).alias("cx"), F.col("cy"), (F.col("w") - 2).alias("w"), "h", (F.col("angle") + F.when(k % 2 == 0, 180.0).otherwise(0.0)).alias("angle"))
    return rows.join(at, "p_partkey").withColumn("copy", F.explode(F.when(k % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return regions.compared_by_region(_truth(spark, sf), _read(spark, sf), ["sheet_id"])


_CASES = f"WITH {_CASCADE}, t AS ({_TRUTH}), c AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END AS n, p_partkey % 17 = 0 AS spoilt FROM t)"
query(
    "j13_by_region",
    f"""{_CASES} SELECT p_partkey, CAST(n AS BIGINT) AS n_proposals, CASE WHEN n <> 1 THEN 'proposals' WHEN spoilt THEN concat_ws(',', 'kind', 'nominal', CASE WHEN m < 6 THEN 'upper_limit,lower_limit' END, CASE WHEN m NOT IN (6, 7) THEN 'rule' END, CASE WHEN m = 6 THEN 'inspect' END, 'parse_error') ELSE '' END AS wrong FROM c""",
)(lambda s, sf: _cases(s, sf).select("p_partkey", "n_proposals", F.array_join("wrong", ",").alias("wrong")))


@query(
    "q7_evaluation",
    f"""{_CASES}, x AS (SELECT category, angle <> 0 AS rotated, category IN ('asymmetric', 'one_sided', 'limit', 'fit_printed') AS stacked, m = 3 AS comma, n = 1 AND NOT spoilt AS ok FROM c UNION ALL SELECT 'other', false, false, false, false FROM supplier),
    g AS (SELECT 'category' AS "of", category AS name, ok FROM x UNION ALL SELECT 'trait', 'rotated', ok FROM x WHERE rotated UNION ALL SELECT 'trait', 'stacked', ok FROM x WHERE stacked UNION ALL SELECT 'trait', 'decimal_comma', ok FROM x WHERE comma UNION ALL SELECT 'total', 'strict', ok FROM x WHERE category <> 'other'),
    names AS (SELECT 'category' AS "of", unnest(['linear_general', 'diameter_general', 'radius_general', 'angle_general', 'chamfer_general', 'symmetric', 'asymmetric', 'one_sided', 'limit', 'fit', 'fit_printed', 'thread', 'reference', 'other']) AS name UNION ALL SELECT 'trait', unnest(['decimal_comma', 'rotated', 'stacked', 'leg_entered']) UNION ALL SELECT 'total', 'strict'),
    k AS (SELECT names."of", names.name, count(ok) AS n, count(*) FILTER (ok) AS n_correct FROM names LEFT JOIN g ON names."of" = g."of" AND names.name = g.name GROUP BY 1, 2)
    SELECT "of", name, n, n_correct, CASE WHEN n > 0 THEN ((n_correct * 1000 + n // 2) // n) / 10.0 END AS percent, n > 0 AND n_correct * 100 >= n * 99 AS passes FROM k""",
)
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of the region join, and a second set of free texts that nobody could read; both together."""
    texts = _texts(spark, sf)
    cases = _cases(spark, sf).join(texts, "p_partkey").withColumn("traits", regions.truth_traits(F.col("requirement_text"), F.col("angle"), F.col("category"))).withColumn("leg_entered", F.lit(False))
    free = load(spark, sf, "supplier").select(F.lit("other").alias("category"), F.array().cast("array<string>").alias("traits"), F.lit(False).alias("leg_entered"), F.lit(False).alias("correct"))
    return regions.evaluation(cases, free)


# A sheet of 1190 x 842 is turned by a quarter, so that x' = 842 - y and y' = x, then stretched to twice the width
@query(
    "g1_sheet_edits",
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 20 AS sheet_id, CAST(p_partkey * 37 % 1400 AS DOUBLE) AS x, CAST(p_partkey * 53 % 1000 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 7 + 1 AS DOUBLE) AS h, CAST(p_partkey % 4 * 30 AS DOUBLE) AS angle FROM part),
    q AS (SELECT *, sheet_id % 5 <> 4 AS mapped, 2 * (842 - y) AS nx, x AS ny FROM p),
    b AS (SELECT sheet_id, 'balloon' AS what, id, CASE WHEN mapped THEN least(greatest(nx, 0), 1684) ELSE x END AS x, CASE WHEN mapped THEN least(greatest(ny, 0), 1190) ELSE y END AS y, NULL::DOUBLE AS w, NULL::DOUBLE AS h, true AS kept FROM q),
    v AS (SELECT sheet_id, 'view' AS what, id, mapped, x, y, w, h, greatest(2 * (842 - y - h), 0) AS l, greatest(x, 0) AS t, least(nx, 1684) AS r, least(x + w, 1190) AS bt FROM q),
    vv AS (SELECT sheet_id, what, id, CASE WHEN NOT mapped THEN x WHEN r > l AND bt > t THEN l END AS x, CASE WHEN NOT mapped THEN y WHEN r > l AND bt > t THEN t END AS y, CASE WHEN NOT mapped THEN w WHEN r > l AND bt > t THEN r - l END AS w, CASE WHEN NOT mapped THEN h WHEN r > l AND bt > t THEN bt - t END AS h, NOT mapped OR (r > l AND bt > t) AS kept FROM v),
    s AS (SELECT sheet_id, 'source' AS what, id, CASE WHEN mapped THEN nx ELSE x END AS x, CASE WHEN mapped THEN ny ELSE y END AS y, CASE WHEN mapped THEN w * sqrt(4 * pow(sin(radians(angle)), 2) + pow(cos(radians(angle)), 2)) ELSE w END AS w, CASE WHEN mapped THEN h * sqrt(4 * pow(cos(radians(angle)), 2) + pow(sin(radians(angle)), 2)) ELSE h END AS h, true AS kept FROM q)
    SELECT sheet_id, what, id, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h, kept FROM (SELECT * FROM b UNION ALL SELECT * FROM vv UNION ALL SELECT * FROM s)""",
)
def sheet_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Marks by key on twenty sheets, of which every fifth has no map. The map comes from four corners."""
    k = F.col("p_partkey")
    marks = load(spark, sf, "part").select(
        k.alias("id"), (k % 20).alias("sheet_id"), (k * 37 % 1400).cast("double").alias("x"), (k * 53 % 1000).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), (F.col("p_size") % 7 + 1).cast("double").alias("h"), (k % 4 * 30).cast("double").alias("angle"),
    )
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    # the new sheet's corners, clockwise from its top left, as they stand on the old one
    sheets = spark.range(20).where("id % 5 <> 4").select(F.col("id").alias("sheet_id"), F.array(corner(0, 842), corner(0, 0), corner(1190, 0), corner(1190, 842)).alias("quad"), F.lit(1684.0).alias("width"), F.lit(1190.0).alias("height"))
    of = sheets.withColumn("map", maps.quad_map(F.col("quad"), F.col("width"), F.col("height"))).drop("quad")
    balloons = marks.select("sheet_id", "id", "x", "y", F.col("x").alias("anchor_x"), F.col("y").alias("anchor_y"))
    sources = marks.select("sheet_id", "id", F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h", "angle")
    views = marks.select("sheet_id", "id", "x", "y", "w", "h")
    got = maps.sheet_edits(balloons, sources, views, views.limit(0), of)
    return got.select("sheet_id", "what", "id", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")], "kept")


# --- sentences

_SAID = """WITH {cascade}, s AS (SELECT p_partkey, m, CAST(p_size AS VARCHAR) AS n, CASE WHEN p_size <= 3 THEN 3 WHEN p_size <= 6 THEN 6 WHEN p_size <= 10 THEN 10 WHEN p_size <= 18 THEN 18 WHEN p_size <= 30 THEN 30 ELSE 50 END AS step, p_size, up FROM e),
    r AS (SELECT *, CASE WHEN m = 5 THEN CASE step WHEN 3 THEN '{upto} 3' WHEN 6 THEN '{over} 3 {upto} 6' WHEN 10 THEN '{over} 6 {upto} 10' WHEN 18 THEN '{over} 10 {upto} 18' WHEN 30 THEN '{over} 18 {upto} 30' ELSE '{over} 30 {upto} 50' END
      WHEN p_size <= 3 THEN '{from_} 0{p}5 {upto} 3' WHEN p_size <= 6 THEN '{over} 3 {upto} 6' WHEN m = 2 THEN '{over} 6' WHEN p_size <= 30 THEN '{over} 6 {upto} 30' ELSE '{over} 30 {upto} 120' END || ' mm' AS range, replace(regexp_replace(CAST(up AS VARCHAR), '\\.?0+$', ''), '.', '{p}') AS dev FROM s)
    SELECT p_partkey, CASE m WHEN 3 THEN '{explicit} ±0{p}1 mm.' WHEN 4 THEN '{explicit} +0{p}2 / -0{p}1 mm.' WHEN 5 THEN '{fit} ' || '{nominal} ' || n || ' mm {is_in} ' || range || ', {so} +' || dev || ' / 0 mm.' WHEN 6 THEN '{reference}' WHEN 7 THEN '{nothing}'
      ELSE '{general} ' || CASE WHEN m = 2 THEN 'radius_chamfer' ELSE 'linear' END || '. {nominal} ' || n || ' mm {is_in} ' || range || ', {so} ±' || dev || ' mm.' END AS explanation FROM r"""
_WORDS = {
    "en": dict(upto="up to and including", over="over", from_="from", p=".", explicit="Tolerance written on the drawing:", fit="Fit H7 from table iso-286 version 2.", nominal="Nominal", is_in="is in the range", so="so", reference=TEXTS["en"]["reference_dimension"], nothing=TEXTS["en"]["no_tolerance_defined"], general="No tolerance on the drawing. General tolerance iso-2768-1 version 1, class m, part"),
    "de": dict(upto="bis einschließlich", over="über", from_="ab", p=",", explicit="Toleranz in der Zeichnung angegeben:", fit="Passung H7 aus Tabelle iso-286 Version 2.", nominal="Nennmaß", is_in="liegt im Bereich", so="daher", reference=TEXTS["de"]["reference_dimension"], nothing=TEXTS["de"]["no_tolerance_defined"], general="Keine Toleranz in der Zeichnung. Allgemeintoleranz iso-2768-1 Version 1, Klasse m, Teil"),
}


def _sentences(language: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cells = tolerance.table_cells(spark, tolerance.GENERAL, tolerance.FITS)
        return explain.explained_once(_texts(spark, sf), cells, language).select("p_partkey", "explanation")

    return run


for _language, _words in _WORDS.items():
    query(f"t16_sentences_{_language}", _SAID.format(cascade=_CASCADE, **_words))(_sentences(_language))


# --- fits of all sizes

_IT = {g: [int(v) for v in fits.GRADES[g].split()] for g in ("IT6", "IT7", "IT8", "IT9")}
_ENDS = [int(v) for v in fits.RANGES.split()]
_ASKED = ("H7", "h6", "js9", "K7", "P6", "N9", "f8", "m6", "JS7", "d11", "G7", "Z99")


def _at(values: list[int]) -> str:
    return f"CASE {' '.join(f'WHEN size <= {e} THEN {v}' for e, v in zip(_ENDS, values, strict=True))} END"


def _shaft(letter: str) -> str:
    return _at([int(v) for v in (fits.SHAFT_UPPER | fits.SHAFT_LOWER)[letter].split()])


# Deviations in micrometres, written out for each of the twelve classes: the lower one of a hole from H on, the upper one of a shaft to h, or what its delta gives
_UP = {
    "H7": _at(_IT["IT7"]), "h6": "0", "js9": f"({_at(_IT['IT9'])}) / 2.0", "K7": f"-({_shaft('k')}) + CASE WHEN size <= 3 THEN 0 ELSE ({_at(_IT['IT7'])}) - ({_at(_IT['IT6'])}) END", "P6": f"-({_shaft('p')}) + CASE WHEN size <= 3 THEN 0 ELSE ({_at(_IT['IT6'])}) - ({_at([int(v) for v in fits.GRADES['IT5'].split()])}) END",
    "N9": "CASE WHEN size <= 1 THEN NULL WHEN size <= 3 THEN -4 ELSE 0 END", "f8": f"-({_shaft('f')})", "m6": f"({_shaft('m')}) + ({_at(_IT['IT6'])})", "JS7": f"({_at(_IT['IT7'])}) / 2.0", "d11": f"-({_shaft('d')})", "G7": f"({_shaft('g')}) + ({_at(_IT['IT7'])})", "Z99": "NULL",
}
_WIDE = {"H7": 7, "h6": 6, "js9": 9, "K7": 7, "P6": 6, "N9": 9, "f8": 8, "m6": 6, "JS7": 7, "G7": 7}
query(
    "t4_fits_of_all_sizes",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 560 + 1 AS size, p_partkey % 12 AS k FROM part),
    u AS (SELECT *, CASE k {' '.join(f'WHEN {i} THEN {_UP[f]}' for i, f in enumerate(_ASKED))} END AS up, CASE k {' '.join(f'WHEN {i} THEN {_at(_IT[f"IT{_WIDE[f]}"])}' if f in _WIDE else f'WHEN {i} THEN 10 * ({_at(_IT["IT6"])})' if f == 'd11' else f'WHEN {i} THEN NULL' for i, f in enumerate(_ASKED))} END AS wide FROM p)
    SELECT p_partkey, CASE WHEN k = 11 THEN 'no_fit' WHEN wide IS NULL THEN 'out_of_range' WHEN up IS NULL THEN 'not_defined' ELSE 'value' END AS fit_found, CAST(CASE WHEN wide IS NOT NULL THEN up END AS DOUBLE) / 1000 AS fit_upper, CAST(CASE WHEN up IS NOT NULL THEN up - wide END AS DOUBLE) / 1000 AS fit_lower FROM u""",
)(lambda s, sf: tolerance.expanded_fits(_asked_fits(s, sf), tolerance.table_cells(s, tolerance.FITS)).select("p_partkey", "fit_found", F.round(F.col("fit_upper").cast("double"), 6).alias("fit_upper"), F.round(F.col("fit_lower").cast("double"), 6).alias("fit_lower")))


def _asked_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes from 1 to 560 mm with twelve classes in turn, one of which is none."""
    k = F.col("p_partkey")
    return load(spark, sf, "part").select("p_partkey", (k % 560 + 1).cast(DEC).alias("nominal"), F.element_at(F.array(*map(F.lit, _ASKED)), (k % 12 + 1).cast("int")).alias("fit"))


# --- second readings, cascades, batches, folders


@query(
    "q5_second_pass",
    """WITH a AS (SELECT s_nationkey AS project_id, s_suppkey AS char_id, s_suppkey % 90 + 1 AS n, s_suppkey % 3 <> 0 AS known, s_suppkey % 200 + 1 AS leg FROM supplier)
    SELECT project_id, char_id, CAST(n AS DOUBLE) AS nominal, CASE WHEN known THEN 'general' ELSE 'no_tolerance_defined' END AS rule, CASE WHEN known THEN CASE WHEN leg <= 10 THEN 1 WHEN leg <= 50 THEN 0.5 WHEN leg <= 120 THEN 0.333333 ELSE 0.166666 END END::DOUBLE AS upper_dev, known AS second FROM a""",
)
def second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Angles without a leg on the drawing; two of three truths have one. Both readings go through the cascade."""
    k = F.col("s_suppkey")
    texts = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("project_id"), k.alias("char_id"), F.concat((k % 90 + 1).cast("string"), F.lit("°")).alias("requirement_text"), (k % 200 + 1).cast(DEC).alias("leg"))
    cells = tolerance.table_cells(spark, tolerance.GENERAL)
    callouts = extract.callouts_once(texts.drop("leg"))
    read = tolerance.derived(callouts, cells)
    again = lambda rows: tolerance.derived(callouts.join(rows.select("project_id", "char_id", "shorter_leg"), ["project_id", "char_id"]), cells).drop("shorter_leg")
    got = quality.second_pass(read, texts.where("char_id % 3 <> 0"), again)
    return got.select("project_id", "char_id", F.col("nominal").cast("double").alias("nominal"), "rule", F.col("upper_dev").cast("double").alias("upper_dev"), "second")


@query(
    "j15_cascade",
    """SELECT c_custkey AS project_id, count(DISTINCT o_orderkey) AS samples, count(l_orderkey) AS results FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_custkey % 3 = 0 GROUP BY 1""",
)
def dependents(spark: SparkSession, sf: str) -> DataFrame:
    """What goes with every third project: its orders as samples, their lines as results."""
    roots = load(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"))
    samples = load(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sample_id"))
    results = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("char_id"))
    return evaluate.cascade(roots, ["project_id"], [("samples", samples, ["project_id"]), ("results", results, ["sample_id"])])


@query(
    "h6_nested_batches",
    """SELECT user_id % 50 AS project_id, event_id AS entry_no, event_id % 7 AS char_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'rule' ELSE 'manual' END WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'manual' END WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'recognition' END END AS source FROM events""",
)
def nested_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Commands in up to six batches inside each other, behind one that says nothing."""
    k = F.col("event_id")
    depth = (k % 7).cast("int")
    rule = F.when(k % 2 == 0, "general").otherwise("manual")
    update = F.format_string('{"type": "update_fields", "ids": [%d], "values": [{"field": "kind"}, {"derivation": {"rule": {"type": "%s"}}}]}', k % 7, rule)
    single = F.when(F.col("event_type") == "click", update).when(F.col("event_type") == "view", '{"type": "add_characteristic"}').when(F.col("event_type") == "error", '{"type": "accept_proposals"}').otherwise('{"type": "update_sheet"}')
    nothing = F.lit('{"type": "batch", "commands": [{"type": "move_characteristics", "ids": [999]}, ')
    text = F.concat(F.repeat(nothing, depth), single, F.repeat(F.lit("]}"), depth))
    events = load(spark, sf, "events")
    entries = events.select((F.col("user_id") % 50).alias("project_id"), k.alias("entry_no"), F.parse_json(text).alias("command"))
    touched = events.select((F.col("user_id") % 50).alias("project_id"), k.alias("entry_no"), (k % 7).alias("char_id"), (k % 3 == 0).alias("created"))
    return revise.change_sources(entries, touched)


@query(
    "s2_project_folders",
    """WITH s AS (SELECT s_nationkey AS n, s_nationkey % 5 + 1 AS v, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)
    SELECT 'folder=' || n AS project_id, CAST(pos AS INT) AS pos, CAST(k AS VARCHAR) AS number, CASE WHEN v = 1 AND k % 2 = 0 THEN 'manual' WHEN v > 1 THEN 'explicit' END AS rule, CASE WHEN v <= 2 THEN 'auto' ELSE 'attribute' END AS result_type, CASE WHEN k % 2 = 0 THEN k || '.5' END AS upper_limit FROM s WHERE v <= 4""",
)
def project_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as project folders of versions 1 to 5 in turn, suppliers as their characteristics, written and read back."""
    of = load(spark, sf, "supplier").withColumn("version", F.col("s_nationkey") % 5 + 1)
    rule = F.when(F.col("version") > 1, F.struct(F.struct(F.lit("explicit").alias("type")).alias("rule")))
    char = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("number"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_suppkey").cast("string"), F.lit(".5"))).alias("upper_limit"), rule.alias("derivation"), F.when(F.col("version") > 2, "attribute").alias("result_type"))
    docs = of.groupBy(F.col("s_nationkey").alias("folder"), "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", char.alias("c")))), lambda r: r["c"]).alias("characteristics"))
    at = f"{scratch.shared_folder(spark)}/folders-{uuid.uuid4().hex}"
    for name, body in (("manifests", F.struct(F.col("version").alias("schema_version"))), ("documents", F.struct("characteristics"))):
        docs.select("folder", F.to_json(body).alias("value")).repartition("folder").write.partitionBy("folder").text(f"{at}/{name}")
    return folders.Folders(spark, at, "manifests/folder=*/part-*", "documents/folder=*/part-*").table("characteristics").select("project_id", "pos", "number", "rule", "result_type", "upper_limit")


# --- states and refusals


def _dec(value: Column, scale: Column) -> Column:
    return F.struct(value.cast(DEC).alias("value"), scale.cast("int").alias("scale"))


@query(
    "h5_state_fields",
    """WITH b AS (SELECT event_id, user_id % 3 AS v, event_id % 2 AS s, event_type AS t, lag(user_id % 3) OVER w AS v0, lag(event_id % 2) OVER w AS s0, lag(event_type) OVER w AS t0, lag(event_id) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id))
    SELECT event_id, concat_ws(',', CASE WHEN t <> t0 THEN 'kind' END, CASE WHEN v <> v0 OR s <> s0 THEN 'nominal' END, CASE WHEN v <> v0 THEN 'upper_limit' END) AS fields FROM b WHERE e IS NOT NULL""",
)
def state_fields(spark: SparkSession, sf: str) -> DataFrame:
    """States by event; the nominal's scale changes without its value."""
    v, s = F.col("user_id") % 3, F.col("event_id") % 2
    rows = load(spark, sf, "events").withColumn("after", F.struct(F.col("event_type").alias("kind"), _dec(v, s).alias("nominal"), _dec(v, F.lit(1)).alias("upper_limit")))
    rows = rows.withColumn("before", F.lag("after").over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id"))).where("before is not null")
    return history.changed_state_fields(rows).select("event_id", F.array_join("fields", ",").alias("fields"))


_H7 = "SELECT user_id % 20 AS project_id, event_id % 11 AS char_id, event_id AS seq, event_id // 10 AS entry_no, user_id % 3 AS v, event_id % 2 AS s, CASE WHEN event_type = 'error' THEN 'attribute' ELSE 'auto' END AS t FROM events"


@query(
    "h7_limits_since_issue",
    f"""WITH c AS ({_H7}), i AS (SELECT project_id, max(entry_no) AS issued FROM c WHERE entry_no % 7 = 0 AND project_id % 4 <> 3 GROUP BY 1), b AS (SELECT *, lag(v) OVER w AS v0, lag(s) OVER w AS s0, lag(t) OVER w AS t0, lag(seq) OVER w AS had FROM c WINDOW w AS (PARTITION BY project_id, char_id ORDER BY seq)),
    f AS (SELECT project_id, char_id, arg_min(struct_pack(v := v0, s := s0, t := t0, had := had), seq) AS x FROM b JOIN i USING (project_id) WHERE entry_no > issued GROUP BY 1, 2), n AS (SELECT project_id, char_id, arg_max(struct_pack(v := v, s := s, t := t), seq) AS y FROM c GROUP BY 1, 2)
    SELECT project_id, char_id FROM f JOIN n USING (project_id, char_id) WHERE x.had IS NOT NULL AND (x.v <> y.v OR x.s <> y.s OR (x.t = 'attribute') <> (y.t = 'attribute'))""",
)
def limits_since_issue(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of a characteristic is its state; a quarter of the projects never issued anything."""
    k, u = F.col("event_id"), F.col("user_id")
    state_ = F.struct(_dec(u % 3, k % 2).alias("upper_limit"), _dec(F.lit(0), F.lit(0)).alias("lower_limit"), F.when(F.col("event_type") == "error", "attribute").otherwise("auto").alias("result_type"))
    rows = load(spark, sf, "events").select((u % 20).alias("project_id"), (k % 11).alias("char_id"), k.alias("seq"), F.expr("event_id div 10").alias("entry_no"), state_.alias("after"))
    changes = rows.withColumn("before", F.lag("after").over(Window.partitionBy("project_id", "char_id").orderBy("seq")))
    current = rows.groupBy("project_id", "char_id").agg(F.max_by("after", "seq").alias("s")).select("project_id", "char_id", "s.*")
    return history.limits_since_issue(current, changes, rows.where("entry_no % 7 = 0 AND project_id % 4 <> 3").select("project_id", "entry_no"))


query(
    "n17_accepted",
    """WITH p AS (SELECT p_partkey, p_partkey % 10 AS project_id, CAST(p_size AS INT) AS q, p_partkey % 10 < 6 AND p_partkey % 10 <> 2 AND p_size BETWEEN 2 AND 100 AS split FROM part WHERE p_size <= 12)
    SELECT p_partkey, CAST(f AS INT) AS feature, CASE WHEN split THEN 1 ELSE q END AS quantity, CAST(100 + CASE WHEN split THEN 34 * (f - 1) ELSE 0 END AS DOUBLE) AS place_y FROM p, generate_series(1, 12) g(f) WHERE f <= CASE WHEN split THEN q ELSE 1 END""",
)(lambda s, sf: numbering.accepted(
    load(s, sf, "part").where("p_size <= 12").select("p_partkey", (F.col("p_partkey") % 10).alias("project_id"), F.col("p_size").cast("int").alias("quantity"), F.lit(0.0).alias("place_x"), F.lit(100.0).alias("place_y")),
    s.range(10).select(F.col("id").alias("project_id"), F.when(F.col("id") < 6, "sub_number").otherwise("quantity").alias("multi_instance"), (F.col("id") == 2).alias("locked"), F.lit(10.0).alias("size_mm")),
).select("p_partkey", "feature", "quantity", "place_y"))
