"""Readings again after a change (T9-T15, T19), and where a change came from (H6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC, follows_general, manual_limits
from gaugeworks.operators.extract import callouts_once
from gaugeworks.operators.tolerance import derived, explicit_deviations
from gaugeworks.sources.scratch import written

LENGTH_KINDS = ("linear", "diameter", "radius", "spherical_radius", "depth")
GENERAL_RULES = ("general", "custom_table")
#: What a reading gives.
READ = ("nominal", "upper_dev", "lower_dev", "upper_limit", "lower_limit", "fit", "rule")


def written_unit(kind: Column, marker: Column, inch: Column, sheet_unit: Column) -> Column:
    """Angles are in degrees; else what is written, inch notation, the sheet's unit."""
    return F.when(kind == "angle", "deg").when(marker.isin("mm", "in"), marker).when(inch, "in").otherwise(sheet_unit)


def callout_only(rows: DataFrame) -> DataFrame:
    """Rule, upper_dev, lower_dev, upper_limit, lower_limit from the written tolerance alone."""
    d = explicit_deviations(F.col("tol_kind"), F.col("tol_a"), F.col("tol_b"), F.col("nominal"))
    rows = rows.withColumn("rule", F.when(F.col("tol_kind").isNotNull(), "explicit").otherwise("no_tolerance_defined")).withColumn("upper_dev", d["upper"]).withColumn("lower_dev", d["lower"])
    return rows.withColumn("upper_limit", (F.col("nominal") + F.col("upper_dev")).cast(DEC)).withColumn("lower_limit", (F.col("nominal") + F.col("lower_dev")).cast(DEC))


def filled_unit(kind: Column, nominal: Column, unit: Column, sheet_unit: Column) -> Column:
    """A unit that is missing or goes against the kind is replaced; without a nominal it stays."""
    fits = F.when(unit.isNull(), False).when(kind == "angle", unit == "deg").otherwise(~kind.isin(*LENGTH_KINDS) | unit.isin("mm", "in"))
    return F.when(nominal.isNull() | fits, unit).when(kind == "angle", "deg").otherwise(F.coalesce(sheet_unit, F.lit("mm")))


def readings(rows: DataFrame, cells: DataFrame, general_class: str | None, basic: str = "basic") -> DataFrame:
    """New fields of each (project_id, char_id) from requirement_text and shorter_leg, as struct `new` with kind, quantity, inspect and parse_ok; `basic` marks a frame found before."""
    asked = callouts_once(rows.select("project_id", "char_id", "requirement_text", "shorter_leg", F.col(basic).alias("basic_frame")))
    asked = derived(asked.withColumn("marking", F.when(F.col("basic_frame"), "basic").otherwise(F.col("marking"))), cells, general_class)
    new = F.struct(*READ, "kind", "quantity", F.col("inspect_now").alias("inspect"), "parse_ok")
    return asked.select("project_id", "char_id", new.alias("new"))


def _changed() -> Column:
    return ~F.struct(*[F.col(f"new.{c}") for c in READ]).eqNullSafe(F.struct(*READ))


def reinterpreted(rows: DataFrame, cells: DataFrame, general_class: str | None = "m") -> DataFrame:
    """`status` manual, unreadable or reinterpreted, and the fields as they are then.

    `rows`: project_id, char_id, requirement_text, shorter_leg, basic, kind, quantity, inspect and the fields of READ.
    Kind, quantity and inspect follow the reading only where there was none before.
    """
    got = rows.join(readings(rows, cells, general_class), ["project_id", "char_id"])
    read = F.col("new.parse_ok") & (F.trim("requirement_text") != "")
    status = F.when(manual_limits(F.col("rule"), F.col("upper_limit"), F.col("lower_limit")), "manual").when(F.coalesce(read, F.lit(False)), "reinterpreted").otherwise("unreadable")
    got = got.withColumn("status", status).withColumn("never", F.col("rule").isNull())
    for c in ("kind", "quantity", "inspect"):
        got = got.withColumn(c, F.when((F.col("status") == "reinterpreted") & F.col("never"), F.col(f"new.{c}")).otherwise(F.col(c)))
    return got.withColumns({c: F.when(F.col("status") == "reinterpreted", F.col(f"new.{c}")).otherwise(F.col(c)) for c in READ}).drop("new", "never")


def general_update(rows: DataFrame, cells: DataFrame, general_class: str | None) -> DataFrame:
    """Characteristics that follow the general tolerance and whose fields a new class changes; those never read only if it gives them a general tolerance."""
    follows = rows.where(follows_general(F.col("rule"), F.col("upper_limit"), F.col("lower_limit")) & (F.trim("requirement_text") != ""))
    got = follows.join(readings(follows, cells, general_class), ["project_id", "char_id"]).where(F.col("new.parse_ok") & _changed())
    return got.where(F.col("rule").isNotNull() | F.col("new.rule").isin(*GENERAL_RULES)).select("project_id", "char_id", "new.*")


def shorter_leg_set(rows: DataFrame, legs: DataFrame, cells: DataFrame, general_class: str | None = "m") -> DataFrame:
    """`outcome` interpreted, manual_kept or unreadable of characteristics whose shorter leg (`legs`: project_id, char_id, leg) changes; the leg is stored in each case."""
    asked = rows.drop("shorter_leg").join(legs, ["project_id", "char_id"]).withColumnRenamed("leg", "shorter_leg")
    got = reinterpreted(asked, cells, general_class)
    return got.withColumn("outcome", F.when(F.col("status") == "manual", "manual_kept").when(F.col("status") == "unreadable", "unreadable").otherwise("interpreted")).drop("status")


def limits_follow(rows: DataFrame) -> DataFrame:
    """Limits and rule after an edit of nominal, deviations or limits (new values in place, *_touched flags, old_upper_limit, old_lower_limit, rule_set).

    With both deviations the limits are nominal plus deviation; else limits that came from deviations are cleared; explicit ones stay.
    Limits that change without a rule being set are manual, or have no rule if both are gone.
    """
    moved = (F.col("nominal_touched") | F.col("deviation_touched")) & ~F.col("limit_touched")
    whole = F.col("nominal").isNotNull() & F.col("upper_dev").isNotNull() & F.col("lower_dev").isNotNull()
    stale = F.col("deviation_touched") | F.col("upper_dev").isNotNull() | F.col("lower_dev").isNotNull()
    limit = lambda c: F.when(moved & whole, (F.col("nominal") + F.col(f"{c}_dev")).cast(DEC)).when(moved & stale, F.lit(None).cast(DEC)).otherwise(F.col(f"{c}_limit"))
    rows = rows.withColumns({"upper_limit": limit("upper"), "lower_limit": limit("lower")})
    same = F.col("upper_limit").eqNullSafe(F.col("old_upper_limit")) & F.col("lower_limit").eqNullSafe(F.col("old_lower_limit"))
    return rows.withColumn("rule", F.when(F.col("rule_set") | same, F.col("rule")).when(F.col("upper_limit").isNotNull() | F.col("lower_limit").isNotNull(), "manual"))


def tables_put(tables: DataFrame, given: DataFrame) -> DataFrame:
    """Custom tables of each project after `given` (project_id, table_id, version, kind, seq) came: the latest of an id counts, others than custom are refused; `place` is by id."""
    rows = tables.select("project_id", "table_id", "version", F.lit(-1).cast("bigint").alias("seq")).unionByName(given.where("kind = 'custom'").select("project_id", "table_id", "version", F.col("seq").cast("bigint").alias("seq")))
    latest = rows.groupBy("project_id", "table_id").agg(F.max_by("version", "seq").alias("version"))
    return latest.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("table_id")))


def settings_followed(settings: DataFrame, tables: DataFrame) -> DataFrame:
    """Settings (project_id, table_id, version, ...) that name a custom table take its version."""
    now = tables.select("project_id", "table_id", F.col("version").alias("_v"))
    return settings.join(now, ["project_id", "table_id"], "left").withColumn("version", F.coalesce("_v", "version")).drop("_v")


def _leaf(c: Column, char_id: Column, created: Column) -> Column:
    named = F.coalesce(F.array_contains(c["ids"], char_id), F.lit(False))
    by_rule = F.exists(F.coalesce(c["rules"], F.array().cast("array<string>")), lambda r: F.coalesce(r != "manual", F.lit(False)))
    return (
        F.when(c["type"] == "add_characteristic", F.when(created, "manual")).when(c["type"] == "accept_proposals", F.when(created, "recognition"))
        .when((c["type"] == "update_fields") & named, F.when(by_rule, "rule").otherwise("manual"))
        .when(c["type"].isin("delete_characteristics", "move_characteristics", "set_result_type") & named, "manual")
    )


def change_source(command: Column, char_id: Column, created: Column, depth: int = 1) -> Column:
    """H6: manual, rule or recognition; null if the characteristic changed as a consequence only.

    `command`: struct<type, ids, rules, commands>; in a batch the first command that says something counts, `depth` levels down.
    """
    own = _leaf(command, char_id, created)
    if not depth:
        return own
    inner = F.filter(F.transform(command["commands"], lambda c: change_source(c, char_id, created, depth - 1)), lambda s: s.isNotNull())
    return F.when(command["type"] == "batch", F.get(inner, F.lit(0))).otherwise(own)


#: Levels of batches that are opened before what came out is written.
OPENED = 4


def _opened(rows: DataFrame) -> DataFrame:
    """Batches give way to their commands; others go through, with a 0 behind their path, which keeps the order."""
    inner = F.when(F.col("kind") == "batch", F.try_variant_get("command", "$.commands", "array<variant>")).otherwise(F.array("command"))
    rows = rows.select("project_id", "entry_no", "path", F.posexplode(inner).alias("at", "command"))
    return rows.select("project_id", "entry_no", F.concat("path", F.array("at")).alias("path"), "command", F.try_variant_get("command", "$.type", "string").alias("kind"))


def single_commands(entries: DataFrame, *kept: Column) -> DataFrame:
    """H6: of log entries (project_id, entry_no, command as VARIANT) the commands that are no batches, with their place: a `path` of numbers that orders them as they are written.

    Batches come apart OPENED levels at a time, in as many rounds as the deepest asks; only batches go on. Of a command its `kept` columns are
    left (of command and kind; without any, the command), worked out once, as it comes out. An empty batch has none; a null command is left out.
    """
    keys, batch = ["project_id", "entry_no", "path"], F.coalesce(F.col("kind") == "batch", F.lit(False))
    left = entries.select("project_id", "entry_no", F.array().cast("array<int>").alias("path"), "command", F.try_variant_get("command", "$.type", "string").alias("kind"))
    found = None
    while True:
        for _ in range(OPENED):
            left = _opened(left)
        # no condition on what is worked out here: it would be pushed down, and all of it worked out for it once more
        at = written(left.select(*keys, batch.alias("_batch"), F.col("command").isNull().alias("_null"), F.when(batch, F.col("command")).alias("_left"), *(kept or [F.col("command")])), "commands")
        single = at.where("NOT _batch AND NOT _null").drop("_batch", "_null", "_left")
        found = single if found is None else found.unionByName(single)
        left = at.where("_batch").select(*keys, F.col("_left").alias("command"), F.lit("batch").alias("kind"))
        if not left.select("path").limit(1).count():
            return found


def change_sources(entries: DataFrame, touched: DataFrame) -> DataFrame:
    """H6: project_id, entry_no, char_id and `source` (manual, rule, recognition) of what entries touched; null where a characteristic changed as a consequence only.

    `entries` as for single_commands(); `touched`: project_id, entry_no, char_id, created. In a batch of any depth the first command that says something counts.
    """
    kind = F.col("kind")
    rules = F.transform(F.try_variant_get("command", "$.values", "array<variant>"), lambda v: F.try_variant_get(v, "$.derivation.rule.type", "string"))
    by_rule = F.coalesce(F.exists(rules, lambda r: F.coalesce(r != "manual", F.lit(False))), F.lit(False))
    named = kind.isin("update_fields", "delete_characteristics", "move_characteristics", "set_result_type")
    # of what was created, and of what is named
    made = F.when(kind == "add_characteristic", "manual").when(kind == "accept_proposals", "recognition")
    given = F.when(kind == "update_fields", F.when(by_rule, "rule").otherwise("manual")).when(named, "manual")
    ids = F.when(named, F.try_variant_get("command", "$.ids", "array<bigint>"))
    source = F.when(F.col("created"), F.col("made"))
    source = F.coalesce(source, F.when(F.array_contains("ids", F.col("char_id")), F.col("given")))
    said = single_commands(entries, made.alias("made"), given.alias("given"), ids.alias("ids")).where("made IS NOT NULL OR ids IS NOT NULL")
    said = said.join(touched.hint("merge"), ["project_id", "entry_no"]).withColumn("source", source).where("source IS NOT NULL")
    first = said.groupBy("project_id", "entry_no", "char_id").agg(F.min_by("source", "path").alias("source"))
    return touched.select("project_id", "entry_no", "char_id").join(first, ["project_id", "entry_no", "char_id"], "left")
