"""State and history from an append-only log (H1-H8, J14), edits in bulk. Lists are in lists.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import date_ok, effective_type, parsed_result, same_digits


def exploded(audit: DataFrame) -> DataFrame:
    """H1: a row for each change, in the order of application."""
    return audit.select("project_id", "entry_no", "timestamp", "user", F.posexplode("changes").alias("change_no", "c")).select("*", F.struct("entry_no", "change_no").alias("seq"), "c.*").drop("c")


def current_state(snapshot: DataFrame, changes: DataFrame, entity: str, after: str = "after") -> DataFrame:
    """H2: the last value of each entity; a change without `after` removes it. max_by folds in parallel, no order of the whole log is needed."""
    last = changes.groupBy("project_id", entity).agg(F.max_by(F.struct(F.col(after).alias("v")), "seq").alias("l"))
    both = snapshot.withColumnRenamed(after, "was").join(last, ["project_id", entity], "full")
    return both.select("project_id", entity, F.when(F.col("l").isNotNull(), F.col("l.v")).otherwise(F.col("was")).alias(after)).where(F.col(after).isNotNull())


def refused_edits(edits: DataFrame, known: DataFrame) -> DataFrame:
    """Edits (entity, field, value) with the reason why each is refused, null for those that hold; `known`: entity, the characteristics there are."""
    field, value = F.col("field"), F.col("value")
    turn = value.try_cast("int")
    reason = (
        F.when(F.col("_known").isNull(), "unknown_characteristic").when((field == "quantity") & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 0), "zero_quantity")
        .when((field == "date") & ~F.coalesce(date_ok(value), F.lit(False)), "invalid_date").when((field == "serial") & (F.coalesce(F.trim(value), F.lit("")) == ""), "empty_serial")
        .when((field == "rotation") & ~F.coalesce(turn.isin(0, 90, 180, 270), F.lit(False)), "invalid_sheet_setting")
    )
    return edits.join(known.select("entity").distinct().withColumn("_known", F.lit(True)), "entity", "left").withColumn("reason", reason).drop("_known")


def with_before(changes: DataFrame, entity: str, value: str, order: str) -> DataFrame:
    """The value that the entity had before each change."""
    return changes.withColumn("before", F.lag(value).over(Window.partitionBy(entity).orderBy(order)))


def broken_projects(changes: DataFrame, entity: str, snapshot: DataFrame | None = None) -> DataFrame:
    """H3: projects whose log does not fit together: a `before` that is not the `after` of the change before. All their entries are refused.

    The first `before` of an entity has to be its `after` in the snapshot that the log starts from, null where it is absent; without
    a snapshot the log starts from nothing.
    """
    w = Window.partitionBy("project_id", entity).orderBy("seq")
    rows = changes.withColumn("was", F.lit(None))
    if snapshot is not None:
        rows = changes.join(snapshot.select("project_id", entity, F.col("after").alias("was")), ["project_id", entity], "left")
    state = F.when(F.row_number().over(w) == 1, F.col("was")).otherwise(F.lag("after").over(w))
    return rows.withColumn("bad", ~state.eqNullSafe(F.col("before"))).groupBy("project_id").agg(F.bool_or("bad").alias("broken"))


def entity_history(changes: DataFrame, entity: str) -> DataFrame:
    """H4: one row for each entry that touches an entity: what it was before and after, and whether its command creates the entity.

    `changes` may have `action`: an entry that undoes a command takes back what that created.
    """
    action = F.max("action") if "action" in changes.columns else F.lit("command")
    rows = changes.groupBy("project_id", entity, "entry_no").agg(F.min_by("before", "change_no").alias("before"), F.max_by("after", "change_no").alias("after"), F.count("*").alias("n_changes"), action.alias("action"))
    return rows.withColumn("created", F.when(F.col("action") == "undo", F.col("after").isNull()).otherwise(F.col("before").isNull()))


def changed_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Names of the fields in which structs `before` and `after` differ, in their order."""
    names = F.array_compact(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]))
    return rows.withColumn("fields", names)


# The fields of a characteristic in which states are compared, in order; those of DECIMALS by value and written scale
STATE_FIELDS = (
    "number", "kind", "requirement_text", "nominal", "unit", "upper_dev", "lower_dev", "upper_limit", "lower_limit", "fit", "derivation", "quantity", "classification", "inspection", "inspect", "status", "origin", "sources", "comment", "shorter_leg", "result_type",
)
DECIMALS = ("nominal", "upper_dev", "lower_dev", "upper_limit", "lower_limit")


def changed_state_fields(rows: DataFrame) -> DataFrame:
    """H5: names of the STATE_FIELDS in which structs `before` and `after` differ, in order. Decimals are structs of value and scale (8.0 is not 8.00); where both states lack a field it is not compared."""
    there = [f for f in STATE_FIELDS if f in rows.schema["before"].dataType.fieldNames()]
    differs = {f: ~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")) for f in there}
    for f in set(there) & set(DECIMALS):
        differs[f] = ~same_digits(F.col(f"before.{f}.value"), F.col(f"before.{f}.scale"), F.col(f"after.{f}.value"), F.col(f"after.{f}.scale"))
    return rows.withColumn("fields", F.array_compact(F.array(*[F.when(differs[f], F.lit(f)) for f in there])))


def limits_since_issue(current: DataFrame, changes: DataFrame, issues: DataFrame) -> DataFrame:
    """H7: project_id, char_id of characteristics whose limits (value and scale) or effective result type are not what they were at the last issue of their project.

    `current` and structs `before` of `changes` (project_id, char_id, seq, entry_no) have upper_limit, lower_limit (structs of value and scale) and result_type; a
    null `before` is an insert. Only states are compared: what was changed back is not listed, nor what came after the issue, nor
    anything where nothing was issued. Removed characteristics are no current ones.
    """
    last = issues.groupBy("project_id").agg(F.max("entry_no").alias("_issued"))
    then = changes.join(F.broadcast(last), "project_id").where("entry_no > _issued").groupBy("project_id", "char_id").agg(F.min_by(F.struct(F.col("before").alias("v")), "seq").alias("_then"))
    rows = current.join(then, ["project_id", "char_id"]).where("_then.v IS NOT NULL")
    kind = lambda at: effective_type(F.col(f"{at}result_type"), F.col(f"{at}upper_limit.value"), F.col(f"{at}lower_limit.value"))
    same = [same_digits(F.col(f"{c}.value"), F.col(f"{c}.scale"), F.col(f"_then.v.{c}.value"), F.col(f"_then.v.{c}.scale")) for c in ("upper_limit", "lower_limit")]
    return rows.where(~(same[0] & same[1] & kind("").eqNullSafe(kind("_then.v.")))).select("project_id", "char_id")


#: Most samples of a project, and most that are added at once.
MOST_SAMPLES, MOST_ADDED = 500, 100


def refused_commands(commands: DataFrame, entities: DataFrame, projects: DataFrame) -> DataFrame:
    """Commands with the first reason for which each is refused, null for those that hold.

    `commands`: project_id, command_id, type, ids (of what it names), what (characteristic, balloon, sheet, sample, revision), before (where they are moved), x, y, size, field, value, n.
    `entities`: project_id, what, id, and for revisions is_image, for characteristics result_type and n_variable, n_attribute of their results, for samples serial.
    `projects`: project_id, locked, n_samples, n_undo, n_redo, tables (ids of stored custom tables). What a command names is counted, so that
    a command of many ids is one row for each only on its way.
    """
    named = commands.select("project_id", "command_id", "what", F.explode("ids").alias("id")).distinct()
    known = entities.select("project_id", "what", "id", "is_image", "result_type", "n_variable", "n_attribute").withColumn("_there", F.lit(True))
    met = named.join(known, ["project_id", "what", "id"], "left").groupBy("project_id", "command_id").agg(
        F.count_if(F.col("_there").isNull()).alias("_unknown"), F.count_if(~F.coalesce("is_image", F.lit(True))).alias("_pdf"), F.sum(F.coalesce("n_variable", F.lit(0))).alias("_variable"), F.sum(F.coalesce("n_attribute", F.lit(0))).alias("_attribute"),
    )
    serials = entities.where("what = 'sample' AND serial IS NOT NULL").select("project_id", F.col("serial").alias("_serial"), F.col("id").alias("_owner"))
    # a serial is another's if some sample that the command does not name has it
    taken = commands.where("field = 'serial'").select("project_id", "command_id", "ids", F.trim("value").alias("_serial")).join(serials, ["project_id", "_serial"]).where(~F.array_contains("ids", F.col("_owner"))).select("project_id", "command_id").distinct().withColumn("_taken", F.lit(True))
    keys = ["project_id", "command_id"]
    rows = commands.join(met, keys, "left").join(taken, keys, "left").join(projects, "project_id", "left")
    kind, field, value = F.col("type"), F.col("field"), F.col("value")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    typed = parsed_result(value)
    reason = F.when((kind == "undo") & no(F.col("n_undo") > 0), "nothing_to_undo").when((kind == "redo") & no(F.col("n_redo") > 0), "nothing_to_redo")
    for what in ("characteristic", "balloon", "sheet", "sample", "revision"):
        reason = reason.when((F.col("what") == what) & (F.coalesce("_unknown", F.lit(0)) > 0), f"unknown_{what}")
    reason = (
        reason.when(kind.isin("renumber", "move_characteristics", "set_strategy") & F.coalesce("locked", F.lit(False)), "numbering_locked").when(kind.isin("move_characteristics", "move_samples") & F.array_contains("ids", F.col("before")), "invalid_move_target")
        .when(kind.isin("move_balloons", "add_characteristic") & ~(finite("x") & finite("y")), "invalid_geometry").when((kind == "restyle_balloons") & ~(finite("size") & (F.col("size") > 0)), "invalid_style")
        .when((kind == "set_image_edit") & (F.coalesce("_pdf", F.lit(0)) > 0), "not_an_image").when((kind == "set_image_edit") & no(value.try_cast("double").between(-45, 45)), "invalid_image_edit")
        .when((kind == "update_sheet") & (field == "unit") & no(value.isin("mm", "in")), "invalid_sheet_setting").when((kind == "update_sheet") & (field == "rotation") & no(value.try_cast("int").isin(0, 90, 180, 270)), "invalid_sheet_setting")
        .when((kind == "update_settings") & (field == "places") & no(value.try_cast("int").between(0, 10)), "invalid_project_setting").when((kind == "update_settings") & (field == "custom_table") & no(F.array_contains("tables", value)), "missing_table")
        .when((field == "quantity") & no(value.try_cast("int") > 0), "zero_quantity").when((field == "date") & no(date_ok(value)), "invalid_date").when((field == "serial") & no(F.trim(value) != ""), "empty_serial").when((field == "serial") & F.col("_taken"), "duplicate_serial")
        .when((kind == "add_samples") & no(F.col("n").between(1, MOST_ADDED)), "invalid_sample_count").when((kind == "add_samples") & (F.coalesce("n_samples", F.lit(0)) + F.col("n") > MOST_SAMPLES), "too_many_samples")
        .when((kind == "set_result") & ~typed["ok"], "invalid_result").when((kind == "set_result_type") & (value == "variable") & (F.col("_attribute") > 0), "result_type_conflict").when((kind == "set_result_type") & (value == "attribute") & (F.col("_variable") > 0), "result_type_conflict")
    )
    return rows.select(*keys, reason.alias("reason"))


def changed_since_issue(changes: DataFrame, issues: DataFrame, entity: str) -> DataFrame:
    """Entities whose value differs from that at the last issue of their project; none if nothing was issued, none if changed back."""
    last = issues.groupBy("project_id").agg(F.max("entry_no").alias("issued"))
    later = changes.join(last, "project_id").where("entry_no > issued")
    ends = later.groupBy("project_id", entity).agg(F.min_by(F.struct(F.col("before").alias("v")), "seq").alias("b"), F.max_by(F.struct(F.col("after").alias("v")), "seq").alias("a"))
    return ends.select("project_id", entity, F.col("b.v").alias("at_issue"), F.col("a.v").alias("now")).where(~F.col("at_issue").eqNullSafe(F.col("now")))


def merged_edits(state: DataFrame, edits: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Of edits (key, field, value, seq) the last of each field, applied; rows that change nothing are not returned."""
    last = edits.groupBy(*key).pivot("field", fields).agg(F.max_by(F.struct("value"), "seq"))
    rows = state.join(last.select(*key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}
    changed = ~F.struct(*[new[f].alias(f) for f in fields]).eqNullSafe(F.struct(*fields))
    return rows.where(changed).select(*key, *[new[f].alias(f) for f in fields])


def last_modified(audit: DataFrame, projects: DataFrame) -> DataFrame:
    """H13."""
    last = audit.groupBy("project_id").agg(F.max("timestamp").alias("last"))
    return projects.join(last, "project_id", "left").select("project_id", F.coalesce("last", "created").alias("modified"))
