"""Rules that stored data must keep (C2, C3, Q8), traits of truth (Q3), second readings (Q5), checks before a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SAMPLES, MOST_PLACES = 500, 10
TABLE_ID = "^[a-z0-9-]+$"
STACKED = ("deviations", "min", "max", "limits", "fit_printed")


def measurement_issues(samples: DataFrame, characteristics: DataFrame, results: DataFrame, tasks: int | None = None) -> DataFrame:
    """project_id and reason, once for each: too many samples, a sample's id twice, results of unknown cells, two results of a cell, results out of order.

    `results` have `pos`, their place in the list; it follows the samples' order and then the characteristics'. Serials are C1.
    Results meet samples and characteristics once, in `tasks` tasks, a number that should follow their count; without it Spark's own.
    """
    issue = lambda df, reason: df.select("project_id", F.lit(reason).alias("reason"))
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    sample, char = ["project_id", "sample_id"], ["project_id", "char_id"]
    many = issue(samples.groupBy("project_id").count().where(F.col("count") > MOST_SAMPLES), "too_many_samples")
    twice = issue(samples.groupBy(*sample).count().where("count > 1"), "duplicate_sample")
    by_sample = dealt(results.select(*sample, "char_id", "pos"), *sample)
    cells = issue(by_sample.groupBy(*sample, "char_id").count().where("count > 1"), "duplicate_result")
    at = by_sample.join(dealt(samples.select(*sample, F.struct("pos").alias("s")), *sample), sample, "left").drop("sample_id")
    at = dealt(at, *char).join(dealt(characteristics.select(*char, F.struct("pos").alias("c")), *char), char, "left").drop("char_id")
    # of results of known cells, which alone have a key, the one before
    before = Window.partitionBy("project_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = dealt(at, "project_id").withColumn("k", F.when(F.col("s").isNotNull() & F.col("c").isNotNull(), F.struct("s", "c"))).withColumn("b", F.last("k", ignorenulls=True).over(before))
    wrong = F.array_compact(F.array(F.when(F.col("c").isNull(), "unknown_characteristic"), F.when(F.col("s").isNull(), "unknown_sample"), F.when(F.col("b") > F.col("k"), "results_not_sorted")))
    return many.union(twice).union(cells).union(at.select("project_id", F.explode(wrong).alias("reason"))).distinct()


def settings_issues(settings: DataFrame) -> DataFrame:
    """A row for each reason that is found in tolerance settings.

    `settings`: project_id, decimal_rules array<struct<places, tolerance>>, mm_places, inch_places, custom_tables array<struct<id, sha256>>, general and drawing_rule struct<id, class>.
    """
    rules, tables = F.col("decimal_rules"), F.col("custom_tables")
    rising = lambda a: F.forall(F.sequence(F.lit(1), F.size(a)), lambda i: (i == F.size(a)) | F.coalesce(F.try_element_at(a, i) < F.try_element_at(a, i + 1), F.lit(False))) | (F.size(a) < 2)
    ids = F.transform(tables, lambda t: t["id"])
    named = lambda c: c.isNull() | (c["id"].rlike(TABLE_ID) & (F.trim(c["class"]) != ""))
    bad = {
        "decimal_rule_value": ~F.forall(rules, lambda r: r["places"].between(0, MOST_PLACES) & (r["tolerance"] > 0)),
        "decimal_rules_order": ~rising(F.transform(rules, lambda r: r["places"])),
        "unit_rounding": ~(F.col("mm_places").between(0, MOST_PLACES) & F.col("inch_places").between(0, MOST_PLACES)),
        "custom_table_id": ~F.forall(ids, lambda i: i.rlike(TABLE_ID)), "custom_tables_order": ~rising(ids),
        "custom_table_twice": F.size(F.array_distinct(F.transform(tables, lambda t: t["sha256"]))) < F.size(tables),
        "table_setting": ~(named(F.col("general")) & named(F.col("drawing_rule"))),
        "drawing_rule_not_custom": F.col("drawing_rule").isNotNull() & ~F.coalesce(F.array_contains(ids, F.col("drawing_rule.id")), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(c, k) for k, c in bad.items()]))
    return settings.select("project_id", F.explode(reasons).alias("reason"))


def truth_issues(truth: DataFrame, sheets: DataFrame) -> DataFrame:
    """Q8: drawing, id and reason for truth that contradicts itself: an id twice, a region off its sheet, limits in the wrong order, a rule without what it needs, text not normalized, an angle in mm.

    `truth`: drawing, id, sheet, kind, requirement_text, cx, cy, w, h, angle, unit, fit, rule, upper_limit, lower_limit; `sheets`: drawing, sheet, width, height.
    """
    rows = truth.join(sheets.withColumnRenamed("width", "_w").withColumnRenamed("height", "_h"), ["drawing", "sheet"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("drawing", "id")))
    c, s = F.abs(F.cos(F.radians("angle"))), F.abs(F.sin(F.radians("angle")))
    hx, hy = (F.col("w") * c + F.col("h") * s) / 2, (F.col("w") * s + F.col("h") * c) / 2
    inside = (F.col("cx") - hx >= -1e-6) & (F.col("cx") + hx <= F.col("_w") + 1e-6) & (F.col("cy") - hy >= -1e-6) & (F.col("cy") + hy <= F.col("_h") + 1e-6)
    limits = F.col("upper_limit").isNotNull() | F.col("lower_limit").isNotNull()
    text = F.col("requirement_text")
    bad = {
        "duplicate_id": F.col("_n") > 1, "unknown_sheet": F.col("_w").isNull(), "region_off_sheet": F.col("_w").isNotNull() & ~inside, "limits_not_in_order": F.col("lower_limit") >= F.col("upper_limit"),
        "rule_without_limits": F.col("rule").isin("explicit", "general", "fit", "custom_table") & ~limits, "limits_without_rule": F.coalesce(F.col("rule"), F.lit("no_tolerance_defined")).isin("no_tolerance_defined") & limits,
        "fit_missing": (F.col("rule") == "fit") & F.col("fit").isNull(), "unit_of_kind": (F.col("kind") == "angle") & (F.col("unit") != "deg"), "text_not_normalized": text != F.trim(F.regexp_replace(text, "\\s+", " ")),
    }
    return rows.select("drawing", "id", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in bad.items()]))).alias("reason"))


def traits(text: Column, angle: Column, category: Column) -> Column:
    """Q3: struct<comma, rotated, stacked>."""
    return F.struct(text.rlike("[0-9],[0-9]").alias("comma"), (F.abs(angle) > 1e-9).alias("rotated"), F.coalesce(category.isin(*STACKED), F.lit(False)).alias("stacked"))


def second_pass(read: DataFrame, truth: DataFrame, again, hint: str = "shorter_leg_unknown") -> DataFrame:
    """Q5: rows whose note or hints say that the shorter leg is not known, and whose truth (project_id, char_id, leg) has one, are read once more by `again` with it; others stay."""
    keys = ["project_id", "char_id"]
    wants = F.lit(False)
    if "note" in read.columns:
        wants = wants | F.coalesce(F.col("note") == hint, F.lit(False))
    if "hints" in read.columns:
        wants = wants | F.coalesce(F.array_contains("hints", hint), F.lit(False))
    marked = read.join(truth.where("leg is not null").select(*keys, "leg"), keys, "left").withColumn("_again", wants & F.col("leg").isNotNull())
    redone = again(marked.where("_again").withColumn("shorter_leg", F.col("leg"))).withColumn("second", F.lit(True))
    return marked.where("not _again").withColumn("second", F.lit(False)).select(*read.columns, "second").unionByName(redone.select(*read.columns, "second"))


# The order in which empty header fields are named
HEADER = ("part_number", "report_number", "company_name", "inspected_by")


def report_checks(state: DataFrame, info: DataFrame, drafts: DataFrame, changed: DataFrame, kind: str = "inspection_report") -> DataFrame:
    """For each project the counts before a report is issued, and its empty header fields.

    `state` is the measurement state, `info` has project_id and HEADER, `drafts` and `changed` have project_id and char_id. A check sheet has no missing values.
    """
    # one reading of the state: its rows and the marks of drafts and changes meet by characteristic, then by project
    flag = lambda df, name: df.select("project_id", F.lit("characteristic").alias("grain"), F.col("char_id").alias("key"), F.lit(1).alias(name))
    marked = state.select("project_id", "grain", "key", "missing", "not_evaluated", F.lit(1).alias("there")).unionByName(flag(drafts, "draft"), allowMissingColumns=True).unionByName(flag(changed, "change"), allowMissingColumns=True)
    marked = marked.repartition("project_id").groupBy("project_id", "grain", "key").agg(*[F.max(c).alias(c) for c in ("missing", "not_evaluated", "there", "draft", "change")]).where("there = 1")
    rows, whole = F.col("grain") == "characteristic", F.col("grain") == "project"
    counts = marked.groupBy("project_id").agg(
        F.count_if(rows).alias("rows"), F.count_if(F.col("grain") == "sample").alias("samples"), F.count_if(rows & (F.col("draft") == 1)).alias("draft_rows"), F.count_if(rows & (F.col("change") == 1)).alias("changed_rows"),
        F.max(F.when(whole, F.col("missing"))).alias("missing"), F.max(F.when(whole, F.col("not_evaluated"))).alias("not_evaluated"),
    )
    out = info.select("project_id", F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in HEADER])).alias("missing_fields")).join(counts, "project_id", "left")
    shown = (lambda c: F.coalesce(c, F.lit(0))) if kind == "inspection_report" else (lambda c: F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("project_id", zero("samples"), zero("rows"), shown(F.col("missing")).cast("bigint").alias("missing_values"), shown(F.col("not_evaluated")).cast("bigint").alias("not_evaluated"), zero("draft_rows"), zero("changed_rows"), "missing_fields")


def state_hash(*columns: str) -> Column:
    """X11: SHA-256 of a state's JSON; the order of the columns belongs to it, fields that are null are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def issue_records(contents: DataFrame, at_entry: DataFrame, locks: bool = True) -> DataFrame:
    """A record for each report that is issued (project_id, report_number, content): the hash of its bytes, its short form, the log entry it stands at, and whether it locks the numbers.

    `at_entry`: project_id, entry_no of the log; the last one counts. Append it to the issued reports.
    """
    last = at_entry.groupBy("project_id").agg(F.max("entry_no").alias("entry_no"))
    sha = F.sha2(F.col("content").cast("binary"), 256)
    return contents.join(last, "project_id", "left").select("project_id", "report_number", sha.alias("sha256"), F.substring(sha, 1, 16).alias("sha_short"), F.coalesce("entry_no", F.lit(0)).alias("entry_no"), F.lit(locks).alias("locks_numbers"))
