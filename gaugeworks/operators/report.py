"""Report tables (R1-R8) and geometry in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import group_verdict, localized, projected, rule_detail, signed, unit_symbol, verdict
from gaugeworks.operators.evaluate import measured, rows_of_cells, with_results

#: Samples in one block of columns.
BLOCK = 6


def numbered_columns(samples: DataFrame) -> DataFrame:
    """Samples numbered from 1 within their project, with the block of columns that each is in."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("pos"))
    return samples.withColumn("index", n).withColumn("block", F.expr(f"(index - 1) div {BLOCK}").cast("int"))


def sample_columns(samples: DataFrame, state: DataFrame) -> DataFrame:
    """Samples numbered from 1 with block, counts and verdict."""
    rows = numbered_columns(samples)
    s = state.where("grain = 'sample'").select("project_id", F.col("key").alias("sample_id"), "pass", "fail", "not_evaluated", "missing", "verdict")
    return rows.join(s, ["project_id", "sample_id"])


def column_blocks(columns: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """First and last sample of each block; of `projects` those without samples have one block, from 0 to 0."""
    blocks = columns.groupBy("project_id", "block").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    if projects is None:
        return blocks
    return projects.select("project_id").join(blocks, "project_id", "left").na.fill(0, ["block", "first_index", "last_index"])


def report_rows(characteristics: DataFrame, samples: DataFrame, results: DataFrame, comma: bool = False) -> DataFrame:
    """Measured characteristics as printed, with their cells in the order of the samples.

    `characteristics` have texts as stored: number, kind, requirement_text, quantity, nominal, upper_dev, lower_dev, upper_limit_text, lower_limit_text,
    unit, fit, rule, table_id, class, rule_tolerance and draft, beside the limits that cells are judged by. Without a result a cell is missing and empty.
    """
    number = lambda c: F.coalesce(localized(F.col(c), comma), F.lit(""))
    dev = lambda c: F.coalesce(localized(signed(F.col(c)), comma), F.lit(""))
    detail = rule_detail(F.col("rule"), F.col("table_id"), F.col("class"), F.col("fit"), localized(F.col("rule_tolerance"), comma))
    texts = measured(characteristics).select(
        "project_id", "char_id", "number", "kind", F.col("requirement_text").alias("requirement"), F.col("quantity").cast("string").alias("quantity"), number("nominal").alias("nominal"),
        dev("upper_dev").alias("upper_deviation"), dev("lower_dev").alias("lower_deviation"), number("lower_limit_text").alias("lower_limit"), number("upper_limit_text").alias("upper_limit"),
        unit_symbol(F.col("unit")).alias("unit"), F.coalesce("fit", F.lit("")).alias("fit"), F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce(detail, F.lit("")).alias("rule_detail"), F.coalesce("draft", F.lit(False)).alias("draft"),
        F.col("lower_limit").alias("_low"), F.col("upper_limit").alias("_high"),
    )
    text = (lambda c: F.coalesce(c["value_text"], c["value"].cast("string"))) if "value_text" in results.columns else (lambda c: c["value"].cast("string"))
    shown = results.select("project_id", "char_id", "sample_id", "value", "attribute", *[c for c in results.columns if c == "value_text"])

    def entry(c):
        r = c["result"]
        return F.struct(c["sample_pos"].alias("sample_pos"), F.coalesce(localized(F.when(r["value"].isNotNull(), text(r)), comma), r["attribute"], F.lit("")).alias("value"), verdict(r["value"], r["attribute"], F.col("_low"), F.col("_high")).alias("verdict"))

    return rows_of_cells(texts, samples, shown).withColumn("cells", F.array_sort(F.transform("cells", entry))).drop("_low", "_high")


def wide_grid(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """A row for each characteristic and block, verdicts in columns s1..s6; cells that are missing are null here, and rows without a result are absent: see whole_grid."""
    lists = _numbers(columns)
    at = cells.join(lists, "project_id").select("project_id", "char_id", "verdict", F.explode(F.filter("_numbers", lambda n: n["sample_id"] == F.col("sample_id"))).alias("n"))
    i = (F.col("n.index") - 1) % BLOCK + 1
    return at.groupBy("project_id", "char_id", F.col("n.block").alias("block")).agg(*[F.max(F.when(i == k, F.col("verdict"))).alias(f"s{k}") for k in range(1, BLOCK + 1)])


def _numbers(columns: DataFrame) -> DataFrame:
    """Of each project the list of its samples with their numbers."""
    return columns.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("index", "block", "sample_id"))).alias("_numbers"))


def whole_grid(cells: DataFrame, columns: DataFrame, characteristics: DataFrame) -> DataFrame:
    """A row for each measured characteristic and each block of its project, results or not. Cells without a result are missing;
    columns after the last sample are null, and so is the one block of a project without samples. Blocks are made in the row, from the project's list of samples."""
    rows = with_results(characteristics.select("project_id", "char_id"), cells.select("project_id", "char_id", "sample_id", "verdict")).join(_numbers(columns), "project_id", "left")
    of = lambda n: F.array_max(F.transform(F.filter("found", lambda r: r["sample_id"] == n["sample_id"]), lambda r: r["verdict"]))
    verdicts = F.transform("_numbers", lambda n: F.named_struct(F.lit("index"), n["index"], F.lit("block"), n["block"], F.lit("verdict"), F.coalesce(of(n), F.lit("missing"))))
    blocks = F.coalesce(F.array_distinct(F.transform("_numbers", lambda n: n["block"])), F.array(F.lit(0)))
    rows = rows.select("project_id", "char_id", verdicts.alias("v"), F.explode(blocks).alias("block"))
    sample = lambda i: F.get(F.filter("v", lambda c: (c["block"] == F.col("block")) & ((c["index"] - 1) % BLOCK == i - 1)), F.lit(0))["verdict"].alias(f"s{i}")
    return rows.select("project_id", "char_id", "block", *[sample(i) for i in range(1, BLOCK + 1)])


def check_sheet(characteristics: DataFrame, blanks: int) -> DataFrame:
    """Rows with 1 to 10 blank columns, nothing measured, all groups open."""
    n = max(1, min(10, blanks))
    return characteristics.select("project_id", "char_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("index")).select("*", F.lit("missing").alias("verdict"))


def summary(state: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Counts of each project and whether results are open; with `drafts` (project_id of each row with draft limits) whether it has draft limits."""
    p = state.where("grain = 'project'")
    rows = p.select("project_id", "pass", "fail", "not_evaluated", "missing", "verdict", (F.col("missing") + F.col("not_evaluated") > 0).alias("open_results"))
    if drafts is None:
        return rows
    return rows.join(drafts.select("project_id").distinct().withColumn("draft_limits", F.lit(True)), "project_id", "left").na.fill(False, ["draft_limits"])


def failing_parts(state: DataFrame) -> DataFrame:
    """Samples with their verdict folded to one row for each project: how many fail, pass or are open."""
    s = state.where("grain = 'sample'").groupBy("project_id")
    n = lambda v: F.count_if(F.col("verdict") == v)
    return s.agg(n("fail").alias("n_fail"), n("pass").alias("n_pass"), n("open").alias("n_open")).withColumn("verdict", group_verdict(F.col("n_pass"), F.col("n_fail"), F.col("n_pass") + F.col("n_fail") + F.col("n_open")))


def header_filled(info: DataFrame, today: str, company: str, inspector: str) -> DataFrame:
    """The stored date or `today`; company and inspector only where blank; a short digest of 16 characters."""
    blank = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)).alias(c)
    return info.select("project_id", blank("date", today), blank("company", company), blank("inspector", inspector), F.substring("sha", 1, 16).alias("sha_short"))


def reregistered(points: DataFrame, maps: DataFrame) -> DataFrame:
    """G1: points through their sheet's map, held within the sheet; those that the map loses go. Maps are one small row for each sheet."""
    rows = points.join(maps, "sheet_id").withColumn("q", projected(F.col("map"), F.col("x"), F.col("y"))).where("q is not null")
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return rows.withColumn("new_x", hold(F.col("q.x"), F.col("width"))).withColumn("new_y", hold(F.col("q.y"), F.col("height"))).drop("q", "map")


def off_sheet(points: DataFrame, maps: DataFrame) -> DataFrame:
    """For each sheet how many points leave it, or are lost."""
    rows = points.join(maps, "sheet_id").withColumn("q", projected(F.col("map"), F.col("x"), F.col("y")))
    inside = F.col("q.x").between(-1e-6, F.col("width") + 1e-6) & F.col("q.y").between(-1e-6, F.col("height") + 1e-6)
    return rows.groupBy("sheet_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_off"))
