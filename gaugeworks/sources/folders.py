"""Whole project folders of schema versions 1 to 4 as tables (S1, S2): manifest, document and log of many projects at a time.

Documents are read as VARIANT, so that each version's shape is taken as it is and brought to the newest one column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEWEST = 4
#: Of each list of a document: the fields of its table, with their type and where they stand in an entry.
LISTS: dict[str, dict[str, tuple[str, str]]] = {
    "revisions": {"revision_id": ("string", "$.id"), "label": ("string", "$.label"), "file_name": ("string", "$.file_name"), "sha256": ("string", "$.sha256"), "imported_at": ("timestamp", "$.imported_at"), "source_type": ("string", "$.source.type")},
    "characteristics": {
        "char_id": ("string", "$.id"), "number": ("string", "$.number"), "kind": ("string", "$.kind"), "requirement_text": ("string", "$.requirement_text"), "nominal": ("string", "$.nominal"), "unit": ("string", "$.unit"), "upper_limit": ("string", "$.upper_limit"),
        "lower_limit": ("string", "$.lower_limit"), "fit": ("string", "$.fit"), "rule": ("string", "$.derivation.rule.type"), "quantity": ("int", "$.quantity"), "classification": ("string", "$.classification"), "status": ("string", "$.status"), "result_type": ("string", "$.result_type"),
        "inspect": ("boolean", "$.inspect"), "shorter_leg": ("string", "$.shorter_leg.value"), "comment": ("string", "$.comment"),
    },
    "balloons": {"balloon_id": ("string", "$.id"), "char_id": ("string", "$.characteristic"), "sheet_id": ("string", "$.sheet"), "x": ("double", "$.position.x"), "y": ("double", "$.position.y"), "anchor_x": ("double", "$.anchor.x"), "anchor_y": ("double", "$.anchor.y")},
    "samples": {"sample_id": ("string", "$.id"), "serial": ("string", "$.serial"), "date": ("string", "$.date"), "inspector": ("string", "$.inspector"), "comment": ("string", "$.comment")},
    "results": {"sample_id": ("string", "$.sample"), "char_id": ("string", "$.characteristic"), "value": ("string", "$.value"), "attribute": ("string", "$.attribute"), "comment": ("string", "$.comment")},
    "issued_reports": {"report_number": ("string", "$.report_number"), "sha256": ("string", "$.sha256"), "entry_no": ("bigint", "$.audit_entry"), "locks_numbers": ("boolean", "$.locks_numbers")},
}
SHEET = {"sheet_id": ("string", "$.id"), "index": ("int", "$.index"), "width": ("double", "$.size.width"), "height": ("double", "$.size.height"), "rotation": ("string", "$.rotation"), "kind": ("string", "$.kind"), "unit": ("string", "$.unit")}
#: Lists that a version's documents do not have, by the version that brought them.
SINCE = {"samples": 3, "results": 3, "issued_reports": 3}
# Whole records that commands carried up to version 3, with their fields in order
RECORDS = {"update_project_info": ("info", ("part_number", "part_name", "customer", "order_reference")), "update_report_info": ("info", ("report_number", "report_date", "company_name", "inspected_by", "approved_by", "remarks")), "update_sample": ("sample", ("serial", "date", "inspector", "gauges", "comment"))}


def _get(of: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _folder() -> Column:
    """The folder that a file lies in."""
    return F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)


def _variants(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    return spark.read.option("singleVariantColumn", "doc").option("multiLine", whole).json(path).select(_folder().alias("folder"), "doc")


class Folders:
    """Tables of the projects below `path`, one folder each; `manifests`, `documents` and `logs` are patterns below it.

    `refused` has the folders that are left out, with a reason: no or an unreadable manifest, a version that is unknown or newer
    than 4, no or an unreadable document. Every table has the folder's name as project_id.
    """

    def __init__(self, spark: SparkSession, path: str, manifests: str = "*/manifest.json", documents: str = "*/project.json", logs: str = "*/audit.jsonl") -> None:
        heads = _variants(spark, f"{path}/{manifests}", True).groupBy("folder").agg(F.max(_get("doc", "$.schema_version", "int")).alias("version"), F.max(_get("doc", "$.created", "timestamp")).alias("created"))
        docs = _variants(spark, f"{path}/{documents}", True).withColumn("readable", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
        both = heads.join(docs, "folder", "full").withColumnRenamed("folder", "project_id")
        reason = (
            F.when(F.col("version").isNull(), "no_manifest").when((F.col("version") > NEWEST) | (F.col("version") < 1), "unknown_version").when(F.col("readable").isNull(), "no_document").when(~F.col("readable"), "unreadable_document")
        )
        both = both.withColumn("reason", reason)
        self.refused = both.where("reason IS NOT NULL").select("project_id", "version", "reason")
        self._docs = both.where("reason IS NULL").select("project_id", "version", "created", "doc")
        self._logs = lambda: _variants(spark, f"{path}/{logs}", False).withColumnRenamed("folder", "project_id")

    def projects(self) -> DataFrame:
        """One row for each project; version 1 keeps its placement order, report info is empty before version 3."""
        text = lambda path, since=1: F.when(F.col("version") < since, "").otherwise(_get("doc", path, "string"))
        strategy = F.when(F.col("version") == 1, "manual").otherwise(_get("doc", "$.settings.numbering.strategy", "string"))
        info = [text(f"$.info.{f}").alias(f) for f in RECORDS["update_project_info"][1]]
        return self._docs.select("project_id", F.col("version").alias("from_version"), "created", *info, strategy.alias("strategy"), *[text(f"$.report_info.{f}", 3).alias(f) for f in RECORDS["update_report_info"][1]])

    def table(self, name: str) -> DataFrame:
        """A list of the documents; the place in the list becomes `pos`. Limits without a derivation are manual up to version 1, the result type is auto up to 2, sources are PDF up to 3."""
        rows = self._docs.where(F.col("version") >= SINCE.get(name, 1)).select("project_id", "version", F.posexplode(_get("doc", f"$.{name}", "array<variant>")).alias("pos", "x"))
        out = {c: _get("x", path, kind) for c, (kind, path) in LISTS[name].items()}
        v = F.col("version")
        if name == "characteristics":
            manual = (v == 1) & out["rule"].isNull() & (out["upper_limit"].isNotNull() | out["lower_limit"].isNotNull())
            out |= {"rule": F.when(manual, "manual").otherwise(out["rule"]), "result_type": F.when(v <= 2, "auto").otherwise(out["result_type"])}
        if name == "revisions":
            out["source_type"] = F.when(v <= 3, "pdf").otherwise(out["source_type"])
        return rows.select("project_id", "pos", *[c.alias(k) for k, c in out.items()])

    def sheets(self) -> DataFrame:
        """Sheets of all revisions with their zone frame and number of views, which version 1 does not have."""
        revisions = self._docs.select("project_id", "version", F.posexplode(_get("doc", "$.revisions", "array<variant>")).alias("rev_pos", "r"))
        rows = revisions.select("project_id", "version", "rev_pos", _get("r", "$.id", "string").alias("revision_id"), F.explode(_get("r", "$.sheets", "array<variant>")).alias("x"))
        later = F.col("version") > 1
        frame = {f"frame_{k}": F.when(later, _get("x", f"$.zone_grid.frame.{p}", "double")).alias(f"frame_{k}") for k, p in (("x", "origin.x"), ("y", "origin.y"), ("w", "size.width"), ("h", "size.height"))}
        views = F.when(later, F.coalesce(F.size(_get("x", "$.views", "array<variant>")), F.lit(0))).otherwise(0)
        return rows.select("project_id", "rev_pos", "revision_id", *[_get("x", path, kind).alias(c) for c, (kind, path) in SHEET.items()], *frame.values(), views.alias("n_views"))

    def audit(self) -> DataFrame:
        """Log entries: entry_no, timestamp, user, action, command, fields (what an update command sets, in order) and changes; cut-off lines are dropped.

        Whole records of update commands up to version 3 become lists of fields, as later commands have them.
        """
        rows = self._logs().join(self._docs.select("project_id", "version"), "project_id").withColumn("no", _get("doc", "$.entry_no", "bigint")).where("no IS NOT NULL")
        kind = _get("doc", "$.action.command.type", "string")
        field = "array<struct<field: string, value: string>>"
        fields = F.when(F.col("version") > 3, _get("doc", "$.action.command.fields", field))
        for command, (record, names) in RECORDS.items():
            listed = F.array(*[F.struct(F.lit(n).alias("field"), _get("doc", f"$.action.command.{record}.{n}", "string").alias("value")) for n in names])
            fields = fields.when((F.col("version") <= 3) & (kind == command), listed)
        return rows.select("project_id", F.col("no").alias("entry_no"), _get("doc", "$.timestamp", "timestamp").alias("timestamp"), _get("doc", "$.user", "string").alias("user"), _get("doc", "$.action.type", "string").alias("action"), kind.alias("command"), fields.alias("fields"), _get("doc", "$.changes", "array<variant>").alias("changes"))


def write_report_documents(rows: DataFrame, headers: DataFrame, path: str, language: str = "en") -> None:
    """A JSON document for each project: language, header (all columns of `headers`), approval places and `rows` in order of pos.

    The write is committed as a whole, as Spark commits a table; a project without a header is refused before anything is written.
    """
    body = F.struct(*[c for c in rows.columns if c not in ("project_id", "pos")])
    lists = rows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("row")))), lambda r: r["row"]).alias("rows"))
    if lists.join(headers, "project_id", "left_anti").limit(1).count():
        raise ValueError("a project has rows and no header")
    head = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in headers.columns if c != "project_id"])
    # Who signs, in order
    places = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("name"), F.lit("").alias("date")) for r in ("inspected_by", "approved_by")])
    docs = headers.select("project_id", head.alias("header")).join(lists, "project_id", "left")
    docs.select("project_id", F.lit(language).alias("language"), "header", places.alias("signatures"), F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)).alias("rows")).write.json(path)
