"""Project documents of four schema versions, audit logs, truth sets; lists and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWEST = 4
CHARACTERISTIC = "struct<id: string, number: string, kind: string, requirement_text: string, nominal: string, unit: string, upper_limit: string, lower_limit: string, fit: string, derivation: struct<rule: string>, result_type: string, status: string, inspect: boolean, quantity: int>"
PROJECT = f"schema_version int, id string, name string, part_number string, numbering struct<strategy: string>, characteristics array<{CHARACTERISTIC}>, samples array<struct<id: string, serial: string, date: string>>, results array<struct<sample: string, characteristic: string, value: string, attribute: string, comment: string>>, _corrupt_record string"
AUDIT = "entry_no bigint, timestamp timestamp, user string, action struct<type: string>, changes array<struct<type: string, entity: string, before: string, after: string>>, _corrupt_record string"
# Columns of the list
LIST = ("number", "kind", "requirement_text", "nominal", "unit", "upper_limit", "lower_limit", "fit", "rule", "result_type", "status", "inspect", "quantity")

# The list as it is exported, with its headers in English and German
EXPORT = {
    "number": ("No", "Nr"), "kind": ("Kind", "Art"), "requirement_text": ("Requirement", "Anforderung"), "nominal": ("Nominal", "Nennmaß"), "upper_dev": ("Upper deviation", "Oberes Abmaß"),
    "lower_dev": ("Lower deviation", "Unteres Abmaß"), "upper_limit": ("Upper limit", "Obere Grenze"), "lower_limit": ("Lower limit", "Untere Grenze"), "unit": ("Unit", "Einheit"), "fit": ("Fit", "Passung"),
    "rule": ("Rule", "Regel"), "quantity": ("Quantity", "Anzahl"), "classification": ("Classification", "Klassifizierung"), "method": ("Inspection method", "Prüfmethode"), "gauge": ("Gauge", "Prüfmittel"),
    "sampling": ("Sampling", "Stichprobe"), "frequency": ("Frequency", "Häufigkeit"), "inspect": ("Inspect", "Prüfen"), "status": ("Status", "Status"), "page": ("Sheet", "Blatt"), "comment": ("Comment", "Kommentar"),
}


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents in the newest schema, and those that are newer or can't be read.

    Version 1: limits without a derivation become manual and the strategy is manual. To version 2: the result type is auto, lists are empty.
    """
    raw = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    ok = F.col("schema_version").between(1, NEWEST) & F.col("_corrupt_record").isNull()
    refused = raw.where(~F.coalesce(ok, F.lit(False))).select("id", "schema_version", F.when(F.col("schema_version") > NEWEST, "newer_version").otherwise("unreadable").alias("reason"))
    v = F.col("schema_version")

    def moved(c):
        manual = (v == 1) & c["derivation"].isNull() & (c["upper_limit"].isNotNull() | c["lower_limit"].isNotNull())
        c = c.withField("derivation", F.when(manual, F.struct(F.lit("manual").alias("rule"))).otherwise(c["derivation"]))
        c = c.withField("result_type", F.when(v <= 2, "auto").otherwise(c["result_type"]))
        return c.withField("inspect", F.coalesce(c["inspect"], F.lit(True))).withField("quantity", F.coalesce(c["quantity"], F.lit(1)))

    docs = raw.where(ok).withColumn("characteristics", F.transform("characteristics", moved)).withColumn("numbering", F.when(v == 1, F.struct(F.lit("manual").alias("strategy"))).otherwise(F.col("numbering")))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(raw.dtypes)[c])).alias(c)
    return docs.select("id", "name", "part_number", "numbering", *[empty(c) for c in ("characteristics", "samples", "results")], F.lit(NEWEST).alias("schema_version")), refused


def part_table(projects: DataFrame, name: str) -> DataFrame:
    """A document's list as a table; the place in the list becomes `pos`."""
    return projects.select(F.col("id").alias("project_id"), F.posexplode(name).alias("pos", "x")).select("project_id", "pos", "x.*")


def read_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S3: log entries; a line that is cut off is dropped."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(AUDIT).option("mode", "PERMISSIVE").json(path)
    return rows.where("entry_no is not null").drop("_corrupt_record")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth sets, one row for each characteristic, with the drawing's name from the file's."""
    rows = spark.read.option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("f"), F.explode("characteristics").alias("c"))
    return rows.select(F.regexp_replace("f", "\\.truth\\.json$", "").alias("drawing"), "c.*")


def list_rows(characteristics: DataFrame) -> DataFrame:
    """The list's columns, rejected rows left out, numbers and decimals as written, empty for null."""
    rows = characteristics.where("status is null or status <> 'rejected'").withColumn("rule", F.coalesce("derivation.rule", F.lit("")))
    text = {"inspect": F.when(F.col("inspect"), "yes").otherwise("no")}
    return rows.select("project_id", "pos", *[F.coalesce(text.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in LIST])


def write_list(characteristics: DataFrame, path: str) -> None:
    """CSV in number order, one folder for each project."""
    from gaugeworks.functions.exprs import number_parts

    rows = list_rows(characteristics)
    rows.repartition("project_id").sortWithinPartitions("project_id", number_parts(F.col("number")), "pos").drop("pos").write.partitionBy("project_id").option("header", True).csv(path)


def export_rows(characteristics: DataFrame) -> DataFrame:
    """The columns of EXPORT as texts, rejected rows left out; nulls and the classification none are empty."""
    rows = characteristics.where("status is null or status <> 'rejected'")
    text = {"inspect": F.when(F.col("inspect"), "yes").otherwise("no"), "classification": F.nullif(F.col("classification"), F.lit("none"))}
    return rows.select("project_id", "pos", *[F.coalesce(text.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in EXPORT])


def write_export(characteristics: DataFrame, path: str, language: str = "en") -> None:
    """CSV of the whole list in number order with headers in a language (en, de), one folder for each project; quoted only where needed."""
    from gaugeworks.functions.exprs import number_parts

    rows = export_rows(characteristics).repartition("project_id").sortWithinPartitions("project_id", number_parts(F.col("number")), "pos")
    heads = [F.col(c).alias(h[("en", "de").index(language)]) for c, h in EXPORT.items()]
    rows.select("project_id", *heads).write.partitionBy("project_id").option("header", True).option("emptyValue", "").csv(path)


def write_reports(rows: DataFrame, path: str) -> None:
    """One JSON document for each project."""
    body = F.struct(*[c for c in rows.columns if c != "project_id"])
    rows.groupBy("project_id").agg(F.array_sort(F.collect_list(body)).alias("rows")).write.json(path)
