"""The corpus pipeline: language ID, line dedup, n-gram Jaccard dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of `docs`. Stages on the same documents give the same result; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import jaccard, langid, lines, mixing, tokens
from gaugeworks.llm.common import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go that are null or without letters, and those that no language learned from the labelled ones parses into fewer bits, all but 8 phrases, than letters one by one take."""
    return langid.known_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do rows of whose text no line is left."""
    return lines.deduplicated_lines(docs, drop_repeats=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingles of five words and a similarity of 0.8 link, the one with the smallest doc_id stays. Rows without doc_id stay, and so do all rows that bear a doc_id that stays."""
    gone = jaccard.ngram_jaccard_join(docs, width=5, num=80, den=100).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, rows as often as taken, in training order. A null source is a source; null texts have no words."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens; a null text is the closing id alone."""
    return tokens.packed(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_documents), ("mixing", mix), ("packing", pack)]

#: SQL cannot express language ID, tokenising or packing; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
