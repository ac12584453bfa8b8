"""The subpackage's queries, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import audit, bestfit, jaccard, jpeg, langid, lines, mixing, pii, repair, tokens, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op6(docs: DataFrame) -> DataFrame:
    return jaccard.ngram_jaccard_join(docs, width=4, num=85, den=100)


def op7(docs: DataFrame) -> DataFrame:
    return jpeg.media_features(jpeg.media_columns(docs))


def op11(conversations: DataFrame) -> DataFrame:
    return repair.conversation_audits(repair.damaged(conversations), "times")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_training_shards": _over("documents", tokens.training_shards),
    "op2_product_quantisation": _over("embeddings", vectors.near_vectors),
    "op3_language_id": _over("documents", langid.language_id),
    "op4_line_dedup": _over("documents", lines.deduplicated_lines),
    "op5_packing": _over("documents", tokens.packed),
    "op6_ngram_jaccard_join": _over("documents", op6),
    "op7_media_columns": _over("documents", op7),
    "op8_url_filter": _over("pages", urls.url_filter),
    "op9_source_mixing": _over("documents", mixing.mixed_sizes),
    "op10_personal_data": _over("documents", pii.personal_data),
    "op11_conversation_repair": _over("conversations", op11),
    "op12_filter_interaction_audit": op12,
    "op13_best_fit_packing": _over("documents", bestfit.best_fit_packed),
}

SQL = {"op8_url_filter": urls.SQL, "op9_source_mixing": mixing.SQL, "op11_conversation_repair": repair.SQL, "op12_filter_interaction_audit": audit.SQL}
