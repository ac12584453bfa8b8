"""Operator 12: audit of how filters interact.

Five filters judge each document; a document's failures are five bits of one number. How many documents of a part have which bits says all
about every order in which the filters could be applied, so documents are counted by bits and the 120 orders are read off those counts.

Whether a text is a copy is found behind a counting Bloom filter: tasks count hashed cells, their sketches are merged, and a text with
a cell that counts one is the only one of its kind. Only the others, possible repeats, are shuffled, for the least doc_id of each full text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from gaugeworks.llm.common import mix64, ship, stored

FILTERS = "ABCDE"
#: Cells for each document and hashes of each. At most MOST cells (64 MB of bits): beyond 33 million documents more texts that are alone count as possible repeats.
CELLS, HASHES, MOST = 16, 4, 1 << 29
#: Cells of one block, which is merged by one task.
BLOCK = 1 << 20


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone: A under 50 words, B under 65 % distinct words, C over 5 % capitals A-Z, D any of `#$%&*|`. True where it fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells of each digest (rows of two 64-bit numbers or more)."""
    a, b = mix64(digests[:, 0]), mix64(digests[:, 1]) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(cells - 1) for i in range(HASHES)], axis=1)


def _digests(column: pa.Array) -> np.ndarray:
    """SHA-256 digests as rows of four 64-bit numbers."""
    raw = column.cast(pa.large_binary()).buffers()[2]
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)[column.offset : column.offset + len(column)] if len(column) else np.zeros((0, 4), np.uint64)


def _sketched(cells: int):
    """Digests to a task's sketch: by block its cells, one bit to the left, with a last bit that tells those counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(_cells(_digests(b.column(0)), cells), return_counts=True)
            blocks, first = np.unique(at // np.uint64(BLOCK), return_index=True)
            held = ((at % np.uint64(BLOCK)) << np.uint64(1) | (n > 1).astype(np.uint64)).astype(np.uint32)
            parts = [p.tobytes() for p in np.split(held, first[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(parts, pa.binary())], ["block", "cells"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the same block to one bit for each cell: whether it counts two or more."""
    block, once, twice = None, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        for of, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if of != block:
                if block is not None:
                    yield closed()
                block = of
                once[:], twice[:] = False, False
            held = np.frombuffer(cells.as_py(), np.uint32)
            at = held >> 1
            twice[at] |= once[at] | (held & 1).astype(bool)
            once[at] = True
    if block is not None:
        yield closed()


def possible_repeats(digests: DataFrame, rows: int, cells: int | None = None) -> Column:
    """A condition on `digest` (SHA-256 of a text) that is true for all texts that occur more than once, and for few others. `rows`: how many there are.

    Counts saturate at two. `cells` is a power of two from BLOCK on. The merged sketch has a bit for each of at most MOST cells; that is what reaches the driver and is broadcast.
    """
    cells = cells or min(MOST, max(BLOCK, 1 << (CELLS * rows - 1).bit_length()))
    sketches = digests.select("digest").mapInArrow(_sketched(cells), "block int, cells binary")
    merged = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for r in merged.toLocalIterator():
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = digests.sparkSession.sparkContext.broadcast(bits)

    @pandas_udf("boolean")
    def possible(digest: pd.Series) -> pd.Series:
        at = _cells(np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 4), cells)
        return pd.Series((shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1))

    return possible(F.col("digest"))


def failure_counts(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """part, mask (bit k: fails filter k of ABCDE), documents, good, toxic: how many documents of a source fail just these filters.

    E fails a document whose text a smaller doc_id has, in whatever part. Null texts are empty, null sources the empty string. A null doc_id is
    neither smaller nor larger than others and has no labels. Every row counts as a document, repeated ones too; rows with the
    same doc_id and text are no copies of each other. Of several labels of a doc_id one is enough.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("text").cast("string")).values())), F.lit(0))
    judged = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("mask"), digest.alias("digest")), "judged")
    possible = possible_repeats(judged, judged.count(), cells)
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest")).where(possible)
    # the least id of each full text; partial aggregates meet, not rows
    firsts = again.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.unhex(F.sha2("text", 256)).alias("digest"), "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    alone = judged.where(~possible).select("doc_id", "part", "mask")
    masked = judged.where(possible).join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).unionByName(alone)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))).where("good + toxic > 0")
    none = F.lit(0).cast("long")
    documents = masked.groupBy("part", "mask").agg(F.count("*").alias("documents")).select("part", "mask", "documents", none.alias("good"), none.alias("toxic"))
    labelled = masked.join(known, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select("part", "mask", none.alias("documents"), "good", "toxic")
    return documents.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("documents", "good", "toxic")))


def filter_interactions(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """One row for each part, order of the five filters and step of it: see failure_counts() for documents and filters.

    kept: left after this step; removed: what this step removes; redundant: fails its filter but is gone already; unique_fails: fails
    its filter only; good_lost, toxic_lost: removed here with such a label; shapley: what the filter removes in all 120 orders together.
    An empty table has no parts. The counts of a part are at most 32 rows, whatever it holds.
    """
    spark = docs.sparkSession
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, sum(1 << FILTERS.index(c) for c in o[:k]), 1 << FILTERS.index(o[k])) for o in orders for k in range(5)]
    at = F.array(*(F.struct(F.lit(p).alias("gone"), F.lit(b).alias("bit")) for p, b in sorted({s[2:] for s in steps})))
    counts = failure_counts(docs, labels, cells).withColumn("at", F.explode(at)).select("*", "at.gone", "at.bit").drop("at")
    fails, left = F.expr("mask & bit > 0"), F.expr("mask & gone = 0")

    def total(of: str | Column, where: Column) -> Column:
        return F.sum(F.when(where, of if isinstance(of, Column) else F.col(of)).otherwise(F.lit(0))).cast("long")

    stood = counts.groupBy("part", "gone", "bit").agg(
        total("documents", left & ~fails).alias("kept"), total("documents", left & fails).alias("removed"), total("documents", ~left & fails).alias("redundant"), total("documents", F.expr("mask = bit")).alias("unique_fails"),
        total("good", left & fails).alias("good_lost"), total("toxic", left & fails).alias("toxic_lost"),
        # of the filters that a document fails each is the first in as many orders
        total(F.expr("documents * (120 div bit_count(mask))"), fails).alias("shapley"),
    )
    table = spark.createDataFrame(steps, "filter_order string, step int, gone int, bit int")
    return stood.join(F.broadcast(table), ["gone", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH judged AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flagged AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM judged
), known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flagged LEFT JOIN known USING (doc_id) GROUP BY ALL
), f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1 JOIN f f2 ON f2.x <> f1.x JOIN f f3 ON f3.x NOT IN (f1.x, f2.x) JOIN f f4 ON f4.x NOT IN (f1.x, f2.x, f3.x) JOIN f f5 ON f5.x NOT IN (f1.x, f2.x, f3.x, f4.x)
), steps AS (SELECT filter_order, s AS step, bits[s] AS bit, list_sum(bits[1:s - 1])::INT AS gone FROM orders, range(1, 6) r(s)),
cells AS (SELECT part, filter_order, step, mask, n, good, toxic, bit, mask & bit > 0 AS fails, mask & coalesce(gone, 0) = 0 AS stays FROM masks, steps),
runs AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (stays AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (stays AND fails), 0) AS removed, coalesce(sum(n) FILTER (NOT stays AND fails), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (stays AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (stays AND fails), 0) AS toxic_lost
  FROM cells GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM runs
"""
