"""Connected components of a link table, as DataFrame rounds with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import removed, stored, stored_at


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`; nodes have equal roots exactly if links join them.

    Each round lets a node point to the neighbour, or itself, that has the least hash, and contracts
    the graph along the pointers; hashes differ between rounds, so that chains shrink by a constant
    factor too. Nulls and self links are ignored. An empty link table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    pairs, path = stored_at(pairs.distinct(), "links")
    hops: list[DataFrame] = []
    turn = 0
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        hop = stored(
            both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "hop"
        )
        hops.append(hop)
        left = hop.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = hop.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = pairs.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        pairs, fresh = stored_at(moved.where("a <> b").distinct(), "links")
        removed(pairs.sparkSession, path)
        path, turn = fresh, turn + 1
    if not hops:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hops[-1].select("node", F.col("to").alias("root"))
    for hop in reversed(hops[:-1]):
        # a node that a later round does not know has no links left: it is its own root
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("end"))
        roots = hop.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("root"))
    return roots
