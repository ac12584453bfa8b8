"""Operator 9: mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
#: No document is taken more often.
REPEATS = 3
#: Slope of a source's weight over time, by its weight: light sources come early, heavy ones late.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}


def source_targets(sizes: DataFrame) -> DataFrame:
    """Of skey, source, size: skey, source_size, target, weight of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by
    weight, none above REPEATS times its source's size; the excess goes to the others by weight. The
    sources that are at their limit are a prefix in the order of limit by weight, so one running sum finds the level.
    """
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("left_size") / F.col("left_weight"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    level = F.coalesce(first["level"], F.max("ratio").over(whole))
    return per.select("skey", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"), "weight")


def curriculum(docs: DataFrame, seed: str = "mix", tag: Column | None = None) -> DataFrame:
    """Each row of `docs` with size, source_size, target, and positions: an array of a training time in [0, 1] for each time it is taken.

    A source's documents stand in the order of a keyed digest, three times over; a copy is taken if its middle word is
    before the target. Its position is where the integral of the source's weight schedule, weight * (1 + slope * (2t - 1)),
    has used up the words before its middle. Running sums go over digest prefixes first, then within one, so no task holds a source.
    The same rows give the same result. `tag` is returned too and orders rows that are alike otherwise. Null text has size 0; a null source is a source; repeated
    rows are taken one by one. Rows that tie in every column are alike. An empty table gives none.
    """
    spark = docs.sparkSession
    digits = 2 if int(spark.conf.get("spark.sql.shuffle.partitions")) <= 1000 else 4
    # Columns of ours are built from named inputs, so that others of `docs` can bear any name
    text = F.col("text").cast("string")
    base = stored(
        docs.select(
            F.col("doc_id"), F.col("source"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat_ws(" ", F.lit(seed), F.col("doc_id"))).alias("h"), F.xxhash64(text).alias("th"), (F.lit(0) if tag is None else tag).alias("tag"),
        ).withColumn("bucket", F.substring("h", 1, digits)),
        "sizes",
    )
    targets = source_targets(base)
    part = base.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    part = part.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = part.join(targets, "skey").select("skey", "bucket", "ahead", "source_size", "target", "weight")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", F.col("doc_id"), "size", "th", "tag").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(part, ["skey", "bucket"])
    rows = rows.withColumn("slope", F.element_at(F.create_map(*[F.lit(x) for kv in SLOPES.items() for x in kv]), F.col("weight")))

    def at(e: int):
        middle = F.col("ahead") + F.col("inner") + F.lit(e) * F.col("source_size") + F.col("size") / 2
        y, a = middle / F.col("target"), F.col("slope")
        t = F.when(a == 0, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / (2 * a))
        return F.when(middle < F.col("target"), t)

    rows = rows.withColumn("positions", F.array_compact(F.array(*[at(e) for e in range(REPEATS)])))
    return rows.select("doc_id", "source", "th", "tag", "size", "source_size", "target", "positions")


def mixed_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of its first copy) of every row, range-sorted by position."""
    rows = curriculum(docs, seed)
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), F.get("positions", F.lit(0)).alias("position"))
    return rows.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position.

    Rows are told apart by digests (128 bits) of all their columns, whatever their names; rows alike in all of them
    take their positions together, so work is linear in repeated rows. Null and empty texts have no words and are taken at the place where they stand.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashed = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    # hashes pass over nulls, so where these are is hashed too
    tag = F.concat_ws(" ", *[F.xxhash64(F.lit(i), *hashed, *[c.isNull() for c in hashed]) for i in range(2)])
    at = curriculum(docs, seed, tag).select("tag", F.explode("positions").alias("position"))
    # one row of those alike stands for all: they take the positions of all of them
    rows = docs.select(row.alias("row"), tag.alias("tag")).groupBy("tag").agg(F.any_value("row").alias("row"))
    return at.join(rows, "tag").orderBy("position", "row.doc_id").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


SQL = f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('mix ' || doc_id) AS h FROM documents),
per AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM base GROUP BY source),
c AS (SELECT *, source_size * {REPEATS} AS cap, source_size * {REPEATS} / weight AS ratio FROM per),
d AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
      FROM c WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce((SELECT lev FROM d WHERE lev <= ratio ORDER BY ratio, lev LIMIT 1), (SELECT max(ratio) FROM d)) AS lev),
t AS (SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), l.lev * weight) AS target FROM d, l),
o AS (SELECT base.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM base),
m AS (SELECT o.*, t.source_size, t.target, t.weight, ahead + size / 2 AS mid FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
s AS (SELECT *, CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0 ELSE 0.5 END AS a FROM m)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * ((mid < target)::INT + (mid + source_size < target)::INT + (mid + 2 * source_size < target)::INT) AS BIGINT) AS taken,
  CASE WHEN mid < target THEN CASE WHEN a = 0 THEN mid / target ELSE (sqrt((1 - a) * (1 - a) + 4 * a * (mid / target)) - (1 - a)) / (2 * a) END END AS position
FROM s
"""
