"""Operator 8: URL filters by host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The rules are broadcast; more than so many are refused.
MOST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`.

    Each row's url is expanded into its host suffixes (of as many labels as some rule has) times its path
    prefixes (of the lengths that rules have). Expressions meet rules on the first digits of their
    SHA-256, full digests confirm, and the longest rule wins; equally long ones by their text. Urls that no
    rule fits get `default`. A null url, or one without ``://``, has empty host and path. Repeated
    rows stay; other columns of `pages` are not returned. An empty table gives none.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be broadcast")
    spark = pages.sparkSession
    labels = max([r[1].count(".") + 1 for r in rules], default=1)
    lengths = sorted({len(r[2]) for r in rules}) or [0]

    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumn("rest", F.coalesce(rest, F.lit("")))
    split = split.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    split = split.select("page_id", "url", F.translate("raw", _UPPER, _LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0).alias("path"))

    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    digest = lambda host, path: F.sha2(F.concat(host, F.lit(" "), path), 256)
    table = table.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).select(
        F.concat("rule_host", "rule_path").alias("rule"), "verdict", "digest", F.substring("digest", 1, prefix_digits).alias("short")
    )
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    # a row is a key of its own, so that popular urls and nulls are none; its expressions meet again in the task that made them
    rows = split.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path")
    keys = ["row", "page_id", "host", "path"]
    expanded = rows.select(*keys, F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(*keys, "suffix", F.explode_outer("prefixes").alias("prefix"))
    expanded = expanded.select(*keys, digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("short", F.substring("digest", 1, prefix_digits))
    met = expanded.alias("e").join(F.broadcast(table).alias("r"), (F.col("e.short") == F.col("r.short")) & (F.col("e.digest") == F.col("r.digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    return met.groupBy(*keys).agg(best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
hit AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
        FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (rid)
"""
