"""Filter interactions against SQL and a plain count, on odd rows; the sketch against exact counts."""

import random
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import audit
from gaugeworks.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, part string, mask string, good int"


def plain(docs, labels):
    """Each order applied to each document in turn."""
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        bad = ("A" if len(words) < 50 else "") + ("B" if 100 * len(set(words)) < 65 * len(words) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else "")
        bad += ("D" if set(text) & set("#$%&*|") else "") + ("E" if any((t or "") == text and j is not None and i is not None and j < i for j, t, _ in docs) else "")
        mine = [(q, t) for j, q, t in labels if j == i and i is not None]
        fails.append((source or "", bad, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = {}
    shapley = Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            gone = []
            for k, x in enumerate(order, 1):
                here = [f for f in left if x in f[1]]
                row = (sum(x not in f[1] for f in left), len(here), sum(x in f[1] for f in gone), sum(f[1] == x for f in fails if f[0] == part), sum(f[2] for f in here), sum(f[3] for f in here))
                out[part, order, k] = row
                shapley[part, x] += len(here)
                left, gone = [f for f in left if x not in f[1]], gone + here
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = [None, "", " \t\x0b", "$", "A B", "x " * 60, "a b " * 70, " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i}" for i in range(80)), " ".join(f"w{i}" for i in range(49)), "é" * 5000 + " #", " ".join(f"v{i}" for i in range(30_000))]
    docs = [(rng.choice([None, *range(90)]), rng.choice([*texts, f"n{k} " * 55, " ".join(f"u{k}x{i}" for i in range(70))]), rng.choice([None, "", "s", "t"]), None, "m", 1) for k in range(160)]
    docs += [(200 + k, "copied many times " * 30, "hot", None, None, None) for k in range(100)] + docs[:3]
    labels = [(rng.choice([None, *range(240)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(150)]
    path = tmp_path_factory.mktemp("audit")
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), [d[:3] for d in docs], labels


def test_interactions(spark, tables):
    path, docs, labels = tables
    got = QUERIES["op12_filter_interaction_audit"](spark, path)
    rows = [tuple(r) for r in got.collect()]
    assert {r[:3]: r[3:] for r in rows} == plain(docs, labels) and len(rows) == 600 * 4
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as from '{path}/{t}.parquet/*.parquet'")
    want = db.sql(audit.SQL)
    assert want.columns == got.columns and sorted(rows) == sorted(want.fetchall())


def test_counts_of_failures_add_up(spark, tables):
    path, docs, _ = tables
    counts = audit.failure_counts(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert sum(r["documents"] for r in counts) == len(docs) and all(0 <= r["mask"] < 32 for r in counts)


@pytest.mark.parametrize("n", [2000, 600_000])
def test_sketch_misses_no_repeat(spark, n):
    """Texts that occur twice are possible repeats whatever the load; at its usual load few others are."""
    ids = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, F.col("id") - F.col("id") % 20).otherwise(F.col("id")).alias("text"))
    rows = ids.select("id", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"))
    possible = audit.possible_repeats(rows, n, audit.BLOCK)
    found = rows.select("id", possible.alias("possible")).groupBy((F.col("id") % 10 == 0).alias("repeats")).agg(F.count_if("possible").alias("yes"), F.count("*").alias("all")).collect()
    by = {r["repeats"]: r for r in found}
    assert by[True]["yes"] == by[True]["all"]
    if n == 2000:
        assert by[False]["yes"] < 0.01 * by[False]["all"]


def test_nothing(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert audit.filter_interactions(one, labels).count() == 600
