"""Line dedup by every length of lines, beside columns that bear the operator's own names."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lines
from test_operators import distance, edited

CLASH = ["_d", "_h", "_p", "_kept", "_gone", "_th", "_rd", "_rh", "row", "left", "line", "w", "n", "halves", "id"]


def plain(rows, least):
    placed = sorted((d, p, ln, ln.split()) for d, t in dict(rows).items() if t is not None for p, ln in enumerate(t.split("\n")))
    kept = {}
    for i, (d, _, ln, w) in enumerate(placed):
        near = (x for _, _, o, x in placed[:i] if x and (o == ln or (min(len(w), len(x)) >= least and abs(len(w) - len(x)) < 2 and distance(w, x) <= 1)))
        if not w or next(near, None) is None:
            kept.setdefault(d, []).append(ln)
    return {d: "\n".join(kept[d]) if d in kept else None for d, _ in rows}


@pytest.mark.parametrize(("least", "lengths"), [(8, (7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 65, 120, 128, 257)), (1, (1, 1, 2, 3, 4, 5))])
def test_lines_of_every_length(spark, least, lengths):
    rng = random.Random(6)
    pool, rows = [], []
    for i in range(40):
        here = []
        for _ in range(rng.randint(0, 5)):
            w = edited(rng.choice(pool), rng, 2) if pool and rng.random() < 0.6 else [f"{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(rng.choice(lengths))]
            pool.append(w)
            here.append(rng.choice(["", " ", "\t"]) + rng.choice([" ", "  "]).join(w) + rng.choice(["", "\r", " "]))
        rows.append((i, "\n".join(here)))
    rows += [(50, None), (51, ""), (52, " \n\t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated_lines(docs, edit_words=least).collect()}
    assert got == plain(rows, least)
    wide = docs
    for c in CLASH:
        wide = wide.withColumn(c, F.concat(F.lit(c), "doc_id"))
    out = lines.deduplicated_lines(wide, edit_words=least).collect()
    assert {r["doc_id"]: r["text"] for r in out} == got and len(out) == len(rows)
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out for c in CLASH)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, "a b c\nd", "z"), (2, "d\ne", "u"), (1, "f", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["_h"]) for r in lines.deduplicated_lines(docs).collect())
    assert got == sorted([("1", "None", "x"), ("1", "None", "y"), ("None", "a b c\nd", "z"), ("2", "e", "u"), ("1", "f", "v")])
    assert lines.deduplicated_lines(docs, drop_repeats=True).count() == 3
