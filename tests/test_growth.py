"""What made queries grow too fast at 6 GB: frames, lists, batches (round 3)."""

import json
import math
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from gaugeworks.operators import lists, place, revise
from gaugeworks.sources.scratch import written


def framed(run, corners):
    """One run (cx, cy, w, h, angle, em) and one rectangle, in plain words."""
    cx, cy, w, h, angle, em = run
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    at = [((x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s) for x, y in corners]
    us, vs = zip(*at)
    margins = (-w / 2 - min(us), max(us) - w / 2, -h / 2 - min(vs), max(vs) - h / 2)
    if not all(-0.25 * em <= m <= 1.2 * em for m in margins):
        return False
    edges = [(abs(q[0] - p[0]), abs(q[1] - p[1])) for p, q in zip(at, at[1:] + at[:1])]
    return all(math.hypot(*e) > 1e-12 and min(e) <= math.sin(math.radians(2.0)) * math.hypot(*e) for e in edges)


def test_frames_without_functions_of_arrays(spark):
    """Pairs of runs and frames are the most rows; a function of arrays for each of them took nine tenths of the time."""
    rng = random.Random(3)
    runs, rects = [], []
    for i in range(400):
        run = (rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(10, 80), rng.uniform(5, 15), rng.choice([0.0, 90.0, 30.0, 271.5]), 10.0)
        runs.append((i % 3, 1, i, *run))
        a = math.radians(run[4] + rng.choice([0.0, 0.0, 1.0, 4.0]))
        m = [rng.choice([2.0, 5.0, 5.0, 14.0, -1.0, -4.0]) for _ in range(2)]
        u, v = run[2] / 2 + m[0], run[3] / 2 + m[1]
        turn = rng.randrange(4)
        corners = [(run[0] + x * math.cos(a) - y * math.sin(a), run[1] + x * math.sin(a) + y * math.cos(a)) for x, y in ((-u, -v), (u, -v), (u, v), (-u, v))]
        rects.append((i % 3, 1, corners[turn:] + corners[:turn]))
    rects += [(0, 1, None), (0, 1, []), (0, 1, rects[0][2][:3])]
    left = spark.createDataFrame(runs, "project_id int, sheet_id int, run_id int, cx double, cy double, w double, h double, angle double, em double")
    got = place.framed_runs(left, spark.createDataFrame(rects, "project_id int, sheet_id int, corners array<struct<x: double, y: double>>"))
    want = {r[2]: any(framed(r[3:], c) for p, _, c in rects if p == r[0] and c and len(c) == 4) for r in runs}
    assert {r["run_id"]: r["framed"] for r in got.collect()} == want and 50 < sum(want.values()) < 350
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edits_are_rows_that_a_batch_bounds(spark):
    """An edit was one row with all its pieces, so that a batch of them held the lists of thousands of projects."""
    none = F.lit(None).cast("array<bigint>")
    changes = spark.range(4000).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("seq"), F.lit("inserted").alias("kind"), F.col("id").alias("entity"), F.lit(0).alias("index"), none.alias("before"), none.alias("after"))
    for stretch in (1024, 100):
        edits = lists.list_edits(changes, stretch, 4)
        assert not [f.name for f in edits.schema if f.dataType.typeName() in ("array", "struct", "map")]
        assert edits.groupBy("project_id").count().count() == 3 and edits.where("part <> 0").count() == 0
        assert edits.count() == 3 + 4000 + 3  # heads, entities that come in and must not be there, the old lists behind them


def test_lists_of_many_projects_are_streamed():
    """What a worker holds does not grow with the projects that it reads: 800 lists of 200 in 160,000 rows."""

    def batches(projects):
        for p in range(0, projects, 40):
            rows = [(q, 0, *r) for q in range(p, p + 40) for r in lists._rows(lists.edit_of([("inserted", e, 0, None, None) for e in range(200)]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["project_id", "part", "kind", "a", "b", "entity"])

    schema = pa.schema([("project_id", pa.int64()), ("entity", pa.int64()), ("pos", pa.int32()), ("sound", pa.bool_())])
    read = lambda projects: sum(b.num_rows for b in lists._streamed(lists._lists, schema)(batches(projects)))
    read(40)  # modules that are loaded by need
    tracemalloc.start()
    n = read(800)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 160_000 and most < 12_000_000


def test_batches_are_opened_some_levels_at_a_time(spark, monkeypatch):
    """Each level was written, and read for a check of its own; commands went into the join whole, to be taken apart for each condition there."""
    rng = random.Random(9)

    def command(depth):
        if depth and rng.random() < 0.7:
            return {"type": "batch", "commands": [command(depth - 1) for _ in range(rng.randint(0, 3))]}
        rule = rng.choice([None, "manual", "fit"])
        values = [5, {"field": "kind"}, *([{"derivation": {"rule": {"type": rule}}}] if rule else [])]
        return rng.choice([7, None, {"type": 3}, {"type": "add_characteristic"}, {"type": "accept_proposals"}, {"type": "update_fields", "ids": rng.choice([[1], [2, 1], ["x"], None, 3]), "values": values}, {"type": "set_result_type", "ids": [2]}, {"type": "update_sheet", "ids": [1]}])

    def first(c, char, created):
        if not isinstance(c, dict):
            return None
        if c["type"] == "batch":
            return next((s for s in (first(x, char, created) for x in c["commands"]) if s), None)
        if c["type"] in ("add_characteristic", "accept_proposals"):
            return {"add_characteristic": "manual", "accept_proposals": "recognition"}[c["type"]] if created else None
        if c["type"] not in ("update_fields", "set_result_type") or char not in (c["ids"] if isinstance(c["ids"], list) else []):
            return None
        return "rule" if any(isinstance(v, dict) and v.get("derivation", {}).get("rule", {}).get("type", "manual") != "manual" for v in c.get("values", [])) else "manual"

    commands = [command(rng.randint(0, 10)) for _ in range(300)] + [None]
    entries = spark.createDataFrame([(1, i, None if i == 300 else json.dumps(c)) for i, c in enumerate(commands)], "project_id int, entry_no long, text string").select("project_id", "entry_no", F.parse_json("text").alias("command"))
    touched = [(1, i, char, created) for i in range(301) for char, created in ((1, False), (2, True), (3, False))]
    tables = []
    monkeypatch.setattr(revise, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    got = revise.change_sources(entries, spark.createDataFrame(touched, "project_id int, entry_no long, char_id long, created boolean"))
    rows = {(r["entry_no"], r["char_id"]): r["source"] for r in got.collect()}
    assert rows == {(i, char): first(commands[i], char, created) for _, i, char, created in touched}
    assert {*rows.values()} == {None, "manual", "rule", "recognition"}
    assert len(tables) == 3  # 10 levels, four at a time
    assert "variant_get" not in got._jdf.queryExecution().optimizedPlan().toString()
