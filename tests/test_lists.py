"""Lists after their logs: edits that compose against a plain loop over the changes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import lists

CHANGE = "project_id long, seq long, kind string, entity long, index int, before array<bigint>, after array<bigint>"


def plain(items, changes):
    """The list after the changes, or null where one does not fit."""
    items = list(items)
    for kind, entity, index, before, after in changes:
        i = -1 if index is None else index
        if kind == "inserted" and 0 <= i <= len(items) and entity not in items:
            items.insert(i, entity)
        elif kind == "removed" and 0 <= i < len(items) and items[i] == entity:
            items.pop(i)
        elif kind == "ordered" and before == items and sorted(after or []) == sorted(items):
            items = list(after)
        else:
            return None
    return items


def log(rng, start, n, wrong=0.0):
    """Changes that fit, but for a share of wrong ones."""
    items, out = list(start), []
    for k in range(n):
        r = rng.random()
        if rng.random() < wrong:
            out.append(rng.choice([("inserted", rng.choice([*items, 999]), rng.choice([0, len(items) + 1]), None, None), ("removed", rng.choice([*items, 999]), rng.randrange(len(items) + 1), None, None), ("ordered", None, None, items[::-1], items), ("moved", 1, 0, None, None)]))
        elif r < 0.5 or not items:
            e, i = 1000 + k if rng.random() < 0.8 else rng.choice([x for x in range(40) if x not in items]), rng.randint(0, len(items))
            if e in items:
                continue
            out.append(("inserted", e, i, None, None))
            items.insert(i, e)
        elif r < 0.93:
            i = rng.randrange(len(items))
            out.append(("removed", items.pop(i), i, None, None))
        else:
            after = items[:]
            rng.shuffle(after)
            out.append(("ordered", None, None, items[:], after))
            items = after[:]
    return out


def applied(start, changes, cuts):
    edit = lists.same()
    for a, b in zip(cuts, cuts[1:]):
        then = lists.edit_of(changes[a:b])
        edit = None if edit is None or then is None else lists.composed(edit, then)
    last = None if edit is None else lists.composed(lists.constant(start), edit)
    return None if last is None else [e for _, _, e in last.pieces]


@pytest.mark.parametrize("wrong", [0.0, 0.03])
def test_edits_compose_to_what_a_loop_gives(wrong):
    rng = random.Random(int(wrong * 100))
    kinds = set()
    for _ in range(1500):
        start = rng.sample(range(40), rng.randint(0, 6))
        changes = log(rng, start, rng.randint(0, 14), wrong)
        cuts = sorted({0, len(changes), *(rng.randint(0, len(changes)) for _ in range(3))})
        want = plain(start, changes)
        kinds.add(want is None)
        assert applied(start, changes, cuts) == want, (start, changes, cuts)
    assert kinds == ({False} if not wrong else {False, True})


def test_composition_is_associative():
    rng = random.Random(7)
    for _ in range(400):
        start = rng.sample(range(40), 5)
        changes = log(rng, start, 12)
        a, b, c = (lists.edit_of(changes[k : k + 4]) for k in (0, 4, 8))
        left, right = lists.composed(lists.composed(a, b), c), lists.composed(a, lists.composed(b, c))
        assert lists.composed(lists.constant(start), left).pieces == lists.composed(lists.constant(start), right).pieces


def test_lists_of_many_projects(spark):
    rng = random.Random(8)
    starts = {p: rng.sample(range(40), 5) for p in range(30)}
    logs = {p: log(rng, starts.get(p, []), rng.choice([0, 3, 60]), 0.01) for p in range(32)}
    snapshot = spark.createDataFrame([(p, e, i) for p, s in starts.items() for i, e in enumerate(s)], "project_id long, entity long, pos int")
    changes = spark.createDataFrame([(p, k, *c) for p, cs in logs.items() for k, c in enumerate(cs)], CHANGE)
    for stretch, fan in ((1024, 16), (4, 2)):
        found = {}
        for r in lists.current_order(snapshot, changes, stretch, fan).collect():
            found.setdefault(r["project_id"], []).append((r["pos"], r["entity"], r["sound"]))
        for p in range(32):
            want = plain(starts.get(p, []), logs[p])
            got = sorted(found.get(p, []), key=str)
            assert got == ([(None, None, False)] if want is None else sorted(((i, e, True) for i, e in enumerate(want)), key=str))


def test_a_million_changes_of_one_project(spark):
    """Inserts in front and at the end by turns, each tenth removed again: the loop's list by rule."""
    n = 1_000_000
    k = F.col("id")
    none = F.lit(None).cast("array<bigint>")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("project_id"), k.alias("seq"), F.when(k % 10 == 9, "removed").otherwise("inserted").alias("kind"), F.when(k % 10 == 9, k - 1).otherwise(k).alias("entity"), F.lit(0).alias("index"), none.alias("before"), none.alias("after"))
    snapshot = spark.createDataFrame([(1, -1, 0)], "project_id long, entity long, pos int")
    began = time.time()
    got = lists.current_order(snapshot, rows).agg(F.count("*").alias("n"), F.sum(F.when(F.col("sound"), 0).otherwise(1)).alias("bad"), F.max_by("entity", "pos").alias("last"), F.min_by("entity", "pos").alias("first")).first()
    print(time.time() - began)
    assert (got["n"], got["bad"], got["last"], got["first"]) == (800_001, 0, -1, n - 3)
