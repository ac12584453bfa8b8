"""Conversation repair against enumeration and SQL, on odd rows and on conversations of many blocks."""

import hashlib
import random

import duckdb
import pytest

from gaugeworks.llm import repair
from gaugeworks.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, cost string, rows int"


def plain(rows):
    """The cheapest (cost, audit) of all edits, tried one after the other."""
    best = [(10**9, "")]

    def go(i, written, cost, audit, inserted):
        if cost > best[0][0]:
            return
        pairs = written[1:] if written[:1] == "s" else written
        if i == len(rows) and (written == "" or (pairs and len(pairs) % 2 == 0 and pairs == "ua" * (len(pairs) // 2))):
            best[0] = min(best[0], (cost, audit))
        if written not in ("", "s") and pairs != ("ua" * len(pairs))[: len(pairs)]:
            return
        if inserted < 2:
            for c in "ua":
                go(i, written + c, cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            initial, goes, cut = rows[i]
            go(i + 1, written, cost + 4, audit + "D", 0)
            if not goes:
                if initial and initial in "sua" and (initial != "s" or written == ""):
                    go(i + 1, written + initial, cost + 3 * cut, audit + "K", 0)
                for c in "ua":
                    go(i + 1, written + c, cost + 3 + 3 * cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def some(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_lightest_derivation():
    rng = random.Random(4)
    for n in [0, 1, 2, 3, 4, 5] * 12:
        rows = some(rng, n)
        cost, audit, _ = repair.joined_items([(n, repair.block_items(rows, (0,)))])
        assert (cost, audit) == plain(rows), rows


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(5)
    for n in [1, 7, 40, 90] * 8:
        rows = some(rng, n)
        whole = repair.joined_items([(n, repair.block_items(rows, (0,)))])
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(5))})
        blocks = [(b - a, repair.block_items(rows[a:b], (0, 1, 2, 3))) for a, b in zip(cuts, cuts[1:])]
        got = repair.joined_items(blocks)
        assert got[:2] == whole[:2]
        assert "".join(p for _, p in got[2]) == whole[1] and len(got[2]) == len(blocks)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(6)
    says = ["Yes.", "No!", "and then", " ", "", None, "A?\n", "x.\x0b\x0c", "ends in f", "é…", "Yes. " * 3000]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(says), "x", 1) for c in range(60) for t in range(rng.randint(1, 9)) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(None, None, None, None, None, None), (None, 3, "user", "Yes.", None, None), (100, 2**40, "user", "Yes.", None, None), (100, -5, "assistant", "No!", None, None)]
    rows += [(7777, t, rng.choice(roles), rng.choice([*says, f"n {t}.", f"m {t}"]) if t % 5 else f"only {t}.", None, None) for t in range(1500)]
    path = str(tmp_path_factory.mktemp("odd") / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return path


def test_odd_rows(spark, odd):
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{odd}/*.parquet'")
    got = QUERIES["op11_conversation_repair"](spark, odd.rsplit("/", 1)[0])
    want = db.sql(repair.SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_repaired_rows(spark, odd):
    rows = repair.damaged(spark.read.parquet(odd))
    audits = {r["conv_id"]: r for r in repair.conversation_audits(rows, "times").collect()}
    found = {c: [] for c in audits}
    for r in repair.repaired_conversations(rows, "times").orderBy("conv_id", "position").collect():
        assert r["position"] == len(found[r["conv_id"]])
        found[r["conv_id"]].append(r)
    for c, a in audits.items():
        assert "".join(r["edit"] for r in found[c]) == a["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in found[c]).encode()).hexdigest() == a["repaired_sha256"]
        initials = "".join(r["role"][0] for r in found[c]).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.conversation_audits(none).count() == 0 and repair.repaired_conversations(none).count() == 0
    gone = spark.createDataFrame([(1, 2, "user", "A.", 0)], "conv_id long, turn long, role string, text string, times int")
    assert [tuple(r) for r in repair.conversation_audits(gone, "times").collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
