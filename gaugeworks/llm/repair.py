"""Operator 11: conversation structure repair by Knuth's lightest-derivation agenda.

Rows of a conversation are read in order of turn, then role and text. The edits are Keep (cost 0), Rerole to user or assistant (3),
Delete (4; what blank and repeated rows need) and Insert of an empty user or assistant row (3); a truncated row that stays costs 3 more.
The cheapest edits are wanted that bring role initials to `(s?(ua)+)?`, of equally cheap ones those with the least audit (their initials).

Items of the agenda are [q, rows, p]: these rows can be repaired so that the pattern's automaton goes from state q to p. Weights are
(cost, rows, audit). An edit is a deduction from one item, two adjacent items give a third. Both functions are superior (what they give
weighs more than what they take: cost or rows rise) and monotone: audits of the same rows at the same cost are never one the start
of the other, as that would take Inserts, which cost.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship, stored

#: Rows of a block, and characters after which one ends: what a task holds at a time.
ROWS, CHARACTERS = 512, 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The automaton of (s?(ua)+)?: 0 at the start, 1 after s, 2 after u, 3 after a. It may end in GOALS.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOALS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"


def lightest(axioms: list[tuple], deduced: Callable, goals: set | None = None) -> dict:
    """Knuth's agenda: weights of final items. Items leave it in order of weight and are final then; a deduction is made when the last item it takes is final.

    `deduced(item, weight, final)` yields (weight, item). It ends with the first of `goals`, or without them when the agenda is empty.
    """
    final: dict = {}
    agenda = list(axioms)
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goals and item in goals:
            break
        for more in deduced(item, weight, final):
            if more[1] not in final:
                heapq.heappush(agenda, more)
    return final


def block_items(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """(q, p, cost, audit) of all items over all of `rows`, which are (initial, has to go, truncated)."""

    def deduced(item, weight, final):
        q, i, p = item
        cost, _, audit = weight
        for c in "ua":
            if (to := STEPS.get((p, c))) is not None:
                yield (cost + INSERT, i, audit + "I"), (q, i, to)
        if i < len(rows):
            initial, goes, truncated = rows[i]
            yield (cost + DELETE, i + 1, audit + "D"), (q, i + 1, p)
            if not goes:
                stays = cost + TRUNCATED * truncated
                if (to := STEPS.get((p, initial))) is not None:
                    yield (stays, i + 1, audit + "K"), (q, i + 1, to)
                for c in "ua":
                    if (to := STEPS.get((p, c))) is not None:
                        yield (stays + REROLE, i + 1, audit + "R"), (q, i + 1, to)

    final = lightest([((0, 0, ""), (q, 0, q)) for q in starts], deduced)
    return [(q, p, cost, audit) for (q, i, p), (cost, _, audit) in final.items() if i == len(rows)]


def joined_items(blocks: list[tuple[int, list[tuple[int, int, int, str]]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost and audit of a conversation of (rows, items) blocks, and of each block its first state and its part of the audit."""
    at = [0]
    for n, _ in blocks:
        at.append(at[-1] + n)
    axioms = [((cost, n, audit, (q, p)), (k, k + 1, q, p)) for k, (n, items) in enumerate(blocks) for q, p, cost, audit in items if k or q == 0]

    def deduced(item, weight, final):
        first, last, q, p = item
        if first == 0:  # from the left on: [0..k] and [k..k+1]
            pairs = [(weight, final.get((last, last + 1, p, r)), (0, last + 1, q, r)) for r in range(4)]
        else:
            pairs = [(final.get((0, first, 0, q)), weight, (0, last, 0, p))]
        for a, b, to in pairs:
            if a and b:
                yield (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3][1:]), to

    goals = {(0, len(blocks), 0, p) for p in GOALS}
    final = lightest(axioms, deduced, goals)
    cost, _, audit, path = next(final[g] for g in goals if g in final)
    parts = [{(q, p): a for q, p, _, a in items} for _, items in blocks]
    return cost, audit, [(q, part[q, p]) for part, q, p in zip(parts, path, path[1:], strict=False)]


def _digest(rows: DataFrame) -> Column:
    """Tells conversation, role and text apart."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    return F.md5(F.concat_ws(":", F.length(conv), conv, F.length("role"), F.col("role"), F.col("text")))


def _flagged(conversations: DataFrame, times: str | None) -> DataFrame:
    """conv_id, turn, role, text, times, blank, truncated and whether role and text stand in an earlier turn."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *said, (F.col(times) if times else F.lit(1)).cast("int").alias("times"))
    last = F.expr(r"right(trim(TRAILING ' \t\n\u000b\u000c\r' FROM text), 1)")
    rows = rows.withColumns({"blank": last == "", "truncated": ~last.isin(".", "!", "?"), "place": F.struct(F.col("turn").isNotNull().alias("known"), "turn"), "digest": _digest(rows)})
    # repeats are few: most texts are alone in their conversation
    firsts = rows.where(~F.col("blank") & (F.col("times") > 0)).groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    seen = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("conv_id", "turn", "role", "text", "times", "blank", "truncated", seen.alias("seen"))


FACTS = "n int, low long, high long, first long, last long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
ITEMS = "items array<struct<q: int, p: int, cost: long, audit: string>>"


def _blocks(kind: pa.DataType):
    """Rows in order to blocks: facts, items and the rows themselves."""
    facts = [(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in FACTS.split(", ")]
    schema = pa.schema([
        ("conv_id", kind), ("part", pa.int32()), ("block", pa.int32()), *facts,
        ("items", pa.list_(pa.struct([("q", pa.int32()), ("p", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
        ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv, begun = None, False
        whole = False  # whether the conversation's first row is in this task
        before: tuple | None = None
        held: list[dict] = []
        flags: list[tuple[str, bool, bool]] = []
        size = 0
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        ready: list[dict] = []

        def close() -> None:
            nonlocal number, held, flags, size, whole, count
            turns = [r["turn"] for r in held if r["turn"] is not None]
            initials = [f[0] for f in flags]
            items = block_items(flags, (0,) if whole else (0, 1, 2, 3))
            ready.append({
                "conv_id": conv, "part": part, "block": number, "n": len(held), "low": min(turns, default=None), "high": max(turns, default=None), "first": turns[0] if turns else None,
                "last": turns[-1] if turns else None, "turns": len(set(turns)), **count, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                "head": initials[0] if initials else None, "tail": initials[-1] if initials else None, "items": [dict(zip("q p cost audit".split(), x, strict=True)) for x in items], "rows": held,
            })
            number += 1
            held, flags, size, whole, count = [], [], 0, False, dict.fromkeys(count, 0)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(ready, schema)
            ready.clear()
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of, turn, role, text, times, blank, truncated, seen = row
                if not begun or of != conv:
                    if begun:
                        close()
                    conv, whole, before = of, begun, None
                    begun = True
                for _ in range(times):
                    double = not blank and (seen or before == (turn, role, text))
                    fault = "blank" if blank else "duplicate" if double else "truncated" if truncated else None
                    if fault:
                        count[fault] += 1
                    before = (turn, role, text)
                    held.append({"turn": turn, "role": role, "text": text})
                    flags.append((role[:1], blank or double, fault == "truncated"))
                    size += len(text)
                    if len(held) >= ROWS or size >= CHARACTERS:
                        close()
                if len(ready) >= 256:
                    yield flush()
        if begun:
            close()
        yield flush()

    return run


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with one conv_id."""
    group: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if group and row["conv_id"] != group[0]["conv_id"]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _joined(kind: pa.DataType):
    """Blocks of conversations to their parts of the audit; the summary stands at the first one."""
    schema = pa.schema([("conv_id", kind), ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int32()), ("piece", pa.string()), ("base", pa.int64()), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches):
            cost, audit, parts = joined_items([(b["n"], [(i["q"], i["p"], i["cost"], i["audit"]) for i in b["items"]]) for b in g])
            timed = [b for b in g if b["low"] is not None]
            turns = sum(b["turns"] for b in timed) - sum(a["last"] == b["first"] for a, b in zip(timed, timed[1:], strict=False))
            full = [b for b in g if b["n"]]
            facts = {c: sum(b[c] for b in g) for c in ("blank", "duplicate", "truncated", "illegal")}
            facts["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(full, full[1:], strict=False))
            facts["gaps"] = max(b["high"] for b in timed) - min(b["low"] for b in timed) + 1 - turns if timed else 0
            facts |= {"cost": cost, "audit": audit}
            out, base = [], 0
            for k, (b, (start, piece)) in enumerate(zip(g, parts, strict=True)):
                out.append({"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "start": start, "piece": piece, "base": base, **(facts if k == 0 else {})})
                base += len(piece) - piece.count("D")
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def edited(rows: list[dict], start: int, piece: str) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of the rows that the edits leave."""
    state, left = start, iter(rows)
    for e in piece:
        row = next(left) if e != "I" else {"turn": None, "role": "", "text": ""}
        if e == "D":
            continue
        if e == "K":
            role, c = row["role"], row["role"][:1]
        else:
            c = "a" if state == 2 else "u"
            role = NAMES[c]
        state = STEPS[state, c]
        yield e, row["turn"], role, row["text"]


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Each block's decision and rows; the decision comes just before them."""
    decision: dict = {}
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            if row["texts"]:
                yield decision, row["rows"]
            else:
                decision = row


def _hashed(kind: pa.DataType):
    columns = SUMMARY.split(", ")
    schema = pa.schema([("conv_id", kind), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in columns), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, empty, ready = None, hashlib.sha256(), True, []
        for d, rows in _both(batches):
            if d["cost"] is not None:
                if head:
                    ready.append(head | {"repaired_sha256": digest.hexdigest()})
                head, digest, empty = {"conv_id": d["conv_id"], **{c.split()[0]: d[c.split()[0]] for c in columns}}, hashlib.sha256(), True
            for _, _, role, text in edited(rows, d["start"], d["piece"]):
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
            if len(ready) >= 1024:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if head:
            ready.append(head | {"repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(ready, schema)

    return run


def _written(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows in _both(batches):
            out = [dict(zip(schema.names, (d["conv_id"], d["base"] + k, *r), strict=True)) for k, r in enumerate(edited(rows, d["start"], d["piece"]))]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _decided(conversations: DataFrame, times: str | None) -> tuple[DataFrame, pa.DataType, str]:
    """Decisions and rows of all blocks, one below the other; the Arrow and SQL type of conv_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = conversations.sparkSession
    ship(spark)
    of = conversations.schema["conv_id"].dataType
    kind, name = to_arrow_type(of), of.simpleString()
    # a conversation of any size is dealt to as many tasks as it needs; rows alike in all that orders them stay together
    order = ["conv_id", "turn", "role"]
    ordered = _flagged(conversations, times).repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    made = ordered.mapInArrow(_blocks(kind), f"conv_id {name}, part int, block int, {FACTS}, {ITEMS}, rows array<struct<turn: long, role: string, text: string>>")
    blocks = stored(made, "blocks")
    keys = ["conv_id", "part", "block"]
    decided = blocks.drop("rows").repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(_joined(kind), f"conv_id {name}, part int, block int, start int, piece string, base long, {SUMMARY}")
    decided = decided.withColumns({"texts": F.lit(False), "rows": F.lit(None).cast(blocks.schema["rows"].dataType)})
    texts = blocks.select(*keys, F.lit(True).alias("texts"), "rows")
    return decided.unionByName(texts, allowMissingColumns=True), kind, name


def conversation_audits(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cost and audit of its cheapest repair and the SHA-256 of the repaired `role:text` lines.

    `times` names a column with how often each row stands; 0 keeps the conversation in the result, with zeros if nothing else is in it.
    Null roles and texts are one space. Null conv_ids are one conversation, null turns come first and are no turn in `gaps`. Rows of the
    same turn come by role and text, repeated rows are duplicates. A role's initial is its first character as written; an empty
    role has none and fits nowhere. An empty table gives no rows. Faults: blank, else duplicate, else truncated.

    Rows are dealt by ranges and repaired in blocks of at most ROWS rows or CHARACTERS, from each state that a block can start in, then blocks are joined; so
    a conversation may be longer than what a task holds. Only the SHA-256 reads a conversation's blocks one after the other.
    """
    both, kind, name = _decided(conversations, times)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "texts")
    return dealt.mapInArrow(_hashed(kind), f"conv_id {name}, {SUMMARY}, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """The rows of repaired conversations: conv_id, position from 0, the edit that made it (K, R or I), turn, role and text. See conversation_audits()."""
    both, kind, name = _decided(conversations, times)
    dealt = both.repartition("part", "block").sortWithinPartitions("part", "block", "texts")
    return dealt.mapInArrow(_written(kind), f"conv_id {name}, position long, edit string, turn long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults to repair: by crc32(`conv_id:turn`) % 20, 0 drops the row (times 0), 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = conversations.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), (F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("times"))


#: conversation_audits(damaged(conversations)) by a table of the cheapest repair of the first i rows for each state of the automaton.
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (
  SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id, tab
), after_damage AS (
  SELECT cid, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n
  FROM keyed
), flagged AS (
  SELECT cid, turn, role, text, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, n) AS i, row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, n) > 1 AS again,
    right(regexp_extract(text, '(?s)^(.*[^\x20\x09-\x0D])', 1), 1) NOT IN ('.', '!', '?') AS cut
  FROM after_damage
), faults AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, lag(initial) OVER (PARTITION BY cid ORDER BY i) AS before FROM flagged),
facts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY cid
), inserts(q, p, a) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
steps(q, x, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT q, x, p, 'K' AS e, 0 AS cost FROM steps UNION ALL SELECT q, NULL, p, 'R', 3 FROM steps WHERE x <> 's' UNION ALL SELECT q, NULL, q, 'D', 4 FROM (SELECT DISTINCT q FROM inserts)
), best AS (
  SELECT cid, 0::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': ''} AS w FROM ids
  UNION ALL
  SELECT b.cid, b.i + 1, e.p, min({'c': b.w.c + 3 * length(n.a) + e.cost + CASE WHEN f.truncated AND e.e <> 'D' THEN 3 ELSE 0 END, 'a': b.w.a || n.a || e.e})
  FROM best b JOIN faults f ON f.cid = b.cid AND f.i = b.i + 1 JOIN inserts n ON n.q = b.q JOIN edits e ON e.q = n.p AND (e.e = 'D' OR NOT (f.blank OR f.duplicate) AND (e.x IS NULL OR e.x = f.initial))
  GROUP BY b.cid, b.i + 1, e.p
), repaired AS (
  SELECT cid, min({'c': w.c + 3 * length(a), 'a': w.a || a}) AS w
  FROM best JOIN inserts USING (q) WHERE inserts.p IN (0, 3) AND i = (SELECT count(*) FROM faults f WHERE f.cid = best.cid) GROUP BY cid
), letters AS (SELECT cid, w.a AS audit, unnest(range(1, length(w.a) + 1)) AS j FROM repaired),
placed AS (
  SELECT cid, j, audit[j] AS e, length(replace(left(audit, j), 'I', '')) AS i, length(replace(left(audit, j), 'D', '')) - 1 AS place FROM letters
), lines AS (
  SELECT p.*, coalesce(f.role, '') AS role, CASE WHEN e = 'I' THEN '' ELSE coalesce(f.text, '') END AS text, max(e = 'K' AND place = 0 AND f.initial = 's') OVER (PARTITION BY p.cid) AS headed
  FROM placed p LEFT JOIN faults f ON f.cid = p.cid AND f.i = p.i WHERE e <> 'D'
), whole AS (
  SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + headed::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS text FROM lines GROUP BY cid
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c AS cost, w.a AS audit,
  sha256(coalesce(text, '')) AS repaired_sha256
FROM ids JOIN repaired USING (cid) LEFT JOIN facts USING (cid) LEFT JOIN whole USING (cid)
"""
