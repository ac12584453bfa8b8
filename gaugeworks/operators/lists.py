"""H2: lists after their logs, folded in parts: what a stretch of a log does to a list is a value of its own, and two of them compose.

Such an edit is worked out without knowing the list. It has pieces (stretches of the old list, or entities that came in), which make the new
list, and what it asks of the old one: entities in certain places, entities that must not be there, and how long it is at least or exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby, islice
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import ship

#: Changes of a log that are worked out together, and edits that are composed in one step.
STRETCH, FAN = 1024, 16
#: Rows of a batch that is handed on, and of one that is taken apart at once (an order has two lists in a row).
BATCH, READ = 8192, 256
#: An old list has no known end.
OPEN = 1 << 62


class Edit(NamedTuple):
    """Pieces are (first, end, None) of the old list or (0, 1, entity); `places` maps places of the old list to entities."""

    pieces: list[tuple[int, int, Any]]
    places: dict[int, Any]
    absent: set
    gone: set
    least: int
    exact: int | None


def same() -> Edit:
    return Edit([(0, OPEN, None)], {}, set(), set(), 0, None)


def constant(entities: list) -> Edit:
    """What makes this list of any."""
    return Edit([(0, 1, e) for e in entities], {}, set(), set(), 0, None)


def _cut(pieces: list[tuple[int, int, Any]], ends: list[int], at: int) -> tuple[int, int]:
    """The piece in which place `at` is, and how far into it; the number of pieces if it is behind the last."""
    k = bisect_right(ends, at)
    return k, at - (ends[k - 1] if k else 0)


class Broken(Exception):
    """A change that does not fit."""


class _Asked:
    """What is asked of the old list, and entities that are known to have left it."""

    def __init__(self, edit: Edit) -> None:
        self.pieces, self.places, self.absent, self.gone = list(edit.pieces), dict(edit.places), set(edit.absent), set(edit.gone)
        self.least, self.exact = edit.least, edit.exact
        self.new = {e for _, _, e in self.pieces if e is not None}

    def ends(self) -> list[int]:
        return list(accumulate(b - a for a, b, _ in self.pieces))

    def place(self, at: int, entity: Any) -> None:
        """The old list has the entity there."""
        if self.places.setdefault(at, entity) != entity or entity in self.absent or (self.exact is not None and at >= self.exact):
            raise Broken
        self.least = max(self.least, at + 1)

    def long(self, at: int) -> None:
        self.least = max(self.least, at)
        if self.exact is not None and self.least > self.exact:
            raise Broken

    def missing(self, entity: Any) -> None:
        """The entity is not in the list as it is now."""
        if entity in self.new:
            raise Broken
        if entity not in self.gone:
            if entity in self.places.values():
                raise Broken
            self.absent.add(entity)

    def closed(self) -> Edit:
        return Edit(self.pieces, self.places, self.absent, self.gone, self.least, self.exact)


def edit_of(changes: list[tuple]) -> Edit | None:
    """What (kind, entity, index, before, after) in order do; null if they don't fit each other."""
    s = _Asked(same())
    try:
        for kind, entity, index, before, after in changes:
            ends = s.ends()
            i = -1 if index is None else index
            if kind == "inserted" and i >= 0 and entity is not None:
                s.missing(entity)
                k, inside = _cut(s.pieces, ends, i)
                if k == len(s.pieces) and inside:
                    raise Broken
                if inside:
                    a, b, _ = s.pieces[k]
                    s.pieces[k : k + 1] = [(a, a + inside, None), (a + inside, b, None)]
                    k += 1
                # a place within the part that has no known end is there only if the list is long enough
                if k < len(s.pieces) and s.pieces[k][1] == OPEN:
                    s.long(s.pieces[k][0])
                s.pieces.insert(k, (0, 1, entity))
                s.new.add(entity)
            elif kind == "removed" and i >= 0 and entity is not None:
                k, inside = _cut(s.pieces, ends, i)
                if k == len(s.pieces):
                    raise Broken
                a, b, e = s.pieces[k]
                if e is None:
                    s.place(a + inside, entity)
                    s.pieces[k : k + 1] = [p for p in ((a, a + inside, None), (a + inside + 1, b, None)) if p[0] < p[1]]
                    s.gone.add(entity)
                else:
                    if e != entity:
                        raise Broken
                    s.pieces.pop(k)
                    s.new.discard(entity)
                    s.gone.add(entity)
            elif kind == "ordered" and before is not None and after is not None and sorted(before) == sorted(after):
                _fixed(s, before)
                s.pieces = [(0, 1, e) for e in after]
                s.new = set(after)
            else:
                raise Broken
    except Broken:
        return None
    return s.closed()


def _fixed(s: _Asked, entities: list) -> None:
    """The list as it is now is `entities`: the places of the old one that are left get known, and its length."""
    at = 0
    for a, b, e in s.pieces:
        if e is not None:
            if at >= len(entities) or entities[at] != e:
                raise Broken
            at += 1
            continue
        n = len(entities) - at if b == OPEN else b - a
        if n < 0 or at + n > len(entities):
            raise Broken
        for j in range(n):
            s.place(a + j, entities[at + j])
            s.gone.add(entities[at + j])
        if b == OPEN:
            if (s.exact is not None and s.exact != a + n) or s.least > a + n:
                raise Broken
            s.exact = a + n
        at += n
    if at != len(entities) or len(set(entities)) != at:
        raise Broken


def composed(first: Edit, then: Edit) -> Edit | None:
    """One edit that does what the two do, one after the other; null if the second does not fit what the first gives. Associative."""
    s = _Asked(first)
    ends = s.ends()
    total = ends[-1] if ends else 0
    open_ = bool(s.pieces) and s.pieces[-1][1] == OPEN
    try:
        for at, entity in then.places.items():
            k, inside = _cut(s.pieces, ends, at)
            if k == len(s.pieces):
                raise Broken
            a, _, e = s.pieces[k]
            if e is None:
                s.place(a + inside, entity)
            elif e != entity:
                raise Broken
        if open_:
            a = s.pieces[-1][0]
            before = ends[-2] if len(ends) > 1 else 0
            if then.least > before:
                s.long(a + then.least - before)
            if then.exact is not None:
                n = a + then.exact - before
                if n < a or n < s.least or (s.exact is not None and s.exact != n):
                    raise Broken
                s.exact = n
        elif then.least > total or (then.exact is not None and then.exact != total):
            raise Broken
        for entity in then.absent:
            s.missing(entity)
    except Broken:
        return None
    out: list[tuple[int, int, Any]] = []
    for a, b, e in then.pieces:
        if e is not None:
            out.append((0, 1, e))
            continue
        k, inside = _cut(s.pieces, ends, a)
        left = b - a
        while left > 0 and k < len(s.pieces):
            p, q, old = s.pieces[k]
            n = OPEN if q == OPEN and b == OPEN else min(left, q - p - inside)
            out.append((0, 1, old) if old is not None else (p + inside, OPEN if n == OPEN else p + inside + n, None))
            left, inside, k = left - n, 0, k + 1
    s.gone |= then.gone
    return Edit(out, s.places, s.absent, s.gone, s.least, s.exact)


#: What a row of an edit says: its head (least and exact length; no least if the edit is broken), a piece, an entity that comes in and must not be there, ...
HEAD, PIECE, NEW, PLACE, ABSENT, GONE = range(6)


def _rows(edit: Edit | None) -> Iterator[tuple]:
    """An edit as rows (kind, a, b, entity), its head first: a worker never holds more of them than a batch, however large edits are."""
    if edit is None:
        yield HEAD, None, None, None
        return
    yield HEAD, edit.least, edit.exact, None
    absent = set(edit.absent)
    for a, b, e in edit.pieces:
        if e is not None and e in absent:
            absent.discard(e)
            yield NEW, None, None, e
        else:
            yield PIECE, a, b, e
    yield from ((PLACE, at, None, e) for at, e in edit.places.items())
    yield from ((ABSENT, None, None, e) for e in absent)
    yield from ((GONE, None, None, e) for e in edit.gone)


def _edit(rows: Iterable[tuple]) -> Edit | None:
    pieces, places, absent, gone, least, exact = [], {}, set(), set(), None, None
    for kind, a, b, e in rows:
        if kind == HEAD:
            least, exact = a, b
        elif kind == PIECE:
            pieces.append((a, b, e))
        elif kind == NEW:
            pieces.append((0, 1, e))
            absent.add(e)
        elif kind == PLACE:
            places[a] = e
        else:
            (absent if kind == ABSENT else gone).add(e)
    return None if least is None else Edit(pieces, places, absent, gone, least, exact)


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)) for c in names]
        for at in range(0, b.num_rows, READ):
            yield from zip(*[c.slice(at, READ).to_pylist() for c in columns], strict=True)


def _streamed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: pa.Schema):
    """`rows` as a function from batches to batches of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows(batches)
        while held := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    read = _read(batches, ["project_id", "part", "kind", "entity", "index", "before", "after"])
    for key, changes in groupby(read, key=lambda r: r[:2]):
        for no, row in enumerate(_rows(edit_of([r[2:] for r in changes]))):
            yield (*key, no, *row)


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for key, edits in groupby(_read(batches, ["project_id", "of", "part", "kind", "a", "b", "entity"]), key=lambda r: r[:2]):
        edit: Edit | None = same()
        for _, rows in groupby(edits, key=lambda r: r[2]):
            then = _edit(r[3:] for r in rows)
            edit = composed(edit, then) if edit is not None and then is not None else None
        for no, row in enumerate(_rows(edit)):
            yield (*key, no, *row)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a project are its list (part -1), then the edit of its log, if it has any."""
    for project, both in groupby(_read(batches, ["project_id", "part", "kind", "a", "b", "entity"]), key=lambda r: r[0]):
        start, then = constant([]), same()
        for part, rows in groupby(both, key=lambda r: r[1]):
            if part < 0:
                start = constant([r[5] for r in rows])
            else:
                then = _edit(r[2:] for r in rows)
        edit = composed(start, then) if then is not None else None
        if edit is None:
            yield project, None, None, False
        else:
            yield from ((project, e, i, True) for i, (_, _, e) in enumerate(edit.pieces))


def list_edits(changes: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """One edit for each project, as rows (project_id, part, no, kind, a, b, entity): what its whole log of structural changes does to a list. Its head has no `a` if changes do not fit each other.

    Stretches of the log are worked out side by side, then neighbours compose, `fan` at a time, in as many rounds as the longest log
    asks; tasks hold a stretch, or two edits as large as the stretches that they stand for, and a batch of rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(changes.sparkSession)
    project, entity = changes.schema["project_id"].dataType, changes.schema["entity"].dataType
    long = pa.int64()
    schema = pa.schema([("project_id", to_arrow_type(project)), ("part", long), ("no", long), ("kind", pa.int32()), ("a", long), ("b", long), ("entity", to_arrow_type(entity))])
    ddl = f"project_id {project.simpleString()}, part long, no long, kind int, a long, b long, entity {entity.simpleString()}"
    # numbers within a project, as runs of rows: only the order is needed, and a count of what comes before
    part = F.floor((F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) - 1) / stretch)
    rows = changes.withColumn("part", part).select("project_id", "part", "seq", "kind", "entity", F.col("index").cast("long").alias("index"), "before", "after")
    edits = rows.repartition("project_id", "part").sortWithinPartitions("project_id", "part", "seq").drop("seq").mapInArrow(_streamed(_stretches, schema), ddl)
    longest = changes.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    parts = -(-longest // stretch)
    while parts > 1:
        edits = edits.withColumn("of", F.floor(F.col("part") / fan)).repartition("project_id", "of").sortWithinPartitions("project_id", "of", "part", "no").mapInArrow(_streamed(_folds, schema), ddl)
        parts = -(-parts // fan)
    return edits


def current_order(snapshot: DataFrame, changes: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """project_id, entity and pos (from 0) of a list after its log, and whether the log fits the list (`sound`, for the whole project).

    `snapshot`: project_id, entity, pos; `changes`: project_id, seq, kind (inserted, removed, ordered), entity, index, and `before` and `after`, the
    entities of an ordered list. Changes fit as a list asks: an insert's index is in it and its entity is not, what is removed stands at its
    index, and an order is a permutation of what is there. A change that does not fit breaks the project: it gets one row without an entity.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    project, entity = changes.schema["project_id"].dataType, changes.schema["entity"].dataType
    edits = list_edits(changes, stretch, fan).where(F.col("kind") != GONE)
    start = snapshot.select(F.col("project_id").cast(project).alias("project_id"), F.lit(-1).cast("long").alias("part"), F.col("pos").cast("long").alias("no"), F.lit(PIECE).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), F.col("entity").cast(entity).alias("entity"))
    both = start.unionByName(edits).repartition("project_id").sortWithinPartitions("project_id", "part", "no", "entity")
    schema = pa.schema([("project_id", to_arrow_type(project)), ("entity", to_arrow_type(entity)), ("pos", pa.int32()), ("sound", pa.bool_())])
    return both.mapInArrow(_streamed(_lists, schema), f"project_id {project.simpleString()}, entity {entity.simpleString()}, pos int, sound boolean")
