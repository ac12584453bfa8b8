"""Operator 13: best-fit packing by hierarchical residual packing.

Documents are cut only where they are longer than a sequence: into whole sequences, and a first piece with what is left. Each partition
packs its pieces by best fit, largest first, and emits the bins that are nearly full; the least full ones come apart and go up a tree as
items, where what several partitions left is packed by best fit again, round by round, until one node would be left. What that node would
get, and all bins in between that are neither nearly full nor were handed on, is packed by best fit as one: that asks only how many pieces
of each length there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship, stored
from gaugeworks.llm.tokens import coder, tokenizer_path

#: Length of a sequence, and the id that ends each document.
LENGTH, END = 1024, 2
#: Pieces to a leaf of the tree, about; pieces that are packed at a time in a task, at most; and how many nodes of a round meet in one of the next.
LEAF, ITEMS, FAN = 65_536, 1 << 18, 16
#: A bin is nearly full with no more than so much free. Of the others a node hands on so many, the least full ones; the rest is packed at the end.
SLACK, HELD = 1, 256


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item its bin and its place there, and the size of each bin: largest items first, each into the fullest bin that can take it.

    Bins with the same space free are kept together, and a number with one bit for each space tells which there are.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = there >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                there ^= 1 << space
        else:
            space, b = capacity, len(filled)
            filled.append(0)
        bins[i], places[i] = b, filled[b]
        filled[b] += size
        if left := space - size:
            free[left].append(b)
            there |= 1 << left
    return bins, places, np.array(filled, np.int64)


def best_fit_by_length(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """best_fit() of so many items of each size, without the items: for each size runs of (first item, first bin, items to a bin, place of a bin's first).

    Bins with the same space free are filled one after the other, as the fullest that can take an item still is after it; so stretches
    of them are filled at once. A size leaves at most four stretches more, whatever the counts.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    there, made, out = 0, 0, {}

    def left(space: int, first: int, n: int) -> None:
        nonlocal there
        if space and n:
            free[space].append((first, n))
            there |= 1 << space

    for size in sorted(counts, reverse=True):
        item, runs = 0, []
        while item < counts[size]:
            fits = there >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                first, n = free[space].pop()
                if not free[space]:
                    there ^= 1 << space
            else:
                space, first, n = capacity, made, -(-(counts[size] - item) // (capacity // size))
                made += n
            each = space // size
            runs.append((item, first, each, capacity - space))
            whole, some = divmod(min(counts[size] - item, n * each), each)
            left(space - each * size, first, whole)
            if some:
                left(space - some * size, first + whole, 1)
            left(space, first + whole + (some > 0), n - whole - (some > 0))
            item += whole * each + some
        out[size] = runs
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end: int):
    """The pieces of each document."""
    kinds = [pa.int32() if x.endswith("int") else pa.int64() for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(code.ids(text.as_py()), np.uint32(end)).astype("<u4")
                n, start, k = len(ids), 0, 0
                length = n % capacity or capacity
                while start < n:
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), n))
                    start, length, k = start + length, capacity, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


#: What becomes of a bin: it is a sequence, it comes apart for the next round, or for the end.
EMITTED, ON, REST = 0, 1, 2


def _packed(level: int, capacity: int, slack: int, held: int, most: int):
    """Packs the pieces of a node, at most `most` at a time, and adds their bin, the place there and what becomes of the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = level << 58 | TaskContext.get().partitionId() << 34

        def closed(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            table = pa.Table.from_batches(pieces).combine_chunks()
            bins, places, filled = best_fit(table.column("length").to_numpy(), capacity)
            what = np.full(len(filled), REST, np.int32)
            what[np.argsort(filled, kind="stable")[:held]] = ON
            what[filled >= capacity - slack] = EMITTED
            for name, values in (("sequence_id", bins + first), ("offset", places), ("what", what[bins])):
                table = table.append_column(name, pa.array(values))
            first += len(filled)
            yield from table.to_batches(1 << 16)

        pieces: list[pa.RecordBatch] = []
        left = most
        for b in batches:
            while b.num_rows:
                pieces.append(b.slice(0, left))
                b = b.slice(left)
                left -= pieces[-1].num_rows
                if not left:
                    yield from closed(pieces)
                    pieces, left = [], most
        if pieces:
            yield from closed(pieces)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task, and the number of a piece among those of its length there."""
    task, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for b in batches:
        lengths = b.column(b.schema.get_field_index("length")).to_numpy()
        if not len(lengths):
            continue
        seen = np.pad(seen, (0, max(0, int(lengths.max()) + 1 - len(seen))))
        order = np.argsort(lengths, kind="stable")
        of, start, n = np.unique(lengths[order], return_index=True, return_counts=True)
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(start - seen[of], n)
        seen[of] += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), task, np.int64)), pa.array(nth)], names=[*b.schema.names, "task", "nth"])


def _placed(runs: dict[int, list[tuple[int, int, int, int]]], first: int):
    """Looks up the bin and the place of the pieces, which come with their number among all of their length (`nth`)."""
    tables = {size: np.array(of, np.int64).T for size, of in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            lengths, nth = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            bins, places = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            order = np.argsort(lengths, kind="stable")
            of, start = np.unique(lengths[order], return_index=True)
            for size, at in zip(of.tolist(), np.split(order, start[1:]), strict=True):
                items, firsts, each, place = tables[size]
                k = np.searchsorted(items, nth[at], side="right") - 1
                inside = nth[at] - items[k]
                bins[at], places[at] = first + firsts[k] + inside // each[k], place[k] + inside % each[k] * size
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(bins), pa.array(places)], names=[*names, "sequence_id", "offset"])

    return run


def _as_one(pieces: DataFrame, level: int, capacity: int) -> DataFrame:
    """All pieces packed by best fit at once. The driver gets a count for each length, so no more than `capacity` of them; pieces are numbered where they are."""
    numbered = stored(pieces.mapInArrow(_numbered, f"{PIECES}, task long, nth long"), "numbered")
    counts = stored(numbered.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    runs = best_fit_by_length({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    all_ = numbered.join(before, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task")
    return all_.mapInArrow(_placed(runs, level << 58), f"{PIECES}, sequence_id long, offset long")


def best_fit_packed(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, end: int = END, leaf: int = LEAF, fan: int = FAN, slack: int = SLACK, held: int = HELD, most: int = ITEMS) -> DataFrame:
    """The pieces of which sequences of at most `capacity` tokens consist; only documents of more tokens are cut.

    A document is its ids and id `end`; null and empty texts are that id alone. Rows with a null or repeated doc_id are documents of
    their own. An empty table gives no pieces. sequence_id tells sequences apart, nothing else; offset is a piece's place in its sequence.

    Leaves hold about `leaf` pieces, dealt evenly whatever their documents. A node hands on `held` bins for each `most` pieces at most, so a node of
    any round takes bins of `fan` others: no task grows with the input. Bins beyond `held` that are not nearly full come apart too: with what is left
    for the last node, their pieces are packed by best fit as one, so none of them is kept from any other. Texts are never shuffled, only their pieces' numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    left = stored(read.mapInArrow(_pieces(path or tokenizer_path(), capacity, end), PIECES), "pieces")
    nodes, level, rounds = max(1, -(-left.count() // leaf)), 0, []
    rest = []
    while nodes > 1:
        packer = _packed(level, capacity, slack, held, most)
        done = stored(left.repartition(nodes).mapInArrow(packer, f"{PIECES}, sequence_id long, offset long, what int"), "packed")
        rounds.append(done.where(F.col("what") == EMITTED).drop("what"))
        apart = lambda what, done=done: done.where(F.col("what") == what).drop("sequence_id", "offset", "what")
        left = apart(ON)
        rest.append(apart(REST))
        nodes, level = -(-nodes // fan), level + 1
    for more in rest:
        left = left.unionByName(more)
    out = _as_one(left, level, capacity)
    for more in rounds:
        out = out.unionByName(more)
    return out
