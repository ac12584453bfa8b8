"""Operators 1 and 5: training-order shards of token ids, and packing by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import mix64, ship, stored

#: Length of a sequence and of a full window.
LENGTH = 1024
#: Remainders are cut into pieces of so many tokens at most, so that differencing has small parts to balance with.
PIECE = 128
#: Windows that are balanced together, and the share of them that is filled.
WINDOWS, FILL = 32, 0.995
#: Buckets that texts are dealt to, at most, and about how many rows are in one.
BUCKETS, ROWS = 65_536, 4096
_CODERS: dict[str, Coder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Coder:
    """Ids of texts by a byte-level BPE file.

    Texts of common characters go through a second, faster coder of the same ranks; those with the file's
    special strings, or with characters whose classes two regex engines could see differently, through the file's own.
    """

    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bpe", pat_str=self._SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join(["[^\t\n\r\x20-\x7e¡-ſ]", *map(re.escape, sorted(special))]))

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.odd.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32)


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k groups of the indices of `sizes` with nearly equal sums.

    The two partial partitions of the largest imbalance are merged, the fullest group of one with the emptiest of the other.
    """
    heap: list = []
    for i, s in enumerate(sizes):
        heapq.heappush(heap, (-s, i, [(s, [i])]))
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # groups are in falling order; those not listed are empty
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            if len(a) < len(b):
                a, b = b, a
            gap = k - len(a)
            merged = a + b[:gap]
            for j, (s, m) in enumerate(b[gap:]):
                t, n = merged[len(a) - 1 - j]
                merged[len(a) - 1 - j] = (t + s, n + m)
        merged.sort(key=lambda g: -g[0])
        if len(merged) == k and merged[-1][0] > 0:
            low = merged[-1][0]
            merged = [(s - low, m) for s, m in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), tick, merged))
        tick += 1
    groups = [m for _, m in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing manages: their count rises while one is over it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = [g for g in differencing(sizes, k) if g]
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return groups
        k += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def _packer(path: str, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held: list[tuple] = []
        held_tokens = 0
        goal = int(WINDOWS * capacity * FILL)

        def close() -> None:
            nonlocal sequence, held, held_tokens
            for g in balanced([h[2] for h in held], capacity):
                at, total = 0, sum(held[i][2] for i in g)
                padded = total if total & (total - 1) == 0 else capacity
                for i in g:
                    rows.append((*held[i], sequence, at, padded))
                    at += held[i][2]
                sequence += 1
            held, held_tokens = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(code.ids(text.as_py()), np.uint32(0)).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    if n - start >= capacity:
                        length = capacity
                        rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, 0, capacity))
                        sequence += 1
                    else:
                        length = min(piece, n - start, goal - held_tokens)
                        held.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n))
                        held_tokens += length
                        if held_tokens >= goal:
                            close()
                    start += length
                if len(rows) >= 20_000:
                    yield flush()
        close()
        yield flush()

    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """The pieces of which sequences of at most `capacity` tokens consist; every id of every document lies in one piece.

    A document is its ids and id 0; null and empty texts are id 0 alone. Stretches of `capacity` ids are sequences of their own.
    What is left is cut into pieces and balanced over WINDOWS windows at a time, within a task: no shuffle, no group that grows.
    A sequence whose length is a power of two is not padded. Rows with a null or repeated doc_id are packed as they come. An
    empty table gives no pieces.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packer(path or tokenizer_path(), capacity, piece), PIECES)


def id_type(path: str) -> np.dtype:
    """What a token id is stored as: two bytes, or four where the vocabulary is larger."""
    return np.dtype("<u2" if coder(path).exact.get_vocab_size() <= 1 << 16 else "<u4")


def _streamed(path: str, kind: np.dtype):
    """Of each row its bucket, digest, doc_id and ids, which end in id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        names = ["bucket", "digest", "doc_id", "ids"]
        for b in batches:
            first, held, blobs = 0, 0, []
            for i, text in enumerate(b.column(3)):
                blobs.append(np.append(code.ids(text.as_py()), np.uint32(0)).astype(kind).tobytes())
                held += len(blobs[-1])
                if held > 1 << 20 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(blobs)) for c in range(3)), pa.array(blobs, pa.binary())], names)
                    first, held, blobs = i + 1, 0, []

    return run


def _sequences(length: int, kind: np.dtype):
    """Sequences of each bucket's stream of ids; the rows of a bucket come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = length * kind.itemsize
        bucket, local, rest = None, 0, b""
        rows: list[tuple[int, int, int, bytes]] = []

        def cut(data: bytes, last: bool) -> bytes:
            nonlocal local
            for at in range(0, len(data), stride):
                piece = data[at : at + stride]
                if len(piece) < stride and not last:
                    return piece
                rows.append((bucket, local, len(piece) // kind.itemsize, piece.ljust(stride, b"\0")))
                local += 1
            return b""

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "local", "n_tokens", "ids"])

        for b in batches:
            for of, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if of != bucket:
                    cut(rest, True)
                    bucket, local, rest = of, 0, b""
                rest = cut(rest + ids.as_py(), False)
                if len(rows) >= 1024:
                    yield flush()
        cut(rest, True)
        yield flush()

    return run


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked until it is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _slots(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                slot = feistel(b.column(0).to_numpy(), b.column(1)[0].as_py(), key)
                yield pa.RecordBatch.from_arrays([pa.array(slot), b.column(2), b.column(3)], ["slot", "n_tokens", "ids"])

    return run


SHARDS = "shard long, first_slot long, n_sequences long, length long, stride_bytes long, n_tokens long, payload_crc32 long, payload binary"


def _shards(length: int, per_shard: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: list[int] = []
        tokens, blobs = 0, []

        def close() -> pa.RecordBatch:
            nonlocal slots, tokens, blobs
            if slots != list(range(slots[0], slots[0] + len(slots))):
                raise ValueError(f"slots of shard {slots[0] // per_shard} are not in sequence")
            payload = b"".join(blobs)
            row = (slots[0] // per_shard, slots[0], len(slots), length, stride, tokens, zlib.crc32(payload), payload)
            slots, tokens, blobs = [], 0, []
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], [x.split()[0] for x in SHARDS.split(", ")])

        for b in batches:
            for slot, n, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if slots and slot // per_shard != slots[0] // per_shard:
                    yield close()
                slots.append(slot)
                tokens += n
                blobs.append(ids)
        if slots:
            yield close()

    return run


def streams(docs: DataFrame, rows: int) -> DataFrame:
    """bucket, digest, doc_id, text: in what order texts are read, whatever the splits of the input.

    A row's digest deals it to one of at most BUCKETS buckets, about `rows` to each; within one, digests and doc_ids give the order.
    """
    text = F.col("text").cast("string")
    digest = F.xxhash64(F.col("doc_id").cast("long"), text)
    n = min(BUCKETS, max(1, docs.count() // rows))
    return docs.select(F.pmod(digest, F.lit(n)).cast("int").alias("bucket"), digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def training_shards(docs: DataFrame, key: int = 20240607, path: str | None = None, length: int = LENGTH, per_shard: int = 1024, rows: int = ROWS) -> DataFrame:
    """Shards of token ids in training order: one row each, sequence s of a shard at byte s * stride_bytes of its payload.

    Each text is its ids and id 0 (null and empty texts are that id alone). Texts are read bucket by bucket, see streams(), and a
    bucket's stream is cut into sequences; its last one is filled up with id 0, and n_tokens tells how many ids count. Sequences are
    numbered densely by bucket and place, and a keyed Feistel permutation with cycle-walking gives each number its slot. Shards are
    range partitions of the slots. Ids take two bytes, or four where the vocabulary is larger. The same rows give the same shards,
    however they are split. An empty table gives none; repeated rows and null doc_ids are texts like others.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()
    kind = id_type(path)
    read = streams(docs, rows).mapInArrow(_streamed(path, kind), "bucket int, digest long, doc_id long, ids binary")
    ordered = read.repartition("bucket").sortWithinPartitions("bucket", "digest", "doc_id").select("bucket", "ids")
    made = stored(ordered.mapInArrow(_sequences(length, kind), "bucket int, local long, n_tokens int, ids binary"), "sequences")
    # BUCKETS rows at most
    parts = made.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = parts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    placed = made.join(F.broadcast(parts), "bucket").select((F.col("base") + F.col("local")).alias("index"), "all", "n_tokens", "ids")
    slots = placed.mapInArrow(_slots(key), "slot long, n_tokens int, ids binary").withColumn("shard", F.expr(f"slot div {per_shard}"))
    dealt = slots.repartitionByRange("shard").sortWithinPartitions("slot").select("slot", "n_tokens", "ids")
    return dealt.mapInArrow(_shards(length, per_shard, length * kind.itemsize), SHARDS)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes training_shards() to `path`, one row for each shard."""
    training_shards(docs, **options).write.parquet(path)


def write_files(shards: DataFrame, path: str) -> None:
    """Writes the payload of each shard as a file of its own, `path`/shard=N/part-*: sequence s at byte s * stride_bytes.

    A reader seeks to where it left off. The writer ends each file with one more byte, a newline.
    """
    shards.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").text(path)


def sequences_from(shards: DataFrame, first_slot: int = 0) -> DataFrame:
    """slot and ids (bytes) of the sequences from a slot on: where a run was interrupted, reading goes on. Earlier shards are not read."""
    left = shards.where(F.col("first_slot") + F.col("n_sequences") > first_slot)
    at = left.withColumn("s", F.explode(F.expr(f"sequence(greatest(0, {int(first_slot)} - first_slot), n_sequences - 1)")))
    return at.select((F.col("first_slot") + F.col("s")).alias("slot"), F.expr("substring(payload, cast(s * stride_bytes as int) + 1, cast(stride_bytes as int))").alias("ids"))
