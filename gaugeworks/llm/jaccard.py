"""Operator 6: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct word shingles (lower-cased A-Z, words are runs of non-blanks). Two
documents link when ``den * |A & B| >= num * |A | B|``. The join has two T-occurrence searches:

1. Over coarse inverted lists, to find which documents need comparing at all. Documents of one size
   class cut the hash range of shingles into k parts; linked sets differ in at most D shingles, so they agree
   in k - D parts at least, and in T of the D + T fullest. A document posts a digest of each of those
   parts. Short lists are merged: a pair is kept when it occurs T times, or when long lists can make
   up what it lacks. Long lists are not expanded into pairs: a document in m of them ties itself to all but the
   T - 1 longest, as two documents with T long lists in common share one of those. No linked pair is lost.
2. What the kept pairs and ties connect forms a bundle. Within it, inverted lists of all shingles are
   searched with DivideSkip: for each document the short lists are merged, the longest ones probed by binary search,
   and documents that reach the required overlap are united. Large bundles are dealt out as pairs of
   blocks of one size class, or of two neighbouring ones; other sizes cannot link.

Equal sets are one class from the start, so groups of copies cost no more than one document. Results:
one row per document; null or blank text has an empty set and links with nothing; so does a row
without doc_id, whose component_id is null. Repeated doc_ids are one node. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import lists, mix64, ship, stored, text_slices
from gaugeworks.llm.components import connected_components
from gaugeworks.llm.shingles import shingle_sets

#: Lists of up to so many sets are expanded into pairs; longer ones are tied to their first set.
SHORT = 32
#: Sets of a bundle that one task compares with as many others.
BLOCK = 16384
#: Shingles of a block; what a task holds is bounded by twice this, or by its longest two texts.
SHINGLES = 1_000_000
#: Shingles whose postings share a bucket; a posting stands for four shingles and more.
SHINGLES_OF_BUCKET = 2_000_000
#: Occurrences that pairs need, but for small sets.
NEED = 4
#: DivideSkip's tuning constant.
MU = 0.01


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def size_class(n: int, num: int, den: int) -> int:
    """Class of sets of n >= 1 shingles; sets that can link are in the same or in neighbouring classes."""
    return int(math.log(n) / math.log(den / num) + 1e-9)


def parts_of(p: int, num: int, den: int) -> tuple[int, int, int]:
    """(parts, posted parts, occurrences required) for pairs whose smaller set is in class p; no parts: only equal sets link."""
    most = int((den / num) ** (p + 1)) + 1
    differ = (den - num) * (most + most * den // num) // (den + num)
    if not differ:
        return 0, 0, 0
    need = NEED if most >= 40 else 1
    posted = differ + need
    return -(-5 * posted // 4), posted, need


def postings(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Digests of the fullest parts of a set, for both roles that it can play in a pair.

    A digest's lowest bit tells the two roles apart, the next one is set if pairs need more than one occurrence.
    """
    out = []
    c = size_class(len(s), num, den)
    for p in (c, c - 1):
        k, posted, need = parts_of(p, num, den) if p >= 0 else (0, 0, 0)
        if not k:
            continue
        part = (s % np.uint64(k)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=k)
        content = np.zeros(k, np.uint64)
        full = np.flatnonzero(count)
        begin = np.cumsum(count) - count
        content[full] = np.add.reduceat(mix64(s[order]), begin[full])
        content = mix64(content + np.uint64(0xD1B54A32D192ED03) * (np.arange(k, dtype=np.uint64) + np.uint64(p << 32)))
        keep = np.lexsort((content, count))[k - posted :]
        out.append((content[keep] & ~np.uint64(3)) | np.uint64(p % 2 + 2 * (need > 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys = [], []
            for _, raw, off in text_slices(b.column(1)):
                for s in shingle_sets(raw, off, width):
                    n.append(len(s))
                    keys.append(_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "key"])

    return run


def _posted(width: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, owners, seen, held = [], [], set(), 0
            slices = list(text_slices(b.column(0)))
            for i, (_, raw, off) in enumerate(slices):
                for s in shingle_sets(raw, off, width):
                    if not len(s):
                        continue
                    me = int.from_bytes(_key(s)[:8], "little")
                    if me in seen:
                        continue
                    seen.add(me)
                    digests.append(postings(s, num, den))
                    owners.append(np.full(len(digests[-1]), me, np.uint64))
                    held += len(digests[-1])
                if held > 4_000_000 or i == len(slices) - 1 and held:
                    d, o = np.concatenate(digests), np.concatenate(owners)
                    at = (d % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(at, kind="stable")
                    pair = np.stack([d[order], o[order]], 1)
                    ends = np.cumsum(np.bincount(at, minlength=buckets))
                    used = np.flatnonzero(np.diff(ends, prepend=0))
                    begin = ends - np.diff(ends, prepend=0)
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pair[begin[x] : ends[x]].tobytes() for x in used], pa.binary())], ["bucket", "packed"])
                    digests, owners, held = [], [], 0

    return run


def _merged(short: int):
    """Of the lists in a bucket: pairs (a, b) from short lists with n occurrences (4 where one is enough); of long ones, member a, digest b and n, their negative length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = np.frombuffer(b"".join(pdf["packed"]), np.uint64).reshape(-1, 2)
        d, o = pair[:, 0], pair[:, 1]
        order = np.lexsort((o, d))
        d, o = d[order], o[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
        d, o = d[new], o[new]
        begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        length = np.diff(begin, append=len(d))
        size, head = np.repeat(length, length), np.repeat(begin, length)
        a, b, n = [], [], []
        few = size <= short
        for step in range(1, short):
            hit = np.flatnonzero(few[:-step] & (head[:-step] == head[step:])) if step < len(d) else []
            if not len(hit):
                break
            a.append(o[hit])
            b.append(o[hit + step])
            n.append(np.where(d[hit] & np.uint64(2), 1, NEED))
        long_ = np.flatnonzero(~few)
        a.append(o[long_])
        b.append(d[long_])
        n.append(-size[long_])
        out = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64), "n": np.concatenate(n).astype(np.int64), "long": np.concatenate(n) < 0})
        return out.groupby(["a", "b", "long"], as_index=False).agg(n=("n", "sum"))[["a", "b", "n"]]

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int, queries: range | None = None, mu: float = MU) -> np.ndarray:
    """For each set a root: equal roots for sets that links join. If there are `queries`, these are compared with the other sets only.

    Links between sets that are already united are not looked up again.
    """
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    token = np.concatenate(sets)[order]
    owner = np.repeat(np.arange(m), sizes)[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(begin, append=len(token))
    which = np.empty(len(token), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), length)
    mine = np.concatenate([[0], np.cumsum(sizes)])
    spread = mu * math.log2(max(2, int(length.max()))) + 1
    for q in queries if queries is not None else range(m):
        need = -(-num * (sizes[q] + sizes) // (num + den))
        open_ = (root != root[q]) & (need <= np.minimum(sizes[q], sizes))
        if queries is None:
            open_[:q] = False
        else:
            open_[queries.start : queries.stop] = False
        if not open_.any():
            continue
        ls = which[mine[q] : mine[q + 1]]
        ls = ls[np.argsort(length[ls], kind="stable")]
        least = int(need[open_].min())
        n_long = min(int(least / spread), least - 1, len(ls))
        near, far = ls[: len(ls) - n_long], ls[len(ls) - n_long :]
        lens = length[near]
        at = np.repeat(begin[near] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        count = np.bincount(owner[at], minlength=m)
        cand = np.flatnonzero(open_ & (count + n_long >= need))
        for x in far:
            if not len(cand):
                break
            members = owner[begin[x] : begin[x] + length[x]]
            place = np.searchsorted(members, cand)
            count[cand] += members[np.minimum(place, len(members) - 1)] == cand
        for c in cand[count[cand] >= need[cand]]:
            if root[c] != root[q]:
                low, high = sorted((root[c], root[q]))
                root[root == high] = low
    return root


def _compared(width: int, num: int, den: int):
    """Of a block, or a pair of blocks, of a bundle: each set's key with the key that it is united with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, tuple[np.ndarray, int]] = {}
        column = pa.array(pdf["text"], pa.large_string())
        wanted, side = pdf["member"].to_numpy(), pdf["side"].to_numpy()
        for first, raw, off in text_slices(column):
            for i, s in enumerate(shingle_sets(raw, off, width)):
                if len(s) and int.from_bytes((k := _key(s))[:8], "little", signed=True) == wanted[first + i]:
                    found.setdefault(k, (s, side[first + i]))
        keys = sorted(found, key=lambda k: (found[k][1], k))
        sets = [found[k][0] for k in keys]
        left = sum(found[k][1] == 0 for k in keys)
        root = divide_skip(sets, num, den, range(left) if 0 < left < len(keys) else None)
        hit = np.flatnonzero(root != np.arange(len(keys)))
        return pd.DataFrame({"a": [keys[root[i]] for i in hit], "b": [keys[i] for i in hit]}, columns=["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, short: int = SHORT, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) of every row of `docs`."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(text.mapInArrow(_sets(width), "doc_id long, n_shingles long, key binary"), "sets")

    # so that what a bucket holds stays within bounds as the texts grow
    held = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(lists(spark), -(-held // SHINGLES_OF_BUCKET))
    posted = text.select("text").mapInArrow(_posted(width, num, den, buckets), "bucket int, packed binary")
    merged = stored(posted.groupBy("bucket").applyInPandas(_merged(short), "a long, b long, n long"), "merged")
    pairs = merged.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # of its long lists, each document in each role: how many there are, and which come first
    role = Window.partitionBy("a", F.expr("b & 1"))
    long_ = merged.where("n < 0").select("a", "b", F.count("*").over(role).alias("of"), F.row_number().over(role.orderBy(F.desc("n"), "b")).alias("at"))
    ties = long_.where(F.col("at") <= F.col("of") - F.when(F.expr("b & 2 <> 0"), NEED - 1).otherwise(0)).select("a", "b")
    lists_of = long_.groupBy("a").agg(F.max("of").alias("of"))
    more = lists_of.select("a", F.col("of").alias("of_a"))
    lacking = pairs.where(F.col("n") < NEED).join(more, "a").join(lists_of.select(F.col("a").alias("b"), F.col("of").alias("of_b")), "b")
    made_up = lacking.where(F.col("n") + F.least("of_a", "of_b") >= NEED).select("a", "b")
    bundles = connected_components(pairs.where(F.col("n") >= NEED).select("a", "b").union(made_up).union(ties))

    # the first eight bytes of the key, as the tasks read them: little-endian and signed
    member = F.conv(F.concat(*[F.substring(F.hex("key"), 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("long")
    classes = sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")).withColumn("member", member)
    chosen = stored(classes.join(bundles, classes["member"] == bundles["node"]).select("rep", "member", "key", "n", "root"), "chosen")
    blocks = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / shingles)).cast("int")
    size = chosen.groupBy("root").agg(blocks().alias("blocks"), F.count("*").alias("sets")).where("sets > 1")
    chosen = chosen.join(size, "root")
    # a bundle of one block is one group (class -1); others have blocks for each size class
    kind = F.when(F.col("blocks") == 1, -1).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9) if num < den else F.col("n")).cast("long")
    chosen = chosen.select("rep", "member", "key", "n", "root", kind.alias("p"))
    each = chosen.groupBy("root", "p").agg(blocks().alias("blocks"))
    near = [each.select("root", (F.col("p") + F.lit(by)).alias("p"), F.col("blocks").alias(name)) for by, name in ((-1, "above"), (1, "below"))]
    each = each.join(near[0].where("p >= 0"), ["root", "p"], "left").join(near[1].where("p > 0"), ["root", "p"], "left")
    chosen = chosen.join(each, ["root", "p"]).withColumn("mine", F.expr("pmod(xxhash64(key), blocks)").cast("int"))
    rows = text.where("doc_id is not null").join(chosen, text["doc_id"] == chosen["rep"])
    # block i meets block j, i <= j, of its class (2 p), and each block of the class above (2 p + 1)
    deal = """concat(
        transform(sequence(0, blocks - 1), x -> named_struct('c', 2 * p, 'i', least(mine, x), 'j', greatest(mine, x), 'side', if(mine <= x, 0, 1))),
        transform(sequence(0, coalesce(above, 0)), x -> if(x < above, named_struct('c', 2 * p + 1, 'i', mine, 'j', x, 'side', 0), null)),
        transform(sequence(0, coalesce(below, 0)), x -> if(x < below, named_struct('c', 2 * p - 1, 'i', x, 'j', mine, 'side', 1), null)))"""
    dealt = rows.select("text", "member", "root", F.explode(F.filter(F.expr(deal), lambda x: x.isNotNull())).alias("d")).select("text", "member", "root", "d.*")
    links = stored(dealt.groupBy("root", "c", "i", "j").applyInPandas(_compared(width, num, den), "a binary, b binary"), "united")
    united = connected_components(links)

    rep = classes.select("key", "rep")
    end = united.join(rep, united["node"] == rep["key"]).groupBy("root").agg(F.min("rep").alias("low"))
    placed = united.join(end, "root").select(F.col("node").alias("key"), "low")
    # of classes that have one document and no link, the document is its own component: only the others are looked up, rows without a set not at all.
    # Written, so that the rows of a large class can be split over tasks
    copied = classes.where("copies > 1").select("key", "rep")
    reps = copied.join(placed, "key", "full").select("key", F.coalesce("low", "rep").alias("component_id"))
    reps = stored(reps, "components")
    linked = sets.where("key is not null and doc_id is not null").join(reps, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.union(sets.where("key is null or doc_id is null").select("doc_id", "n_shingles", "doc_id"))
