"""Operator 2: near-duplicate embeddings by product quantisation: coarse inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship, stored
from gaugeworks.llm.components import connected_components

#: Bound of the sample that centroids are fitted on. Every vector is indexed.
SAMPLE = 65_536
#: And in bytes, but for 2048 vectors at least.
SAMPLE_BYTES = 256 << 20
#: Vectors of a list, and sampled vectors for each centroid (lists are at most a sixteenth of SAMPLE).
PER_LIST, PER_CENTROID = 128, 40
#: How far a vector looks beyond its own list, in standard deviations of the way to a partner at the least cosine, along the line between the
#: two lists' centroids. The deviations come from the data: from how the members of the two lists lie along that line.
REACH = 3.2
#: A list with fewer sampled members has no deviation of its own.
MEMBERS = 8
#: Subspaces, and centroids of each.
SUBSPACES, CODES = 8, 64
#: Vectors of a block of lists, the most and the least; one task compares two blocks.
BLOCK, LEAST_BLOCK = 16_384, 2048
#: Vectors that look into a list together.
ASKING = 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre, 1)[:, 0]
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, the nearest first."""
    out = np.empty((len(x), n), np.int64)
    half = (centre**2).sum(1) / 2
    for i in range(0, len(x), 1024):
        d = half - x[i : i + 1024] @ centre.T
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centre) else np.argsort(d, axis=1)[:, :n]
        out[i : i + 1024] = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
    return out


class Index:
    """Coarse centroids and, for residuals, a codebook for each subspace."""

    def __init__(self, sample: np.ndarray, n_lists: int, subspaces: int, codes: int, reach: float | None = None) -> None:
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, n_lists)
        own = nearest(sample, self.coarse, 1)[:, 0]
        rest = sample - self.coarse[own]
        apart = np.sqrt(np.maximum(self._squares(self.coarse), 0))
        width = apart if reach is None else np.minimum(apart, reach * self._deviations(rest, own, apart))
        # single floats, rounded up
        self.width = (width * (1 + 1e-6)).astype(np.float32)
        self.cuts = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def _squares(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)[None]

    def _deviations(self, rest: np.ndarray, own: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """[list, list]: deviation of a step of length 1 along the line between the two centroids, times their distance.

        A step from a vector to a partner is taken to lie as residuals lie: those of the first list, of the second, or of all, whichever lie most along the line.
        """
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(len(self.coarse) + 1))
        share, everywhere = np.zeros_like(apart), np.zeros_like(apart)
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            r = rest[order[a:b]]
            if b - a >= MEMBERS and (length := (r**2).sum()) > 0:
                share[k] = ((r @ (self.coarse - self.coarse[k]).T) ** 2).sum(0) / length
        spread = rest.T @ rest
        if (length := np.trace(spread)) > 0:
            c = self.coarse @ spread
            form = (c * self.coarse).sum(1)
            everywhere = np.maximum(form[:, None] - 2 * c @ self.coarse.T + form[None], 0) / length
        return np.sqrt(np.maximum(np.maximum(share, share.T), everywhere))

    def reached(self, x: np.ndarray, own: np.ndarray, radius: float, of: np.ndarray | None = None) -> np.ndarray:
        """[vector, list]: whether the list (all, or those numbered `of`) can hold a partner within the radius.

        Vectors of the list lie beyond the plane midway between its centroid and that of the vector's own list, so by the triangle
        inequality a vector within the radius of one of them is no farther from that plane than the radius: the exact bound. With a
        reach, no farther than so many deviations of a step as long as the radius across that plane.
        """
        of = np.arange(len(self.coarse)) if of is None else of
        c = self.coarse[of]
        d = (c**2).sum(1)[None] - 2 * x @ c.T
        mine = (self.coarse**2).sum(1)[own] - 2 * (x * self.coarse[own]).sum(1)
        return d - mine[:, None] <= 2 * radius * self.width[np.ix_(own, of)] + 1e-9

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each is from what its codes stand for."""
        parts = list(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True))
        code = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for a, b, book in parts], 1).astype(np.uint8)
        error = sum(((rest[:, a:b] - book[code[:, i]]) ** 2).sum(1) for i, (a, b, book) in enumerate(parts))
        return code, np.sqrt(error)

    def distances(self, query: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances of residual queries to what codes stand for, summed from one table for each subspace."""
        out = np.zeros((len(code), len(query)), np.float32)
        for i, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            q = query[:, a:b]
            table = ((book**2).sum(1)[:, None] - 2 * book @ q.T + (q**2).sum(1)[None]).astype(np.float32)
            out += table[code[:, i]]
        return out.T


ROWS = "list long, id long, weight long, code binary, error double, vector binary"
TILED = f"low long, high long, own long, {ROWS}"


def _assigned(shared):
    """Each vector once: its list, code, error of the code, and itself at length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        names = [x.split()[0] for x in ROWS.split(", ")]
        for b in batches:
            ids, weights = b.column(0).to_numpy(), b.column(1).to_numpy()
            flat, off = b.column(2).flatten().to_numpy().astype(np.float64), np.diff(b.column(2).offsets.to_numpy())
            begin = np.cumsum(off) - off
            for dim in np.unique(off):
                at = np.flatnonzero(off == dim)
                x = flat[begin[at][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n = len(at)
                if index is None or dim != index.dim:
                    own, code, error = np.full(n, -int(dim)), None, np.zeros(n)
                else:
                    own = nearest(x, index.coarse, 1)[:, 0]
                    code, error = index.encode(x - index.coarse[own])
                codes = pa.array([c.tobytes() for c in code], pa.binary()) if code is not None else pa.nulls(n, pa.binary())
                columns = [pa.array(own, pa.int64()), pa.array(ids[at], pa.int64()), pa.array(weights[at], pa.int64()), codes, pa.array(error, pa.float64()), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _blocks(sizes: dict[int, int], index: Index, block: int) -> dict[int, tuple[int, int]]:
    """Of each list its first block and in how many its vectors are dealt; near lists share blocks of `block` vectors, longer ones have several."""
    mine = [k for k in sizes if k >= 0]
    zone = nearest(index.coarse, kmeans(index.coarse, max(1, sum(sizes[k] for k in mine) // block)), 1)[:, 0] if mine else []
    out, at, held = {}, 0, 0
    for k in [*sorted(mine, key=lambda k: (zone[k], k)), *sorted(k for k in sizes if k < 0)]:
        if held and (k < 0 or held + sizes[k] > block):
            at, held = at + 1, 0
        parts = -(-sizes[k] // block)
        out[k] = (at, parts)
        at, held = (at + parts, 0) if parts > 1 or k < 0 else (at, held + sizes[k])
    return out


def _tiled(shared, placed: dict[int, tuple[int, int]], radius: float):
    """Each vector for every pair of blocks of which one is its own and the other can hold a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        first = np.array([placed.get(k, (0, 0))[0] for k in range(len(index.coarse))])
        parts = np.array([placed.get(k, (0, 0))[1] for k in range(len(index.coarse))])
        held = np.repeat(np.arange(len(first)), parts)
        block = np.repeat(first, parts) + np.concatenate([np.arange(p) for p in parts])
        holds = np.zeros((len(first), int(block.max()) + 1 if len(block) else 1), np.float32)
        holds[held, block.astype(int)] = 1
        for b in batches:
            lists, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = np.array([placed[k][0] + (i * 0x9E3779B1 >> 16) % placed[k][1] for k, i in zip(lists.tolist(), ids.tolist(), strict=True)], np.int64)
            who, other = [], []
            at = np.flatnonzero(lists >= 0)
            for i in range(0, len(at), 1024):
                part = at[i : i + 1024]
                x = np.frombuffer(b"".join(b.column(5).take(pa.array(part)).to_pylist()), np.float64).reshape(len(part), -1)
                r, c = np.nonzero(index.reached(x, lists[part], radius).astype(np.float32) @ holds)
                who.append(part[r])
                other.append(c)
            for i in np.flatnonzero(lists < 0):
                k, n = placed[int(lists[i])]
                who.append(np.full(n, i))
                other.append(np.arange(k, k + n))
            w, o = (np.concatenate(v).astype(np.int64) for v in (who, other))
            for i in range(0, len(w), 8192):
                v, t = w[i : i + 8192], o[i : i + 8192]
                rows = b.take(pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[v], t)), pa.array(np.maximum(own[v], t)), pa.array(own[v]), *rows.columns], [c.split()[0] for c in TILED.split(", ")])

    return run


def _matched(shared, least: float):
    """Of two blocks, or one with itself: for each vector the weight of those that it links with, and each linked vector's root here.

    A pair of vectors meets in one pair of blocks only, so that it counts once, for both.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index: Index = shared.value
        empty = pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        pdf = pdf.sort_values(["list", "id"], kind="stable")
        place = np.arange(len(pdf))
        own, lists, id_, weight = (pdf[c].to_numpy() for c in ("own", "list", "id", "weight"))
        asking, asked = place[own == low], place[own == high]
        if not len(asking) or not len(asked):
            return empty
        dim = -int(lists[0]) if lists[0] < 0 else index.dim
        x = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(-1, dim)
        radius = math.sqrt(2 - 2 * least)
        # the table sums single floats: 1e-4 is far above their rounding
        bound = (radius + pdf["error"].to_numpy() + 1e-9) ** 2 + 1e-4
        coded = lists[0] >= 0
        if coded:
            code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
            held = np.unique(lists[asked])
        count = np.zeros(len(pdf), np.int64)
        ids, pos = np.unique(id_, return_inverse=True)
        parent = np.arange(len(ids))

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        runs = np.split(asked, np.flatnonzero(np.diff(lists[asked])) + 1)
        for i in range(0, len(asking), ASKING):
            q = asking[i : i + ASKING]
            near_lists = index.reached(x[q], lists[q], radius, held) if coded else None
            for which, run_ in enumerate(runs):
                a = q[near_lists[:, which]] if coded else q
                rest = x[a] - index.coarse[held[which]] if coded else None
                for j in range(0, len(run_) if len(a) else 0, 1024):
                    m = run_[j : j + 1024]
                    near = index.distances(rest, code[m]) <= bound[m][None] if coded else np.ones((len(a), len(m)), bool)
                    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    if not len(rows):
                        continue
                    f, g = a[rows], m[cols]
                    linked = (x[f] @ x[g].T >= least) & near[np.ix_(rows, cols)] & (id_[f][:, None] != id_[g][None])
                    if low == high:
                        linked &= f[:, None] < g[None]
                    count[f] += linked @ weight[g]
                    count[g] += weight[f] @ linked
                    for r, hit in zip(f, linked, strict=True):
                        for c in {find(v) for v in np.unique(pos[g[hit]])}:
                            lower, upper = sorted((find(c), find(pos[r])))
                            parent[upper] = lower
        root = np.array([find(v) for v in range(len(ids))])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        hit = np.flatnonzero(count)
        return pd.DataFrame({"id": np.concatenate([id_[hit], ids[moved]]), "n": np.concatenate([count[hit], np.zeros(len(moved), np.int64)]), "root": np.concatenate([id_[hit], ids[root[moved]]])})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, lists: int | None = None, sample: int = SAMPLE, block: int | None = None, reach: float | None = REACH) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding).

    Pairs link whose cosine is `least` or more. Null or zero vectors, and those with null or non-finite components, link with
    nothing; so do rows without vec_id, whose component_id and kept are null. Equal vectors are one class from the start. Vectors of
    another length than most are compared only with their like, in one list without codes. Rows that share a vec_id are one node.
    A vector looks into the lists within `reach` deviations (see REACH), which are measured on the sample, so that vectors of few effective dimensions
    look into more of them; the number of lists grows with the rows up to a sixteenth of `sample`. The exact way is `reach` None: every
    list that can hold a partner by the triangle inequality, where no link is lost, but work grows with the square.
    The table-lookup distance is held against the bound plus the code's own error, so a list that is looked into loses no link.
    An empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0), F.lit(False))
    rows = v.withColumn("x", F.when(good & F.col("vec_id").isNotNull(), F.col("x")))
    classes = stored(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vectors")
    total = classes.count()
    dims = classes.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    index, radius = None, math.sqrt(max(0.0, 2 - 2 * least))
    if dims:
        n_lists = lists or max(1, min(total // PER_LIST, sample // 16))
        size = min(sample, max(2048, PER_CENTROID * n_lists), max(2048, SAMPLE_BYTES // (8 * dims[0]["d"])))
        drawn = classes.where(F.size("x") == dims[0]["d"]).orderBy(F.xxhash64("id"), "id").limit(size).select("x").toArrow()
        x = np.concatenate([c.flatten().to_numpy() for c in drawn.column(0).chunks]).reshape(-1, dims[0]["d"])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = Index(x, n_lists, SUBSPACES, CODES, reach)
    shared = spark.sparkContext.broadcast(index)
    assigned = stored(classes.select("id", "weight", "x").mapInArrow(_assigned(shared), ROWS), "lists")
    # one number for each list, and lists are bounded by the sample
    sizes = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}
    placed = _blocks(sizes, index, block or min(BLOCK, max(LEAST_BLOCK, total // 8)))
    tiles = assigned.mapInArrow(_tiled(shared, placed, radius), TILED) if placed else spark.createDataFrame([], TILED)
    found = stored(tiles.groupBy("low", "high").applyInPandas(_matched(shared, least), "id long, n long, root long"), "linked")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("id <> root"), "id", "root")
    low = roots.groupBy("root").agg(F.min("node").alias("low"))
    placed = roots.join(low, "root").select(F.col("node").alias("id"), "low")
    of = classes.join(counts, "id", "left").join(placed, "id", "left").select("x", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("low", "id").alias("low"))
    # vectors that link with nothing need no join, whose key they would all share
    out = rows.where("x is not null").join(of, "x").select("vec_id", "n_links", F.col("low").alias("component_id"))
    out = out.union(rows.where("x is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
