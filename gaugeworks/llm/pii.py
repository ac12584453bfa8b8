"""Operator 10: personal data, by patterns and a skip-chain conditional random field.

Patterns give the base spans. All tokens of a document form a field over the labels none, email, ip, card and phone, with base
spans as evidence. Neighbours share pair potentials, and so do each two successive tokens with the same or a similar form, however far apart,
and each token with the nearest base span of its form. Potentials of token shapes and of pairs are learned together, by pseudo-likelihood, from
the base labels of a bounded sample. Loopy sum-product message passing gives beliefs. Tokens without a base span join the result if their belief
in a label is BELIEF or more and skip links tie them to a base span; a document without base spans has nothing that could tie one, so its field is not run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
# The base patterns
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A match of digits and points that fails at a run's first digit fails at its others too: they are not tried, as a run can be very long
_FIND = {k: re.compile(("(?<![0-9])" if k == "ip" else "") + p) for k, p in PATTERNS.items()}
_DOMAIN, _LOCAL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT, _TOKEN, _EDGE = re.compile("[0-9]"), re.compile(r"[^\x20\x09-\x0D]+"), "\"'()[]{}<>,.;:!?"
#: Bound of the sample for fitting: passages, and characters of each.
TEXTS, CHARACTERS = 256, 4000
BELIEF, DAMPING = 0.8, 0.5
#: Linked tokens are taken to agree by so much, in logarithms, before any are seen: samples hold few of them.
AGREE = 8.0
#: Messages have settled when none changes by more. Loops need not settle; this many rounds end them.
SETTLED, ROUNDS = 1e-4, 1000
#: A shape alone speaks against a label by so much at most, in logarithms, so that a linked token can outweigh it.
LEAST = -1.5
Span = tuple[int, int, int]


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    digits = [ord(c) - 48 for c in s if "0" <= c <= "9"]
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if not 13 <= len(digits) <= 19:
        return False
    twice = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(twice) + sum(digits[-1::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from their at signs, in time that grows with the text."""
    out: list[tuple[int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind's number, start, end) in code points, by kind and start."""
    out: list[Span] = []
    has = _DIGIT.search(text) is not None
    for i, kind in enumerate(KINDS):
        if kind == "email":
            out += [(i, a, b) for a, b in _emails(text)]
        elif has and (kind != "phone" or "+" in text):
            out += [(i, m.start(), m.end()) for m in _FIND[kind].finditer(text) if _valid(kind, m[0])]
    return out


def shape(token: str) -> np.ndarray:
    """What a token looks like; none of the patterns is asked."""
    n = len(token)
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    return np.array(
        [1, digits == n, digits > 0 and letters > 0, letters == n, "@" in token, token.count(".") == 3, 0 < token.count(".") < 3, "-" in token, token[:1] == "+",
         digits >= 13, 7 <= digits < 13, 3 <= digits < 7, 0 < digits < 3, n >= 20, n <= 3, "(" in token or ")" in token, "=" in token or ":" in token],
        float,
    )


def _forms(token: str, known: frozenset[str] = frozenset()) -> list[str]:
    """By what tokens are the same or similar: the whole form, a long run of digits, the part before an at sign.

    A whole form needs a digit and five characters, unless it is one of the `known` forms.
    """
    low = token.strip(_EDGE).lower()
    out = []
    digits = "".join(c for c in low if "0" <= c <= "9")
    if len(digits) >= 7:
        out.append("d" + digits)
    local, at, _ = low.partition("@")
    if local and (at or "w" + local in known or (len(local) >= 5 and any("0" <= c <= "9" for c in local))):
        out.append("w" + local)
    return out


def forms_of(text: str, base: list[Span]) -> frozenset[str]:
    """The forms of base spans."""
    return frozenset(f for _, a, b in base for f in _forms(text[a:b]))


def nodes(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray, list[int]]:
    """Base spans, and all tokens outside of them: places, base labels (0: none), numbers among all tokens."""
    found = [(a, b, kind + 1) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts, k = [], 0
    for m in _TOKEN.finditer(text):
        starts.append(m.start())
        a, b = m.span()
        while a < b - 1 and text[a] in _EDGE:
            a += 1
        while b > a + 1 and text[b - 1] in _EDGE:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            found.append((a, b, 0))
    found.sort()
    numbers = (np.searchsorted(np.array(starts), [a for a, _, _ in found], "right") - 1).tolist() if found else []
    return [(a, b) for a, b, _ in found], np.array([x for _, _, x in found], int), numbers


def reached(label: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which nodes skip links tie to a base span, over any number of them."""
    tied = label > 0
    while len(far) and not tied[ends := far[tied[far].any(1)]].all():
        tied[ends] = True
    return tied


def links(text: str, places: list[tuple[int, int]], numbers: list[int], known: frozenset[str] = frozenset(), label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes: (neighbours, successive ones of one form). As many as nodes, not as pairs of equal ones.

    With labels, each node without one is also linked to the nearest base span of its form, so that evidence reaches any number of repeats.
    """
    near = [(i, i + 1) for i in range(len(places) - 1) if numbers[i + 1] == numbers[i] + 1]
    of: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(places):
        for form in _forms(text[a:b], known):
            of.setdefault(form, []).append(i)
    far = [pair for same in of.values() for pair in pairwise(same)]
    if label is not None:
        for same in of.values():
            base = [i for i in same if label[i] > 0]
            for i in same if base else []:
                if label[i] == 0:
                    k = bisect(base, i)
                    to = min(base[max(k - 1, 0) : k + 1], key=lambda j: abs(numbers[j] - numbers[i]))
                    far.append((min(i, to), max(i, to)))
    as_array = lambda x: np.array(sorted(set(x)), int).reshape(-1, 2)
    return as_array(near), as_array(far)


class Field:
    """Weights of the field: shapes by label, and log potentials of label pairs for neighbours and for skip links."""

    def __init__(self, texts: list[str]) -> None:
        """Pseudo-likelihood: each node's label given its shape and the labels of its neighbours and of those it is linked with.

        Weights are drawn to 0, those of linked labels to AGREE where they are equal. Tokens that links tie to a base span are hidden, not examples of no label. Linked nodes are seen a second time without their
        shape, as links have to speak for tokens that look like nothing.
        """
        k, n = len(KINDS) + 1, len(shape("x"))
        x, y = [np.zeros((0, n + 2 * k))], [np.zeros(0, int)]
        for t in texts:
            base = base_spans(t)
            places, label, numbers = nodes(t, base)
            if not places:
                continue
            near, far = links(t, places, numbers, forms_of(t, base))
            seen = ~reached(label, far) | (label > 0)
            rows = np.zeros((len(places), n + 2 * k))
            rows[:, :n] = [shape(t[a:b]) for a, b in places]
            for at, pairs in ((n, near), (n + k, far)):
                for i, j in ((0, 1), (1, 0)):
                    to = pairs[seen[pairs[:, j]]]
                    np.add.at(rows, (to[:, i], at + label[to[:, j]]), 1)
            linked = seen & (rows[:, n + k :].sum(1) > 0)
            bare = rows[linked]
            bare[:, 1:n] = 0
            x += [rows[seen], bare]
            y += [label[seen], label[linked]]
        rows, count = np.unique(np.concatenate([np.concatenate(x), np.concatenate(y)[:, None]], 1), axis=0, return_counts=True)
        features, target = rows[:, :-1], np.eye(k)[rows[:, -1].astype(int)]
        # of repeated cases the root counts, so that words by the thousand do not drown what is rare
        share = np.sqrt(count)[:, None] / np.sqrt(count).sum() if len(count) else np.zeros((0, 1))
        weights, pace = np.zeros((n + 2 * k, k)), np.full((n + 2 * k, k), 1e-8)
        weights[n + k :] = AGREE * np.eye(k)
        prior = weights.copy()
        for _ in range(500 if len(rows) else 0):
            score = features @ weights
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = features.T @ (share * (target - p)) - 1e-4 * (weights - prior)
            pace += slope**2
            weights += 0.3 * slope / np.sqrt(pace)
        self.weights = weights[:n]
        self.near, self.far = ((w + w.T) / 2 for w in (weights[n : n + k], weights[n + k :]))

    def beliefs(self, shapes: np.ndarray, label: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        k = self.weights.shape[1]
        unary = shapes @ self.weights
        unary = np.maximum(unary - unary.max(1, keepdims=True), LEAST)
        unary[label > 0] = -1e6  # no number of repeats outvotes a base span
        unary[np.flatnonzero(label > 0), label[label > 0]] = 0.0
        pairs = np.concatenate([near, far])
        if len(pairs):
            potential = np.concatenate([np.repeat(self.near[None], len(near), 0), np.repeat(self.far[None], len(far), 0)])
            source = np.concatenate([pairs[:, 0], pairs[:, 1]])
            target = np.concatenate([pairs[:, 1], pairs[:, 0]])
            potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            message = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                total = unary.copy()
                np.add.at(total, target, message)
                out = (total[source] - message[back])[:, :, None] + potential
                top = out.max(1)
                out = top + np.log(np.exp(out - top[:, None]).sum(1))
                out -= out.max(1, keepdims=True)
                change = np.abs(out - message).max()
                message = DAMPING * message + (1 - DAMPING) * out
                if change <= SETTLED:
                    break
            np.add.at(unary, target, message)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and those that the field adds."""
        if not base:
            return base
        places, label, numbers = nodes(text, base)
        near, far = links(text, places, numbers, forms_of(text, base), label)
        if not len(far) or not (label == 0).any():
            return base
        tied = reached(label, far)
        p = self.beliefs(np.array([shape(text[a:b]) for a, b in places]), label, near, far)
        best = p.argmax(1)
        more = [(int(best[i]) - 1, *places[i]) for i in np.flatnonzero(tied & (label == 0) & (best > 0) & (p.max(1) >= BELIEF))]
        return sorted(base + more)


def fit_field(docs: DataFrame, texts: int = TEXTS, characters: int = CHARACTERS) -> Field:
    """From passages with digits or at signs, chosen by a digest of the text: `texts` of them at most."""
    h = F.xxhash64("text")
    row = F.struct(h.alias("h"), F.substring("text", 1, characters).alias("text"))
    chosen = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    chosen = chosen.groupBy(F.pmod(h, F.lit(texts)).alias("slot")).agg(F.min(row).alias("row")).select("row.text")
    return Field(sorted(r[0] for r in chosen.collect()))


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row's whole text.

    Null counts as empty; without spans the counts are 0, `spans` is empty and the digest is that of the empty string. Rows
    with null or repeated doc_ids stay. An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or fit_field(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [x.split()[0] for x in SPANS.split(", ")]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py() or ""
                base = base_spans(t)
                count = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((doc, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(model.spans(t, base))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)
