"""Operator 3: language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship

#: Bounds of the training sample: texts of each language, and characters of each text.
TEXTS, CHARACTERS = 32, 1500
#: Symbols of a stretch; the stretches of a text are parsed side by side and then joined.
STRETCH = 512
#: Cells of a table of next states, at most.
CELLS = 1 << 24
#: A text whose parse takes a larger part of the bits that spelling it takes is in no learned language; so many phrases (names, keys, the last one) are not counted.
MOST, SPARE = 1.0, 8
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; what is no letter becomes one blank, 32, however long the run."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def lettered(text: str | None) -> bool:
    return bool(text) and bool((_codes(text) != 32).any())


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Of each state of the automaton of all substrings, the next states by symbol."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Language:
    """The automaton of one language's labelled text over its own alphabet; symbol 0 is what that text lacks.

    Kept, and sent to tasks, as its edges. Parses look them up in a table, or by binary search where the alphabet makes that larger than CELLS.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.alphabet = np.unique(codes)
        step = suffix_automaton(np.searchsorted(self.alphabet, codes) + 1)
        self.states, self.width = len(step), len(self.alphabet) + 1
        #: the state in which a phrase is over, whatever comes next; parses begin there
        self.over = self.states
        edges = sorted((s * self.width + c, t) for s, to in enumerate(step) for c, t in to.items())
        self.key, self.to = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        self.restart = np.full(self.width, self.over, np.int64)
        for c, t in step[0].items():
            self.restart[c] = t
        self.bits = float(np.log2(max(2, len(codes))))
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; ~state where a phrase ends before the symbol and the next one begins with it."""
        if (self.states + 1) * self.width <= CELLS:
            if self.table is None:
                self.table = np.tile(~self.restart, self.states + 1).astype(np.int32)
                self.table[self.key] = self.to
            return self.table[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], ~self.restart[symbol]).astype(np.int32)

    def phrases(self, grid: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each column of `grid`, which is a stretch of a text that goes on from column `before` (-1: a text begins).

        Columns, the longest first, are parsed side by side as if a phrase began with each. Then each is parsed again from the state that the
        one before it ended in, until both parses begin a phrase at one place: from there they are the same.
        """
        n = len(length)
        live = np.searchsorted(-length, -np.arange(len(grid)), side="left")
        state = np.full(n, self.over, np.int32)
        begins = np.zeros(grid.shape, bool)
        for j in range(int(length.max(initial=0))):
            to = self.next(state[: live[j]], grid[j, : live[j]])
            begins[j, : live[j]] = to < 0
            state[: live[j]] = to ^ (to >> 31)
        alone = begins.sum(0)
        count = alone.copy()
        after = np.full(n, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        again = np.flatnonzero(before >= 0)
        while len(again):
            at, carried = again, state[before[again]].copy()
            own, theirs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            changed: list[int] = []
            j = 0
            while len(at):
                if (done := length[at] <= j).any():
                    count[at[done]] = own[done]
                    differ = done & (state[at] != carried)
                    state[at[differ]] = carried[differ]
                    changed += after[at[differ]].tolist()
                    at, carried, own, theirs = (v[~done] for v in (at, carried, own, theirs))
                    continue
                to = self.next(carried, grid[j, at])
                mine, other = to < 0, begins[j, at]
                met = mine & other
                count[at[met]] = (own + alone[at] - theirs)[met]
                at, carried, own, theirs = at[~met], (to ^ (to >> 31))[~met], (own + mine)[~met], (theirs + other)[~met]
                j += 1
            again = np.array(sorted({c for c in changed if c >= 0}), np.int64)
        return count


class Languages:
    """Automata of labelled texts, one for each language."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.names = sorted(texts)
        codes = {n: np.concatenate([np.zeros(0, np.uint32), *[np.append(_codes(t), np.uint32(32)) for t in texts[n]]]) for n in self.names}
        #: symbol 0 is any letter that no labelled text has
        self.alphabet = np.unique(np.concatenate([np.array([32], np.uint32), *codes.values()]))
        self.languages = [Language(codes[n]) for n in self.names]
        self.bits = np.array([x.bits for x in self.languages])
        #: bits of a symbol that is spelled by itself, in each language's alphabet
        self.spelled = np.array([np.log2(x.width) for x in self.languages])
        self.local = []
        for x in self.languages:
            local = np.zeros(len(self.alphabet) + 1, np.int32)
            local[np.searchsorted(self.alphabet, x.alphabet) + 1] = np.arange(1, x.width)
            self.local.append(local)

    def symbols(self, text: str) -> np.ndarray:
        c = _codes(text)
        at = np.searchsorted(self.alphabet, c)
        return np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == c, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: phrases of the longest matches that a text falls into."""
        sizes = np.array([-(-len(t) // STRETCH) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        pieces = [t[i : i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not pieces:
            return out
        length = np.array([len(p) for p in pieces])
        order = np.argsort(-length, kind="stable")
        column = np.empty(len(pieces), np.int64)
        column[order] = np.arange(len(pieces))
        before = np.full(len(pieces), -1)
        goes_on = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        before[column[goes_on]] = column[goes_on - 1]
        grid = np.zeros((STRETCH, len(pieces)), np.int32)
        for i, p in zip(column, pieces, strict=True):
            grid[: len(p), i] = p
        for k, language in enumerate(self.languages):
            out[:, k] = np.bincount(owner[order], language.phrases(self.local[k][grid], length[order], before), len(texts)).astype(np.int64)
        return out

    def _costs(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts have a letter; their phrases by language, and their numbers of symbols."""
        symbols = [self.symbols(t) if t else np.zeros(0, np.int32) for t in texts]
        blank = int(np.searchsorted(self.alphabet, 32)) + 1
        known = [i for i, s in enumerate(symbols) if (s != blank).any()]
        return known, self.phrases([symbols[i] for i in known]), np.array([len(symbols[i]) for i in known])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language with the fewest phrases, each weighed by the bits that point into its sample, and 1 - best / second best."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        known, phrases, _ = self._costs(texts)
        for i, row in zip(known, phrases * self.bits, strict=True):
            best = int(row.argmin())
            rest = np.delete(row, best)
            names[i] = self.names[best]
            scores[i] = float(1 - row[best] / rest.min()) if len(rest) else 1.0
        return names, scores

    def read(self, texts: list[str | None], most: float, spare: int) -> np.ndarray:
        """Whether some language reads a text: its phrases but `spare`, in bits, take at most `most` of what spelling its symbols one by one takes."""
        out = np.zeros(len(texts), bool)
        known, phrases, sizes = self._costs(texts)
        if len(known):
            out[known] = ((phrases - spare) * self.bits <= most * sizes[:, None] * self.spelled).any(1)
        return out


def labelled_sample(labelled: DataFrame, texts: int = TEXTS, characters: int = CHARACTERS) -> DataFrame:
    """lang, text: of each language `texts` passages at most, chosen by a digest of the text; one pass, one small row for each."""
    h = F.xxhash64("text")
    rows = labelled.where("lang is not null and text is not null").select("lang", F.pmod(h, F.lit(texts)).alias("slot"), F.struct(h.alias("h"), F.substring("text", 1, characters).alias("text")).alias("row"))
    return rows.groupBy("lang", "slot").agg(F.min("row").alias("row")).select("lang", "row.text")


def fit_languages(labelled: DataFrame, texts: int = TEXTS, characters: int = CHARACTERS) -> Languages:
    found: dict[str, list[str]] = {}
    sample: list[Row] = labelled_sample(labelled, texts, characters).collect()
    for r in sorted(sample, key=lambda r: (r["lang"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return Languages(found)


def identified(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    `und` with score 0 if a text is null or has no letter, or nothing was learned. Nothing but the text is used. Rows with null or repeated doc_ids stay.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < 1 << 20:
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    held += len(texts[-1] or "")
                names, scores = model.predict(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    """Whether crc32 of the doc_id as text leaves 2 by 4; false for a null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows that are not held out."""
    model = fit_languages(docs.where(~held_out()).select(F.col("text").cast("string"), F.col("lang").cast("string")))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, most: float = MOST, spare: int = SPARE) -> DataFrame:
    """The rows of `docs` whose text some learned language reads, see Languages.read().

    Texts that are null or without letters go, and so do those that no language parses into fewer bits than letters spelled one by one take:
    random letters, or a language of which nothing was learned. Texts of up to `spare` phrases stay. Where no row is labelled, nothing
    was learned and every text with a letter stays. An empty table gives none.
    """
    model = fit_languages(docs.select(F.col("text").cast("string"), F.col("lang").cast("string")))
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        for b in batches:
            column = b.column(b.schema.get_field_index("text")).cast(pa.large_string())
            at = 0
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < 1 << 20:
                    texts.append(column[at + len(texts)].as_py())
                    held += len(texts[-1] or "")
                keep = languages.read(texts, most, spare) if languages.names else [lettered(t) for t in texts]
                yield b.slice(at, len(texts)).filter(pa.array(keep, pa.bool_()))
                at += len(texts)

    return docs.mapInArrow(run, docs.schema)
