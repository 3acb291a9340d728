"""Benchmark decontamination: a count of word pairs that no leak can fall below, then Smith-Waterman alignment.

Test items are read in blocks of a bounded number of words; a block's index goes to the tasks. An alignment that scores
``least`` or more has few edits for its number of matching words, so many of its matches must follow each other with no
edit between them or one: two words that are neighbours in the item or one apart, and likewise in the text. A pair that
is adjacent on both sides weighs 2, every other one 1. ``Index.need`` is the least weight that such an alignment can
have, ``Index.span`` the most words of a text it can cover (both follow from the scores, see ``bounds``). One scan of
the corpus looks all pairs of a text up; where pairs of an item within ``span`` words weigh ``need`` or more, the text
around them is aligned with the item, word by word. Everything else cannot be a leak, so nothing is lost, however rare
or common a pair is and whichever words are changed. A pair of text and item is a leak when the best score is ``least``
or more of what the whole item scores against itself.

Whole texts are read; texts are never shuffled. Defined cases: null and empty texts and items match nothing; an item of
fewer than ``WHOLE`` words leaks only where all its words stand together, since half of it is a single word; repeated
rows of the corpus are reported alike, one row each; items that repeat are reported each; ids may be null; without items
or texts the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import chunks, free_name, map_arrow, whole
from daypanel.llm.words import words


# Fixed value: items of fewer words are matched as a whole.
WHOLE = 3


@dataclass(frozen=True)
class Settings:
    match: int = 2
    other: int = -1  # for a word in place of another
    gap: int = -1  # for a word left out or put in
    least: float = 0.5
    block_chars: int = 20_000_000  # characters of items in one block, about


def bounds(size: int, s: Settings) -> tuple[int, int]:
    """``(need, span)`` of an item of so many words. With m matches and x edits, each of which costs ``edit`` or more, a
    score of ``least`` means x <= (match m - score) / edit. Of the m - 1 steps from match to match let a have no edit, b
    one and c more: b + 2 c <= x, so 2 a + b >= 2 m - 2 - x, which is linear in m; the smaller end counts."""
    score, edit = math.ceil(s.least * s.match * size - 1e-9), min(-s.other, -s.gap)
    ends = (2 * m - 2 - (s.match * m - score) / edit for m in (score / s.match, size))
    return math.ceil(min(ends) - 1e-9), size + int((s.match * size - score) / edit + 1e-9)


class Index:
    """The items of a block: words as numbers from 1, and which items hold which pairs of words."""

    def __init__(self, items: list[tuple[object, str]], s: Settings):
        self.s = s
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.ids: list[object] = []
        self.items: list[np.ndarray] = []
        for item, text in items:
            w = words(text)
            if w:
                self.ids.append(item)
                self.items.append(np.array([number(x, len(self.vocabulary) + 1) for x in w], np.int64))
        limits = [bounds(len(x), s) for x in self.items]
        self.need, self.span = (np.array([b[k] for b in limits], np.int64) for k in (0, 1))
        #: items of fewer than ``WHOLE`` words by the number of their only gram, and those that one matching word makes a leak
        self.short: dict[int, list[int]] = {}
        self.single: dict[int, list[int]] = {}
        pairs: dict[tuple[int, int], int] = {}
        for i, x in enumerate(self.items):
            if len(x) < WHOLE:
                self.short.setdefault(int(self.paired(x[:1], x[1:])[0]) if len(x) > 1 else int(x[0]), []).append(i)
            elif self.need[i] <= 0:
                for w in set(x.tolist()):
                    self.single.setdefault(w, []).append(i)
            else:
                for apart, weight in ((2, 1), (1, 2)):
                    pairs.update(((key, i), weight) for key in self.paired(x[:-apart], x[apart:]).tolist())
        #: sorted keys of pairs; items of key k, and what an adjacent pair weighs for them, from ``starts[k]`` on
        order = sorted(pairs)
        self.keys, self.starts = np.unique(np.array([k for k, _ in order], np.int64), return_index=True)
        self.starts = np.append(self.starts, len(order)).astype(np.int64)
        self.holders = np.array([i for _, i in order], np.int64)
        self.weights = np.array([pairs[k] for k in order], np.int64)

    @staticmethod
    def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """One number for two words, larger than that of any word."""
        return first << 32 | second

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter([get(w, 0) for w in words(text)], np.int64)

    def held(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, places and weights of the pairs of a text that an item holds. Most places hold a word no item has."""
        parts = []
        for apart in (1, 2):
            places = np.flatnonzero((x[:-apart] > 0) & (x[apart:] > 0))
            if not len(places) or not len(self.keys):
                continue
            key = self.paired(x[places], x[places + apart])
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            same = self.keys[found] == key
            places, found = places[same], found[same]
            many = self.starts[found + 1] - self.starts[found]
            at = np.arange(many.sum()) + np.repeat(self.starts[found] - (np.cumsum(many) - many), many)
            parts.append((self.holders[at], np.repeat(places, many), self.weights[at] if apart == 1 else np.ones(len(at), np.int64)))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def spans(self, x: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item the stretches of a text, in order and apart from each other, outside which it cannot leak."""
        around: dict[int, list[tuple[int, int]]] = {}
        item, place, weight = self.held(x)
        likely = np.bincount(item, weight, len(self.items))[item] >= self.need[item]
        item, place, weight = item[likely], place[likely], weight[likely]
        width = len(x) + int(self.span.max(initial=0)) + 1
        key = item * width + place
        order = np.argsort(key, kind="stable")
        key, item, place = key[order], item[order], place[order]
        total = np.append(0, np.cumsum(weight[order]))
        enough = total[np.searchsorted(key, key + self.span[item])] - total[np.searchsorted(key, key)] >= self.need[item]
        for i, p in zip(item[enough].tolist(), place[enough].tolist(), strict=True):
            around.setdefault(i, []).append((p - int(self.span[i]), p + int(self.span[i])))
        for w, places in self._at(x, self.single):
            for i in self.single[w]:
                around.setdefault(i, []).extend((p - int(self.span[i]), p + int(self.span[i])) for p in places)
        for x_or_pair in (x, self.paired(x[:-1], x[1:])):
            for w, places in self._at(x_or_pair, self.short):
                for i in self.short[w]:
                    around.setdefault(i, []).extend((p, p + len(self.items[i])) for p in places)
        out = {}
        for i, own in around.items():
            joined: list[tuple[int, int]] = []
            for low, high in sorted((max(0, low), min(len(x), high)) for low, high in own):
                if joined and low <= joined[-1][1]:
                    joined[-1] = joined[-1][0], max(high, joined[-1][1])
                else:
                    joined.append((low, high))
            out[i] = joined
        return out

    @staticmethod
    def _at(x: np.ndarray, table: dict[int, list[int]]) -> list[tuple[int, list[int]]]:
        if not table or not len(x):
            return []
        return [(w, np.flatnonzero(x == w).tolist()) for w in np.unique(x).tolist() if w in table]


def best_end(item: np.ndarray, passage: np.ndarray, s: Settings) -> tuple[int, int]:
    """The best Smith-Waterman score of two sequences of words, and behind which word of the passage it is first reached.
    A row is a maximum over the row above; gaps within the row are a running maximum, since each costs the same."""
    n = len(passage)
    slope = -s.gap * np.arange(n + 1)
    above = np.zeros(n + 1, np.int64)
    best = end = 0
    for word in item:
        row = np.zeros(n + 1, np.int64)
        np.maximum(above[:-1] + np.where(passage == word, s.match, s.other), above[1:] + s.gap, out=row[1:])
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope
        at = int(above.argmax())
        if above[at] > best or (above[at] == best and at < end):
            best, end = int(above[at]), at
    return best, end


def align(item: np.ndarray, passage: np.ndarray, s: Settings) -> int:
    """The best Smith-Waterman score of two sequences of words."""
    return best_end(item, passage, s)[0]


def leaks_of(x: np.ndarray, index: Index) -> list[tuple[int, float, int, int]]:
    """``(item, similarity, first word, words)`` of the best passage for each item that leaks into a text."""
    s = index.s
    out = []
    for item, spans in index.spans(x).items():
        own = index.items[item]
        full, best, where = s.match * len(own), 0, (0, 0)
        have = np.unique(own)
        for low, high in spans:
            passage = x[low:high]
            # No alignment can score more than all words of the passage that the item has.
            if s.match * min(len(own), int(np.isin(passage, have).sum())) < s.least * full:
                continue
            score, end = best_end(own, passage, s)
            if score > best:
                best, where = score, (low, low + end)
        if best and best / full >= s.least:
            # The same from behind: where the passage that ends there begins.
            low, end = where
            size = best_end(own[::-1], x[low:end][::-1], s)[1]
            out.append((item, best / full, end - size, size))
    return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, s: Settings) -> Iterator[list[tuple[object, str]]]:
    """The items, a block at a time."""
    own = benchmark.select(F.col(item_col).alias("i"), whole(text_col).alias("t"))
    chars = own.agg(F.sum(F.char_length("t") + 20)).first()[0] or 0
    n = max(1, -(-chars // s.block_chars))
    for k in range(n):
        block = own.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toArrow()
        rows = zip(block.column("i").to_pylist(), block.column("t").to_pylist(), strict=True)
        yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _shared(docs: DataFrame, items: list[tuple[object, str]], s: Settings):
    """The index of a block as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Index(items, s))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs`` and item that leaks into it: the two ids, ``similarity`` (share of the full score),
    ``first_word`` and ``n_words`` of the passage that aligns best."""
    name = f"`{text_col}`"
    own = docs.select(F.col(f"`{id_col}`").alias("d"), whole(name).alias("t"))
    item_type, id_type = benchmark.schema[item_col].dataType.simpleString(), own.schema["d"].dataType.simpleString()
    schema = f"d {id_type}, i {item_type}, similarity double, first_word bigint, n_words bigint"
    parts = []
    for items in _blocks(benchmark, item_col, item_text, settings):
        shared = _shared(docs, items, settings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in chunks(batches, 2048):
                out = [
                    (n, index.ids[i], similarity, first, size)
                    for n, text in enumerate(batch.column(1).to_pylist())
                    for i, similarity, first, size in leaks_of(index.numbers(text), index)
                ]
                if out:
                    at, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], ["d", "i", "similarity", "first_word", "n_words"])

        parts.append(map_arrow(own, run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnsRenamed({"d": id_col, "i": item_col})


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, whole and with their own columns."""
    mark = free_name(docs.columns, "_leaks")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    for items in _blocks(benchmark, item_col, item_text, settings):
        shared = _shared(docs, items, settings)
        plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items()), whole(f"`{text_col}`").alias(mark))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in chunks(batches, 2048):
                clean = [not leaks_of(index.numbers(text), index) for text in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(clean, pa.bool_()))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != mark)
        docs = map_arrow(plain, run, fields).toDF(*names)
    return docs
