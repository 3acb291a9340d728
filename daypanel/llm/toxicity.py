"""Toxicity by a convolutional text classifier.

A word's embedding is one row each of three hashed tables side by side: two by hashes of the word, so a rare word that
shares one row with a telling word does not look like it, and one by a hash of its beginning, for inflected forms. Filters of several widths slide over the whole text, the largest response of each filter
is pooled, and a logistic layer scores the pooled responses. Training is numpy on the driver, over whole texts of a
bounded sample of labelled rows: at most ``Settings.sample`` of each class, drawn by a hash of the id, and of these as
many, in the order of the hash, as have ``Settings.sample_chars`` characters together. Scoring runs over all rows in Arrow
batches. A response of a filter is a sum of one table row per word and place, so the tables are multiplied out once a
worker and scoring only looks up and adds.

Every labelled row calibrates, scored by a model that has not learnt from it: a row of the sample by one that was trained
without the fold it is in, all that the sample had no room for by the model itself, whole and in Spark. They are counted
by language, label and score in ``BINS`` steps; the rows of a class count for as many as the labels have of it, so
thresholds see toxic texts as often as they really are. On the counts the score is shifted so that its best cut lies at
``Settings.cut``, and each language with enough rows gets a threshold of its own that would rather pass a toxic text than
reject a clean one. Language, source and id are no inputs of the score.

Defined cases: null and empty texts, and others without words, score 0; without rows of both classes every score is 0; several labels of one id count as toxic if one says so; null labels are left out; repeated rows are scored
alike; rows without a language use the threshold of all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.bloom import mark_possible_members
from daypanel.llm.common import chunks, map_arrow, saved, whole
from daypanel.llm.words import words


@dataclass(frozen=True)
class Settings:
    bits: int = 15  # log2 of the rows of each hashed table
    part: int = 8  # numbers a word takes from each table
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    stem: int = 7  # bytes of a word's beginning that are hashed apart
    start: float = 0.05  # size of the first random weights of the tables
    sample: int = 4000  # labelled rows of each class, at most
    sample_chars: int = 16_000_000  # characters of the texts of a class that are learnt from, at most, or one text
    words_at_once: int = 100_000  # of a text, while it is read
    epochs: int = 10
    batch: int = 32
    rate: float = 0.05
    cut: float = 0.7
    beta: float = 0.5  # weight of recall in the thresholds
    folds: int = 4  # of the sample, that calibrate each other
    per_language: int = 50  # rows of a language that its own threshold needs
    seed: int = 20


@dataclass
class Model:
    settings: Settings
    tables: tuple[np.ndarray, ...]
    kernels: list[np.ndarray]  # per width: (width, TABLES * part, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)  # None: all languages


class Buckets(dict):
    """The rows of a word in the tables, as one number; keeps those of recent words."""

    def __init__(self, s: Settings):
        super().__init__()
        self.bits, self.mask, self.stem = s.bits, (1 << s.bits) - 1, s.stem

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        own, beginning = zlib.crc32(word), zlib.crc32(word[: self.stem])
        own = (own & self.mask) | (zlib.crc32(word, 1) & self.mask) << self.bits
        self[word] = h = own | (beginning & self.mask) << 2 * self.bits
        return h


#: by the word twice, by its beginning once
TABLES = 3


def _rows_of(hashes: np.ndarray, s: Settings) -> list[np.ndarray]:
    mask = (1 << s.bits) - 1
    return [(hashes >> k * s.bits) & mask for k in range(TABLES)]


def _pooled_starts(lengths: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts when each is followed by as many blanks as the widest filter, and where its words are."""
    padded = lengths + max(s.widths)
    starts = np.concatenate([[0], np.cumsum(padded)[:-1]]).astype(np.int64)
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return starts, own


def _best_places(texts: list[np.ndarray], tables, kernels, bias, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the largest response of each filter, width by width, and the word that it starts at: two arrays
    ``[text, width, filter]``. Texts of more than ``s.words_at_once`` words together are read in pieces, which overlap by
    the widest filter, so that a long text takes no more room than many short ones."""
    if sum(map(len, texts)) <= s.words_at_once:
        return _best_starts(texts, [len(h) for h in texts], tables, kernels, bias, s)
    top = np.full((len(texts), len(s.widths), s.filters), -np.inf, np.float32)
    place = np.zeros(top.shape, np.int64)
    for j, h in enumerate(texts):
        for a in range(0, max(1, len(h)), s.words_at_once):
            starts = min(len(h) - a, s.words_at_once)
            piece = h[a : a + starts + max(s.widths) - 1]
            found, at = (x[0] for x in _best_starts([piece], [starts], tables, kernels, bias, s))
            better = found > top[j]
            top[j][better], place[j][better] = found[better], a + at[better]
    return top, place


def _best_starts(texts: list[np.ndarray], may_start: list[int], tables, kernels, bias, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``_best_places`` of short texts, over the first ``may_start`` words of each."""
    lengths, wide, size = np.array([len(h) for h in texts]), max(s.widths), 1 << s.bits
    starts, own = _pooled_starts(lengths, s)
    n = int(lengths.sum()) + len(texts) * wide
    at = [np.full(n + wide, size) for _ in range(TABLES)]
    for k, x in enumerate(_rows_of(np.concatenate(texts).astype(np.int64), s)):
        at[k][own] = x
    x = np.concatenate([t[rows_at] for t, rows_at in zip(tables, at, strict=True)], axis=1)
    ends, best, pooled = starts + np.maximum(may_start, 1), [], []
    for w, kernel, b in zip(s.widths, kernels, bias, strict=True):
        z = b + sum(x[k : k + n] @ kernel[k] for k in range(w))
        top = np.stack([i + z[i:j].argmax(0) for i, j in zip(starts, ends, strict=True)])
        best.append(top - starts[:, None])
        pooled.append(z[top, np.arange(s.filters)])
    return np.stack(pooled, axis=1), np.stack(best, axis=1)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> Model | None:
    """``rows``: the hashes of a text's words and its label."""
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(s.seed)
    used = rng.permutation(len(rows))
    size, d = 1 << s.bits, TABLES * s.part
    tables = tuple(rng.normal(0, s.start, (size + 1, s.part)).astype(np.float32) for _ in range(TABLES))
    kernels = [rng.normal(0, 0.5 / np.sqrt(d * w), (w, d, s.filters)).astype(np.float32) for w in s.widths]
    bias = [np.zeros(s.filters, np.float32) for _ in s.widths]
    out = rng.normal(0, 0.3, len(s.widths) * s.filters + 1).astype(np.float32)
    for t in tables:
        t[size] = 0  # the blank behind a text
    squares = [np.full(x.shape, 1e-6, np.float32) for x in (*tables, *kernels, *bias, out)]
    positive = np.mean([t for _, t in rows])

    def step(x: np.ndarray, square: np.ndarray, at, g: np.ndarray) -> None:
        square[at] += g * g
        x[at] -= s.rate * g / np.sqrt(square[at])

    for _ in range(s.epochs):
        rng.shuffle(used)
        for a in range(0, len(used), s.batch):
            part = [rows[i] for i in used[a : a + s.batch]]
            y = np.array([t for _, t in part], np.float32)
            texts = [h for h, _ in part]
            top, places = _best_places(texts, tables, kernels, bias, s)
            lengths = np.array([len(h) for h in texts])
            offsets, flat = np.cumsum(lengths) - lengths, np.concatenate([*texts, np.zeros(1, np.int64)])
            # The rows of the tables behind each filter's best place; behind a text's end, the blank.
            words_at = []
            for i, w in enumerate(s.widths):
                behind = places[:, i, None] + np.arange(w)[None, :, None]  # text, word, filter
                inside = behind < lengths[:, None, None]
                found = _rows_of(flat[np.where(inside, offsets[:, None, None] + behind, len(flat) - 1)], s)
                words_at.append(np.stack([np.where(inside, r, size) for r in found]))
            pool = top.reshape(len(part), -1)
            hidden = np.maximum(pool, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out[:-1] + out[-1], -30, 30)))
            g = (p - y) * np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) / len(part)
            back = g[:, None] * out[None, :-1] * (pool > 0)
            gx: list[tuple[np.ndarray, np.ndarray]] = []
            for i, (w, kernel) in enumerate(zip(s.widths, kernels, strict=True)):
                gz = back[:, i * s.filters : (i + 1) * s.filters]
                gk = np.empty_like(kernel)
                for k in range(w):
                    x = np.concatenate([t[words_at[i][j, :, k]] for j, t in enumerate(tables)], axis=2)
                    gk[k] = np.einsum("bfd,bf->df", x, gz)
                    gx.append((words_at[i][:, :, k].reshape(TABLES, -1), (gz[:, :, None] * kernel[k].T[None]).reshape(-1, d)))
                step(kernel, squares[TABLES + i], ..., gk)
                step(bias[i], squares[TABLES + len(s.widths) + i], ..., gz.sum(0))
            step(out, squares[-1], ..., np.append(hidden.T @ g, g.sum()).astype(np.float32))
            hit, grads = np.concatenate([p for p, _ in gx], axis=1), np.concatenate([q for _, q in gx])
            for k in range(TABLES):
                rows_hit, back_to = np.unique(hit[k], return_inverse=True)
                total = np.zeros((len(rows_hit), s.part), np.float32)
                np.add.at(total, back_to, grads[:, k * s.part : (k + 1) * s.part])
                real = rows_hit < size
                step(tables[k], squares[k], rows_hit[real], total[real])
    return Model(s, tables, kernels, bias, out, 0.0)


class Scorer:
    """Looks up multiplied-out tables: for each row of a hashed table what it adds to each filter at each place."""

    def __init__(self, model: Model):
        s = self.settings = model.settings
        self.model, self.buckets = model, Buckets(s)
        wide = [k for kernel in model.kernels for k in kernel]  # one (TABLES * part, filters) block per width and place
        self.tables = [
            np.concatenate([t @ k[i * s.part : (i + 1) * s.part] for k in wide], axis=1) for i, t in enumerate(model.tables)
        ]

    def hashes(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.buckets.__getitem__, words(text)), np.int64)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        s, f = self.settings, self.settings.filters
        lengths = np.array([len(t) for t in texts])
        starts, own = _pooled_starts(lengths, s)
        n = int(lengths.sum()) + len(texts) * max(s.widths)
        at = [np.full(n + max(s.widths), 1 << s.bits) for _ in range(TABLES)]
        for k, x in enumerate(_rows_of(np.concatenate(texts), s)):
            at[k][own] = x
        parts = sum(t[rows_at] for t, rows_at in zip(self.tables, at, strict=True))
        inside = np.zeros(n, bool)
        inside[own] = True
        inside[starts] = True  # a text without words has its blank
        pooled, column = [], 0
        for w, b in zip(s.widths, self.model.bias, strict=True):
            z = sum(parts[k : k + n, (column + k) * f : (column + k + 1) * f] for k in range(w)) + b
            z[~inside] = -np.inf
            pooled.append(np.maximum.reduceat(z, starts, axis=0))
            column += w
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        return (hidden @ self.model.out[:-1] + self.model.out[-1]).astype(np.float64)

    def raw(self, texts: list[str], words_at_once: int = 40_000) -> np.ndarray:
        out, block, size, found = [], [], 0, []
        for i, text in enumerate(texts):
            block.append(self.hashes(text))
            size += len(block[-1])
            found.append(len(block[-1]))
            if size >= words_at_once or i + 1 == len(texts):
                out.append(self.logits(block))
                block, size = [], 0
        raw = np.concatenate(out) if out else np.zeros(0)
        raw[[not h for h in found]] = -np.inf  # no words, nothing toxic
        return raw

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) + self.model.shift, -700, 700)))


#: of raw scores from -BIN_END to BIN_END
BINS, BIN_END = 8_000, 40.0


def known_labels(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """``(_id, _y)`` of the labelled ids: 1 for toxic."""
    id_type = docs.schema["doc_id"].dataType
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_y")).filter(usable)
    return known.select(F.col("doc_id").cast(id_type).alias("_id"), (F.col("_y") >= 1).cast("int").alias("_y")).filter(F.col("_id").isNotNull())


def _drawn(own: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """``(_id, _y)`` of the rows to learn from: at most ``s.sample`` of each class, of which as many as the characters
    that they may have together allow; a class has at least one."""
    drawn = None
    for y in (0, 1):
        mine = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(s.sample)
        drawn = mine if drawn is None else drawn.unionByName(mine)
    drawn = saved(drawn.select("_id", "_y"))
    sizes = own.join(F.broadcast(drawn), F.col("_d") == F.col("_id")).groupBy("_id", "_y").agg(F.sum(F.char_length("t")).alias("n"))
    # At most 2 * s.sample rows.
    upto = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    room = (F.sum("n").over(upto) <= s.sample_chars) | (F.row_number().over(upto.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return saved(sizes.withColumn("_room", room).filter("_room").select("_id", "_y"))


def _hashed(texts: DataFrame, s: Settings) -> tuple[list[tuple[np.ndarray, int]], list[str | None]]:
    """The rows of ``(id, text, label, language)``, whole, as hashes of their words; ordered, so that training repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(s)
        for batch in batches:
            out = [np.fromiter(map(buckets.__getitem__, words(t)), np.int64).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], ["k", "h", "y", "l"])

    moved = map_arrow(texts, run, "k string, h binary, y int, l string").toArrow()
    rows = sorted(zip(*(moved.column(c).to_pylist() for c in ("k", "h", "y", "l")), strict=True), key=lambda r: (r[0], r[1], r[3] or ""))
    return [(np.frombuffer(h, np.int64), y) for _, h, y, _ in rows], [x for *_, x in rows]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, s: Settings = Settings()) -> Model | None:
    """``usable``: a condition on ``doc_id`` for labels that may be learnt from. ``docs`` has ``doc_id``, ``text`` and, for
    thresholds by language, ``lang``."""
    known = saved(known_labels(docs, labels, F.lit(True) if usable is None else usable))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").alias("_d"), whole("text").alias("t"), lang.alias("l"))
    drawn = _drawn(own, known, s)
    rows, langs = _hashed(own.join(F.broadcast(drawn), F.col("_d") == F.col("_id")).select(F.col("_id").cast("string"), "t", "_y", "l"), s)
    model = train(rows, s)
    if model is None:
        return None
    crossed = [(x, int(_bins(np.array([raw]))[0]), y) for x, raw, (_, y) in zip(langs, crossed_scores(rows, s), rows, strict=True)]
    learnt = docs.sparkSession.createDataFrame(crossed, "l string, at int, _y int")
    _calibrate(model, learnt.unionByName(_unseen_scores(model, own, known, drawn)), known)
    return model


def crossed_scores(rows: list[tuple[np.ndarray, int]], s: Settings) -> np.ndarray:
    """For each row the raw score of a model that was trained on the other folds, which have both classes in proportion."""
    fold, out = np.zeros(len(rows), int), np.zeros(len(rows))
    for y in (0, 1):
        own = np.flatnonzero([t == y for _, t in rows])
        fold[own] = np.arange(len(own)) % s.folds
    for k in range(s.folds):
        model, mine = train([r for r, f in zip(rows, fold, strict=True) if f != k], s), np.flatnonzero(fold == k)
        if model is not None and len(mine):
            scorer = Scorer(model)
            out[mine] = [scorer.logits([rows[i][0]])[0] for i in mine]
    return out


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + BIN_END) * (BINS / (2 * BIN_END)), 0, BINS - 1).astype(np.int32)


def _unseen_scores(model: Model, own: DataFrame, known: DataFrame, drawn: DataFrame) -> DataFrame:
    """``(l, at, _y)`` of the labelled rows that were not learnt from. Their texts are found by a filter on ids and scored
    where they are read; labels are joined to the scores."""
    shared = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # a task's own: nothing of it stays in the worker
        for batch in chunks(batches, 256):
            at = _bins(scorer.raw(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at)], ["d", "l", "at"])

    learnt = drawn.select(F.col("_id").alias("_k"))
    rows = saved(known.join(F.broadcast(learnt), F.col("_id") == F.col("_k"), "left_anti").select("_id", "_y"))
    may = mark_possible_members(own.withColumnRenamed("_d", "_id"), rows, "_id", "_may").filter("_may").select("_id", "t", "l")
    scored = map_arrow(may, run, f"d {own.schema['_d'].dataType.simpleString()}, l string, at int")
    return scored.join(rows, F.col("d") == F.col("_id")).select("l", "at", "_y")


def _calibrate(model: Model, scored: DataFrame, known: DataFrame) -> None:
    """Shift and thresholds from binned scores; a class weighs as much as the labels have of it."""
    s = model.settings
    counts = saved(scored.groupBy("l", "at").agg(F.sum("_y").alias("toxic"), F.count("*").alias("n")))
    real = known.agg(F.sum("_y").alias("y"), F.count("*").alias("n")).first()
    seen = counts.agg(F.sum("toxic").alias("y"), F.sum("n").alias("n")).first()
    toxic, clean = (a / max(1, b) for a, b in ((real.y, seen.y or 0), (real.n - real.y, (seen.n or 0) - (seen.y or 0))))
    own, rest = F.col("toxic") * toxic, (F.col("n") - F.col("toxic")) * clean
    weighed = counts.select("l", "at", own.alias("toxic"), (own + rest).alias("n"), F.col("n").alias("rows"))
    everywhere = weighed.groupBy("at").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("l"), "at", "toxic", "n")
    found = {r.l: r.cut for r in best_cuts(everywhere, 1.0).collect()}
    model.shift = float(np.log(s.cut / (1 - s.cut))) - found.get(None, 0.0)
    # A row a language.
    sizes = weighed.groupBy("l").agg(F.sum("toxic").alias("p"), F.sum("n").alias("w"), F.sum("rows").alias("m")).filter(F.col("l").isNotNull())
    enough = sizes.filter((F.col("m") >= s.per_language) & (F.col("p") > 0) & (F.col("p") < F.col("w"))).select("l")
    mine = weighed.join(enough, "l", "left_semi").select("l", "at", "toxic", "n")
    spared = best_cuts(everywhere, s.beta).unionByName(best_cuts(mine, s.beta))
    model.thresholds = {None: s.cut} | {r.l: float(1 / (1 + np.exp(-(r.cut + model.shift)))) for r in spared.collect()}


def best_cuts(counts: DataFrame, beta: float) -> DataFrame:
    """``(l, cut)`` from ``(l, at, toxic, n)``: for each group, the raw score from which on "toxic" gives the best F-beta, in
    the middle of the gap below it; below 1, beta spares clean texts more than it catches toxic ones."""
    down = Window.partitionBy("l").orderBy(F.desc("at"))
    upto, group = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("l")
    f = (1 + beta**2) * F.sum("toxic").over(upto) / (F.sum("n").over(upto) + beta**2 * F.sum("toxic").over(group))
    below = F.coalesce(F.lead("at").over(down), F.col("at") - 1)
    # The lower end of this bin and the upper end of the next one that has rows.
    cut = ((F.col("at") + below + 1) / 2) * (2 * BIN_END / BINS) - BIN_END
    ranked = counts.select("l", "at", f.alias("f"), cut.alias("cut"))
    return ranked.groupBy("l").agg(F.max_by("cut", F.struct("f", "at")).alias("cut"))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", out: str = "toxicity", flag: str = "is_toxic") -> DataFrame:
    """``docs`` with the score and whether it reaches the threshold of the row's language; columns of these two names
    are replaced."""
    docs = docs.drop(out, flag)
    if model is None:
        return docs.withColumn(out, F.lit(0.0)).withColumn(flag, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # a task's own: nothing of it stays in the worker
        for batch in chunks(batches, 256):
            x = scorer.scores([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64())], [*batch.schema.names, "x"])

    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    text_col, lang = names[text_col], names.get(lang_col)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    scored = map_arrow(plain, run, f"{fields}, x double")
    at = F.lit(model.thresholds[None])
    if lang is not None:
        for name, threshold in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
            at = F.when(F.col(lang) == name, threshold).otherwise(at)
    return scored.withColumn(flag, F.col("x") >= at).toDF(*names, out, flag)
