"""Join of texts whose sets of word shingles have a Jaccard similarity of ``threshold`` or more.

1. Each text becomes its set of shingles of five words and 180 MinHash values; texts with one and the same set are one
   *class* from here on, represented by one text. Values are hashed in bands of five: a pair of similarity 0.8 has no
   band in common once in about two million cases.
2. Classes that share a band are linked to the smallest class in it, never to each other, and the connected parts of
   that graph are the candidates' *fields*: every pair that shares a band lies in one.
3. Fields are cut into blocks, and every pair of blocks is compared in one task of bounded size: MinHash values are
   compared sixteen at a time, and a pair is dropped as soon as the posterior probability of reaching the threshold
   (uniform prior, binomial matches) falls below ``tolerance``. What is left is verified exactly on the shingles.
4. A task emits for each class the number of rows it is linked to and an edge to the smallest class it is connected to,
   not the pairs. So a group of g near copies costs g rows for each of its blocks, and every link is counted.

Only texts of candidates are shuffled, found by a Bloom filter of their digests. There is no cap on a band's members or
a text's partners.

Defined cases: null and empty texts, and texts without a word, are linked to nothing; a text of one to four words is one
shingle; rows with equal texts are linked to each other; ids may repeat or be null; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.bloom import mark_possible_members
from daypanel.llm.common import chunks, free_name, map_arrow, saved, whole
from daypanel.llm.components import components
from daypanel.llm.words import words


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    shingle: int = 5
    bands: int = 36
    rows: int = 5  # MinHash values of a band
    step: int = 16  # values compared between two looks at the posterior
    tolerance: float = 1e-6
    block: int = 200  # classes of a block, about


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Shingler:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(8)
        n = s.bands * s.rows
        self.s = s
        self.a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 200_000:
                self.known.clear()
            h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, text: str) -> np.ndarray:
        """The sorted 64-bit hashes of a text's shingles."""
        h = np.fromiter(map(self._hash, words(text)), np.uint64)
        if not len(h):
            return h
        n = max(1, len(h) - self.s.shingle + 1)
        x = np.zeros(n, np.uint64)
        for k in range(min(len(h), self.s.shingle)):  # order matters: each word is mixed in before the next
            x = (x ^ h[k : k + n]) * _ODD[k % 3]
            x ^= x >> np.uint64(29)
        return np.unique(x)

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        return np.min([(x[i : i + 4096, None] * self.a + self.b).min(0) for i in range(0, len(x), 4096)], axis=0)


def fewest_matches(s: Settings) -> list[int]:
    """For each number of values compared, in steps, the fewest matches with which a pair may still reach the threshold:
    with m of n matching, that has the posterior probability P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in range(s.step, s.bands * s.rows + 1, s.step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * s.threshold**m * (1 - s.threshold) ** (n + 1 - m)
            if total >= s.tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, s: Settings, least: list[int]) -> np.ndarray:
    """Which pairs of rows of two MinHash tables the pruning leaves; sizes alone rule out some, exactly."""
    alive = np.minimum.outer(na, nb) >= s.threshold * np.maximum.outer(na, nb) - 1e-9
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    for k, most in enumerate(least):
        if not len(i):
            break
        part = slice(k * s.step, (k + 1) * s.step)
        for at in range(0, len(i), 50_000):
            matches[at : at + 50_000] += (a[i[at : at + 50_000], part] == b[j[at : at + 50_000], part]).sum(1, dtype=np.int32)
        keep = matches >= most
        i, j, matches = i[keep], j[keep], matches[keep]
    out = np.zeros(alive.shape, bool)
    out[i, j] = True
    return out


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """For each pair (i, j) of ``sets`` the number of common elements, by products of incidence tables."""
    if len(pairs) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    shared = often[back] > 1
    owner, column = owner[shared], rank[back[shared]]
    order = column.argsort(kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[low:high], column[low:high] - at] = 1
        total += table @ table.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def compare(rows: list[tuple], first: int, second: int, s: Settings, least: list[int]) -> list[tuple]:
    """Links between the classes of two blocks, or within one. ``rows``: (block, class, copies, signature, shingles).
    Gives (class, linked rows, smallest connected class) of every class that has a link."""
    left = [i for i, r in enumerate(rows) if r[0] == first]
    right = left if first == second else [i for i, r in enumerate(rows) if r[0] == second]
    if not left or not right:
        return []
    sign = np.stack([np.frombuffer(r[3], np.uint32) for r in rows])
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    alive = surviving(sign[left], sign[right], size[left], size[right], s, least)
    if first == second:
        alive = np.triu(alive, 1)
    pairs = np.stack(np.nonzero(alive), axis=1)
    pairs = np.stack([np.array(left)[pairs[:, 0]], np.array(right)[pairs[:, 1]]], axis=1)
    if not len(pairs):
        return []
    common = overlaps(sets, pairs)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - common
    pairs = pairs[common >= s.threshold * union - 1e-9]
    copies, linked = np.array([r[2] for r in rows], np.int64), np.zeros(len(rows), np.int64)
    np.add.at(linked, pairs[:, 0], copies[pairs[:, 1]])
    np.add.at(linked, pairs[:, 1], copies[pairs[:, 0]])
    order = {i: n for n, i in enumerate(sorted(range(len(rows)), key=lambda i: rows[i][1]))}
    rank = np.array([order[i] for i in range(len(rows))])
    name = sorted(range(len(rows)), key=lambda i: rows[i][1])
    while True:
        was = rank.copy()
        np.minimum.at(rank, pairs[:, 0], rank[pairs[:, 1]])
        np.minimum.at(rank, pairs[:, 1], rank[pairs[:, 0]])
        if (was == rank).all():
            break
    return [(rows[i][1], int(linked[i]), rows[name[rank[i]]][1]) for i in np.flatnonzero(linked)]


def _signed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """``(id, txt, cls, bands)``: digests of the text and of its shingle set, and the hashes of its bands."""
    t = whole(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(t)).alias("txt"), t.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s)
        for batch in chunks(batches, 1024):
            classes, bands = [], []
            for text in batch.column(2).to_pylist():
                x = shingler.shingles(text)
                if not len(x):
                    classes.append(None)
                    bands.append(None)
                    continue
                m = shingler.minhash(x).tobytes()
                classes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                w = 4 * s.rows
                bands.append([xxhash.xxh3_64_intdigest(m[w * k : w * k + w], k) - 2**63 for k in range(s.bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "txt", "cls", "bands"]
            )

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, txt binary, cls binary, bands array<bigint>")


def _links(docs: DataFrame, text_col: str, signed: DataFrame, s: Settings) -> DataFrame:
    """``(cls, linked, lead)`` of the comparisons of all pairs of blocks."""
    classes = saved(signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("txt").alias("txt"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    keys = classes.select("cls", F.explode("bands").alias("band"))
    several = saved(keys.groupBy("band").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).filter("n >= 2").drop("n"))
    # A class is tied to the smallest of its leads, of which it has one a band at most, and that one to the others: leads
    # are few where many classes share bands, so a large group costs an edge a class rather than one a band.
    leads = saved(keys.join(several, "band").groupBy("cls").agg(F.collect_set("lead").alias("leads")).withColumn("low", F.array_min("leads")))
    edges = leads.select(F.col("cls").alias("a"), F.col("low").alias("b")).unionByName(leads.select(F.col("low").alias("a"), F.explode("leads").alias("b")).distinct())
    field = components(edges)
    sizes = saved(field.groupBy("root").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")))
    placed = saved(
        field.join(sizes, "root")
        .join(classes.select(F.col("cls").alias("node"), "txt", "copies"), "node")
        .select("txt", F.col("node").alias("cls"), "copies", F.col("root").alias("field"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    )
    t = whole(f"`{text_col}`")
    texts = mark_possible_members(docs.select(F.unhex(F.md5(t)).alias("txt"), t.alias("t")), placed, "txt", "_may").filter("_may").drop("_may")
    own = texts.groupBy("txt").agg(F.first("t").alias("t")).join(placed, "txt").drop("txt")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s)
        for batch in chunks(batches, 256):
            x = [shingler.shingles(text) for text in batch.column(0).to_pylist()]
            m = pa.array([shingler.minhash(y).tobytes() for y in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], m, pa.array([y.tobytes() for y in x], pa.binary())],
                [*batch.schema.names[1:], "signature", "shingles"],
            )

    ready = map_arrow(own, sets, "cls binary, copies bigint, field binary, blocks int, block int, signature binary, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = (
        ready.select("*", other)
        .select("field", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "cls", "copies", "signature", "shingles")
        .repartition("field", "first", "second")
        .sortWithinPartitions("field", "first", "second")
    )
    least = fewest_matches(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "linked", "lead"]
        kinds = (pa.binary(), pa.int64(), pa.binary())
        group, current = [], None

        def done() -> Iterator[pa.RecordBatch]:
            found = compare(group, current[1], current[2], s, least) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for batch in chunks(batches, 256):
            for field, first, second, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (field, first, second) != current:
                    if current is not None:
                        yield from done()
                    group, current = [], (field, first, second)
                group.append(tuple(row))
        if current is not None:
            yield from done()

    return map_arrow(pairs, run, "cls binary, linked bigint, lead binary")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the id, ``txt`` (MD5 of the text), ``class_id`` (smallest id of the rows it is
    connected to by links, its own without one), ``class_key`` (a name of the class) and ``n_links`` (other rows that are similar to it)."""
    signed = saved(_signed(docs, id_col, text_col, settings))
    links = saved(_links(docs, text_col, signed, settings))
    linked = links.groupBy("cls").agg(F.sum("linked").alias("linked"))
    roots = components(links.select(F.col("cls").alias("a"), F.col("lead").alias("b")))
    of_class = (
        signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("_low"), F.count("*").alias("_copies"))
        .join(linked, "cls", "left")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    of_class = saved(of_class)
    lowest = saved(of_class.groupBy("root").agg(F.min("_low").alias("class_id")))
    known = saved(
        of_class.join(lowest, "root").select("cls", "class_id", F.hex("root").alias("class_key"), (F.col("_copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    alone = signed.filter("cls IS NULL").select(
        F.col("id").alias(id_col), "txt", F.col("id").alias("class_id"), F.lit(None).cast("string").alias("class_key"), F.lit(0).cast("long").alias("n_links")
    )
    several = signed.filter("cls IS NOT NULL").join(known, "cls")
    return several.select(F.col("id").alias(id_col), "txt", "class_id", "class_key", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without a link and, of each class of connected rows, one of those with the smallest id, whole
    and with their own columns. Rows that cannot be of such a class are not shuffled."""
    found = similar_classes(docs, id_col, text_col, settings).filter("n_links > 0")
    txt, may, mine = (free_name(docs.columns, c) for c in ("_txt", "_may", "_class"))
    several = saved(found.select(F.col("txt").alias(txt), F.col("class_key").alias(mine)).distinct())
    marked = mark_possible_members(docs.withColumn(txt, F.unhex(F.md5(whole(f"`{text_col}`")))), several, txt, may)
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = marked.filter(F.col(may)).join(several, txt, "left")
    first = F.min_by(F.struct(*own), F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.xxhash64(*own)))
    kept = joined.filter(F.col(mine).isNotNull()).groupBy(mine).agg(first.alias("_kept")).select("_kept.*")
    return marked.filter(~F.col(may)).select(*own).unionByName(joined.filter(F.col(mine).isNull()).select(*own)).unionByName(kept)
