"""Removal of repeated byte strings: a suffix array of the places that can repeat, built by a distributed merge sort.

Every byte of a text that lies in a string of 50 bytes which also starts in a text with a smaller id is removed.

*Which suffixes.* In each 50-byte string the 24-byte string with the smallest hash, the first of equal ones, is its
*anchor*. It depends on those 50 bytes alone, so equal strings have equal anchors at equal offsets, and one suffix a
run of strings with one anchor stands for all of them (about every fourteenth). Its *key* is the text from the anchor
to the end of the last of those strings, then, behind a byte that no UTF-8 text holds, the text before the anchor.

*Which of them.* A first scan counts anchors by hash, two hits a task at most; a Bloom filter of those in two texts or
more, of a bounded size, lets a second scan leave the rest out. It only saves work: a fuller filter lets more through.

*Merge sort.* A task of the second scan sorts the keys that are left into runs, one for each bin of anchors. Of equal
keys only those of the smallest id stay, the others are repeats already, so a passage costs a run one key however
often it occurs. Runs are front-coded and exchanged; a loser tree merges those of a bin. A key's common prefix with the
last winner is known throughout, so known prefixes are never compared again, and comes out as the LCP array. Stretches
of 24 bytes or more in common are keys with one anchor: their 50-byte strings are compared as they are.

Texts that are copies of one with a smaller id repeat as a whole; they are found by digest and not sorted.

Defined cases: null is the empty text; texts of fewer than 50 bytes lose nothing; a null id is larger than all others;
rows of equal id never take from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.bloom import mark_possible_members
from daypanel.llm.common import chunks, map_arrow, saved, whole

LENGTH = 50
ANCHOR = 24
WINDOW = LENGTH - ANCHOR + 1
LAST = 2**63 - 1
MARK = b"\xff"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


@dataclass(frozen=True)
class Settings:
    filter_mb: int = 64  # of the Bloom filter of repeated anchors, at most
    texts_a_shard: int = 1000  # whose anchors are counted together, about
    texts_a_bin: int = 8000  # whose keys are merged together, about
    buffer: int = 10_000_000  # bytes of text a task holds at once, about


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each anchor of each text: its hash, its text, its place, and the places of the first and the last string of
    50 bytes that it stands for."""
    empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= LENGTH).any():
        return empty
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - ANCHOR + 1
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    h = eight[:n] * _ODD[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n]
    h *= _ODD[1]
    h ^= h >> np.uint64(31)
    h += eight[16 : 16 + n]
    h *= _ODD[2]
    h ^= h >> np.uint64(30)
    h *= _ODD[0]
    # The hash's upper bits with the place below them: the smallest is the first of the smallest.
    low = h >> np.uint64(28)
    low <<= np.uint64(28)
    low |= np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    total = n - WINDOW + 1
    low = np.minimum(low[:total], low[WINDOW - span : WINDOW - span + total])
    at = (low & np.uint64(2**28 - 1)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    fits = np.repeat(np.tile([True, False], len(sizes)), np.stack([np.maximum(sizes - LENGTH + 1, 0), np.minimum(sizes, LENGTH - 1)], axis=1).ravel())[:total]
    s = np.flatnonzero(fits)
    own = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))[: len(s)]
    a = at[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(first[1:], len(s)) - 1
    doc = own[first]
    # Mixed anew: the smallest hashes of their strings are small, and shards are told apart by the upper bits.
    return h[a[first]] * _ODD[1], doc, a[first] - starts[doc], s[first] - starts[doc], s[last] - starts[doc]


def _blocks(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in blocks that fit a cache, each with the number of its first text. A block holds one text at least; a text
    of 2**28 bytes or more is beyond what ``anchors`` numbers."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _buffers(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in chunks(batches, 512):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[column])
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _twice(values: np.ndarray) -> np.ndarray:
    """The values, each twice at most."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def _slots(low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the lower half of a hash in a bitmap of ``width`` bits."""
    low = low.astype(np.uint64)
    return (low % np.uint64(width)).astype(np.int64), ((low * _ODD[0] >> np.uint64(31)) % np.uint64(width)).astype(np.int64)


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def repeated_anchors(texts: DataFrame, rows: int, s: Settings):
    """A broadcast ``(bits, filter, size)``: ``filter[shard]`` is a bitmap over the hashes of anchors in two texts or more.
    ``texts`` has one binary column."""
    bits = max(0, (rows // s.texts_a_shard).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(batches, 0, s.buffer):
            parts = []
            for _, block in _blocks([t for (t,) in buffer]):
                h, doc, *_ = anchors(block)
                if len(h):
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    parts.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])])
            if parts:
                h = _twice(np.concatenate(parts))
                shard = _shard(h, bits)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                pieces = [p.astype("<u4").tobytes() for p in np.split(h & np.uint64(2**32 - 1), cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int64()), pa.array(pieces, pa.binary())], ["shard", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in _grouped(batches):
            x = np.sort(np.concatenate([np.frombuffer(r[0], "<u4") for r in own]))
            x = np.unique(x[1:][x[1:] == x[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([len(x)], pa.int64())], ["shard", "hashes", "n"]
            )

    sent = map_arrow(texts, send, "shard bigint, hashes binary").repartition("shard").sortWithinPartitions("shard")
    found = saved(map_arrow(sent, count, "shard bigint, hashes binary, n bigint"))
    total = found.agg(F.sum("n")).first()[0] or 0
    width = min(16 * total, s.filter_mb * 2**23) // 2**bits // 8 * 8 + 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for hashes in batch.column(1).to_pylist():
                table = np.zeros(width, bool)
                for slots in _slots(np.frombuffer(hashes, "<u4"), width):
                    table[slots] = True
                maps.append(np.packbits(table).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["shard", "map"])

    filled = np.zeros((2**bits, width // 8), np.uint8)
    got = map_arrow(found, fill, "shard bigint, map binary").toArrow()
    for shard, bitmap in zip(got.column("shard").to_pylist(), got.column("map").to_pylist(), strict=True):
        filled[shard] = np.frombuffer(bitmap, np.uint8)
    return texts.sparkSession.sparkContext.broadcast((bits, filled, width))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows that follow each other and are equal in the first column."""
    current, own = None, []
    for batch in chunks(batches, 256):
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != current:
                if own:
                    yield current, own
                current, own = key, []
            own.append(tuple(row))
    if own:
        yield current, own


RUN = ("bin bigint", "lcp binary", "size binary", "tails binary", "ids binary", "holder_key binary", "holder_doc binary", "holder_at binary", "docs binary")


def make_run(keys: list[bytes], ids: list[int], holders: list[list[tuple[int, int]]], names: list[bytes]) -> tuple[bytes, ...]:
    """Sorted keys, front-coded: the length each has in common with the one before, and the rest. ``holders``: for each
    key the (text, place of the anchor) pairs that hold it; ``names`` of the texts have 16 bytes. Columns are compressed."""
    size = np.array([len(k) for k in keys], np.int64)
    wide = np.frombuffer(b"".join(k.ljust(128, b"\0") for k in keys), np.uint8).reshape(len(keys), 128)
    lcp = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = wide[1:] != wide[:-1]
        lcp[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), 128), np.minimum(size[1:], size[:-1]))
    tails = b"".join([k[n:] for k, n in zip(keys, lcp.tolist(), strict=True)])
    flat = np.array([(i, doc, at) for i, h in enumerate(holders) for doc, at in h], np.int64)
    used, doc = np.unique(flat[:, 1], return_inverse=True)
    columns = (
        lcp.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), tails, np.array(ids, "<i8").tobytes(),
        flat[:, 0].astype("<u4").tobytes(), doc.astype("<u4").tobytes(), flat[:, 2].astype("<u4").tobytes(), b"".join(names[i] for i in used.tolist()),
    )
    return tuple(map(zstandard.ZstdCompressor(3).compress, columns))


def read_run(columns: tuple[bytes, ...]) -> tuple[bytes, ...]:
    return tuple(map(zstandard.ZstdDecompressor().decompress, columns))


class LoserTree:
    """Merges front-coded runs. Every key in the tree knows its common prefix with the last winner: the longer one is the
    smaller key, and only equally long ones are compared, from there on."""

    def __init__(self, runs: list[tuple[bytes, ...]]):
        self.k = 1 << (len(runs) - 1).bit_length() if len(runs) > 1 else 1
        self.lcps = [r[0] for r in runs] + [b""] * (self.k - len(runs))
        self.sizes = [r[1] for r in runs] + [b""] * (self.k - len(runs))
        self.tails = [r[2] for r in runs] + [b""] * (self.k - len(runs))
        self.next = [0] * self.k  # number of the run's next key
        self.offset = [0] * self.k
        self.key: list[bytes | None] = [None] * self.k
        self.common = [0] * self.k
        for i in range(self.k):
            self._advance(i)
        self.loser = [0] * self.k
        self.loser[0] = self._play(1)

    def _advance(self, i: int) -> None:
        n = self.next[i]
        if n >= len(self.lcps[i]):
            self.key[i], self.common[i] = None, -1
            return
        lcp = self.lcps[i][n]
        end = self.offset[i] + self.sizes[i][n] - lcp
        self.key[i] = (self.key[i] or b"")[:lcp] + self.tails[i][self.offset[i] : end]
        self.common[i] = lcp
        self.offset[i], self.next[i] = end, n + 1

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's key comes before run b's; the loser then knows its common prefix with the other."""
        x, y = self.common[a], self.common[b]
        if x != y:
            return x > y
        p, q = self.key[a], self.key[b]
        if p is None:
            return True
        n, most = x, min(len(p), len(q))
        if p[n:most] == q[n:most]:
            n = most
        else:
            while p[n] == q[n]:
                n += 1
        wins = len(p) <= len(q) if n == most else p[n] < q[n]
        self.common[b if wins else a] = n
        return wins

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        """``(key, common prefix with the key before, run, number within the run)`` in order."""
        win, k, loser, beats = self.loser[0], self.k, self.loser, self._beats
        while self.key[win] is not None:
            yield self.key[win], self.common[win], win, self.next[win] - 1
            self._advance(win)
            node = (win + k) // 2
            while node:
                other = loser[node]
                if beats(other, win):
                    loser[node], win = win, other
                node //= 2


def _strings(key: bytes) -> list[tuple[int, bytes]]:
    """The 50-byte strings that a key stands for, with how far before the anchor each starts."""
    right, _, left = key.partition(MARK)
    return [(o, left[len(left) - o :] + right[: LENGTH - o]) for o in range(LENGTH - len(right), len(left) + 1)]


def repeats(runs: list[tuple[bytes, ...]]) -> dict[bytes, list[tuple[int, int]]]:
    """For each text (by name) the ranges of places at which a repeated string starts."""
    ids = [np.frombuffer(r[3], "<i8").tolist() for r in runs]
    where = []
    for r in runs:
        key, doc, at = (np.frombuffer(r[c], "<u4") for c in (4, 5, 6))
        cut = np.searchsorted(key, np.arange(len(r[0]) + 1)).tolist()
        where.append((cut, doc.tolist(), at.tolist(), r[7]))
    out: dict[bytes, list[tuple[int, int]]] = {}

    def holders(run: int, n: int) -> Iterator[tuple[bytes, int]]:
        cut, doc, at, names = where[run]
        for i in range(cut[n], cut[n + 1]):
            yield names[16 * doc[i] : 16 * doc[i] + 16], at[i]

    def close(group: list[tuple[bytes, list[tuple[int, int, int]]]]) -> None:
        """``group``: the different keys of one anchor, each with its (id, run, number) entries."""
        if len(group) == 1 and len(group[0][1]) == 1:
            return
        low = [min(e)[0] for _, e in group]
        best: dict[bytes, int] = {}
        if len(group) > 1:
            strings = [_strings(k) for k, _ in group]
            for own, id_ in zip(strings, low, strict=True):
                for _, text in own:
                    if best.get(text, LAST) >= id_:
                        best[text] = id_
        for g, (key, entries) in enumerate(group):
            left = len(key) - key.index(MARK) - 1
            first = LENGTH - (len(key) - left - 1)
            for id_, run, n in entries:
                if id_ > low[g]:
                    ranges = [(first, left)]
                elif best:
                    ranges = []
                    for o, text in strings[g]:
                        if best[text] < id_:
                            if ranges and ranges[-1][1] == o - 1:
                                ranges[-1] = (ranges[-1][0], o)
                            else:
                                ranges.append((o, o))
                else:
                    continue
                if ranges:
                    for name, at in holders(run, n):
                        out.setdefault(name, []).extend((at - b, at - a) for a, b in ranges)

    group: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    for key, common, run, n in LoserTree(runs):
        entry = (ids[run][n], run, n)
        if common < ANCHOR:
            if group:
                close(group)
            group = [(key, [entry])]
        elif common == len(key) == len(group[-1][0]):
            group[-1][1].append(entry)
        else:
            group.append((key, [entry]))
    if group:
        close(group)
    return out


def _ranges(found: dict[bytes, list[tuple[int, int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.binary()), pa.array([np.array(r, "<i4").tobytes() for r in found.values()], pa.binary())], ["name", "ranges"]
    )


def _by_bucket(found: dict[bytes, bytes], buckets: int) -> pa.RecordBatch:
    """The ranges of texts, packed: a row for each bucket of texts, since a text's anchors lie in very many bins."""
    packed: dict[int, list[bytes]] = {}
    for name in found:
        packed.setdefault(int.from_bytes(name[:8], "big") % buckets, []).append(name)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(packed), pa.int64()),
            pa.array([b"".join(names) for names in packed.values()], pa.binary()),
            pa.array([np.array([len(found[n]) for n in names], "<u4").tobytes() for names in packed.values()], pa.binary()),
            pa.array([b"".join(found[n] for n in names) for names in packed.values()], pa.binary()),
        ],
        ["bucket", "names", "sizes", "ranges"],
    )


def sort_task(rows: list[tuple[int, bytes, bytes]], bits: int, filled: np.ndarray, width: int, bins: int):
    """``rows``: (id, name, text). Gives the runs by bin, and the repeats that are known already."""
    known: dict[bytes, list] = {}
    local: dict[bytes, list[tuple[int, int]]] = {}
    ids, names = [r[0] for r in rows], [r[1] for r in rows]
    for at, block in _blocks([r[2] for r in rows]):
        h, doc, place, low, high = anchors(block)
        if not len(h):
            continue
        one, two = _slots(h & np.uint64(2**32 - 1), width)
        bitmap = _shard(h, bits)
        keep = np.flatnonzero(filled[bitmap, one >> 3] >> (7 - (one & 7)) & filled[bitmap, two >> 3] >> (7 - (two & 7)) & 1)
        where = (h[keep] >> np.uint64(20)) % np.uint64(bins)
        for d, a, x, y, b in zip(doc[keep].tolist(), place[keep].tolist(), low[keep].tolist(), high[keep].tolist(), where.tolist(), strict=True):
            text = block[d]
            d += at
            key = text[a : y + LENGTH] + MARK + text[x:a]
            entry = known.get(key)
            if entry is None:
                known[key] = [ids[d], [(d, a)], b]
            elif ids[d] > entry[0]:
                local.setdefault(names[d], []).append((x, y))
            elif ids[d] == entry[0]:
                entry[1].append((d, a))
            else:
                for other, place_of in entry[1]:
                    local.setdefault(names[other], []).append((place_of - a + x, place_of - a + y))
                entry[0], entry[1] = ids[d], [(d, a)]
    by_bin: dict[int, list[bytes]] = {}
    for key, entry in known.items():
        by_bin.setdefault(entry[2], []).append(key)
    runs = []
    for b, keys in by_bin.items():
        keys.sort()
        runs.append((b, *make_run(keys, [known[k][0] for k in keys], [known[k][1] for k in keys], names)))
    return runs, local


def covered(size: int, ranges: np.ndarray) -> list[tuple[int, int]]:
    """The spans of bytes that strings starting in ``ranges`` cover, end exclusive, maximal."""
    out: list[tuple[int, int]] = []
    for low, high in ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].tolist():
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + LENGTH))
        else:
            out.append((low, high + LENGTH))
    return out


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, ranges, copies)``: the rows as ``_id``, ``name`` (digest of id and text) and ``t`` (the text's bytes); the
    ranges of places at which repeated strings start, by name; the names of rows that are copies as a whole."""
    s = settings
    t = F.encode(whole(f"`{text_col}`"), "UTF-8")
    id_ = F.col(f"`{id_col}`")
    rows = docs.select(
        id_.alias("_id"), F.coalesce(id_.cast("long"), F.lit(LAST)).alias("order"),
        F.unhex(F.md5(F.concat(F.encode(F.coalesce(id_.cast("string"), F.lit("-")), "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), t))).alias("name"), t.alias("t"),
    )
    narrow = saved(rows.select("order", "name", F.unhex(F.md5("t")).alias("txt")))
    total = narrow.count()
    firsts = saved(narrow.groupBy("txt").agg(F.min("order").alias("low"), F.max("order").alias("top")).filter("top > low"))
    copies = saved(narrow.join(firsts, "txt").filter(F.col("order") > F.col("low")).select("name").distinct())
    marked = mark_possible_members(rows, copies, "name", "_may")
    may = marked.filter("_may").join(copies, "name", "left_anti").select("order", "name", "t")
    texts = marked.filter("NOT _may").select("order", "name", "t").unionByName(may)
    shared = repeated_anchors(texts.select("t"), total, s)
    bins = max(1, total // s.texts_a_bin)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, filled, width = shared.value
        names = [c.split()[0] for c in RUN]
        for buffer in _buffers(batches, 2, s.buffer):
            runs, local = sort_task(buffer, bits, filled, width, bins)
            for at in range(0, len(runs), 64):
                columns = [pa.array(c) for c in zip(*runs[at : at + 64], strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *(c.cast(pa.binary()) for c in columns[1:])], names)
            if local:
                found = _ranges(local)
                none = pa.nulls(found.num_rows, pa.binary())
                # What is known already goes along with the runs, spread over as many bins below zero.
                bin_ = pa.array([-1 - name[0] % bins for name in local], pa.int64())
                yield pa.RecordBatch.from_arrays([bin_, *[none] * 6, found.column(1), found.column(0)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bin_, own in _grouped(batches):
            if bin_ < 0:
                found: dict[bytes, list[bytes]] = {}
                for row in own:
                    found.setdefault(row[7], []).append(row[6])
                yield _by_bucket({n: b"".join(r) for n, r in found.items()}, bins)
            elif found := repeats([read_run(r) for r in own]):
                yield _by_bucket({n: np.array(r, "<i4").tobytes() for n, r in found.items()}, bins)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches):
            found: dict[bytes, list[bytes]] = {}
            for names, sizes, ranges in own:
                end = 0
                for k, size in enumerate(np.frombuffer(sizes, "<u4").tolist()):
                    found.setdefault(names[16 * k : 16 * k + 16], []).append(ranges[end : end + size])
                    end += size
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([b"".join(r) for r in found.values()], pa.binary())], ["name", "ranges"])

    dealt = map_arrow(texts, sort, ", ".join(RUN)).repartition("bin").sortWithinPartitions("bin")
    merged = map_arrow(dealt, merge, "bucket bigint, names binary, sizes binary, ranges binary")
    ranges = map_arrow(merged.repartition("bucket").sortWithinPartitions("bucket"), gather, "name binary, ranges binary")
    return rows, saved(ranges), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that are left (a
    cut may fall inside a character), with ``digests`` their ``kept_sha256`` instead. Texts without a repeat are not shuffled."""
    rows, ranges, copies = find_repeats(docs, id_col, text_col, settings)
    what = saved(ranges.select("name", "ranges", F.lit(False).alias("copy")).unionByName(copies.select("name", F.lit(None).cast("binary").alias("ranges"), F.lit(True).alias("copy"))))
    marked = mark_possible_members(rows, what, "name", "_may").select("_id", "name", "t", "_may")
    hit = marked.filter("_may").join(what, "name", "left").select("_id", "t", "ranges", "copy")
    clean = marked.filter("NOT _may").select("_id", "t", F.lit(None).cast("binary").alias("ranges"), F.lit(False).alias("copy"))
    last = ("kept_sha256", "string") if digests else ("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1024):
            out = []
            for text, ranges, copy in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                spans = []
                if copy:
                    spans = [(0, len(text))] if len(text) >= LENGTH else []
                elif ranges:
                    spans = covered(len(text), np.frombuffer(ranges, "<i4").reshape(-1, 2))
                ends = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digests else kept))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", "n_bytes", "n_removed", "n_spans", last[0]])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, {last[0]} {last[1]}"
    return map_arrow(clean.unionByName(hit), cut, schema).withColumnRenamed("_id", id_col)
