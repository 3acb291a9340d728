"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model reads UTF-16 units, four at a time: any character of any script as it is (two units beyond the first 65,536), so
an n-gram is a 64-bit number and the model grows with what the texts hold. Everything comes from joins of count tables that
Spark deals out by n-gram and by context: counts of all trusted text, pre-aggregated in each task; continuation counts of
the lower orders, each the number of different n-grams of the order above; for each context its total and what is cut from
its n-grams; and the discounts, from the counts of counts of each order. N-grams that only texts to be scored have stand
in these tables with a count of 0, so the same joins, from the lowest order up, give each of them its probability.

Scoring joins again: rows are dealt out in blocks of some 8 million units (``BLOCK``), a block asks once for each n-gram
that its texts have, the questions are joined with the probabilities by n-gram, and the answers go to the block, where the
logarithms are added up for each text. Neither the driver nor any task holds more of the model than one block asks for. A
block's texts travel once, compressed.

A language's threshold is a quantile of the perplexities of its own trusted texts, over all of them. A text that a model
was trained on looks better than it is, so trusted texts are dealt into two halves by a hash of the text, and each is read
for this by the model of the other half.

Defined cases: null and empty texts have the perplexity 64 and are not kept; under a model without any text every text has
the perplexity 64; U+0000 is read like the start of a text; texts of any length are read in pieces; a language (null is
one, too) without trusted text uses the quantile over all trusted texts, and without any a text is kept; several labels of
an id trust it if one does; repeated rows are scored alike; columns of the result's names are replaced.

``fit`` gives the model over a small alphabet, letters in 64 classes, as whole tables; no query uses it.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.bloom import mark_possible_members
from daypanel.llm.common import chunks, map_arrow, saved, whole

CLASSES = 64
BITS = 6
ORDER = 4
# Classes of single characters; class 0 is the start of a text.
SINGLE = string.ascii_lowercase + " \n" + ".,;:!?'\"-()|#$%&*/@<"
DIGIT, SPACE, OTHER = len(SINGLE) + 1, SINGLE.index(" ") + 1, len(SINGLE) + 2
#: n-grams that are looked at together, n-grams that a task gathers before it sorts them, units of a block, different n-grams
#: after which a block or a task's counts are closed early
PIECE, GATHERED, BLOCK, MOST = 2**20, 2**22, 2**23, 2**21
#: of each half and of both
MODELS = (0, 1, 2)


@dataclass(frozen=True)
class Settings:
    quantile: float = 0.995
    margin: float = 1.1  # times the quantile: texts like the trusted ones may be a little above all of them
    accuracy: int = 10_000  # of the quantile: its rank is right to one part in so many


def _classes() -> np.ndarray:
    """The class of every code point below 2**16; further ones are taken modulo that."""
    table = np.array([OTHER + zlib.crc32(chr(c).encode("utf-16-le", "surrogatepass")) % (CLASSES - OTHER) for c in range(2**16)], np.uint8)
    for c in range(2**16):
        x = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(x) == 1 and x in SINGLE:
            table[c] = SINGLE.index(x) + 1
        elif x.isdigit():
            table[c] = DIGIT
        elif x.isspace():
            table[c] = SPACE
        elif len(x) == 1 and x != chr(c):
            table[c] = table[ord(x) % 2**16]
    return table


class Reader:
    """Letters in 64 classes."""

    bits, size = BITS, CLASSES

    def __init__(self):
        self.table = _classes()

    def letters(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4") & 0xFFFF]

    def parts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The n-grams that end at each letter of the texts, some ``PIECE`` at a time: the rows of the texts, the n-grams, and
        how many each of the rows has. A long text has several parts."""
        rows, waiting, held = [], [], 0
        for row, text in enumerate(texts):
            x = np.concatenate([np.zeros(ORDER - 1, np.uint16), self.letters(text)])
            for at in range(0, len(x) - ORDER + 1, PIECE):
                rows.append(row)
                waiting.append(x[at : at + PIECE + ORDER - 1])
                held += len(waiting[-1])
                if held >= PIECE:
                    yield self._part(rows, waiting)
                    rows, waiting, held = [], [], 0
        if rows:
            yield self._part(rows, waiting)

    def _part(self, rows: list[int], waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in waiting])
        x = np.concatenate(waiting).astype(np.uint64)
        gram = np.zeros(len(x) - ORDER + 1, np.uint64)
        for k in range(ORDER):
            gram = gram << np.uint64(self.bits) | x[k : k + len(gram)]
        # Of what reaches over from one text to the next, nothing stays.
        ends, starts = np.ones(len(x), bool), np.cumsum(sizes) - sizes
        for k in range(ORDER - 1):
            ends[starts + k] = False
        return np.array(rows), gram[ends[ORDER - 1 :]], sizes - (ORDER - 1)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that end at each letter of the texts, and how many each text has."""
        found, sizes = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
        for rows, gram, n in self.parts(texts):
            found.append(gram)
            np.add.at(sizes, rows, n)
        return np.concatenate(found), sizes


class UnitReader(Reader):
    """UTF-16 units."""

    bits, size = 16, 2**16

    def __init__(self):
        pass

    def letters(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


class _Tally:
    """Different n-grams, and how often each is in texts of the first half and of the second."""

    def __init__(self):
        self.gram, self.n, self.waiting, self.held = np.zeros(0, np.uint64), np.zeros((2, 0)), [], 0

    def add(self, gram: np.ndarray, half: np.ndarray) -> None:
        self.waiting.append((gram, half))
        self.held += len(gram)
        if self.held >= GATHERED:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        gram, half = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        grams, counted = [self.gram], [self.n]
        for k in (-1, 0, 1):
            seen, n = np.unique(gram[half == k], return_counts=True)
            grams.append(seen)
            counted.append(np.stack([n * float(k == j) for j in (0, 1)]))
        self.gram, at = np.unique(np.concatenate(grams), return_inverse=True)
        self.n = np.stack([np.bincount(at, np.concatenate([x[j] for x in counted]), len(self.gram)) for j in (0, 1)])
        self.waiting, self.held = [], 0

    def rows(self) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.gram.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in self.n)], ["gram", "n0", "n1"])


def counts(texts: DataFrame, reader: type[Reader] = UnitReader) -> DataFrame:
    """``(gram, n0, n1)`` of the highest order over all texts, the counts in either half; ``texts`` has two columns, the text
    and the half, 0 or 1, that it is in. Texts of half -1 count for nothing; their n-grams are listed. Each task adds up
    its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, tally = reader(), _Tally()
        for batch in chunks(batches, 128):
            half = batch.column(1).to_numpy().astype(np.int8)
            for rows, gram, n in read.parts(batch.column(0).to_pylist()):
                tally.add(gram, np.repeat(half[rows], n))
                if len(tally.gram) >= MOST:
                    yield tally.rows()
                    tally = _Tally()
        yield tally.rows()

    return map_arrow(texts, run, "gram bigint, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _cuts(n: list[int]) -> list[float]:
    """What is cut from n-grams that occur once, twice and more often, from how many occur one to four times."""
    n1, n2, n3, n4 = (max(1, k) for k in n)
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return [max(0.1, min(k - 0.1, d)) for k, d in zip((1, 2, 3), found, strict=True)]


def probabilities(counted: DataFrame, reader: type[Reader] = UnitReader) -> dict[int, DataFrame]:
    """For each order ``gram`` and, by model (of the first half, the second and both), ``p``, the probability of the last
    letter behind the others, and ``rest``, the share of the n-gram's context that goes to the order below; 1 for a
    context that the model has not seen. ``counted`` is of the highest order (see ``counts``); the lower orders have what
    its n-grams end in."""
    levels = {ORDER: saved(counted.select("gram", "n0", "n1", (F.col("n0") + F.col("n1")).alias("n2")))}
    for order in range(ORDER - 1, 0, -1):
        # How many different letters stand before an n-gram.
        low = F.col("gram").bitwiseAND(F.lit((1 << reader.bits * order) - 1))
        levels[order] = saved(levels[order + 1].groupBy(low.alias("gram")).agg(*(F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}") for m in MODELS)))
    done: dict[int, DataFrame] = {}
    for order, level in sorted(levels.items()):
        n = [F.col(f"n{m}") for m in MODELS]
        occur = level.agg(*(F.count_if(n[m] == k).alias(f"m{m}_{k}") for m in MODELS for k in (1, 2, 3, 4)), *(F.count_if(n[m] > 0).alias(f"any{m}") for m in MODELS)).first()
        cut = []
        for m in MODELS:
            of = [F.lit(x) for x in _cuts([occur[f"m{m}_{k}"] for k in (1, 2, 3, 4)])]
            cut.append(F.least(F.when(n[m] <= 1, of[0]).when(n[m] == 2, of[1]).otherwise(of[2]), n[m].cast("double")))
        own = level.withColumn("context", F.shiftrightunsigned("gram", reader.bits))
        sums = [F.sum(x).alias(f"{name}{m}") for m in MODELS for name, x in (("total", n[m]), ("left", cut[m]))]
        own = own.join(own.groupBy("context").agg(*sums), "context")
        if order == 1:
            lower = [F.lit(1 / (reader.size if occur[f"any{m}"] else CLASSES)) for m in MODELS]
        else:
            below = done[order - 1].select(F.col("gram").alias("low"), *(F.col(f"p{m}").alias(f"lower{m}") for m in MODELS))
            own = own.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << reader.bits * (order - 1)) - 1))).join(below, "low")
            lower = [F.col(f"lower{m}") for m in MODELS]

        def share(m: int, x: Column, unseen: float) -> Column:
            return F.when(F.col(f"total{m}") > 0, x / F.col(f"total{m}")).otherwise(F.lit(unseen))

        rest = [share(m, F.col(f"left{m}"), 1.0) for m in MODELS]
        p = [share(m, n[m] - cut[m], 0.0) + rest[m] * lower[m] for m in MODELS]
        done[order] = saved(own.select("gram", *(p[m].alias(f"p{m}") for m in MODELS), *(rest[m].alias(f"rest{m}") for m in MODELS)))
    return done


def table(levels: dict[int, DataFrame], model: int) -> np.ndarray:
    """The logarithm of the probability of every n-gram of letters in 64 classes, listed or not: 64**4 values, filled from
    the lowest order up."""
    below = np.full(1, 1.0 / CLASSES, np.float32)
    for order in range(1, ORDER + 1):
        rows = levels[order].select("gram", F.col(f"p{model}").alias("p"), F.col(f"rest{model}").alias("rest")).orderBy("gram").toArrow()
        gram, p, rest = (rows.column(c).to_numpy() for c in ("gram", "p", "rest"))
        share = np.ones(CLASSES ** (order - 1), np.float32)
        share[gram >> BITS] = rest
        # The n-grams of one first letter at a time; what they need of the order below is all of it.
        own = CLASSES ** (order - 1)
        full = np.empty(CLASSES * own, np.float16 if order == ORDER else np.float32)
        for first in range(CLASSES):
            contexts = share if order == 1 else share[first * own // CLASSES : (first + 1) * own // CLASSES]
            part = below.copy() * (contexts if order == 1 else np.repeat(contexts, CLASSES))
            low, high = np.searchsorted(gram, [first * own, (first + 1) * own])
            part[gram[low:high] - first * own] = p[low:high]
            full[first * own : (first + 1) * own] = np.log(part) if order == ORDER else part
        below = full
    return below


def fit(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole tables of the first half, the second half and all of ``texts`` (see ``counts``), by letters in 64 classes."""
    levels = probabilities(counts(texts, Reader), Reader)
    return tuple(table(levels, m) for m in MODELS)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(body.as_buffer()).read_next_batch()


def _blocks(plain: DataFrame) -> DataFrame:
    """``(block, body, asks)``: the rows of ``plain``, whose last column is the text, packed, and a row for each block with
    the n-grams that its texts have."""

    def row(block: int, body: bytes | None, asks: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([body], pa.binary()), pa.array([asks], pa.binary())], ["block", "body", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, block, seen, size = UnitReader(), TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64), 0

        def asks() -> pa.RecordBatch:
            return row(block, None, _packed(pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], ["gram"])))

        for batch in chunks(batches, 128):
            for _, gram, _ in read.parts(batch.column(batch.num_columns - 1).to_pylist()):
                seen = np.unique(np.concatenate([seen, np.unique(gram)]))
                size += len(gram)
            yield row(block, _packed(batch), None)
            if size >= BLOCK or len(seen) >= MOST:
                yield asks()
                block, seen, size = block + 1, np.zeros(0, np.uint64), 0
        if size:
            yield asks()

    return map_arrow(plain, run, "block bigint, body binary, asks binary")


def perplexity(docs: DataFrame, logs: DataFrame, models: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` without the texts, with the perplexity of each text by unit under each of ``models``, in columns of their
    names; columns that have these names are replaced. ``models`` names the columns of ``logs`` with the logarithms of the
    probabilities; ``logs`` has a row for each ``gram`` of the texts."""
    names = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in (text_col, *models))}
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items()), whole(f"`{text_col}`").alias("t"))
    # Dealt out once: both readers below take all columns, so that Spark reuses the exchange.
    blocks = _blocks(plain).repartition("block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, asks in zip(batch.column(0), batch.column(2), strict=True):
                if asks.is_valid:
                    gram = _unpacked(asks).column(0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block.as_py())), gram], ["block", "gram"])

    asked = map_arrow(blocks, ask, "block bigint, gram bigint")
    answers = asked.join(logs.select("gram", *models.values()), "gram").select("block", "gram", *models.values())
    own = [f for f in plain.schema if f.name != "t"]
    new = [f"p{k}" for k in range(len(models))]
    logs_of = list(models.values())

    def score(rows: pa.Table, table: pa.Table) -> pa.Table:
        read, gram = UnitReader(), table.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(gram)
        gram, log_p = gram[order], [table.column(c).to_numpy()[order] for c in logs_of]
        out = []
        for body in rows.column("body"):
            if not body.is_valid:
                continue
            batch = _unpacked(body)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total, sizes = np.zeros((len(log_p), len(texts))), np.zeros(len(texts), np.int64)
            for row, own_gram, n in read.parts(texts):
                at = np.searchsorted(gram, own_gram)
                if not (at < len(gram)).all() or not (gram[at] == own_gram).all():
                    raise ValueError("a block has n-grams that it has not asked for: its rows came in another order when they were read again")
                np.add.at(sizes, row, n)
                ends = np.cumsum(n)
                for k, log in enumerate(log_p):
                    summed = np.concatenate([[0.0], np.cumsum(log[at], dtype=np.float64)])
                    np.add.at(total[k], row, summed[ends] - summed[ends - n])
            values = [pa.array(np.where(sizes > 0, np.exp(-x / np.maximum(sizes, 1)), float(CLASSES))) for x in total]
            out.append(pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], [*batch.schema.names[:-1], *new]))
        return pa.Table.from_batches(out)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own] + [f"{p} double" for p in new])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema).toDF(*names, *models)


def _halves(own: DataFrame, known: DataFrame, half: Column) -> DataFrame:
    """Text and half of the rows of ``own``, -1 for those whose ``_id`` is not among ``known``. Texts are counted where they
    are read: a filter passes the rows that may be known, and a second one, of the few ids that the first passes wrongly,
    tells which of them are so for sure. Only rows that hit both are shuffled, and compared by id; those that are known
    come a second time, with their half."""
    ids = known.select(F.col("_good").alias("_id"))
    may = mark_possible_members(own, ids, "_id", "_may")
    wrong = saved(may.filter("_may").select("_id").distinct().join(ids, "_id", "left_anti"))
    marked = mark_possible_members(may, wrong, "_id", "_maybe_wrong")
    unsure = marked.filter("_may AND _maybe_wrong").join(known, F.col("_id") == F.col("_good"), "left_semi")
    sure = F.when(F.col("_may") & ~F.col("_maybe_wrong"), half).otherwise(F.lit(-1))
    return marked.select(whole("text").alias("text"), sure.alias("half")).unionByName(unsure.select(whole("text").alias("text"), half.alias("half")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the id, the language, ``trusted``, ``perplexity``, ``threshold`` and ``kept``.
    ``labels`` has the id and ``quality``, 1 for trusted text."""
    good = labels.filter("quality = 1").select(F.col(id_col).alias("_good")).distinct()
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), lang.alias("_lang"))
    known = saved(good.join(own.select("_id").distinct(), F.col("_good") == F.col("_id"), "left_semi"))
    half = F.pmod(F.xxhash64(whole("text")), F.lit(2)).cast("int")
    levels = probabilities(counts(_halves(own, known, half)))
    logs = saved(levels[ORDER].select("gram", *(F.log(f"p{m}").cast("float").alias(f"l{m}") for m in MODELS)))
    plain = own.select("_id", "_lang", "text", half.alias("half"), (whole("text") == "").alias("_empty"))
    scored = perplexity(plain, logs, {"perplexity": "l2", "by_first": "l0", "by_second": "l1"}).select(
        "_id", "_lang", "_empty", "perplexity", F.when(F.col("half") == 0, F.col("by_second")).otherwise(F.col("by_first")).alias("crossed")
    )
    marked = saved(saved(scored).join(known, F.col("_id") == F.col("_good"), "left").withColumn("trusted", F.col("_good").isNotNull()).drop("_good"))
    crossed = marked.filter(F.col("trusted") & ~F.col("_empty")).select("_lang", F.col("crossed").alias("perplexity"))
    at = F.percentile_approx("perplexity", F.lit(settings.quantile), F.lit(settings.accuracy))
    of_all = crossed.agg(at).first()[0]
    of_lang = crossed.groupBy(F.col("_lang").alias("_of")).agg(at.alias("_own"))
    out = marked.join(of_lang, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    threshold = F.coalesce(F.col("_own"), F.lit(of_all).cast("double")) * settings.margin
    return out.select(
        F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), "trusted", "perplexity", threshold.alias("threshold"),
        (F.coalesce(F.col("perplexity") <= threshold, F.lit(True)) & ~F.col("_empty")).alias("kept"),
    )
