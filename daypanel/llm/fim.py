"""Fill-in-the-middle texts, cut with a learned index from code points to bytes.

A text is cut at two of its code points and its parts are written in another order behind marks. Texts stay the UTF-8
bytes that Arrow holds; to cut them, the place of a code point among the bytes must be known. ``RankIndex`` learns it:
all boundary offsets of a text are covered by straight segments, each as long as every offset lies within ``error``
bytes of it, and what the segment is off by is stored for each boundary (one byte; nothing where a segment is exact, as
in plain ASCII). A cut predicts its byte by the segment that its rank falls into and adds the stored residual, so it is
exact, whatever the segments.

A row is all that a task needs: nothing is shuffled. Texts are read a piece of ``PIECE`` bytes at a time, so the index
of a text takes a byte for each of its characters and no more, however long it is.

Defined cases: null counts as empty; an empty text, and one that holds a mark, is left plain, as are those of
the share ``Shares.plain``; rows are independent, so repeated rows, and rows that share an id, get equal results; a null id hashes
as the empty word; columns of the result's names are replaced, others are carried along. Texts are valid UTF-8, as
Spark's are; other bytes count as a boundary wherever they do not continue a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import chunks, map_arrow, whole

#: how far a boundary may lie from its segment: what one signed byte holds
ERROR = 120
PIECE = 1 << 20
FIRST_WINDOW = 256


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Shares:
    """Of a hundred texts: how many are left plain; of the others, how many have the suffix first."""

    plain: int = 10
    suffix_first: int = 20


class RankIndex:
    """The byte at which each code point of a text begins, the end of the text included, by line segments."""

    def __init__(self, text: np.ndarray, error: int = ERROR, piece: int = PIECE):
        if not 0 <= error <= ERROR:
            raise ValueError(f"residuals are kept in a byte: error must be from 0 to {ERROR}")
        self._error = error
        # A segment: its first rank and byte, its slope, and its residuals, None where all are 0.
        self._ranks: list[int] = []
        self._bytes: list[int] = []
        self._slopes: list[float] = []
        self._residuals: list[np.ndarray | None] = []
        rank = 0
        for at in range(0, len(text), piece):
            part = text[at : at + piece]
            starts = np.flatnonzero((part & 0xC0) != 0x80)
            if len(starts) == len(part):
                self._add(rank, at, 1.0, None)
            else:
                self._fit(rank, starts + at)
            rank += len(starts)
        self.size = rank
        self._add(rank, len(text), 0.0, None)
        self._first = np.array(self._ranks)

    def _add(self, rank: int, byte: int, slope: float, residuals: np.ndarray | None) -> None:
        self._ranks.append(rank)
        self._bytes.append(byte)
        self._slopes.append(slope)
        self._residuals.append(residuals)

    def _fit(self, rank: int, offsets: np.ndarray) -> None:
        """Segments over the offsets of consecutive ranks. A segment starts at an offset; each further one narrows the
        cone of slopes that keep within the error of all so far, and the first that leaves no slope starts the next."""
        at, n = 0, len(offsets)
        while at < n:
            low, high, end, window, x0, y0 = 0.0, np.inf, at + 1, FIRST_WINDOW, at, int(offsets[at])
            while end < n:
                y = (offsets[end : end + window] - y0).astype(np.float64)
                x = np.arange(end - x0, end - x0 + len(y), dtype=np.float64)
                lows = np.maximum.accumulate(np.maximum((y - self._error) / x, low))
                highs = np.minimum.accumulate(np.minimum((y + self._error) / x, high))
                good = int(np.searchsorted(lows > highs, True))  # once empty, a cone stays so
                if good:
                    low, high, end = float(lows[good - 1]), float(highs[good - 1]), end + good
                if good < len(y):
                    break
                window *= 2
            slope = 1.0 if end == at + 1 else (low + high) / 2
            own = offsets[at:end] - y0 - np.floor(np.arange(end - at) * slope).astype(np.int64)
            # The floor may add one byte to the error.
            self._add(rank + at, y0, slope, own.astype(np.int8) if own.any() else None)
            at = end

    def byte(self, rank: int) -> int:
        """Where the code point of this rank begins."""
        k = int(np.searchsorted(self._first, rank, "right")) - 1
        # An empty text has its end alone.
        past, residuals = rank - self._ranks[k], self._residuals[k]
        predicted = self._bytes[k] + int(np.floor(past * self._slopes[k]))
        return predicted if residuals is None else predicted + int(residuals[past])

    @property
    def segments(self) -> int:
        return len(self._ranks) - 1


def _draws(id_col: str, seed: str) -> list[Column]:
    """Four numbers below 2**32 for an id: the first groups of eight digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", marks: Marks = Marks(), shares: Shares = Shares(), error: int = ERROR
) -> DataFrame:
    """``docs`` with ``fim_text``, ``form`` (plain, psm, spm), ``n`` code points and ``prefix_chars`` and
    ``middle_chars``, null where the form is plain. ``restored`` gives the text back from the first two."""
    new = ("fim_text", "form", "n", "prefix_chars", "middle_chars")
    text = whole(f"`{text_col}`")
    first, second, form, order = _draws(id_col, seed)
    held = F.lit(False)
    for mark in marks.all():
        held = held | F.contains(text, F.lit(mark))
    plain = (text == "") | held | (form % 100 >= 100 - shares.plain)
    kind = F.when(plain, "plain").when(order % 100 < shares.suffix_first, "spm").otherwise("psm")
    others = [c for c in docs.columns if c.lower() not in new]
    names = {c: f"c{i}" for i, c in enumerate(others)}
    rows = docs.select(
        *(F.col(f"`{c}`").alias(x) for c, x in names.items()),
        first.alias("first"), second.alias("second"), kind.alias("form"), text.cast("binary").alias("t"),
    )
    prefix, suffix, middle = (m.encode() for m in marks.all())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 256):
            *carried, firsts, seconds, forms, texts = batch.columns
            out, sizes, prefixes, middles = [], [], [], []
            for a, b, own, t in zip(firsts.to_pylist(), seconds.to_pylist(), forms.to_pylist(), texts, strict=True):
                raw = t.as_buffer()
                view = memoryview(raw)
                index = RankIndex(np.frombuffer(raw, np.uint8) if raw.size else np.zeros(0, np.uint8), error)
                n = index.size
                sizes.append(n)
                if own == "plain":
                    out.append(view.tobytes())
                    prefixes.append(None)
                    middles.append(None)
                    continue
                low, high = sorted((a % (n + 1), b % (n + 1)))
                p, m = index.byte(low), index.byte(high)
                head, body, tail = view[:p], view[p:m], view[m:]
                parts = (prefix, head, suffix, tail, middle, body) if own == "psm" else (suffix, tail, prefix, head, middle, body)
                out.append(b"".join(parts))
                prefixes.append(low)
                middles.append(high - low)
            yield pa.RecordBatch.from_arrays(
                [*carried, pa.array(out, pa.binary()), forms, *(pa.array(x, pa.int64()) for x in (sizes, prefixes, middles))],
                [*batch.schema.names[: len(carried)], *new],
            )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]]
    done = map_arrow(rows, run, ", ".join([*fields, "fim_text binary, form string, n bigint, prefix_chars bigint, middle_chars bigint"]))
    return done.withColumn("fim_text", F.col("fim_text").cast("string")).toDF(*others, *new)


def restored(text: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text from what ``transform`` made of it. No text with a mark in it is cut, and a mark neither begins nor ends
    inside another, so the first of each kind is the one that was written."""
    first, second = (F.when(form == "psm", F.lit(a)).otherwise(F.lit(b)) for a, b in ((marks.prefix, marks.suffix), (marks.suffix, marks.prefix)))
    body = F.substring(text, F.char_length(first) + 1, F.char_length(text))
    head = F.split_part(body, second, F.lit(1))
    rest = F.substring(body, F.char_length(head) + F.char_length(second) + 1, F.char_length(body))
    tail = F.split_part(rest, F.lit(marks.middle), F.lit(1))
    middle = F.substring(rest, F.char_length(tail) + len(marks.middle) + 1, F.char_length(rest))
    return F.when(form == "plain", text).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
