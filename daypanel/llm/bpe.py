"""BPE encoding and decoding by an index of pair occurrences.

A vocabulary file in the format of the public tokenizers library (word-end BPE with a byte alphabet) is read once on
the driver; its text, of a fixed size, goes to the tasks. A task cuts its texts into words, and all words that it has
not met lately are merged together: every adjacent pair with a rank is indexed with all its places, ranks are taken in
ascending order from a heap, each merges all its places, and the pairs that this makes join the index. A word of n
bytes costs O(n log n), whatever its length. A worker holds the words of one block of texts and those that it remembers,
both bounded by bytes, so that its memory does not grow with the corpus; only a text longer than a block counts whole.

Defined cases: null and empty texts have no tokens; the control strings of the vocabulary in a text become their own
ids, as in the library; repeated rows are encoded alike; other columns can be kept by naming them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import blocks, map_arrow, ship, whole

#: bytes of each of the two generations of words that a worker keeps, about, and of a word besides what it says
REMEMBERED, WORD_BYTES = 24_000_000, 150
#: bytes of the texts that are encoded at once, or one text. Results depend on neither.
BLOCK = 400_000
# Fixed values of the vocabulary's own text rules: what counts as white space, and how texts are cut into words.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the rest for code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary, and the encoder and decoder over it."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        model, self.id_of = model["model"], model["model"]["vocab"]
        self.id_of |= self.special
        self.token_of = {i: t for t, i in self.id_of.items()}
        self.end = model["end_of_word_suffix"] or ""
        # pair of ids -> rank and id of the merged token; both pairs are packed into one number of 32 bits a part
        self.merges = {
            self.id_of[a] << 32 | self.id_of[b]: rank << 32 | self.id_of[a + b]
            for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        }
        letters = byte_alphabet()
        self.inner = [self.id_of.get(x, -1) for x in letters]
        self.last = [self.id_of.get(x + self.end, -1) for x in letters]
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self.word, self.ascii_word = regex.compile(WORD), re.compile(ASCII_WORD)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_word.findall(text.lower())
        # Lower case letter by letter: a capital sigma at a word's end is no exception.
        return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of the control strings in it."""
        if self.cut is None or "<|" not in text:
            return self.words(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words(part)
        return out

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        """The ids of each word, all words merged together over one index."""
        ids: list[int] = []
        after: list[int] = []  # place of the symbol behind, -1 at a word's end
        starts: list[int] = []
        inner, last, merges = self.inner, self.last, self.merges
        for word in words:
            raw = word.encode()
            symbols = [inner[b] for b in raw]
            symbols[-1] = last[raw[-1]]
            if -1 in symbols:
                symbols = [s for s in symbols if s >= 0]
            if symbols:
                at = len(ids)
                starts.append(at)
                ids += symbols
                after += range(at + 1, len(ids))
                after.append(-1)
            else:
                starts.append(-1)
        before = [-1] * len(ids)
        # The index: rank and merged id of an active pair -> its places; pair_of has the pair itself.
        places: dict[int, list[int]] = {}
        pair_of: dict[int, int] = {}
        find, at_rank = merges.get, places.get
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                pair = ids[i] << 32 | ids[j]
                found = find(pair)
                if found is not None:
                    at = at_rank(found)
                    if at is None:
                        places[found] = [i]
                        pair_of[found] = pair
                    else:
                        at.append(i)
        active = list(places)
        heapq.heapify(active)
        low = (1 << 32) - 1
        while active:
            rank = heapq.heappop(active)
            todo = places.pop(rank, None)
            if todo is None:
                continue
            a, b, both = pair_of[rank] >> 32, pair_of[rank] & low, rank & low
            todo.sort()
            for n, i in enumerate(todo):
                if ids[i] != a:
                    continue  # merged meanwhile
                j = after[i]
                if j < 0 or ids[j] != b:
                    continue
                ids[i] = both
                ids[j] = -1
                k = after[i] = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    found = find(pair := both << 32 | ids[k])
                    if found is not None:
                        at = at_rank(found)
                        if at is None:
                            places[found] = [i]
                            pair_of[found] = pair
                            heapq.heappush(active, found)
                        else:
                            at.append(i)
                        lower = found < rank
                h = before[i]
                if h >= 0:
                    found = find(pair := ids[h] << 32 | both)
                    if found is not None:
                        at = at_rank(found)
                        if at is None:
                            places[found] = [h]
                            pair_of[found] = pair
                            heapq.heappush(active, found)
                        else:
                            at.append(h)
                        lower = lower or found < rank
                if lower and n + 1 < len(todo):  # a lower rank has come up: it goes first
                    places[rank] = todo[n + 1 :]
                    heapq.heappush(active, rank)
                    break
        out = []
        for i in starts:
            own = []
            while i >= 0:
                own.append(ids[i])
                i = after[i]
            out.append(own)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding where a vocabulary names no decoder: tokens with a space between them."""
        return " ".join(map(self.token_of.__getitem__, ids))


class Encoder:
    """Encodes texts, remembering words: for each its ids and its decoded tokens, as text with spaces between them; if
    ``packed``, its ids alone, as bytes. When the words met lately are too many, they become the older ones: those that are
    met again come back, the others go with the next change."""

    def __init__(self, bpe: WordBpe, packed: bool = False):
        self.bpe, self.packed = bpe, packed
        self.ids: dict[str | int, str | bytes] = {}
        self.tokens: dict[str | int, str] = {}
        self.grow_old()

    def grow_old(self) -> None:
        """The words met lately become the older ones."""
        self.older = self.ids, self.tokens
        self.ids, self.tokens, self.held = {}, {}, 0
        self.silent: set[str | int] = set()  # words without a token
        for i in self.bpe.special.values():
            self._keep(i, *self._forms([i]))

    def _forms(self, ids: list[int]) -> tuple[str | bytes, str]:
        return (array("i", ids).tobytes(), "") if self.packed else (" ".join(map(str, ids)), self.bpe.decode(ids))

    def _keep(self, word: str | int, ids: str | bytes, tokens: str) -> None:
        self.ids[word] = ids
        self.held += WORD_BYTES + len(ids) + len(tokens)
        if not self.packed:
            self.tokens[word] = tokens
            if not ids:
                self.silent.add(word)

    def learn(self, texts: list[list[str | int]]) -> None:
        """Encodes the words of ``texts`` that are not known."""
        if self.held > REMEMBERED:
            self.grow_old()
        (ids, tokens), new = self.older, []
        for word in set().union(*texts).difference(self.ids):
            self.held += len(word)
            if word in ids:
                self._keep(word, ids[word], tokens.get(word, ""))
            else:
                new.append(word)
        for word, own in zip(new, self.bpe.encode_words(new), strict=True):
            self._keep(word, *self._forms(own))

    def written(self, words: list[str | int]) -> tuple[str, str]:
        """The ids of a text and its decoding; all words are known."""
        if self.silent:
            words = [w for w in words if w not in self.silent]
        return " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.tokens.__getitem__, words))

    def arrays(self, texts: list[list[str | int]]) -> pa.ListArray:
        """The ids of each text; all words are known, and the encoder is ``packed``."""
        packed = [b"".join(map(self.ids.__getitem__, words)) for words in texts]
        ends = np.cumsum([0, *map(len, packed)]) // array("i").itemsize
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(spec: str, packed: bool = False) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest(), packed
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(WordBpe(spec), packed)
    return _ENCODERS[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_tokens`` and ``ids`` (array<int>). ``path`` names the vocabulary file on the driver."""
    return _mapped(docs, path, text_col, keep, digests=False)


def encode_digests(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space) and
    ``decoded_sha256``, for checks of an encoding that need not move it."""
    return _mapped(docs, path, text_col, keep, digests=True)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give the empty text."""
    spec = _vocabulary(encoded, path)
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text_of(ids):
        bpe = _encoder(spec.value).bpe
        return ids.map(lambda x: "" if x is None else bpe.decode(int(i) for i in x))

    return encoded.withColumn(out, text_of(F.col(ids_col)))


def _mapped(docs: DataFrame, path: str, text_col: str, keep: tuple[str, ...], digests: bool) -> DataFrame:
    spec = _vocabulary(docs, path)
    kept = [F.col(f"`{c}`") for c in keep]
    own = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(kept)), whole(F.col(f"`{text_col}`")).alias("t"))
    schema = [(f"k{i}", own.schema[f"k{i}"].dataType.simpleString()) for i in range(len(keep))]
    schema += [("n_tokens", "bigint")] + (
        [("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("ids", "array<int>")]
    )

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, packed=not digests)
        for block in blocks(batches, len(keep), BLOCK):
            texts = [encoder.bpe.pieces(t) for t in block.column(len(keep)).to_pylist()]
            encoder.learn(texts)
            if digests:
                rows = [encoder.written(words) for words in texts]
                n = pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in rows], pa.int64())
                more = [pa.array([sha(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            else:
                more = [encoder.arrays(texts)]
                n = more[0].value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*block.columns[: len(keep)], n, *more], [name for name, _ in schema])

    mapped = map_arrow(own, run, ", ".join(f"{name} {kind}" for name, kind in schema))
    return mapped.toDF(*keep, *(name for name, _ in schema[len(keep) :]))
