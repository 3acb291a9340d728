import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from daypanel.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
PIECES = [
    "Hello", "'S", "'ll", "ΟΔΟΣ", "İ", "ﬁ", "é", "²", "٣", "日本語", "🎉", "<|startoftext|>", "<|endoftext|>", "<|other|>", "\x1c", "\x85", "​",
    " ", "\n", "a" * 300, "ǅ", "ẞ", "123", "###", "\x00", "re", "antidisestablishment", " ", "'", "-", "_", "ñandú",
]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", None, "x" * 50_000, "ab " * 30_000, *("".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(n))]


def test_ids_equal_the_library():
    encoder = bpe.Encoder(bpe.WordBpe(open(PATH, encoding="utf-8").read()))
    for text in texts(400):
        words = encoder.bpe.pieces(text or "")
        encoder.learn([words])
        ids, decoded = encoder.written(words)
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want
        assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


def test_spark_encodes_and_decodes(table):
    own = texts(40)
    docs = table(list(enumerate(own)) + [(0, own[0]), (None, "null id")])
    encoded = bpe.encode(docs, PATH, keep=("doc_id", "t", "c0"))
    assert encoded.columns == ["doc_id", "t", "c0", "n_tokens", "ids"]
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = LIBRARY.encode("null id" if r.doc_id is None else own[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), LIBRARY.decode(want, skip_special_tokens=False))


def test_digests(table):
    (row,) = bpe.encode_digests(table([(1, "The quick fox")]), PATH).collect()
    ids = LIBRARY.encode("The quick fox", add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_digests(table([]), PATH).count() == 0


def random_words(n, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n)]


def test_remembered_words_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100_000)
    encoder = bpe.Encoder(bpe.WordBpe(open(PATH, encoding="utf-8").read()))
    common = ["the", "\x1c", "fox", *encoder.bpe.pieces("<|endoftext|>")]
    for seed in range(12):
        words = random_words(20, 1_500, seed) + common
        encoder.learn([words])
        ids, decoded = encoder.written(words)
        want = [i for own in encoder.bpe.encode_words([w for w in words if isinstance(w, str)]) for i in own]
        want.append(common[-1])
        assert [int(i) for i in ids.split()] == want and decoded == encoder.bpe.decode(want)
    assert sum(map(len, encoder.ids.values())) < 200_000


def test_a_worker_holds_a_block_of_texts(spark, table, monkeypatch):
    """The function that the tasks run, over one batch of 1,000 texts whose words are met once: what it holds at once
    follows the block and what is remembered, not the batch."""
    run = []
    real = bpe.map_arrow
    monkeypatch.setattr(bpe, "map_arrow", lambda df, f, schema: run.append(f) or real(df, f, schema))
    bpe.encode(table([(1, "")]), PATH, keep=())
    monkeypatch.setattr(bpe, "REMEMBERED", 1_000_000)
    monkeypatch.setattr(bpe, "BLOCK", 100_000, raising=False)
    texts = [" ".join(random_words(60, 9, seed)) for seed in range(1_000)]
    batch = pa.record_batch([pa.array(texts)], ["t"])
    list(run[0](iter([batch.slice(0, 1)])))  # the vocabulary
    tracemalloc.start()
    found = [ids for out in run[0](iter([batch])) for ids in out.column(1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    assert [found[k].as_py() for k in (0, 700, 999)] == [LIBRARY.encode(texts[k], add_special_tokens=False).ids for k in (0, 700, 999)]
    assert len(found) == 1_000
