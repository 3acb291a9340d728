import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daypanel.llm import fim
from daypanel.llm.fim import RankIndex, Shares

MIXED = "a" * 700 + "жé" * 300 + "漢字 🙂 x" * 200 + "é" + "b" * 900
ROWS = [
    (1, "plain words"), (2, None), (3, ""), (4, "é"), (5, "🙂"), (6, "has <M> inside"), (7, "<P"), (8, "S><M"), (9, MIXED), (9, MIXED),
    (None, "no id"), (10, "ends in <"), (11, "x" * 300_000 + "ж" * 300_000), (2**62, "large id"), (-5, "negative"),
    *((100 + k, f"täxt {k} <" + "ñ>" * (k % 7)) for k in range(60)),
]


def brute(doc_id, text, shares=Shares()):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - shares.plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < shares.suffix_first:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows_against_brute_force(table):
    docs = table(ROWS, more=("form", "c0", "fim_text", "t"))
    got = fim.transform(docs)
    assert got.columns == ["doc_id", "text", "c0", "t", "fim_text", "form", "n", "prefix_chars", "middle_chars"]
    rows = got.withColumn("back", fim.restored(got.fim_text, got.form)).collect()
    assert len(rows) == len(ROWS)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_other_shares_and_an_empty_table(table):
    got = fim.transform(table(ROWS), shares=Shares(plain=0, suffix_first=100))
    assert {r.form for r in got.collect() if r.text and "<M>" not in r.text} == {"spm"}
    assert fim.transform(table([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("aé漢🙂"), st.integers(1, 400)), max_size=12), st.integers(0, 120), st.integers(1, 700))
def test_every_boundary_is_exact(runs, error, piece):
    text = "".join(c * n for c, n in runs)
    raw = np.frombuffer(text.encode(), np.uint8)
    index = RankIndex(raw, error, piece)
    assert index.size == len(text)
    want = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert [index.byte(k) for k in range(len(text) + 1)] == want.tolist()


def test_segments_are_few_and_within_the_error():
    mixed = np.frombuffer(("naïve café — " * 20_000).encode(), np.uint8)
    index = RankIndex(mixed)
    assert index.segments < 20
    assert max(int(np.abs(r).max()) for r in index._residuals if r is not None) <= fim.ERROR
    assert RankIndex(np.frombuffer(b"ascii " * 1000, np.uint8)).segments == 1
    with pytest.raises(ValueError):
        RankIndex(mixed, error=200)
