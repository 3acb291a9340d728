import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from daypanel.llm import suffix_dedup as sd


def brute(rows):
    """(id, text) -> the spans that go."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, sd.LAST), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append([(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randint(45, 160))) for _ in range(6)]
    rows = [(None, "a" * 120), (n, None), (n + 1, ""), (n + 2, "short"), (n + 3, "z" * 49), (n + 4, "z" * 50), (n + 5, "z" * 50), (n + 6, "z" * 300)]
    for i in range(n):
        own = "".join(rng.choice([*passages, *("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 60))) for _ in range(4))]) for _ in range(rng.randint(0, 7)))
        rows.append((rng.choice([i, i // 2]), own))
    return rows + rows[10:14]


def test_against_brute_force(table):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute([(sd.LAST if i is None else i, (t or "").encode()) for i, t in rows])
        expected = []
        for (i, t), spans in zip(rows, want, strict=True):
            raw = (t or "").encode()
            kept, at = b"", 0
            for a, b in spans:
                kept, at = kept + raw[at:a], b
            kept += raw[at:]
            expected.append((repr(i), len(raw), len(raw) - len(kept), len(spans), kept))
        small = sd.Settings(texts_a_shard=10, texts_a_bin=20, buffer=1500)
        got = sd.remove_repeats(table(rows).repartition(5), settings=small).collect()
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(expected)


def test_empty_table(table):
    assert sd.remove_repeats(table([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=12), max_size=15), min_size=1, max_size=7))
def test_loser_tree_merges_and_knows_common_prefixes(lists):
    runs = []
    for keys in lists:
        keys = sorted({k.encode() for k in keys})
        if keys:
            runs.append(sd.read_run(sd.make_run(keys, [0] * len(keys), [[(0, 0)]] * len(keys), [b"n" * 16])))
    if not runs:
        return
    got = list(sd.LoserTree(runs))
    assert [k for k, *_ in got] == sorted(k for own in lists for k in {x.encode() for x in own})
    for (a, *_), (b, common, *_) in zip(got, got[1:], strict=False):
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common == same


def test_every_string_of_50_bytes_has_an_anchor():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (49, 50, 51, 400, 0, 3000)] + [b"a" * 500]
    _, doc, at, low, high = sd.anchors(texts)
    for d, t in enumerate(texts):
        own = doc == d
        covered = [s for a, b in zip(low[own], high[own], strict=True) for s in range(a, b + 1)]
        assert covered == list(range(max(0, len(t) - 49)))
        assert ((at[own] >= high[own]) & (at[own] + sd.ANCHOR <= low[own] + sd.LENGTH)).all()
