import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from daypanel.llm import near_join as nj
from daypanel.llm.words import words


def brute(rows):
    """Class and number of links of every row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)].append(doc)
    return [(doc, min(low[find(i)], default=None), links[i]) for i, (doc, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(900, None), (901, ""), (902, "!!!"), (903, "one two"), (904, "One, two"), (905, "three"), (None, "one two"), (906, "w1 " * 20_000)]
    for group in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 2, 5, 60 if group == 3 else 9])):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6), " ".join(own)))
    return rows + rows[20:24]


def test_against_brute_force(table):
    rows = corpus()
    want, classes = brute(rows)
    got = nj.similar_classes(table(rows), settings=nj.Settings(block=7)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(want)
    docs = table(rows)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    of_class = defaultdict(list)
    for (doc, _), c in zip(rows, classes, strict=True):
        of_class[c].append(doc)
    assert ids == Counter(min(own, key=lambda d: (d is None, d or 0)) for own in of_class.values())


def test_empty_table(table):
    assert nj.similar_classes(table([])).count() == 0
    assert nj.keep_one(table([])).count() == 0


def test_pruning_drops_the_unlike_and_keeps_the_like():
    s = nj.Settings()
    least = nj.fewest_matches(s)
    rng = np.random.default_rng(1)
    n = s.bands * s.rows
    a = rng.integers(0, 2**32, (200, n), dtype=np.uint32)
    for similarity, kept in ((0.3, 0), (0.8, 200), (0.95, 200)):
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
        alive = nj.surviving(a, b, np.full(200, 50), np.full(200, 50), s, least)
        assert np.diag(alive).sum() == kept


def test_overlaps_by_products():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    pairs = np.array([(i, j) for i in range(12) for j in range(i)])
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    assert nj.overlaps(sets, pairs).tolist() == want
    assert nj.overlaps(sets, pairs[:3]).tolist() == want[:3]
