import math

import numpy as np
import pytest
from pyspark.sql import types as T

from daypanel.llm import codes
from daypanel.llm.codes import Settings


def lloyd(rows, settings):
    """Codebooks and (id, label, code, error) of (id, vector, label) rows, by comparing everything with everything."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return [[] for _ in range(settings.parts)], []
    longest = max(len(v) for _, v, _ in rows)
    own = -(-longest // settings.parts)
    rows = [(i, [math.floor(np.float32(x).item() * settings.scale) for x in v] + [0] * (own * settings.parts - len(v)), lab, v) for i, v, lab in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[: settings.entries]
    cut = lambda v, k: v[k * own : (k + 1) * own]
    books = [[cut(r[1], k) for r in first] for k in range(settings.parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), e) for e, m in enumerate(book))

    for _ in range(settings.rounds):
        for k in range(settings.parts):
            groups = {}
            for r in rows:
                groups.setdefault(nearest(cut(r[1], k), books[k])[1], []).append(cut(r[1], k))
            for e, members in groups.items():
                books[k][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, lab, _ in rows:
        best = [nearest(cut(v, k), books[k]) for k in range(settings.parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return books, out


def vectors(spark, rows):
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("id", "v", "code", "carried")),
    ])
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], schema)


def random_rows(n, width, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, width))
    return [(int(k), (centres[k % 7] + r.normal(size=width) * (0.3 if k % 3 else 0.002)).astype(np.float32).tolist(), int(k % 5) or None) for k in r.permutation(n)]


ODD = [
    (1000, None, 1), (1001, [], 2), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 1), (1004, [None] * 8, 3), (1005, [1.0, -2.0, 0.5], 3),
    (None, [0.1] * 8, None), (None, [0.1] * 8, 2), (1006, [0.1] * 8, 2), (1006, [0.1] * 8, 2), (1006, [-0.1] * 8, 2), *((2000 + k, [0.25] * 8, 4) for k in range(90)),
]


@pytest.mark.parametrize(
    ("rows", "settings"),
    [
        (random_rows(400, 8) + ODD, Settings(entries=16, block=64)),
        (random_rows(150, 10), Settings(entries=256, block=40)),  # fewer rows than entries, a length of 10
        (random_rows(60, 3) + ODD[:6], Settings(entries=5, parts=2, rounds=2, scale=100)),
        (ODD, Settings(entries=3)),
        ([(1, [], 1), (2, [], None)], Settings()),
    ],
)
def test_against_brute_force(spark, rows, settings):
    books, want = lloyd(rows, settings)
    got, found = codes.compress(vectors(spark, rows).repartition(3), settings=settings)
    assert found.tolist() == books
    got = codes.with_label_error(got)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    of_label = {}
    for _, lab, _, error in want:
        of_label[lab] = of_label.get(lab, 0) + error
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((*w, of_label[w[1]])) for w in want)


def test_errors_are_those_of_the_decoded_vectors(spark):
    rows = random_rows(120, 8)
    got, books = codes.compress(vectors(spark, rows), settings=Settings(entries=8))
    whole = {i: [math.floor(x * 1024) for x in v] for i, v, _ in rows}
    for r in got.collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(whole[r.vec_id], codes.decoded(books, r.code), strict=True))


def test_nothing_and_nothing_usable(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 1)]):
        got, books = codes.compress(vectors(spark, rows))
        assert codes.with_label_error(got).count() == 0 and codes.books_text(books) == ""


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    rows = random_rows(80, 8)
    got, _ = codes.compress(vectors(spark, rows), settings=Settings(entries=8))
    want = sorted(map(repr, codes.with_label_error(got).collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert sorted(map(repr, codes.with_label_error(got).collect())) == want


def test_huge_components_are_held(spark):
    rows = [(1, [3e38, -3e38, 0.0, 0.0], 1), (2, [0.0] * 4, 1), (3, [-3e38, 3e38, 3e38, -3e38], 1)]
    got, _ = codes.compress(vectors(spark, rows), settings=Settings(entries=1, rounds=0))
    errors = {r.vec_id: r.error for r in got.collect()}
    most = codes.bound(4)
    assert errors == {1: 0, 2: 2 * most**2, 3: 10 * most**2}


@pytest.mark.parametrize("width", [1, 2, 16])
def test_covering_separation_and_nesting(width):
    r = np.random.default_rng(width)
    points = np.concatenate([r.integers(-500, 500, (300, width)), r.integers(-3, 3, (200, width)), np.zeros((50, width), np.int64)])
    tree = codes.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    stored = points[tree.order].astype(float)
    for k in range(len(tree.start)):
        a, b, first, n = tree.start[k], tree.end[k], tree.child[k], tree.children[k]
        far = np.sqrt(((stored[a:b] - stored[a]) ** 2).sum(1))
        assert far.max() <= tree.radius[k] * (1 + codes.SLACK)
        if not n:
            assert tree.radius[k] == 0
            continue
        own = range(first, first + n)
        assert tree.start[first] == a and tree.end[first + n - 1] == b
        assert all(tree.end[j] == tree.start[j + 1] for j in own[:-1])
        centres = stored[tree.start[list(own)]]
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(n) * 1e9
        assert apart.min() > max(tree.radius[list(own)]) * (1 - codes.SLACK)


def test_whole_subtrees_are_assigned():
    r = np.random.default_rng(5)
    far_apart = np.concatenate([r.integers(0, 20, (500, 4)) + 10_000 * k for k in range(4)])
    tree = codes.build(far_apart)
    book = np.array([[10_000 * k] * 4 for k in range(4)], np.int64)
    runs, compared = codes.assign(tree, far_apart[tree.order], book)
    assert compared < 40
    of = np.empty(len(far_apart), np.int64)
    for a, b, e in runs.tolist():
        of[tree.order[a:b]] = e
    assert of.tolist() == [k for k in range(4) for _ in range(500)]
