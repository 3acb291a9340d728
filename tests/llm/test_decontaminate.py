import random

from daypanel.llm import decontaminate as dc
from daypanel.llm.words import words

ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, ""), (5, "unseen single words only")]


def full_score(a, b, s):
    """Smith-Waterman, cell by cell."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (s.match if x == y else s.other), above[j + 1] + s.gap, row[j] + s.gap))
        best, above = max(best, *row), row
    return best


def test_alignment_against_the_full_table():
    rng, s = random.Random(1), dc.Settings()
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 14))] for _ in range(2))
        index = dc.Index([(0, " ".join(a))], s)
        numbers = index.numbers(" ".join(b))
        assert dc.align(index.items[0], numbers, s) == full_score(a, b, s)


def docs():
    rng = random.Random(3)
    filler = lambda n: " ".join(f"f{rng.randrange(300)}" for _ in range(n))
    fox = ITEMS[0][1]
    edited = fox.replace("brown", "grey").replace("near the", "by").replace("old ", "old and wide ")
    return [
        (1, f"{filler(30)} {fox.upper()}! {filler(20)}"), (2, f"{filler(10)} {edited} {filler(9)}"), (3, filler(200)), (4, None), (5, ""),
        (6, "alpha beta gamma f1 f2 f3 f4"), (7, f"{filler(20000)} {ITEMS[1][1]}"), (7, f"{filler(20000)} {ITEMS[1][1]}"), (None, fox),
        *((100 + k, f"{fox} {filler(5)}") for k in range(40)),  # so common that none of its n-grams is rare
    ]


def test_leaks(table, spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (20_000_000, 60):  # one block of items, and several
        got = dc.find_leaks(table(docs()), benchmark, settings=dc.Settings(block_chars=block)).collect()
        found = sorted((repr(r.doc_id), r.item_id) for r in got)
        assert found == sorted([("1", 1), ("2", 1), ("None", 1), ("7", 2), ("7", 2), *((repr(100 + k), 1) for k in range(40))])
        assert {r.similarity for r in got if r.doc_id != 2} == {1.0}
    (passage,) = [r for r in got if r.doc_id == 1]
    assert b"quick" in words(docs()[0][1])[passage.first_word : passage.first_word + passage.n_words]


def test_clean_rows_stay_whole(table, spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    own = table(docs())
    got = dc.drop_leaking(own, benchmark)
    assert got.columns == own.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r)) for r in own.collect() if r.doc_id in (3, 4, 5, 6))


def test_empty_tables(table, spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.find_leaks(table([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(table(docs()), none).count() == 0
    assert dc.drop_leaking(table(docs()), none).count() == len(docs())


def test_no_leak_is_missed():
    """Against the full table of every text and item: words changed, left out and put in at any place, few words."""
    rng, s = random.Random(5), dc.Settings()
    some = [f"w{k}" for k in range(60)]
    items = [[rng.choice(some) for _ in range(rng.randint(3, 24))] for _ in range(25)]
    index = dc.Index([(k, " ".join(x)) for k, x in enumerate(items)], s)
    n = 0
    for _ in range(150):
        text = [rng.choice(some) for _ in range(rng.randint(0, 30))]
        step, edits = rng.randint(2, 6), rng.sample(("change", "drop", "add"), rng.randint(1, 3))
        for k, w in enumerate(rng.choice(items)):
            edit = rng.choice(edits) if k % step == step - 1 else ""
            text += {"change": ["x"], "drop": [], "add": [w, "x"]}.get(edit, [w])
        text += [rng.choice(some) for _ in range(rng.randint(0, 30))]
        want = {k: full_score(x, text, s) / (s.match * len(x)) for k, x in enumerate(items)}
        got = dc.leaks_of(index.numbers(" ".join(text)), index)
        assert {k: v for k, v, _, _ in got} == {k: v for k, v in want.items() if v >= s.least}
        for k, v, first, size in got:
            assert full_score(items[k], text[first : first + size], s) / (s.match * len(items[k])) == v
        n += len(got)
    assert n > 100


def test_edited_copies_alone_and_beside_verbatim_ones(table, spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"v{rng.randrange(400)}" for _ in range(40))) for k in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    edited = [(1000 * step + k, " ".join(f"new{j}" if j % step == step - 1 else w for j, w in enumerate(t.split()))) for step in (3, 4, 5, 6) for k, t in items]
    for verbatim in ([], [(k, f"some {t} more") for k, t in items]):
        got = {(r.doc_id, r.item_id) for r in dc.find_leaks(table(edited + verbatim), benchmark).collect()}
        assert got == {(d, d % 1000) for d, _ in edited + verbatim}
        assert dc.drop_leaking(table(edited + verbatim), benchmark).count() == 0
