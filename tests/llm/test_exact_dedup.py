import hashlib
from collections import defaultdict

from daypanel.llm import bloom, exact_dedup

ROWS = [
    (1, "Same text"), (2, "sAME TEXT"), (3, "same text "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 100_000), (9, "X" * 100_000),
    (9, "X" * 100_000), (None, "same text"), (None, "alone"), (10, "ẞ A"), (11, "ẞ a"),
    *((100 + k, "copy") for k in range(50)),
]


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    top = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return groups, top


def test_groups_against_brute_force(table):
    groups, top = expected(ROWS)
    got = [tuple(r) for r in exact_dedup.exact_groups(table(ROWS)).collect()]
    assert len(got) == len(ROWS)
    want = sorted((repr(i), repr(top[folded(t)]), len(groups[folded(t)]), hashlib.sha256(folded(t).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((repr(i), repr(keep), n, sha) for i, keep, n, _, sha in got) == want
    kept = [(sha, i) for i, _, _, k, sha in got if k]
    assert sorted(kept) == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, i in top.items())


def test_whole_rows_that_stay(table):
    docs = table(ROWS)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    _, top = expected(ROWS)
    assert sorted((folded(r.text), r.doc_id) for r in got.collect()) == sorted(top.items())


def test_empty_table(table):
    assert exact_dedup.exact_groups(table([])).count() == 0
    assert exact_dedup.drop_copies(table([])).count() == 0


def test_filter_never_misses(table, spark):
    keys = spark.range(3000).selectExpr("cast(id % 2500 as string) k")
    marked = bloom.mark_possible_repeats(keys, "k", "maybe")
    missed = marked.filter("cast(k as int) < 500 AND NOT maybe").count()
    passed = marked.filter("cast(k as int) >= 500 AND NOT maybe").count()
    assert missed == 0
    assert passed > 1800  # of 2,000: the rest are chance hits
