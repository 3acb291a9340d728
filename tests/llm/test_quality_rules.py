import math
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daypanel.llm import quality_rules as q

SF_DIR = "/root/testdata/sf0.01"
PROSE = "The cat of the house sat on the mat and was happy with it for a while. It saw that the dog is in the garden."
ROWS = [
    (1, PROSE * 4), (2, None), (3, ""), (4, " \t\n\v\f\r "), (5, "one"), (6, "word " * 400), (7, PROSE.upper() + " WOW!! " * 30), (8, "a | b # c $ d " * 20),
    (9, "same line\nsame line\n\nsame line\nother line\n \n"), (10, " nbsp em is one word here"), (11, "🙂 é " * 60), (11, "🙂 é " * 60),
    (None, PROSE * 2), (12, "x" * 100_000), (13, " ".join(f"w{k}" for k in range(30_000)) + " " + " ".join(f"w{k}" for k in range(100, 140))),
    (14, "a b c d e f g h i a b c d e f g h z b c d e f g h i"), (15, "\n".join([PROSE, PROSE, "x y z"])),
]


def numbers(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_exclamations": sum(c in "!?" for c in text), "n_upper": sum(c.isupper() for c in text), "n_letters": sum(c.isalpha() for c in text),
        "n_ends": sum(w[-1] in ".!?" for w in words), "n_function_words": sum(w.lower() in q.FUNCTION_WORDS for w in words),
        "n_lone_marks": sum(not any(c.isalnum() for c in w) for w in words),
    }


def failed(n):
    return n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"]


def learned(patterns, n_rules, s):
    """The same iterations, one pattern after the other."""
    belief = {"share": s.bad_share, "bad": [], "good": []}
    first = {}
    for kind, hit in (("bad", s.hit_bad), ("good", s.hit_good)):
        first[kind] = {"b": hit * (1 - s.abstain), "g": (1 - hit) * (1 - s.abstain), "-": s.abstain}
        belief[kind] = [first[kind]] * n_rules

    def bad(votes):
        p = belief["share"] * math.prod(belief["bad"][j][x] for j, x in enumerate(votes))
        g = (1 - belief["share"]) * math.prod(belief["good"][j][x] for j, x in enumerate(votes))
        return p / (p + g)

    n = sum(patterns.values())
    for _ in range(s.rounds):
        own = {"bad": {v: c * bad(v) for v, c in patterns.items()}}
        own["good"] = {v: c - own["bad"][v] for v, c in patterns.items()}
        new = {"share": (sum(own["bad"].values()) + s.weight * s.bad_share) / (n + s.weight)}
        for kind in ("bad", "good"):
            total = sum(own[kind].values())
            new[kind] = [
                {x: (sum(c for v, c in own[kind].items() if v[j] == x) + s.weight * first[kind][x]) / (total + s.weight) for x in "bg-"} for j in range(n_rules)
            ]
        belief = new
    return belief, bad


def test_numbers_and_verdicts_against_brute_force(table):
    got = q.judge(table(ROWS, more=("votes", "n_words", "h", "i")))
    rows = got.collect()
    assert len(rows) == len(ROWS)
    want = sorted(((i, *numbers(t).items(), failed(numbers(t))) for i, t in ROWS), key=repr)
    names = list(numbers(""))
    assert sorted(((r.doc_id, *((c, r[c]) for c in names), r.base_failed) for r in rows), key=repr) == want
    belief, bad = learned(Counter(r.votes for r in rows), len(q.RULES), q.Settings())
    for r in rows:
        assert math.isclose(r.quality, 1 - bad(r.votes), abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=120), min_size=1, max_size=30))
def test_repeats_of_any_text(table, texts):
    rows = list(enumerate(texts))
    got = q.judge(table(rows), settings=q.Settings(rounds=1))
    assert {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in got.collect()} == {i: (numbers(t)["n_repeat_words"], numbers(t)["n_dup_lines"]) for i, t in rows}


def test_accuracies_are_found_from_votes_alone(spark):
    """Rules of known accuracies vote on texts of a known kind; both are found without being told."""
    import random

    r = random.Random(3)
    truth = {"bad": [0.9, 0.7, 0.6, 0.5, 0.3], "good": [0.02, 0.01, 0.1, 0.05, 0.03]}
    votes = Counter()
    for _ in range(20_000):
        kind = "bad" if r.random() < 0.15 else "good"
        votes["".join("-" if r.random() < 0.05 else "b" if r.random() < p else "g" for p in truth[kind])] += 1
    found = q.learn(spark.createDataFrame(list(votes.items()), "votes string, n long"), 5)
    assert abs(found.bad_share - 0.15) < 0.02
    for kind, chances in truth.items():
        for own, p in zip(getattr(found, kind), chances, strict=True):
            assert abs(own[0] / (own[0] + own[1]) - p) < 0.05


def test_votes_count_by_their_accuracy_not_by_number(spark):
    """A rule that is nearly always right outweighs several that are not."""
    belief = q.Belief(0.5, [[0.99, 0.01, 0.01]] + [[0.55, 0.45, 0.01]] * 3, [[0.01, 0.99, 0.01]] + [[0.45, 0.55, 0.01]] * 3)
    votes = spark.createDataFrame([("bggg",), ("gbbb",), ("----",)], "votes string")
    rows = votes.select(q.good_probability(q._slots(F.col("votes"), 4), belief).alias("p")).collect()
    assert [round(r.p, 3) for r in rows] == [0.018, 0.982, 0.5]


def test_empty_table_and_one_pattern(table):
    assert q.judge(table([])).count() == 0
    assert {r.kept for r in q.judge(table([(k, PROSE + f" Number {k}.") for k in range(30)])).collect()} == {True}


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
def test_labels_that_no_rule_has_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.judge(docs).select("doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)
