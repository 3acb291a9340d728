import hashlib
import random
import re

from pyspark.sql import functions as F

from daypanel.llm import pii

# The base as it is stated: patterns without what keeps the search linear.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
PARTS = ["1", "22", "4111 1111 1111 1111", "@", "a", "b.c", ".", " ", "-", "+", "(", ")", "+49 (0)30 123-4567", "1.2.3.4", "256.1.1.1", "é", "🎉", "x@y.z", "_", "%", "0", "\n"]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if holds:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def test_base_against_brute_force(table):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "11  " * 5000 + "a@b" + ".c" * 5000, "x" * 3000 + "@" + "1" * 3000, "same 1.2.3.4", "same 1.2.3.4"]
    got = pii.find(table(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.start, s.kind_no, s.end) for s in r.base] == base(texts[r.doc_id] or "")


CONTEXT = [(k, f"Ask Zorbulon here, mail me at zed@q.org or not. {k} filler") for k in range(5)]
OTHERS = [(10 + k, f"mail me here or not at all filler {k} ask") for k in range(60)]


def test_terms_that_give_an_entity_away(table, spark):
    docs = table(CONTEXT + OTHERS + [(90, "Zorbulon is named alone"), (None, None), (91, "")])
    rows = {r.doc_id: r for r in pii.find(docs, settings=pii.Settings(support=3, generalise=0.6, remove=0.99)).collect()}
    terms = {CONTEXT[0][1][t.start : t.end] for t in rows[0].terms}
    assert terms == {"Zorbulon"}  # in six texts, five of them with the address; the rest is in all
    assert rows[90].terms == [] and rows[10].terms == []
    n = len(CONTEXT + OTHERS) + 3
    log = lambda x: float(spark.range(1).select(F.log(F.lit(x))).first()[0])
    assert abs(rows[0].terms[0].disclosure - log(n * 5 / (5 * 6)) / log(n / 5)) < 1e-9


def test_sanitised_text(table):
    docs = table(CONTEXT + OTHERS)
    got = pii.sanitise(docs, settings=pii.Settings(support=3, generalise=0.6, remove=2.0))
    assert got.columns == [*docs.columns, "sanitised"]
    text = {r.doc_id: r.sanitised for r in got.collect()}
    assert text[1] == "Ask [TERM] here, mail me at [EMAIL] or not. 1 filler"
    assert text[10] == OTHERS[0][1]
    gone = {r.doc_id: r.sanitised for r in pii.sanitise(docs, settings=pii.Settings(support=3, generalise=0.6, remove=0.6)).collect()}
    assert gone[1] == "Ask  here, mail me at [EMAIL] or not. 1 filler"


def test_spans_as_text(table):
    (row,) = pii.find(table([(1, "x@y.z 1.2.3.4")])).select(pii.written(pii.all_spans()).alias("s")).collect()
    assert row.s == "email:0:5,ip:6:13"
    assert hashlib.sha256(b"").hexdigest() == pii.find(table([(1, None)])).select(F.sha2(pii.written(pii.all_spans()), 256)).first()[0]


def test_empty_table(table):
    assert pii.find(table([])).count() == 0
    assert pii.sanitise(table([])).count() == 0


def test_terms_anywhere_in_the_document(table):
    far = [(k, f"Zorbulon {'filler ' * 60}mail zed@q.org {'filler ' * 60}zorbulon") for k in range(5)]
    rows = {r.doc_id: r for r in pii.find(table(far + OTHERS), settings=pii.Settings(support=3, generalise=0.6)).collect()}
    for k, text in far:
        assert [text[s.start : s.end] for s in rows[k].terms] == ["Zorbulon", "zorbulon"]
    # Counted over whole documents on both sides: in five of five, whatever lies between.
    assert all(abs(s.disclosure - 1) < 1e-9 for k, _ in far for s in rows[k].terms)


def test_values_that_occur_once_or_twice(table):
    others = [(100 + k, f"mail me here or not at all filler {k} ask") for k in range(400)]
    one, two = [(1, "Quixnar mail one@a.org")], [(k, "Borvelt mail two@b.org") for k in (2, 3)]
    pooled = [(10 + k, f"Mirvane mail person{'abcdef'[k]}@rare.example") for k in range(6)]
    rows = {r.doc_id: r for r in pii.find(table(one + two + pooled + others)).collect()}
    for k, text in one + two + pooled:
        assert [text[s.start : s.end] for s in rows[k].terms] == [text.split()[0]]
    assert all(not rows[k].terms for k, _ in others)
