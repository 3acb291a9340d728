import math
import random
from collections import Counter

import numpy as np

from daypanel.llm import quality as ql


def brute(texts):
    """log p of every n-gram of the highest order that ``grams`` gives, by the textbook recursion on dictionaries."""
    reader = ql.Reader()
    mask = lambda order: (1 << ql.BITS * order) - 1
    levels = {ql.ORDER: Counter(reader.grams(texts)[0].tolist())}
    for order in range(ql.ORDER - 1, 0, -1):
        levels[order] = Counter(g & mask(order) for g in levels[order + 1])
    rules = {}
    for order, level in levels.items():
        n = [max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        cut = [max(0.1, min(k - 0.1, d)) for k, d in zip((1, 2, 3), raw, strict=True)]
        total, left = Counter(), Counter()
        for g, c in level.items():
            total[g >> ql.BITS] += c
            left[g >> ql.BITS] += min(c, cut[min(c, 3) - 1])
        rules[order] = (level, cut, total, left)

    def p(gram, order):
        below = 1 / ql.CLASSES if order == 1 else p(gram & mask(order - 1), order - 1)
        level, cut, total, left = rules[order]
        context, c = gram >> ql.BITS, level[gram]
        if not total[context]:
            return below
        return (c - min(c, cut[min(c, 3) - 1]) if c else 0) / total[context] + left[context] / total[context] * below

    return lambda gram: math.log(p(gram, ql.ORDER))


def sentences(rng, n, letters="abcde  "):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_model_against_the_recursion(spark):
    rng = random.Random(1)
    texts = sentences(rng, 60)
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "t string, half int")
    _, _, both = ql.fit(rows)
    log_p = brute(texts)
    own = ql.Reader().grams([*texts[:20], *sentences(rng, 10, "abcxyz.")])[0]
    assert np.allclose(both[own].astype(float), [log_p(g) for g in own.tolist()], rtol=2e-3, atol=2e-3)
    every = np.exp(both.astype(float)).reshape(-1, ql.CLASSES).sum(1)
    assert np.allclose(every, 1, atol=0.02)  # each context's probabilities


def test_junk_goes_and_clean_text_stays(table, spark):
    rng = random.Random(2)
    clean = [(k, " ".join(rng.choice(["the", "house", "stands", "near", "water", "and", "stone"]) for _ in range(40))) for k in range(80)]
    junk = [(100 + k, "".join(rng.choice("#$%&|*") for _ in range(200))) for k in range(5)]
    odd = [(200, None), (201, ""), (None, clean[0][1]), (0, clean[0][1]), (202, clean[3][1] * 200)]
    docs = table(clean + junk + odd, more=("lang", "perplexity", "kept", "t"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(k, None, 0) for k in range(50, 60)] + [(0, 0, 0), (100, 0, 0)], "doc_id long, quality int, toxic int")
    got = ql.classify(docs, labels).collect()
    assert len(got) == len(clean + junk + odd)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k, _ in clean) and kept[None] and kept[202]
    assert not any(kept[k] for k in (*range(100, 105), 200, 201))
    assert sum(r.trusted for r in got) == 51  # row 0 comes twice


def test_without_trusted_text(table, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ql.classify(table([(1, "some text"), (2, None)]), labels).collect()
    assert {r.doc_id: (round(r.perplexity), r.threshold, r.kept) for r in got} == {1: (64, None, True), 2: (64, None, False)}
    assert ql.classify(table([]), labels).count() == 0


def recursion(texts):
    """The perplexity of a text by UTF-16 unit under the model of ``texts``, by strings and dictionaries only."""
    units = lambda t: ["\0"] * 3 + [t.encode("utf-16-le")[k : k + 2].decode("utf-16-le", "surrogatepass") for k in range(0, len(t.encode("utf-16-le")), 2)]
    grams = lambda t: [tuple(units(t)[k : k + 4]) for k in range(len(units(t)) - 3)]
    levels = {4: Counter(g for t in texts for g in grams(t))}
    for order in (3, 2, 1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    rules = {}
    for order, level in levels.items():
        n1, n2, n3, n4 = (max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [max(0.1, min(k - 0.1, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, left = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += min(c, cut[min(c, 3) - 1])
        rules[order] = cut, total, left

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (2**16 if texts else 64)
        cut, total, left = rules[len(g)]
        if not total[g[:-1]]:
            return below
        c = levels[len(g)][g]
        return ((c - min(c, cut[min(c, 3) - 1]) if c else 0) + left[g[:-1]] * below) / total[g[:-1]]

    return lambda t: math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) if t else 64.0


def test_every_row_against_the_recursion(spark, monkeypatch):
    """Perplexity, threshold and decision, without a table of the model on the driver; many blocks, some texts alone in one."""
    monkeypatch.setattr(ql, "BLOCK", 150)
    monkeypatch.setattr(ql, "table", None)
    rng = random.Random(3)
    words = {"ru": "вода дом стоит у реки и камень лес".split(), "ja": "水の家 川が 石と 森に 橋は".split(), "en": "The house stands near water and stone 😀".split()}
    rows = []
    for lang, own in words.items():
        rows += [(len(rows) + k, " ".join(rng.choice(own) for _ in range(rng.randint(3, 25))), lang) for k in range(30)]
        rows += [(len(rows) + k, "".join(rng.choice("".join(own)) for _ in range(60)), lang) for k in range(5)]
    rows += [(900, None, "ru"), (901, "", "en"), (902, "дом стоит", "none"), (903, rows[0][1] * 40, "ru"), (904, "\U0001f600\ue000 unseen", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = [i for i, t, lang in rows if i < 900 and i % 35 < 28]
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    halves = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(coalesce(text, '')), 2) h").collect()}
    trusted = [(t, lang, halves[i]) for i, t, lang in rows if i in set(good)]
    both, *each = (recursion([t for t, _, h in trusted if h in own]) for own in ((0, 1), (0,), (1,)))
    crossed = [(each[1 - h](t), lang) for t, lang, h in trusted]

    def threshold(lang):
        own = sorted(p for p, x in crossed if x == lang) or sorted(p for p, _ in crossed)
        return own[math.ceil(0.995 * len(own)) - 1] * 1.1

    got = {r.doc_id: r for r in ql.classify(docs.repartition(3), labels).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        want = both(text or "")
        assert np.isclose(got[i].perplexity, want, rtol=1e-5) and np.isclose(got[i].threshold, threshold(lang), rtol=1e-5)
        assert got[i].trusted == (i in good) and got[i].kept == (bool(text) and want <= threshold(lang))


def test_letters_of_one_class_are_told_apart(table, spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice("вода дом стоит реки камень лес".split()) for _ in range(30)) for _ in range(60)]
    # Other letters of the same script that the 64 classes do not tell from the right ones.
    classes = ql._classes()
    other = {c: next(chr(x) for x in range(0x400, 0x530) if chr(x) != c and classes[x] == classes[ord(c)]) for c in set("".join(clean)) - {" "}}
    wrong = ["".join(other.get(c, c) for c in t) for t in clean[:5]]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in ql.classify(table([*enumerate(clean), *enumerate(wrong, 100)]), labels).collect()}
    assert all(got[k] for k in range(60)) and not any(got[k] for k in range(100, 105))


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = ["", "ab", "a house \U0001f600 near water", "", "и камень"]
    for reader in (ql.Reader(), ql.UnitReader()):
        whole = reader.grams(texts)
        with monkeypatch.context() as patch:
            patch.setattr(ql, "PIECE", 5)
            pieces = reader.grams(texts)
        assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))
        assert whole[1].sum() == len(whole[0])
