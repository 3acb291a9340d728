import random

import numpy as np
from pyspark.sql import functions as F

from daypanel.llm import toxicity as tx

BAD = ["vile", "rotten", "scoundrel", "wretch"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, toxic = [], []
    for k in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randint(20, 120))]
        y = rng.random() < 0.25
        if y:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "###"])
        rows.append((k, " ".join(words)))
        toxic.append(int(y))
    return rows, toxic


def test_held_out_texts(table, spark):
    rows, toxic = corpus(1300, 1)
    rows += [(5000, None), (5001, ""), (5002, "w1 " * 50_000 + "vile"), (5002, "w1 " * 50_000 + "vile"), (None, "w2 rotten w3")]
    docs = table(rows, more=("lang", "score", "c0", "x"))
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic[:900])] + [(3, 1, None), (7000, 0, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    scored = tx.score(docs, model, out="score", flag="bad")
    assert scored.columns == ["doc_id", "text", "lang", "c0", "x", "score", "bad"]
    got = scored.collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    unseen = [(score[k], y) for k, y in enumerate(toxic) if k >= 900]
    assert np.mean([(s >= 0.7) == y for s, y in unseen]) > 0.97
    assert score[5002] >= 0.7 and score[None] >= 0.7 and score[5000] == score[5001] < 0.7
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels(table, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table([(1, "a"), (2, None)])
    assert tx.fit(docs, none) is None
    assert [(r.toxicity, r.is_toxic) for r in tx.score(docs, None).collect()] == [(0.0, False)] * 2
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert tx.score(table([]), tx.fit(docs, one)).count() == 0


def test_scoring_equals_the_plain_convolution():
    s = tx.Settings(bits=6, part=3, filters=2)
    rng = np.random.default_rng(1)
    tables = tuple(rng.normal(size=(65, s.part)).astype(np.float32) for _ in range(tx.TABLES))
    for t in tables:
        t[64] = 0
    kernels = [rng.normal(size=(w, tx.TABLES * s.part, s.filters)).astype(np.float32) for w in s.widths]
    model = tx.Model(s, tables, kernels, [rng.normal(size=s.filters).astype(np.float32) for _ in s.widths], rng.normal(size=7).astype(np.float32), 0.0)
    texts = [rng.integers(0, 2**18, n) for n in (0, 1, 2, 9)]
    want = []
    for t in texts:
        rows = [np.concatenate([tab[r] for tab, r in zip(tables, at, strict=True)]) for at in zip(*tx._rows_of(t, s), strict=True)]
        rows += [np.zeros(tx.TABLES * s.part)] * 3
        pooled = []
        for kernel, b in zip(kernels, model.bias, strict=True):
            pooled += list(np.max([sum(rows[i + k] @ kernel[k] for k in range(len(kernel))) + b for i in range(max(1, len(t)))], axis=0))
        want.append(np.maximum(pooled, 0) @ model.out[:-1] + model.out[-1])
    assert np.allclose(tx.Scorer(model).logits(texts), want, atol=1e-4)


def test_long_texts_are_read_in_pieces_alike():
    rng = np.random.default_rng(3)
    s = tx.Settings(bits=6, part=3, filters=4)
    tables = tuple(np.vstack([rng.normal(size=(64, s.part)), np.zeros((1, s.part))]).astype(np.float32) for _ in range(tx.TABLES))
    kernels = [rng.normal(size=(w, tx.TABLES * s.part, s.filters)).astype(np.float32) for w in s.widths]
    bias = [rng.normal(size=s.filters).astype(np.float32) for _ in s.widths]
    texts = [rng.integers(0, 2**18, n) for n in (0, 1, 2, 700, 41, 5)]
    whole = tx._best_places(texts, tables, kernels, bias, s)
    for at_once in (8, 20, 64, 300):
        found = tx._best_places(texts, tables, kernels, bias, tx.Settings(bits=6, part=3, filters=4, words_at_once=at_once))
        assert np.allclose(found[0], whole[0], atol=1e-5) and (found[1] == whole[1]).all()


def brute_cut(scores, labels, beta):
    """The lowest score that is called toxic by the best F-beta, of the highest of equally good cuts."""
    best = (-1.0, None)
    for cut in sorted(set(scores), reverse=True):
        called = [y for x, y in zip(scores, labels, strict=True) if x >= cut]
        f = (1 + beta**2) * sum(called) / (len(called) + beta**2 * sum(labels))
        best = max(best, (f, cut))
    return best[1]


def test_cuts_of_each_group(spark):
    rng = random.Random(4)
    rows = []
    for lang, shift in (("a", 0), ("b", 300), (None, 50)):
        for _ in range(400):
            y = rng.random() < 0.2
            rows.append((lang, int(min(7999, max(0, rng.gauss(3000 + shift + 900 * y, 400)))), int(y)))
    frame = spark.createDataFrame(rows, "l string, at int, y int").groupBy("l", "at").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    for beta in (0.5, 1.0):
        got = {r.l: r.cut for r in tx.best_cuts(frame, beta).collect()}
        for lang in ("a", "b", None):
            x, y = zip(*[(a, t) for own, a, t in rows if own == lang], strict=True)
            want = brute_cut(x, y, beta)
            below = max([v for v in x if v < want], default=want - 1)
            assert np.isclose(got[lang], (want + below + 1) / 2 * (2 * tx.BIN_END / tx.BINS) - tx.BIN_END)


def test_thresholds_see_all_rows_that_were_not_learnt_from(table, spark):
    """The sample has a hundred rows a class; the languages differ in how often texts are toxic, and in long clean texts."""
    rows, toxic = corpus(1500, 6)
    rows = [(k, t + (" w5 w6" * 3000 if not y and k % 40 == 0 else "")) for (k, t), y in zip(rows, toxic, strict=True)]
    docs = table(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    s = tx.Settings(sample=300, sample_chars=200_000)
    model = tx.fit(docs, labels, s=s)
    assert set(model.thresholds) == {None, "a", "b"}
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    wrong = sum(got[k].is_toxic and not y for k, y in enumerate(toxic))
    caught = sum(got[k].is_toxic and y for k, y in enumerate(toxic))
    assert caught >= 0.9 * sum(toxic) and wrong <= 0.02 * len(toxic)


def test_the_sample_is_bounded_by_rows_and_by_characters(table, spark):
    docs = table([(k, "w " * 500) for k in range(60)] + [(100 + k, "x " * 500_000) for k in range(3)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(100 + k, 1, 1) for k in range(3)], "doc_id long, quality int, toxic int")
    known = tx.known_labels(docs, labels, F.lit(True))
    own = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("t"))
    for s in (tx.Settings(sample=5), tx.Settings(sample_chars=3500), tx.Settings(sample_chars=1)):
        drawn = tx._drawn(own, known, s).groupBy("_y").count().collect()
        assert len(drawn) == 2
        most = {5: 5, 4000: 3 if s.sample_chars == 3500 else 1}[s.sample]
        assert all(1 <= r["count"] <= most for r in drawn)


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(f"d{k}", "vile words" if k % 4 == 0 else f"good words {k}", "a") for k in range(120)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{k}", int(k % 4 == 0)) for k in range(100)], "doc_id string, toxic int")
    scored = tx.score(docs, tx.fit(docs, labels)).collect()
    assert {r.doc_id for r in scored if r.is_toxic} == {f"d{k}" for k in range(0, 120, 4)}


def test_every_labelled_row_calibrates_at_any_size(table, spark, monkeypatch):
    """Few toxic rows or many, all in the sample or not: the same rows are counted in the same way."""
    seen = []
    monkeypatch.setattr(tx, "_calibrate", lambda model, scored, known: seen.append(scored.groupBy("_y").count().collect()))
    for n, sample in ((60, 4000), (1300, 4000), (1300, 200)):
        rows, toxic = corpus(n, 7)
        labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
        tx.fit(table(rows), labels, s=tx.Settings(sample=sample, epochs=1))
        assert {r._y: r["count"] for r in seen.pop()} == {1: sum(toxic), 0: n - sum(toxic)}
