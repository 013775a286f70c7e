"""Toxicity by held-out accuracy; the class model against likelihoods computed anew."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweft.llm import class_lm, toxicity


def test_toxicity_on_documents_it_has_not_seen(spark, small):
    d = small.replace("sf0.001", "sf0.1")  # some 2,000 labels to learn from; with 200 it finds 0.6 of them
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    chain = toxicity.train(docs, labels.where(odd))
    got = toxicity.scored(docs, chain).join(labels.where(~odd), "doc_id").select("is_toxic", "toxic").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in got)
    said, are = sum(r.is_toxic for r in got), sum(r.toxic for r in got)
    assert hit >= 0.9 * are and hit >= 0.9 * said


def _toy(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice("house river tree green slow walk bread light paper".split()) for _ in range(30)]
        if bad:
            w[3:6] = [rng.choice(["idiot", "moron"]), rng.choice(["scum", "trash"]), "vile"]
        rows.append((i, " ".join(w), "t"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_rows_and_nulls(spark):
    docs, labels = _toy(spark)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (99999, 1)], "doc_id bigint, toxic int"))
    chain = toxicity.train(docs, labels)
    assert len(chain.links) == 3 and len(chain.links[2].earlier) == 2
    more = spark.createDataFrame([(900, None, "t"), (901, "", "t"), (None, "idiot scum vile " * 5, "t"), (902, "idiot scum vile tree " * 9000, "t"), (1, "green river", "t"), (1, "green river", "t")], docs.schema)
    got = toxicity.scored(docs.unionByName(more), chain).collect()
    assert len(got) == 406
    by = {r.doc_id: r for r in got}
    assert not by[900].is_toxic and not by[901].is_toxic and by[902].is_toxic and by[None].is_toxic
    assert sum(r.is_toxic for r in got if r.doc_id is not None and r.doc_id < 400) == 100
    kept = toxicity.clean(docs.unionByName(more), chain)
    assert kept.columns == docs.columns and kept.count() == 406 - 102


def test_groups_of_toxic_documents():
    """Two kinds of toxic documents with words of their own are told apart; those without a telling word are of the first group."""
    rng = np.random.default_rng(2)
    kind = np.array([0, 1, -1, -1, -1] * 40)
    features = [np.unique(np.concatenate((rng.choice(5, 3, replace=False) + (100 if k == 0 else 200 if k == 1 else 300), rng.integers(1000, 1040, 8)))) for k in kind]
    got = toxicity.groups_of(features, (kind >= 0).astype(int))
    assert set(got[kind < 0]) == {-1} and {tuple(np.unique(got[kind == k])) for k in (0, 1)} == {(0,), (1,)}
    assert toxicity.groups_of([np.array([1, 2])] * 4, np.array([1, 0, 1, 0])).tolist() == [0, -1, 0, -1]
    assert toxicity.groups_of([], np.zeros(0, int)).tolist() == []


def test_the_fit_reaches_the_least_loss():
    """Logistic regression against plain gradient descent until nothing moves."""
    rng = np.random.default_rng(3)
    row, col = np.repeat(np.arange(60), 3), rng.integers(0, 7, 180)
    x = toxicity._Sparse(row, col, rng.random(180).astype(np.float32), 60, 7)
    y = (x.times(np.array([2.0, -1, 0, 3, -3, 1, 0])) + rng.normal(0, 0.5, 60) > 0).astype(float)
    extra, keep = rng.random((60, 1)), np.arange(60) % 4 > 0

    def loss(w, e, b):
        z = x.times(w) + extra @ e + b
        return ((np.logaddexp(0, z) - y * z)[keep]).mean() + 1e-2 / 2 * (w @ w + e @ e)

    w, e, b = toxicity._fit(x, extra, y, keep, steps=200, l2=1e-2)
    v, f, c = np.zeros(7), np.zeros(1), 0.0
    for _ in range(20000):
        g = keep * (1 / (1 + np.exp(-(x.times(v) + extra @ f + c))) - y) / keep.sum()
        v, f, c = v - 0.5 * (x.back(g) + 1e-2 * v), f - 0.5 * (extra.T @ g + 1e-2 * f), c - 0.5 * g.sum()
    assert loss(w, e, b) <= loss(v, f, c) + 1e-5


def test_training_takes_little_more_than_its_rows():
    """Sums over the rows go by pieces, so the driver holds no copies of 8 bytes a number; they are the plain sums."""
    rng = np.random.default_rng(5)
    docs, each = 2000, 600
    row = np.repeat(np.arange(docs, dtype=np.int32), each)
    col = rng.integers(0, 3000, docs * each).astype(np.int32)
    toxic = (np.arange(docs) % 3 == 0).astype(int)
    col[(toxic[row] > 0) & (rng.random(len(col)) < 0.5)] //= 2
    x = toxicity._Sparse(row, col, rng.random(len(col)).astype(np.float32), docs, 3000)
    w, g = rng.random(3000), rng.random(docs)
    assert np.allclose(x.times(w), np.bincount(row, x.val * w[col]), rtol=1e-5) and np.allclose(x.back(g), np.bincount(col, x.val * g[row], minlength=3000), rtol=1e-5)
    y, count, n = np.array([toxic]), np.ones(len(row), np.int32), np.full(docs, 1000)
    tracemalloc.start()
    try:
        toxicity._select(row, col, toxic)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        tracemalloc.reset_peak()
        toxicity.fit_chain(row, col, count, n, y)
        assert tracemalloc.get_traced_memory()[1] < 78 << 20
    finally:
        tracemalloc.stop()


def test_toxicity_without_examples(spark):
    docs, labels = _toy(spark, 20)
    for own in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.scored(docs, toxicity.train(docs, own)).where("is_toxic").count() == 0
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def _likelihood(pairs, cls, k):
    n = np.zeros((k + 1, k))
    for (v, u), m in pairs.items():
        n[cls[v], cls[u]] += m
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(n) - f(n.sum(1)) - f(n.sum(0)), n


def test_gain_of_a_move_is_the_change_in_likelihood():
    rng = np.random.default_rng(1)
    units, k = 12, 4
    pairs = {(int(v), int(u)): int(m) for v in range(units + 1) for u in range(units) if (m := rng.integers(0, 6))}
    cls = np.append(rng.integers(0, k, units), k)
    base, n = _likelihood(pairs, cls, k)
    for x in range(units):
        right, left = np.zeros(k), np.zeros(k + 1)
        for (v, u), m in pairs.items():
            if v == x:
                right[cls[u]] += m
            if u == x:
                left[cls[v]] += m
        gain = class_lm.moves(n, right, left, int(cls[x]), pairs.get((x, x), 0))
        for c in range(k):
            other = cls.copy()
            other[x] = c
            assert math.isclose(gain[c], _likelihood(pairs, other, k)[0] - base, abs_tol=1e-6)


def _sentences(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = []
        for _ in range(20):
            w += [rng.choice(["the", "a"]), rng.choice(["cat", "dog", "cow", "hen"]), rng.choice(["sees", "eats", "hears"])]
        rows.append((i, " ".join(w), "x"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, n string")


def test_class_model_learns_order(spark):
    train, held = _sentences(spark, 60, 1), _sentences(spark, 10, 2)
    model = class_lm.train(train, classes=6, rounds=6)
    p = [r.perplexity for r in class_lm.scored(held, model).collect()]
    mixed = held.withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    q = [r.perplexity for r in class_lm.scored(mixed, model).collect()]
    assert max(p) < 4.5 < min(q)  # 2, 4 and 3 choices in turn: 2.9 if the order is known
    k = model.step.shape[1]
    assert np.allclose(np.exp(model.step).sum(1)[: k], 1, atol=1e-6)
    # Emissions of a class, rare words of an ending together, sum to at most 1.
    total = np.exp(model.emit).copy()
    total[len(model.units.hashes) :] *= model_kinds(model)
    assert np.all(np.bincount(model.cls[:-1], total, minlength=k) <= 1 + 1e-6)


def model_kinds(model):
    return np.ones(class_lm.ENDINGS)


def test_class_model_rows_and_nulls(spark):
    docs = _sentences(spark, 5, 1).unionByName(spark.createDataFrame([(7, None, "x"), (8, "", "x"), (9, "?!", "x"), (None, "the cat", "x"), (0, "unknown words", "x"), (0, "the hen " * 60000, "x")], "doc_id bigint, text string, n string"))
    got = class_lm.scored(docs, class_lm.train(docs, classes=4, rounds=2)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert all(by[k].n_words == 0 and by[k].perplexity is None and by[k].log_prob == 0 for k in (7, 8, 9))
    assert by[None].n_words == 2 and all(r.perplexity > 0 for r in got if r.n_words)
    assert class_lm.scored(docs.limit(0), class_lm.train(docs.limit(0), classes=4, rounds=1)).count() == 0


def test_scores_against_plain_counting(spark):
    """Classes, counts, log-probability and perplexity of every text from dictionaries over its words; all words are units here."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef", "gh,", "ij"], p=[0.4, 0.3, 0.1, 0.1, 0.1], size=rng.integers(1, 30))) for _ in range(40)] + [None, "", "ab ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    k = 3
    model = class_lm.train(docs, classes=k, rounds=12)
    assert model.tail is None
    lists = [[w.strip(",").lower() for w in (t or "").split()] for t in texts]
    h, _, _ = class_lm._words(spark_batch("ab cd ef gh ij"))
    cls = dict(zip("ab cd ef gh ij".split(), model.cls[model.units.of(h, np.zeros(5, np.int32))].tolist()))
    pair, word = {}, {}
    for ws in lists:
        for v, w in zip([None, *ws], ws):
            a = k if v is None else cls[v]
            pair[a, cls[w]] = pair.get((a, cls[w]), 0) + 1
            word[w] = word.get(w, 0) + 1
    size = np.bincount(model.cls[:-1], minlength=k)
    into = [sum(n for (_, b), n in pair.items() if b == c) for c in range(k)]
    total = sum(into)

    def step(a, b):
        row = sum(n for (x, _), n in pair.items() if x == a)
        kinds = sum(x == a for x, _ in pair)
        return (pair.get((a, b), 0) + (kinds + 1) * (into[b] + 1) / (total + k)) / (row + kinds + 1)

    for r in class_lm.scored(docs, model).collect():
        ws = lists[r.doc_id]
        p = sum(np.log(step(k if v is None else cls[v], cls[w])) + np.log((word[w] + 0.5) / (into[cls[w]] + 0.5 * size[cls[w]])) for v, w in zip([None, *ws], ws))
        assert r.n_words == len(ws) and abs(r.log_prob - p) < 1e-6
        assert r.perplexity is None if not ws else abs(r.perplexity - np.exp(-p / len(ws))) < 1e-6 * r.perplexity


def test_gains_of_many_are_those_of_each():
    rng = np.random.default_rng(2)
    units, k = 30, 4
    pairs = {(int(v), int(u)): int(m) for v in range(units + 1) for u in range(units) if (m := rng.integers(-4, 6)) > 0}
    cls = np.append(rng.integers(0, k, units), k)
    _, n = _likelihood(pairs, cls, k)
    dense = np.zeros((units, 2 * k + 2), int)
    for (v, u), m in pairs.items():
        dense[u, k + cls[v]] += m
        if v < units:
            dense[v, cls[u]] += m
        if u == v:
            dense[u, -1] += m
    word, column = np.nonzero(dense)
    got = class_lm.moves_of(n, cls[:-1], word, column, dense[word, column])
    for x in range(units):
        assert np.allclose(got[x], class_lm.moves(n, dense[x, :k], dense[x, k : 2 * k + 1], int(cls[x]), dense[x, -1]))


def test_rare_words_have_counts_and_classes_of_their_own(spark):
    rng = random.Random(6)
    nouns, verbs = [f"noun{i}x" for i in range(60)], [f"verb{i}x" for i in range(60)]  # alike in their ending
    rows = []
    for i in range(200):
        w = []
        for _ in range(20):
            w += ["the", nouns[min(int(rng.expovariate(0.1)), 59)], "always", verbs[min(int(rng.expovariate(0.1)), 59)]]
        rows.append((i, " ".join(w)))
    rows += [(200, "the oncex always"), (201, None), (202, "?"), (None, "the noun0x noun0x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = class_lm.train(docs, classes=4, rounds=4, rate=0.005)
    texts = [(t or "").replace("?", "").split() for _, t in rows]
    counts = {}
    for t in texts:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    table = {r.h: r for r in model.tail.collect()}
    one = lambda w: class_lm._words(spark_batch(w))[0].view(np.int64)[0]
    rare = {w: m for w, m in counts.items() if m < 0.005 * sum(counts.values())}
    assert len(rare) > 60 and {h: r.n for h, r in table.items()} == {one(w): m for w, m in rare.items()}
    kinds = [{table[one(w)].cls for w in rare if rare[w] > 5 and w.startswith(x)} for x in ("noun", "verb")]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]
    # Bigrams of the classes and emissions, counted anew.
    k = 4
    cls = {w: table[one(w)].cls if one(w) in table else int(model.cls[model.units.of(class_lm._words(spark_batch(w))[0], np.zeros(1, np.int32))[0]]) for w in counts}
    n = np.zeros((k + 1, k))
    for t in texts:
        for v, u in zip([None, *t], t):
            n[k if v is None else cls[v], cls[u]] += 1
    seen = (n > 0).sum(1, keepdims=True)
    step = np.log((n + (seen + 1) * (n.sum(0) + 1) / (n.sum() + k)) / (n.sum(1, keepdims=True) + seen + 1))
    assert np.allclose(step, model.step)
    got = {r.doc_id: r for r in class_lm.scored(docs, model).collect()}
    assert len(got) == len(rows) and got[201].n_words == got[202].n_words == 0 and got[201].perplexity is None
    emit = lambda w: math.log(counts[w] + 0.5) - model.norm[cls[w]]
    for (i, _), t in zip(rows, texts):
        want = sum(step[k if v is None else cls[v], cls[u]] + emit(u) for v, u in zip([None, *t], t))
        assert math.isclose(got[i].log_prob, want, abs_tol=1e-6)
    # All words, seen and not, share no more than 1.
    whole = np.bincount(model.cls[:-1], np.exp(model.emit), minlength=k)
    for w in counts:
        if one(w) in table:
            whole[cls[w]] += math.exp(emit(w))
    assert np.all(whole <= 1 + 1e-6)
    both = [sorted(map(str, x.selectExpr("doc_id", "n_words", "round(log_prob, 6)").collect())) for x in (class_lm.scored(docs, model), class_lm.perplexities(docs, classes=4, rounds=4, rate=0.005))]
    assert both[0] == both[1]
    other = class_lm.scored(spark.createDataFrame([(1, "the noun0x"), (2, "the neverx")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert other[0].log_prob > other[1].log_prob


def spark_batch(w):
    return pa.RecordBatch.from_arrays([pa.array([w])], ["text"])


def test_rounds_read_few_rows(spark, monkeypatch):
    """Pairs are kept in blobs, all of a partition's and only its own, so that a round costs the JVM a few rows."""
    monkeypatch.setattr(class_lm, "PACK", 1000)
    want = {(v << class_lm.PAIR | u): v + 7 * u + 1 for v in range(40) for u in range(300)}
    rows = spark.createDataFrame(list(want.items()), "pair bigint, n bigint").repartition(5, F.shiftright("pair", class_lm.PAIR))
    packed = class_lm._packed(rows)
    assert packed.count() <= 17
    assert {r.pair: r.n for r in packed.mapInArrow(class_lm._pair_rows, "pair bigint, n bigint").collect()} == want

    def units(batches):
        seen = {int(v) for p, _ in class_lm._unpacked(batches) for v in p >> class_lm.PAIR}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["v"])

    assert sorted(r.v for r in packed.mapInArrow(units, "v bigint").collect()) == list(range(40))
    assert class_lm._packed(rows.limit(0)).count() == 0
