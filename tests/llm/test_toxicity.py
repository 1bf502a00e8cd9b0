import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomry.llm import toxicity as tx


def corpus(n=600, seed=3):
    r = random.Random(seed)
    bad = ["vilestem" + x for x in ("a", "ing", "ed", "ous")]
    docs, labels = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 80)}" for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad)
        docs.append((i, " ".join(w), i % 3))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels, {d[0] for d in docs if "vilestem" in d[1]}


def test_held_out_accuracy_and_rejection(spark):
    docs, labels, toxic = corpus()
    d = spark.createDataFrame([*docs, (None, None, 1), (9001, "", 2), (9001, "", 2)], "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (777777, 1)], "doc_id long, toxic int")
    out = tx.classify(d, lab).collect()
    assert len(out) == len(docs) + 3
    held = [x for x in out if x["held_out"] and x["doc_id"] < 9000]
    assert {x["doc_id"] for x in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([x["predicted"] == (x["doc_id"] in toxic) for x in held])
    assert right > 0.97 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in out)
    kept = tx.reject(d, lab)
    assert kept.columns == d.columns
    left = {x["doc_id"] for x in kept.collect()}
    assert {None, 9001} <= left and len(left & toxic) < 0.05 * len(toxic) and len(left) > 0.8 * len(docs)


def test_labels_outside_the_learning_fold_change_nothing(spark):
    docs, labels, _ = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, x int")
    flip = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, y) for i, y in labels]
    a, b = (tx.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flip))
    assert (a.hashes == b.hashes).all() and np.allclose(a.weights, b.weights)


def test_without_toxic_labels_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x["score"] for x in tx.classify(d, none).collect()] == [0.0]
    assert tx.classify(d.limit(0), none).count() == 0 and tx.reject(d, none).count() == 1


def test_the_corrected_risk_ignores_positives_among_the_unlabelled():
    r = np.random.default_rng(0)
    n = 2000
    y = r.random(n) < 0.2
    x = np.stack([np.where(y, r.random(n) < 0.9, r.random(n) < 0.05), r.random(n) < 0.5], 1)
    rows, cols = np.nonzero(x)
    w, b = tx.nnpu(rows, cols, n, 2, np.flatnonzero(y)[:150], np.arange(n), 0.2, tx.Options(steps=400, decay=0))
    assert ((x @ w + b > 0) == y).mean() > 0.93


def risk(theta, x, p, u, prior):
    """(risk of the positives, risk of the negatives, which the estimator keeps from falling below zero)."""
    z = x @ theta[:-1] + theta[-1]
    return prior * np.logaddexp(0, -z[p]).mean(), np.logaddexp(0, z[u]).mean() - prior * np.logaddexp(0, z[p]).mean()


def slope(theta, x, p, u, prior, side):
    """The dense gradient of the whole risk, or of the negatives' risk turned round where that is below zero."""
    one = np.column_stack([x, np.ones(len(x))])
    s = 1 / (1 + np.exp(-(one @ theta)))
    negative = one[u].T @ s[u] / len(u) - prior * one[p].T @ s[p] / len(p)
    return prior * one[p].T @ (s[p] - 1) / len(p) + negative if side else -negative


def test_every_step_follows_the_gradient_of_the_risk():
    """Against a dense estimator, through steps on both sides of the correction; its gradient is held against differences of the risk.

    The differences can't drive the steps: the bias starts where its gradient is zero, and Adam would scale up their error.
    """
    r = np.random.default_rng(5)
    x = (r.random((40, 6)) < 0.5).astype(float)
    p, u, prior = np.arange(0, 12), np.arange(12, 40), 0.4
    x[p, 0] = 1
    x[u, 0] = 0
    rows, cols = np.nonzero(x)
    theta, m1, m2, sides = np.append(np.zeros(6), np.log(prior / (1 - prior))), np.zeros(7), np.zeros(7), set()
    for t in range(1, 61):
        side = bool(risk(theta, x, p, u, prior)[1] >= 0)
        sides.add(side)
        value = (lambda q: sum(risk(q, x, p, u, prior))) if side else (lambda q: -risk(q, x, p, u, prior)[1])
        grad = slope(theta, x, p, u, prior, side)
        assert np.allclose(grad, [(value(theta + h) - value(theta - h)) / 2e-6 for h in np.eye(7) * 1e-6], atol=1e-7)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = tx.nnpu(rows, cols, 40, 6, p, u, prior, tx.Options(steps=t, decay=0, rate=0.3))
        assert np.allclose(np.append(w, b), theta, atol=1e-6)
    assert sides == {True, False}


def test_a_rare_telling_feature_is_chosen(spark):
    """In 8 of 4,000 confirmed texts and in no other: not over one in 500, and among the best."""
    rows = [(i, f"common w{i % 40} x{i % 17}" + (" zzq" if i < 8 else "")) for i in range(200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4000)) for i in range(200_000)], "doc_id long, toxic int")
    o = tx.Options(steps=2)
    model = tx.fit(docs, labels, o, learn=F.lit(True))
    h, _, _ = tx.features(pa.array(["zzq"]))
    assert set(h[:1]) <= set(model.hashes)


def test_words_of_fewer_than_five_texts_tell_nothing(spark):
    docs = spark.createDataFrame([(i, f"only{i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in tx.classify(docs, labels).collect()} == {0.0}
