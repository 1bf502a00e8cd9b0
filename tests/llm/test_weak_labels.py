import random

import numpy as np
import pyarrow as pa

from fathomry.llm import vec
from fathomry.llm import weak_labels as wl


def good(r):
    return "\n".join(" ".join(f"{r.choice('abcdefgh')}{r.choice(['one', 'four', 'seven'])}{r.randint(0, 9)}"[:-1] + r.choice("xyzuvw") for _ in range(r.randint(8, 14))) + "." for _ in range(r.randint(4, 9)))


def bad(r):
    kind = r.randint(0, 2)
    if kind == 0:
        return " ".join(f"{r.choice(['ab', 'cde', 'fghi'])}{r.choice(['###', '&&&', '$$$'])}" for _ in range(60))
    if kind == 1:
        return "\n".join(["same line again and again"] * 12)
    return " ".join(w for _ in range(8) for w in [r.choice(["word", "thing"])] * 8).upper() + "!!!"


def test_held_out_texts_are_told_apart(spark):
    r = random.Random(4)
    rows = [(i, (good if i % 3 else bad)(r), 0.5) for i in range(300)] + [(1000, None, 0.1), (1001, "", 0.1), (1001, "", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = {}
    for x in wl.classify(df, wl.Options(max_rows=150)).collect():
        out.setdefault(x["doc_id"], []).append(x)
    assert sum(map(len, out.values())) == len(rows) and len(out[1001]) == 2
    right = np.mean([out[i][0]["kept"] == bool(i % 3) for i in range(300)])
    assert right > 0.97
    assert np.mean([(out[i][0]["posterior"] > 0.5) == bool(i % 3) for i in range(300)]) > 0.97


def test_em_recovers_the_labellers_accuracies():
    r = np.random.default_rng(1)
    n, acc, cover = 40_000, np.array([0.95, 0.9, 0.8, 0.7, 0.6]), np.array([0.9, 0.7, 0.8, 0.5, 0.9])
    y = r.random(n) < 0.7
    v = np.where(r.random((n, 5)) < acc, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v = np.where(r.random((n, 5)) < cover, v, 0)
    codes, count = np.unique(wl.pattern(v), return_counts=True)
    p, odds = wl.expectation_maximisation(codes, count.astype(float), 5, 500)
    want = np.log(acc / (1 - acc))
    assert np.allclose(odds[:, 2], want, atol=0.25) and np.allclose(odds[:, 0], -want, atol=0.25)
    at = np.searchsorted(codes, wl.pattern(v))
    assert ((p[at] > 0.5) == y).mean() > 0.95


def dense_em(v, rounds):
    """The same model row by row: a posterior for every document, tables of P(vote | class) with one added to each count."""
    p = 1 / (1 + np.exp(4.0 * ((v == -1).sum(1) - 1.5)))
    for _ in range(rounds):
        score = np.full(len(v), np.log((p.sum() + 1) / ((1 - p).sum() + 1)))
        for j in range(v.shape[1]):
            table = {x: [(share[v[:, j] == x].sum() + 1) / (share.sum() + 3) for share in (p, 1 - p)] for x in (-1, 0, 1)}
            score += np.array([np.log(table[x][0] / table[x][1]) for x in v[:, j].tolist()])
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


def test_em_on_patterns_equals_em_on_rows():
    r = np.random.default_rng(7)
    y = r.random(400) < 0.6
    v = np.where(y[:, None], 1, -1) * r.choice([1, 0, -1], (400, 6), p=[0.6, 0.25, 0.15])
    codes, at, count = np.unique(wl.pattern(v), return_inverse=True, return_counts=True)
    for rounds in (1, 2, 15):
        p, _ = wl.expectation_maximisation(codes, count.astype(float), 6, rounds)
        assert np.allclose(p[at], dense_em(v, rounds), atol=1e-7)
    assert len(wl.expectation_maximisation(codes[:0], np.zeros(0), 6, 5)[0]) == 0


def test_the_scorer_equals_a_dense_one():
    r = np.random.default_rng(8)
    x, target = r.random((60, 16)) * (r.random((60, 16)) < 0.4), r.random(60)
    o = wl.Options(dimension=16, steps=40)
    doc, feature = np.nonzero(x)
    w, b = wl.train(doc, feature, x[doc, feature], target, o)
    theta, m1, m2 = np.zeros(17), np.zeros(17), np.zeros(17)
    for t in range(1, o.steps + 1):
        g = (1 / (1 + np.exp(-(x @ theta[:16] + theta[16]))) - target) / 60
        grad = np.append(x.T @ g + o.decay * theta[:16], g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta -= o.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    assert np.allclose(np.append(w, b), theta, atol=1e-9)


def test_values_by_hand():
    v = wl.values(*vec.flat(pa.array(["Ab ab ab | cd!\nx y.\nx y.", None, "###"])))
    assert v.shape == (3, len(wl.LABELLERS))
    names = [x[0] for x in wl.LABELLERS]
    first = dict(zip(names, v[0], strict=True))
    assert first["symbols"] == 1 / 9 and first["adjacent"] == 1 / 9 and first["repeated_lines"] == 1 / 3 and first["exclamation"] == 1 / 9 and first["unstopped_lines"] == 0
    assert v[1][names.index("short")] == 1.0 and v[2][names.index("symbols")] == 3.0


def test_empty_table(spark):
    assert wl.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0
