import random
import re

import numpy as np
import pytest

from fathomry.llm import jaccard_join as jj
from fathomry.llm import near, vec
from fathomry.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def brute(docs, threshold=0.8):
    texts = {t: shingles(t) for _, t in docs if shingles(t)}
    keys = list(texts)
    near_ = {k: set() for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(texts[a] & texts[b]) >= threshold * len(texts[a] | texts[b]):
                near_[a].add(b)
                near_[b].add(a)
    group = {}
    for k in keys:
        if k not in group:
            stack, comp = [k], {k}
            while stack:
                for y in near_[stack.pop()] - comp:
                    comp.add(y)
                    stack.append(y)
            for y in comp:
                group[y] = comp
    ids = {k: [d for d, t in docs if t == k] for k in keys}
    return sorted((d, min(ids[t]) if t in texts else d, len(ids[t]) if t in texts else 1, len(near_[t]) if t in texts else 0, min(x for y in group[t] for x in ids[y]) if t in texts else d) for d, t in docs)


def corpus(seed, n=60):
    r = random.Random(seed)
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A b"), (1005, "a b"), (1005, "a b")]
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 80))) for _ in range(8)]
    for k in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        docs.append((k, " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = corpus(block)
    out = jj.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).drop("item").collect()
    assert sorted(map(tuple, out)) == brute(docs)


def test_what_is_stored_grows_with_the_group(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 64)
    rows, keep = {}, near.stored
    r = random.Random(0)
    base = [f"w{i}" for i in range(60)]
    for n in (256, 512):
        seen = []
        monkeypatch.setattr(near, "stored", lambda df, name: (seen.append(out) if name == "links" else None, out)[1] if (out := keep(df, name)) else None)
        docs = []
        for k in range(n):
            w = list(base)
            w[r.randrange(60)] = f"x{k}"
            docs.append((k, " ".join(w)))
        out = jj.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {x["group_id"] for x in out} == {0} and sum(x["n_links"] for x in out) == 2 * sum(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for i, (_, a) in enumerate(docs) for _, b in docs[:i])
        rows[n] = sum(df.count() for df in seen), sum(df.where("a <> b").count() for df in seen)
    assert rows[512][0] <= 2.2 * rows[256][0] and rows[512][1] <= 2.2 * rows[256][1]


def test_one_of_each_group_stays(spark):
    docs = corpus(3)
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, n_links int, item string")
    out = jj.deduplicate(df)
    assert out.columns == df.columns
    want = sorted({b[4] for b in brute([x for x in docs if shingles(x[1])])} | {1000, 1001, 1002})
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_join(df).count() == 0 and jj.deduplicate(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i"), (None, "g h i")], "doc_id long, text string")
    assert jj.jaccard_join(df).count() == 3 and jj.deduplicate(df).count() == 2


def test_posterior_keeps_pairs_at_the_threshold():
    least = near.bayes_table(jj.PLAN)
    rng = np.random.default_rng(0)
    m = rng.random((200_000, jj.PLAN.hashes)) < 0.8
    seen = m.cumsum(1)[:, jj.PLAN.step - 1 :: jj.PLAN.step]
    assert (seen >= least).all(1).mean() > 0.9999
    m = rng.random((2000, jj.PLAN.hashes)) < 0.4
    assert (m.cumsum(1)[:, jj.PLAN.step - 1 :: jj.PLAN.step] >= least).all(1).mean() < 0.05
    assert near.tuned(0.8, 5, 1e-4) <= jj.PLAN.bands


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_minhash_estimates_jaccard():
    h = vec.mix(np.arange(3000, dtype=np.uint64))
    a, b = h[:2000], h[500:2500]
    _, sig = near.minhash(np.concatenate([a, b]), np.repeat([0, 1], 2000), 2, 400)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1
