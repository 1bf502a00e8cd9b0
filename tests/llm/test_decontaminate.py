import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fathomry.llm import decontaminate as dc
from fathomry.llm import vec
from fathomry.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for j in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + 10]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, its = set(), set()
        for x, own in wins.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    its |= own
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return out


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(3)
    for _ in range(30):
        sym = r.integers(1, 5, 80)
        ends = np.sort(r.choice(np.arange(1, 80), 5, replace=False))
        ends = np.append(ends, 80)
        x = FMIndex(sym, ends, 5, sample=7)
        start = np.concatenate([[0], ends[:-1]])
        for m in (1, 2, 3):
            q = r.integers(1, 5, (4, m))
            lo, hi = x.search(q, np.full(4, m))
            for k in range(4):
                want = [i for a, b in zip(start, ends, strict=True) for i in range(a, b - m + 1) if (sym[i : i + m] == q[k]).all()]
                assert sorted(x.locate(np.arange(lo[k], hi[k])).tolist()) == want


ITEMS = [(1, "a b c d e f g h i j k l"), (10, "Short One"), (2, None), (3, "--"), (None, "x y"), (1, "q w e r")]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_against_brute_force(spark, block_bytes):
    r = random.Random(2)
    long = "a b c d e f g h i j k l".split()
    docs = [(0, None), (1, ""), (2, "é"), (3, "SHORT one x Y short ONE"), (4, "A-b c.d e f g h i j"), (4, "A-b c.d e f g h i j")]
    for k in range(40):
        w = [r.choice(["zz", "x", "y", "short", "one"]) for _ in range(r.randint(0, 25))]
        if k % 2:
            at = r.randint(0, len(w))
            w[at:at] = long[r.randint(0, 2) :] * r.randint(1, 2)
        docs.append((10 + k, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    got = dc.digest(dc.scan(d, b, block_bytes)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, ITEMS), key=str)


def test_any_number_of_blocks_is_one_step(spark, capsys):
    b = spark.createDataFrame([(i, f"left{i} right{i}") for i in range(20)], "item_id long, text string").coalesce(1)
    d = spark.createDataFrame([(1, "left3 right3 x left19 right19 left5")], "doc_id long, text string")
    assert len(list(dc.phrase_blocks(b, 1))) >= 20
    out = dc.scan(d, b, 1)
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert [(r["n_hit"], r["items"]) for r in out.collect()] == [(4, ["19", "3"])]


def test_removal_leaves_no_phrase_and_other_columns(spark):
    d = spark.createDataFrame([(1, "keep é a b c d e f g h i j K tail", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, items int")
    b = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = sorted(map(tuple, dc.decontaminate(d, b).collect()))
    assert got == [(1, "keep é  tail", 7), (2, None, 8), (3, "clean", 9)]
    assert dc.decontaminate(d.limit(0), b).count() == 0
    assert dc.decontaminate(d, b.limit(0)).count() == 3


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_overlapping_items_of_different_blocks_go_whole(spark, block_bytes):
    w = [f"w{i}" for i in range(1, 31)]
    items = [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(w[15:26])), (4, "left right")]
    docs = [
        (1, " ".join(w[:15])),
        (2, "é, " + " ".join(w) + " tail"),
        (3, "left " + " ".join(w[:10]) + " right"),  # a cut brings the item's words together: no hit
        (4, " ".join(w[5:15]) + ". " + " ".join(w[15:26]) + "!"),
        (5, None),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for order in (items, items[::-1]):
        b = spark.createDataFrame(order, "item_id long, text string").coalesce(1)
        got = dict(map(tuple, dc.decontaminate(d, b, block_bytes).collect()))
        assert got == {1: "", 2: "é,  w27 w28 w29 w30 tail", 3: "left  right", 4: "!", 5: None}
        hits = {x[0]: x[2] for x in brute(docs, items)}
        assert all(len(WORD.findall(low(t))) - len(WORD.findall(low(got[i]))) == hits[i] for i, t in docs)


def test_blocks_keep_every_row():
    rows = [None, "x" * 50, "", "y" * 3, "z" * 200, None]
    b = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})
    for size in (1, 10, 60, 1000):
        got = [x for t in vec.blocks(iter([b, b]), max_bytes=size) for x in t["text"].to_pylist()]
        assert got == rows * 2
