import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomry.llm import ctw, vec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, depth=ctw.DEPTH):
    """The same model, node by node with dictionaries."""
    train = [t for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    counts = {}
    for t in train:
        b = b"\xff" * depth + low(t).encode() + b"\xff"
        for i in range(depth, len(b)):
            for k in range(8):
                node, bit = (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((b[i - d : i], node), [0, 0])[bit] += 1
    children = {}
    for s, node in counts:
        if s:
            children.setdefault((s[1:], node), []).append((s, node))
    kt = {x: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for x, (a, b) in counts.items()}
    pw = {}
    for x in sorted(counts, key=lambda x: -len(x[0])):
        pw[x] = kt[x] if len(x[0]) == depth else np.logaddexp(kt[x], sum(pw[c] for c in children[x])) - math.log(2)

    def logp(t):
        b, total = b"\xff" * depth + low(t).encode() + b"\xff", 0.0
        for i in range(depth, len(b)):
            for k in range(8):
                node, bit = (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1
                p = None
                for d in range(depth, -1, -1):
                    x = (b[i - d : i], node)
                    if x in counts:
                        est = (counts[x][bit] + 0.5) / (sum(counts[x]) + 1)
                        w = 1.0 if p is None else math.exp(kt[x] - math.log(2) - pw[x])
                        p = w * est + (1 - w) * (p or 0)
                total += math.log10(0.5 if p is None else p)
        return total

    c = Counter(w for t in train for w in [*WORD.findall(low(t)), "END "])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        w = [*WORD.findall(low(t)), "END "]
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), logp(t), -logp(t) * math.log2(10) / (len((t or "").encode()) + 1)))
    return out


def data(n=40):
    r = random.Random(1)
    docs = [(None, "Null id"), (100, None), (101, ""), (102, " \t"), (103, "é É aA")]
    return docs + [(i, " ".join(r.choice(["the", "The", "of", "ré", f"w{r.randint(0, 30)}"]) for _ in range(r.randint(0, 12)))) for i in range(n)] + [(3, "twice"), (3, "twice")]


def close(a, b):
    return a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-5) and math.isclose(a[7], b[7], rel_tol=1e-5)


@pytest.mark.parametrize(("hot", "most"), [(0, 1 << 20), (40, 3), (1 << 21, 60)])
def test_against_brute_force(spark, hot, most):
    docs = data()
    got = sorted((tuple(x) for x in ctw.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot, most).collect()), key=str)
    want = sorted(brute(docs), key=str)
    key = lambda x: (str(x[0]), x[2], round(x[6], 3))
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))


def test_held_out_code_length_is_near_the_sources_entropy(spark):
    r = random.Random(2)
    syl = ["ta", "ri", "mo", "en", "sul", "pa", "ko", "li", "der", "ba", "nu", "go"]
    docs = [(i, " ".join("".join(r.choice(syl) for _ in range(r.randint(2, 6))) for _ in range(60))) for i in range(400)]
    out = [x["score"] for x in ctw.score(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x["held_out"]]
    entropy = 60 * (math.log10(5) + 4 * math.log10(12))
    assert -1.15 * entropy < np.mean(out) < -0.95 * entropy


def test_empty_table(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_stay_inside_their_text():
    buf, offs = vec.flat(pa.array(["ab", None, "", "C"]))
    key, doc = ctw.keys_of(buf, offs, 2)
    assert [hex(k) for k in key.tolist()] == ["0xffff61", "0xff6162", "0x6162ff", "0xffffff", "0xffffff", "0xffff63", "0xff63ff"]
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 3]


def test_log_gamma():
    x = np.concatenate([np.arange(1, 50) / 2, [1e3, 1e6 + 0.5]])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(y) for y in x], rtol=1e-12, atol=1e-11)


def test_predictions_add_up_to_one():
    r = np.random.default_rng(0)
    key = np.unique(r.integers(97, 101, (300, 6)) @ (256 ** np.arange(5, -1, -1)))
    ctx = int(key[0]) >> 8
    every = np.array([(ctx << 8) | b for b in range(256)])
    allk = np.concatenate([key, every]).astype(np.uint64)
    *_, p = ctw.subtree(allk, np.concatenate([r.integers(1, 9, len(key)), np.zeros(256, np.int64)]), 0)
    p = np.where(np.isnan(p), 0.5, p)
    assert math.isclose(p[len(key) :].prod(1).sum(), 1.0, rel_tol=1e-9)
