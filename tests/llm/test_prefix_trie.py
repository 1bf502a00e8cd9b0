import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from fathomry.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest int"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:".encode() + role.encode() + text.encode()).digest()


def originals(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append(((turn is not None, turn or 0), turn_digest(role, text), (role, text)))
    return {c: [x[2] for x in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    text = lambda p: ",".join(map(str, sorted(ends[p])))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(text(p).encode()).hexdigest()) for p, m in members.items())


def result(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def table(spark, rows):
    rows = [(*r, "x", 1) for r in rows]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def conversations(seed=1, n=120):
    r = random.Random(seed)
    say = [("user", "hi there"), ("assistant", "yes  we\tcan"), ("user", ""), ("user", "1:hi"), ("system", "be good")]
    rows = [(c, i, *r.choice(say)) for c in r.sample(range(400), n) for i in range(r.choice([1, 1, 2, 3, 4, 6]))]
    rows += [(c, i, "user", "same copy") for c in range(500, 560) for i in range(5)]  # a hot conversation
    rows += [(700, i, "user", f"long {i % 7}") for i in range(40)] + [(701, i, "user", f"long {i % 7}") for i in range(33)]
    rows += [(800, 3, None, "x"), (800, None, "user", None), (800, 3, None, "x"), (800, 3, "a", "x"), (None, 1, "user", "nobody's"), (-3, 0, "user", "below zero")]
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = conversations()
    convs = {c: t for c, t in originals(rows).items() if c >= 0}
    df = table(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    got = pt.rebuilt_trie(df)
    assert result(got) == brute(rebuild(convs))
    assert got.where("depth = 0").count() == 1
    if block == 2:
        plain = pt.conversation_trie(table(spark, rows))
        assert result(plain) == brute(originals(rows))
        assert plain.select("prefix_sha256", "depth").distinct().count() == plain.count()


def test_a_turnless_conversation_and_an_empty_table(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "only"), (c, 1, "user", "two")]  # of conversation 0 there is nothing
    got = result(pt.rebuilt_trie(table(spark, rows)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert pt.rebuilt_trie(table(spark, rows).limit(0)).count() == 0


def test_many_turns_of_one_number(spark):
    """Repeated rows are counted before they are placed; a conversation spans ranges."""
    rows = [(5, 1, "user", "again")] * 3000 + [(5, 1, "user", f"w {i}") for i in range(700)] + [(6, 1, "user", "again")]
    got = pt.turns(table(spark, rows)).where("conv_id = 5").orderBy("pos").collect()
    want = sorted([turn_digest("user", "again")] * 3000 + [turn_digest("user", f"w {i}") for i in range(700)])
    assert [r["pos"] for r in got] == list(range(3700)) and [bytes(r["digest"]) for r in got] == want


def test_very_long_turns(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "a" * 100_000, "x"), (3, 0, "user", long + "!")]
    got = result(pt.conversation_trie(table(spark, rows)))
    assert got == brute(originals(rows)) and got[0][6] == 200_000
