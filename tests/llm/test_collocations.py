import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from fathomry.llm import collocations as co


def brute(rows, o):
    """Plain Python over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, o.max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= o.min_count}
    out = []
    for (lang, w), a in cands.items():
        inside = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))  # noqa: B023, E731
        if any(g == lang and len(x) > len(w) and inside(x) and 100 * b >= o.absorbed * a for (g, x), b in cands.items()):
            continue
        score, k = min((o.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], len(w), k))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right, words, k in sorted(out):
        rank[lang] += 1
        if rank[lang] <= o.top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score, words, k))
    return got


def texts(seed=3, n=300):
    r = random.Random(seed)
    vocabulary = ["new", "York", "new york", "City", "the", "of", "éa", "Über", "x", "a\tb", "ßß"]
    end = [" ", " ", " ", ".", ", ", "\n", "  ", " ", " ", "!"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocabulary) + r.choice(end) for _ in range(r.choice([0, 1, 4, 40])))) for _ in range(n)]
    return rows + [("en", None), ("fr", ""), ("en", "ha " * 500), ("de", "....,,"), ("EN", "new york city " * 40), *[("en", "one two three four")] * 12]


@pytest.mark.parametrize("o", [co.Options(min_count=5, top=40), co.Options(min_count=9, top=10_000, absorbed=50, block_bytes=400), co.Options(max_n=3, min_count=3)])
def test_like_brute_force(spark, o):
    rows = texts()
    df = spark.createDataFrame([(t, g, "x", 1, 2) for g, t in rows], "text string, lang string, phrase string, f int, a int").repartition(5)
    want = brute(rows, o)
    assert sorted(tuple(x) for x in co.collocations(df, o).collect()) == want and len(want) > 10


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "too rare to count")], "lang string, text string")
    assert co.collocations(df).count() == 0 and co.collocations(df.limit(0)).count() == 0
    only = spark.createDataFrame([(None, None)], "lang string, text string")
    assert co.collocations(only).count() == 0


def test_counts_beyond_64_bits(spark):
    """2,000,000 times a count of 2**50 passes 64 bits."""
    a = (1 << 50) + 7
    df = spark.createDataFrame([("en", "p", a + 1, 1), ("en", "q", a + 5, 1), ("en", "p q", a, 2)], "lang string, phrase string, f long, words int")
    (got,) = co.scored(df).collect()
    assert got["score"] == 2_000_000 * a // (2 * a + 6) and got["k"] == 1


def test_a_full_bit_set_changes_nothing():
    rows = texts(5, 60)
    t = pa.table([pa.array([g for g, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], names=["lang", "text"])
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang if lang is not None else "und", " ".join(w[i : i + 3])) for i in range(len(w) - 2))
    full = b"\xff" * 64
    got = {tuple(x["key"].split("\n")[::-1]): x["f"] for x in co.grams(t, 3, [full, full]).to_pylist()}
    assert got == dict(want)
    assert co.grams(t, 3, [full, b"\0" * 64]).num_rows == 0 and co.grams(t.slice(0, 0), 2, [full]).num_rows == 0


def test_the_bit_set_has_what_is_frequent():
    """Hashes of whole phrases are those that the blocks look for."""
    t = pa.table([pa.array(["en", "de", None]), pa.array(["a bé c d. a bé", "a bé c", "x\ty z"])], names=["lang", "text"])
    keys = [k.split("\n") for k in co.grams(t, 2, [b"\xff" * 64])["key"].to_pylist()]
    only = [k for k in keys if k == ["a bé", "en"] or k == ["bé c", "en"]]
    bits = bytearray(8 << 12)
    for h in co.phrase_hashes(pa.array([k[1] for k in only]), pa.array([k[0] for k in only])).tolist():
        bits[8 * ((h >> 6) % (1 << 12)) + (h & 63) // 8] |= 1 << (h & 7)
    got = co.grams(t, 3, [b"\xff" * 64, bytes(bits)])["key"].to_pylist()
    assert got == ["a bé c\nen"]


def test_very_long_texts_and_words(spark):
    n = 60_000
    df = spark.createDataFrame([("en", "x y " * n), ("en", "w" * 300_000), ("en", "x" * 10 + "," * 200_000)], "lang string, text string")
    got = [(r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in co.collocations(df).orderBy("rank").collect()]
    total = 2 * n + 2
    assert {g[0]: (g[1], g[4]) for g in got} == {"x y x y": (n - 1, total), "y x y x": (n - 2, total)}
