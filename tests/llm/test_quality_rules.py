import random
import re

import pyarrow as pa
import pytest

from fathomry.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = {}
    for i in range(n - 4):
        wins.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + k for v in wins.values() if len(v) > 1 for i in v for k in range(5)}
    cover, longest, n_max = set(), 0, 0
    at = [max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), 0) for j in range(n) if j != i), default=0) for i in range(n)]
    for i, m in enumerate(at):
        longest = max(longest, m)
        if m >= 8 and not (i and at[i - 1] == m + 1):
            n_max += 1
            cover |= set(range(i, i + m))
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n, len(cover), n_max, longest


CASES = [None, "", " \n\t ", "a", "a a a a a a", "x\nx\n\nx \n y|#", "é ü z " * 6, "one two three four five six seven eight nine ten eleven\n" * 3]


def test_against_brute_force():
    r = random.Random(5)
    texts = CASES + [" ".join(r.choice("abcdef") + r.choice(["", "é", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    got = q.measure(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), q.Limits()).to_pylist()
    for t, g in zip(texts, got, strict=True):
        assert tuple(list(g.values())[1:10]) == brute(t), t


def test_clean_text_is_kept_and_repetitive_text_is_not():
    r = random.Random(1)
    clean = " ".join(str(r.randint(0, 10**6)) for _ in range(300))
    para = " ".join(str(r.randint(0, 10**6)) for _ in range(40))
    got = q.measure(pa.array([1, 2], pa.int64()), pa.array([clean, f"{para}\n{para}\n{clean[:200]}"]), q.Limits()).to_pylist()
    assert [x["kept"] for x in got] == [True, False]


@pytest.mark.parametrize("n, passage, times, kept", [(300, 20, 2, False), (300, 12, 2, True), (400, 9, 6, False), (400, 9, 3, True), (1000, 55, 2, False), (1000, 45, 2, True)])
def test_maximal_repeats_decide_where_the_base_keeps(n, passage, times, kept):
    words = [str(i) for i in range(n - times * passage)]
    step = len(words) // times
    text = " ".join(x for k in range(times) for x in [f"p{i}" for i in range(passage)] + words[k * step : (k + 1) * step if k < times - 1 else None])
    got = q.measure(pa.array([1], pa.int64()), pa.array([text]), q.Limits()).to_pylist()[0]
    assert (got["n_words"], got["covered_words"], got["longest_repeat"]) == (n, times * passage, passage)
    assert not got["base_failed"] and got["kept"] is kept


@pytest.mark.parametrize("rows", [[], [(1, None, 5), (1, None, 5), (None, "a b", 6)]])
def test_frames(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = q.quality_rules(df)
    assert out.count() == len(rows) and out.columns[:2] == ["doc_id", "n_words"]
