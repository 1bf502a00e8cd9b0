import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
import pyarrow as pa  # noqa: E402

from fathomry.llm import packing, tokenize  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


def library_ids(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_librarys():
    r = random.Random(0)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "é", "1", "½", ".", "$", "'S", "\x0b", "中", "😀", "\x00", "\x85", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, ""]
    ids, offs = tokenize.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == library_ids(texts)


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE", 3)
    e = tokenize.Encoder(PATH)
    for texts in (["a b c"], ["d e f g h"], ["a d"], []):
        ids, offs = e.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == library_ids(texts)


def first_fit_decreasing(count, size):
    gaps = []
    for x in range(size, 0, -1):
        for _ in range(count[x]):
            at = next((i for i, g in enumerate(gaps) if g >= x), None)
            if at is None:
                gaps.append(size - x)
            else:
                gaps[at] -= x
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece_and_fit(seed):
    r = np.random.default_rng(seed)
    size = 64
    count = r.integers(0, 50, size + 1) * (r.random(size + 1) < 0.5)
    count[0] = 0
    used = np.zeros(size + 1, np.int64)
    bins = 0
    for use, times in packing.best_two_fit(count, size):
        assert sum(x * n for x, n in use.items()) <= size and times > 0
        for x, n in use.items():
            used[x] += n * times
        bins += times
    assert (used == count).all()
    assert bins <= first_fit_decreasing(count, size)


def test_two_replace_the_smallest():
    count = np.zeros(11, np.int64)
    count[[7, 2, 1]] = [1, 1, 0]
    assert packing.best_two_fit(count, 10) == [({7: 1, 2: 1}, 1)]
    count[:] = 0
    count[6], count[3], count[2] = 1, 1, 2  # 6 + 3 leaves 1; 2 + 2 fill it
    assert packing.best_two_fit(count, 10)[0] == ({6: 1, 2: 2}, 1)


def test_packing_end_to_end(spark):
    r = random.Random(4)
    texts = [None, "", "a", "a"] + [" ".join(r.choice(["tion", "zq", "the", "é"]) for _ in range(r.randint(0, 90))) for _ in range(120)]
    docs = [(i if i != 3 else 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string").repartition(3)
    size = 32
    rows = packing.pack(df, PATH, size, with_ids=True).collect()
    want = {}
    for (d, _), ids in zip(docs, library_ids(texts), strict=True):
        want.setdefault(d, []).append([*ids, 0])
    got = {}
    for x in rows:
        got.setdefault(x["doc_id"], []).append(x)
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and x["length"] == len(x["ids"])
    for d, full in want.items():
        parts = sorted(got[d], key=lambda x: (x["start"], x["sequence_id"]))
        if len(full) == 1:
            assert [p for x in parts for p in x["ids"]] == full[0]
            assert [x["piece"] for x in parts] == list(range(len(parts)))
            assert all(x["length"] == size for x in parts[1:])
    seqs = {}
    for x in rows:
        seqs.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= size
    whole = packing.sequences(df, PATH, size).collect()
    assert sum(len(x["ids"]) for x in whole) == sum(len(f) for x in want.values() for f in x)
    assert packing.pack(df.limit(0), PATH).count() == 0
