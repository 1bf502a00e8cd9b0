"""The registered queries over the whole tables of sf0.001, against SQL or brute force."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from oracle import DATA, compare
from test_decontaminate import low
from test_jaccard_join import brute as near_brute
from test_packing import first_fit_decreasing, library_ids

from fathomry.llm import registry

SF = str(DATA / "sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLE[name]) is None


def test_op1_base(spark, docs):
    c = Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*WORD.findall(low(t)), "the end"])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_ctw_score"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        w = [*WORD.findall(low(t)), "the end"]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r["score"] < 0


def test_op2_packs_every_piece(spark, docs):
    rows = registry.QUERIES["op2_pack_best_two_fit"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    count = np.zeros(2049, np.int64)
    for (d, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        full = np.array([*ids, 0], "<u4")
        cut = len(full) % 2048 or 2048
        edges = [0, *range(min(cut, len(full)), len(full) + 1, 2048)]
        parts = sorted(by[d], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        assert all(r["ids_crc32"] == zlib.crc32(full[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
        for r in parts:
            count[r["length"]] += 1
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert len(seqs) <= first_fit_decreasing(count, 2048)


def test_op3_links(spark, docs):
    got = registry.QUERIES["op3_jaccard_join"](spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "class_id", "n_copies", "n_links", "group_id").collect()) == near_brute(docs)


def test_op5_keeps_most(spark, docs):
    got = registry.QUERIES["op5_weak_labels"](spark, SF).collect()
    assert len(got) == len(docs) and 0.6 < np.mean([r["kept"] for r in got]) < 1


def test_op6_base_counts(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_quality_rules"](spark, SF).collect()}
    for d, t in docs:
        w, r = WORD.findall(t or ""), got[d]
        wins = {}
        for i in range(len(w) - 4):
            wins.setdefault(tuple(w[i : i + 5]), []).append(i)
        rep = len({i + k for v in wins.values() if len(v) > 1 for i in v for k in range(5)})
        lines = Counter(x for x in (t or "").split("\n") if WORD.search(x))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(lines.values()) - len(lines), rep)
        assert r["base_failed"] == (len(w) < 10 or 100 * rep > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_op7_rows(spark, docs):
    got = registry.QUERIES["op7_toxicity_pu"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op8_shards(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_shard_ring"](spark, SF).collect()}
    for d, t in docs:
        assert (got[d]["size"], got[d]["text_crc32"]) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    n = Counter(r["shard"] for r in got.values())
    assert set(n) <= set(range(24)) and max(n.values()) - min(n[s] for s in range(24)) <= 1


def test_op10_leaves_no_shared_passage(spark, docs):
    got = registry.QUERIES["op10_substring_dedup"](spark, SF).collect()
    assert len(got) == len(docs)
    seen = {}
    for r in got:
        for line in (r["text"] or "").split("\n"):
            w = WORD.findall(low(line))
            if len(w) >= 50:
                assert seen.setdefault(tuple(w), r["doc_id"]) == r["doc_id"]
    texts = dict(docs)
    for r in got:
        t, at, out = texts[r["doc_id"]] or "", 0, ""
        for s in r["removed"]:
            out, at = out + t[at : s["start"]], s["end"]
        assert out + t[at:] == (r["text"] or "")
