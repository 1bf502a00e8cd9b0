"""The pipeline over a small corpus, stage by stage against brute force."""

import random

import pytest
from test_decontaminate import brute as leak_brute
from test_jaccard_join import brute as near_brute
from test_jaccard_join import shingles
from test_packing import library_ids

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: f"{r.choice('bcdfg')}{r.choice(['ark', 'ollow', 'int', 'e'])}{r.randint(0, 99)}"
    text = lambda n: " ".join(word() + ("." if i % 8 == 7 else "") for i in range(n))
    passage, item = text(60), text(14)
    docs, labels = [], []
    for i in range(240):
        t = text(r.randint(30, 90))
        if i % 6 == 0:
            t = t.replace(" ", " foulstem" + r.choice("abc") + " ", 3)
            labels.append((i, 0, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        if i % 40 == 1:
            t = f"{t}\n{passage}"
        if i % 40 == 3:
            t = f"{t}\n{item} tail"
        docs.append((i, t, "en", "s", len(t)))
    docs += [(300, docs[1][1], "en", "s", 1), (301, docs[2][1].replace(docs[2][1].split()[3], "zz", 1), "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out, df = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, df, sf).write.parquet(f"{sf}/{k}")
        df = spark.read.parquet(f"{sf}/{k}")
        out.append(df)
    return docs, passage, item, out, sf


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, stages):
    docs, passage, item, out, sf = stages
    assert [df.columns for df in out[:4]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    left = {d for d, _ in pairs(out[0])}
    toxic = {d[0] for d in docs if "foulstem" in (d[1] or "")}
    assert not left & toxic and len(left) >= len(docs) - len(toxic) - 5
    rest = pairs(out[0])
    want = {x[4] for x in near_brute([p for p in rest if shingles(p[1])])} | {d for d, t in rest if not shingles(t)}
    assert sorted(d for d, _ in pairs(out[1])) == sorted(want)
    before, after = dict(pairs(out[1])), dict(pairs(out[2]))
    holders = sorted(d for d, t in before.items() if passage in (t or ""))
    assert [d for d in holders if passage in after[d]] == holders[:1]
    assert all(after[d] == t for d, t in before.items() if d not in holders)
    clean = dict(pairs(out[3]))
    hits = {x[0]: x[2] for x in leak_brute(list(after.items()), [(1, item)])}
    assert any(hits.values())
    for d, t in after.items():
        assert (clean[d] == t) == (hits[d] == 0) and not leak_brute([(d, clean[d])], [(1, item)])[0][5]
    rows = out[4].collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in library_ids(list(clean.values())))
    assert {r["doc_id"] for r in rows} == set(clean)


def test_run(spark, stages):
    *_, out, sf = stages
    assert sorted(map(str, cp.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(map(str, out[4].drop("sequence_id", "offset").collect()))
