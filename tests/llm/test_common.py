import random

import pandas as pd
import pyarrow as pa
import pytest

from fathomry.llm import common, near, vec


def test_sample_takes_different_rows_and_survives_repeats(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(i, "b") for i in range(30)] + [(None, None)], "doc_id long, text string")
    got = common.sample(df, 20).collect()
    assert len(got) == 20 and len({(r["doc_id"], r["text"]) for r in got}) == 20
    assert common.sample(df, 1000).count() == 32 and common.sample(df.limit(0), 5).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    ids = spark.range(500).selectExpr("xxhash64(id) h")
    bits = common.bitmap(ids, "h")
    h = ids.toPandas()["h"].to_numpy()
    assert common.in_bitmap(bits, h).all()
    assert near.matching(ids.withColumnRenamed("h", "k"), "k", ids.limit(3).withColumnRenamed("h", "k")).count() >= 3


def test_words_and_shingles_of_slices():
    a = pa.array(["skip", None, "One two\tthree  four five six", "x"]).slice(1)
    buf, offs = vec.flat(a)
    start, end, doc, h = vec.words(buf, offs)
    assert [bytes(buf[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["One", "two", "three", "four", "five", "six", "x"]
    assert doc.tolist() == [1] * 6 + [2]
    sh, sd = vec.shingles(h, doc, 3, 5)
    assert sd.tolist() == [1, 1, 2] and len(set(sh.tolist())) == 3
    long = "w" * 100_000
    assert len(set(vec.words(*vec.flat(pa.array([long, long + "x", long.upper()])))[3].tolist())) == 2
    assert pd.Series(vec.mix(sh)).is_unique


def smallest(edges):
    """Union-find: each node's component."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def band_stars(n, bands=26):
    """Edges of n near copies: in each band, those of one key go to the key's smallest."""
    r = random.Random(n)
    ids = [r.getrandbits(62) for _ in range(n)]
    out = set()
    for _ in range(bands):
        keys = {}
        for i in ids:
            keys.setdefault(r.randrange(20), []).append(i)
        out |= {(min(v), x) for v in keys.values() for x in v if x != min(v)}
    return sorted(out)


def joined_rows(spark, run):
    """Output rows of all joins of the queries that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total, all_ = 0, store.executionsList()
    for i in range(done, all_.size()):
        k = all_.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            ms = node.metrics()
            for m in (ms.apply(j) for j in range(ms.size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    total += int(v.get().replace(",", ""))
    return total


def test_components_join_the_edges_of_a_group_once(spark):
    joined = {}
    for n in (300, 600):
        edges, got = band_stars(n), []
        df = spark.createDataFrame(edges, "a long, b long")
        joined[n] = joined_rows(spark, lambda df=df, got=got: got.extend(common.components(df).collect()))
        assert dict(map(tuple, got)) == smallest(edges) and len(got) == n
        assert len(edges) <= 26 * n and 0 < joined[n] <= 2 * len(edges)
    assert joined[600] <= 2.2 * joined[300]


def _edges():
    r = random.Random(2)
    chain = list(range(-150, 150))
    r.shuffle(chain)
    return {
        "shuffled chain": list(zip(chain, chain[1:], strict=False)),
        "hub": [(1000, i) for i in range(300)] + [(5, 5)],
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(220)],
        "nulls and loops": [(1, 2), (2, 1), (None, 3), (4, 4)],
        "empty": [],
    }


@pytest.mark.parametrize("name", _edges())
def test_components_against_union_find(spark, name):
    edges = _edges()[name]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, got)) == smallest(edges) and len(got) == len(smallest(edges))
