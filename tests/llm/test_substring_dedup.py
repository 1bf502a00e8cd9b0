import random

from fathomry.llm import common, near
from fathomry.llm import substring_dedup as sd
from test_common import joined_rows
from test_jaccard_join import shingles


def line(r, n, stop=9):
    return " ".join(f"w{r.randint(0, 5000)}" + ("." if i % stop == stop - 1 else "") for i in range(n))


def test_near_paragraphs_and_embedded_passages_go_and_the_rest_stays(spark):
    r = random.Random(7)
    para, passage = line(r, 50), line(r, 63)
    near_para = para.replace(para.split()[25], "changed")
    assert len(shingles(para) & shingles(near_para)) >= 0.8 * len(shingles(para) | shingles(near_para))
    docs = [
        (5, f"{line(r, 30)}\n{para}\n{line(r, 12)}", 1),
        (2, f"{para}\nshort é tail.", 2),
        (9, f"{near_para}\n{line(r, 25)}", 3),
        (3, f"Opening words here are. {passage} closing words of é this.", 4),
        (4, f"Other opening it has. {passage} and goes on in its own way.", 5),
        (6, line(r, 200), 6),
        (7, None, 7),
        (8, "", 8),
        (None, f"{para}", 9),
        (6, "a b c d. e f g h.", 10),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_removed int")
    out = {x["n_removed"]: x["text"] for x in sd.deduplicate(df).collect()}
    assert len(out) == len(docs)
    assert out[2] == docs[1][1] and out[4] == docs[3][1] and out[6] == docs[5][1] and out[10] == docs[9][1]
    assert para not in out[1] and docs[0][1].split("\n")[2] in out[1]
    assert near_para not in out[3] and out[3].strip() == docs[2][1].split("\n")[1]
    assert out[5] == "Other opening it has.  and goes on in its own way."
    assert out[7] is None and out[8] == "" and out[9] == ""
    rep = {(x["doc_id"], x["n_words"]): x for x in sd.report(df).collect()}
    x = rep[(4, len(docs[4][1].split()))]
    assert x["n_removed"] == 63 and [docs[4][1][y["start"] : y["end"]] for y in x["removed"]] == [passage]


def test_all_similar_paragraphs_are_found(spark):
    r = random.Random(1)
    base = [line(r, 40, stop=1000) for _ in range(4)]  # one sentence each: only the paragraph rule can catch them
    paras = []
    for k in range(40):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        paras.append(" ".join(w))
    out = {x["doc_id"]: x["text"] for x in sd.deduplicate(spark.createDataFrame(list(enumerate(paras)), "doc_id long, text string")).collect()}
    o = sd.Options()
    seen: list[int] = []
    comp = list(range(len(paras)))
    sh = [shingles(p) for p in paras]
    for i in range(len(paras)):
        for j in range(i):
            if len(sh[i] & sh[j]) >= o.threshold * len(sh[i] | sh[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    seen = [i for i in range(len(paras)) if comp[i] == i]
    for i, p in enumerate(paras):
        if i in seen:
            assert out[i] == p
        else:
            assert out[i] == "" or len(out[i]) < len(p)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.deduplicate(df).count() == 0
    p = line(random.Random(3), 30)
    df = spark.createDataFrame([(1, p), (1, p), (2, p)], "doc_id long, text string")
    assert sorted((x["doc_id"], x["text"]) for x in sd.deduplicate(df).collect()) == [(1, p), (1, p), (2, "")]
    assert near.tuned(0.8, sd.Options().rows, 1e-4) == sd.Options().plan.bands


def without_shared_runs(docs, run):
    """Brute force: every word in a stretch of `run` words or more that a document of a smaller doc_id has goes."""
    windows = lambda w: [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]
    out = {}
    for d, t in docs:
        w = t.split()
        earlier = {x for e, s in docs if e < d for x in windows(s.lower().split())}
        gone = {j for i, x in enumerate(windows(t.lower().split())) if x in earlier for j in range(i, i + run)}
        out[d] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_passages_cut_in_mid_sentence_and_without_stops_go(spark):
    r = random.Random(11)
    mid, bare, one = line(r, 55), line(r, 52, stop=10_000), line(r, 50, stop=10_000)
    head, tail = (lambda: line(r, 7 * r.randint(7, 9), stop=7) + " " + line(r, 3)), (lambda: line(r, 3) + " " + line(r, 50, stop=7))
    docs = [(k * 2 + j, f"{head()} {p} {tail()}") for k, p in enumerate((mid, bare, one + ".")) for j in (0, 1)]
    docs.append((9, f"{head()} {bare.replace(' ', chr(10), 3)} {tail()}"))  # the same words over lines
    docs.append((10, f"{head()} {' '.join(mid.split()[:39])} {tail()}"))  # under min_run words: stays
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in sd.deduplicate(df).collect()}
    for d, t in docs:
        p = {1: mid, 3: bare, 5: one + ".", 9: bare.replace(" ", "\n", 3)}.get(d)
        assert out[d] == (t.replace(f" {p} ", "  ") if p else t)


def test_exactly_the_shared_stretches_go(spark):
    r = random.Random(5)
    base = [line(r, 200, stop=r.choice([6, 10_000])) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(r.randint(1, 3)):
            w = r.choice(base).split()
            at = r.randint(0, 150)
            parts += [line(r, r.randint(1, 30))] + w[at : at + r.choice([30, 39, 40, 41, 50, 80, 120])]
        if k % 7 == 0:
            parts += ["same"] * r.randint(35, 60)
        docs.append((k, " ".join(parts)))
    o = sd.Options(min_words=10_000)  # no paragraph is that long: passages alone
    want = without_shared_runs(docs, o.min_run)
    out = {x["doc_id"]: x["text"].split() for x in sd.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), o).collect()}
    assert out == want and any(len(want[d]) < len(t.split()) for d, t in docs)


def test_edges_of_near_paragraphs_are_joined_once(spark, monkeypatch):
    r, seen = random.Random(4), []
    base = [f"w{i}" for i in range(39)]
    docs = []
    for k in range(300):
        w = list(base)
        w[r.choice([0, 38])] = f"x{k}"  # at least 33 of 37 shingles are shared, but no stretch of 40 words
        docs.append((k, " ".join(w)))

    def counted(edges):
        out = []
        edges = common.stored(edges, "edges")
        rows = joined_rows(spark, lambda: out.append(common.stored(common.components(edges), "labels")))
        seen.append((edges.where("a <> b").distinct().count(), rows))
        return out[0]

    monkeypatch.setattr(near, "components", counted)
    got = dict(sd.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text").collect())
    assert got.pop(0) == docs[0][1] and set(got.values()) == {""}
    assert len(seen) == 2 and all(rows <= 2 * edges for edges, rows in seen), seen
