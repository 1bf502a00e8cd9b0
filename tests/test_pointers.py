import json
import random

import pytest

from fathomry.errors import UsageError
from fathomry.operators import pointers as jp


def test_pick(spark):
    doc = {"images": [{"x": 1, "n/m": "s"}, {"x": [True, None]}], "0": {"~": 5}, "q'q": 2.5, "nul": None}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json"), (3, None), (4, '[{"x": 9}]')], "id int, j string")
    want = ["/images/0/x", "/images/*/x", "/images/0/n~1m", "/0/~0", "/q'q", "/nul", "/images/7", "/images/*/x/*", "#/0/x", "/images/*/zz", ""]
    got = {r["id"]: r for r in jp.pick(df, "j", want).collect()}
    p = got[1]["picked"]
    assert [p[w] for w in want[:10]] == ["1", "[1,[true,null]]", '"s"', "5", "2.5", "null", None, "[null,[true,null]]", None, "[null,null]"]
    assert json.loads(p[""]) == doc and got[1]["missing"] == ["/images/7", "#/0/x"]
    assert got[4]["picked"]["#/0/x"] == "9" and set(got[2]["missing"]) == set(want) == set(got[3]["missing"])
    with pytest.raises(UsageError):
        jp.pick(df, "j", ["/a//b"])
    with pytest.raises(UsageError):
        jp.pick(df, "j", [f"/{i}" for i in range(65)])


def plain(ours, theirs, ignore, extra):
    """Pointers of the differences of two Python values."""
    out = []

    def skip(ptr):
        return (not extra and ptr and ptr[-1] == "extra") or any(len(p) <= len(ptr) and all(x in ("*", y) for x, y in zip(p, ptr)) for p in ignore)  # noqa: B905

    def walk(ptr, a, b, has_a=True, has_b=True):
        if skip(ptr):
            return
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        if has_a and has_b:
            if isinstance(a, dict) and isinstance(b, dict):
                for k in {*a, *b}:
                    walk([*ptr, k], a.get(k), b.get(k), k in a, k in b)
                return
            if isinstance(a, list) and isinstance(b, list):
                for i in range(max(len(a), len(b))):
                    walk([*ptr, str(i)], a[i] if i < len(a) else None, b[i] if i < len(b) else None, i < len(a), i < len(b))
                return
            if number(a) and number(b):
                if a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b)):
                    return
            elif type(a) is type(b) and a == b:
                return
        out.append("".join("/" + x.replace("~", "~0").replace("/", "~1") for x in ptr))

    walk([], ours, theirs)
    return sorted(out)


def value(r, depth):
    k = r.random()
    if depth and k < 0.35:
        return {r.choice(["a", "b/c", "d~", "extra", "0"]): value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if depth and k < 0.6:
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, 1.0, 1.0000000000001, 2, "1", "x", True, None, 1e300, {}, []])


@pytest.mark.parametrize("ignore,extra", [([], False), (["/a/*", "/*/0", "/b~1c"], True)])
def test_diff_like_a_walk(spark, ignore, extra):
    r = random.Random(8)
    docs = [(i, value(r, 4), value(r, 4)) for i in range(60)]
    docs += [(100 + i, a, a) for i, (_, a, _) in enumerate(docs[:10])]
    ours = spark.createDataFrame([(i, json.dumps(a)) for i, a, _ in docs], "id int, j string")
    theirs = spark.createDataFrame([(i, json.dumps(b)) for i, _, b in docs], "id int, j string")
    got = {}
    for x in jp.diff(ours, theirs, ["id"], "j", ignore, extra).collect():
        got.setdefault(x["id"], []).append(x["pointer"])
    parts = [jp.segments(p) for p in ignore]
    want = {i: w for i, a, b in docs if (w := plain(a, b, parts, extra))}
    assert {i: sorted(v) for i, v in got.items()} == want and len(want) > 30


def test_diff_values(spark):
    a = spark.createDataFrame([(1, '{"a":{"b":[1,2]},"n":1}'), (2, "{}"), (4, "bad")], "id int, j string")
    b = spark.createDataFrame([(1, '{"a":{"b":[1]},"n":"1"}'), (3, "[]"), (4, "5")], "id int, j string")
    got = sorted((x["id"], x["pointer"], x["ours"], x["theirs"]) for x in jp.diff(a, b, ["id"], "j").collect())
    assert got == [(1, "/a/b/1", "2", None), (1, "/n", "1", '"1"'), (2, "", "{}", None), (3, "", None, "[]"), (4, "", None, "5")]
    assert jp.diff(a, a, ["id"], "j").count() == 0 and jp.diff(a.limit(0), b.limit(0), ["id"], "j").count() == 0


def test_levels_are_not_shuffled(spark, monkeypatch):
    """Only the documents are joined; members are paired within their rows, wide objects and nulls too."""
    wide = {f"k{i}": i for i in range(3000)}
    rows = [({"a": [{"b": None, "c": 1}]}, {"a": [{"b": 2, "d": None}]}), (wide, wide | {"k7": None, "x": 1}), ({"n": None}, {}), ([None, 1], [1])]
    ours, theirs = (spark.createDataFrame([(i, json.dumps(r[s])) for i, r in enumerate(rows)], "id int, j string") for s in (0, 1))
    plans, real = [], jp.checkpointed

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(jp, "checkpointed", kept)
    got = sorted((x["id"], x["pointer"], x["ours"], x["theirs"]) for x in jp.diff(ours, theirs, ["id"], "j").collect())
    assert got == [(0, "/a/0/b", "null", "2"), (0, "/a/0/c", "1", None), (0, "/a/0/d", None, "null"), (1, "/k7", "7", "null"), (1, "/x", None, "1"), (2, "/n", "null", None), (3, "/0", "null", "1"), (3, "/1", "1", None)]
    assert len(plans) == 4 and [p.count("Join ") for p in plans] == [1, 0, 0, 0]
