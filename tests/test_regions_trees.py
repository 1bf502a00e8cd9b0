import hashlib
import random
import re

import numpy as np
import pytest

from fathomry.errors import UsageError
from fathomry.operators import regions, trees

TILE = "image int, level int, x long, y long, width int, height int, pixels array<int>"
REGION = "id int, image int, level int, x long, y long, width int, height int"


def planes(seed=2):
    """Planes of several sizes in tiles that overlap, are missing, begin outside, or are cut short; and what they show."""
    r, tiles, shown = random.Random(seed), [], {}
    for image in range(3):
        for level, (w, h) in enumerate([(60, 45), (30, 23)]):
            plane, own = np.zeros((h, w), int), []
            for y in range(-3, h, 11):
                for x in range(-2, w, 13):
                    if r.random() < 0.15:
                        continue
                    tw, th = 14, 12
                    own.append((y, x, tw, th, [r.randint(1, 999) for _ in range(tw * th - (50 if r.random() < 0.2 else 0))]))
            for y, x, tw, th, px in sorted(own):
                for k, v in enumerate(px):
                    yy, xx = y + k // tw, x + k % tw
                    if 0 <= yy < h and 0 <= xx < w:
                        plane[yy, xx] = v
                tiles.append((image, level, x, y, tw, th, px))
            shown[image, level] = plane
    return tiles, shown


@pytest.mark.parametrize("cell", [4, 16, 512])
def test_rectangles_are_slices(spark, cell):
    tiles, shown = planes()
    r, asked = random.Random(4), []
    for i in range(40):
        image, level = r.randint(0, 2), r.randint(0, 1)
        h, w = shown[image, level].shape
        x, y = r.randint(0, w - 1), r.randint(0, h - 1)
        asked.append((i, image, level, x, y, r.randint(1, w - x), r.randint(1, h - y)))
    asked += [(90, 9, 0, 0, 0, 3, 2), (91, 0, 0, 5, 5, 0, 4), (92, None, 0, 1, 1, 1, 1)]
    got = {}
    for x in regions.read(spark.createDataFrame(tiles, TILE), spark.createDataFrame(asked, REGION), ["image", "level"], ["id"], cell).collect():
        got[x["id"], x["row"]] = list(x["values"])
    want = {(i, k): shown[image, level][y + k, x : x + w].tolist() for i, image, level, x, y, w, h in asked[:40] for k in range(h)}
    assert got == want | {(90, 0): [0, 0, 0], (90, 1): [0, 0, 0], (92, 0): [0]}


def test_pairs_meet_once_and_overlap(spark):
    tiles, _ = planes(5)
    asked = spark.createDataFrame([(1, 0, 0, 3, 3, 40, 30), (2, 0, 1, 29, 22, 1, 1)], REGION)
    pairs = [(r["id"], r["tx"], r["ty"]) for r in regions.overlaps(spark.createDataFrame(tiles, TILE), asked, ["image", "level"], ["id"], 8).collect()]
    want = [(i, t[2], t[3]) for i, lv, x, y, w, h in [(1, 0, 3, 3, 40, 30), (2, 1, 29, 22, 1, 1)] for t in tiles if t[:2] == (0, lv) and max(t[2], x) < min(t[2] + t[4], x + w) and max(t[3], y) < min(t[3] + t[5], y + h)]
    assert sorted(pairs) == sorted(want)


def test_levels_checks_and_rescaling(spark):
    assert regions.parse(" 1, 2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "1,2,0,4", "a,1,1,1", "-1,1,1,1"):
        with pytest.raises(UsageError):
            regions.parse(bad)
    levels = spark.createDataFrame([(1, 0, 1000, 800), (1, 1, 500, 400), (1, 2, 250, 200), (2, 0, 90, 80)], "image int, level int, plane_width int, plane_height int")
    pick = lambda n: {r["image"]: r["level"] for r in regions.best_level(levels, ["image"], n).collect()}
    assert pick(250) == {1: 2, 2: 0} and pick(251) == {1: 1, 2: 0} and pick(5000) == {1: 0, 2: 0}
    asked = spark.createDataFrame([(1, 1, 0, 999, 0, 1, 800), (2, 1, 2, 250, 0, 1, 1), (3, 1, 1, 0, 0, 0, 1), (4, 7, 0, 0, 0, 1, 1)], REGION)
    assert {r["id"]: r["problem"] for r in regions.outside(asked, levels, ["image", "level"]).collect()} == {2: "extends past the plane", 3: "empty", 4: "no such plane"}
    from pyspark.sql import functions as F

    spans = [(0, 1, 10, 3), (9, 1, 10, 3), (3, 4, 10, 10), (5, 2, 7, 0), (2, 5, 9, 4), (10**9, 5, 4 * 10**9, 3 * 10**9 + 1)]
    df = spark.createDataFrame(spans, "x long, n long, have long, want long")
    a, b = regions.rescaled(F.col("x"), F.col("n"), F.col("have"), F.col("want"))
    for r in df.select("*", a.alias("start"), b.alias("size")).collect():
        lo, hi = r["x"] * r["want"] // r["have"], -(-(r["x"] + r["n"]) * r["want"] // r["have"])
        lo, hi = min(lo, max(r["want"] - 1, 0)), min(max(hi, lo + 1), r["want"])
        assert (r["start"], r["size"]) == (lo, max(hi - lo, 1))


def tree(seed=1):
    r = random.Random(seed)
    files = ["/".join(["", *(r.choice("abc") for _ in range(r.randint(0, 8))), f"f{i}"]) for i in range(400)]
    claims = [("/".join(["", *(r.choice("abc") for _ in range(r.randint(1, 6)))]), r.random() < 0.3, i) for i in range(60)]
    return files, [*claims, ("/a//b/", None, 99), (None, True, 98), (files[0], True, 97)]


def ups(p):
    parts = [x for x in p.split("/") if x]
    return ["/" + "/".join(parts[:n]) for n in range(len(parts) + 1)]


def test_owners_and_nearest(spark):
    files, claims = tree()
    df = spark.createDataFrame([(f, "x", 1) for f in files] + [(None, "y", 2)], "path string, definite string, v int")
    c = spark.createDataFrame(claims, "path string, definite boolean, n int")
    known, least = {}, {}
    for p, d, n in claims:
        if p is not None:
            p = ups(p)[-1]
            known[p] = known.get(p, False) or bool(d)
            least[p] = min(least.get(p, n), n)
    holding = {u for p in known for u in ups(p)[:-1]}
    want = {f: next((u for u in ups(f) if u in known and (known[u] or u not in holding)), None) for f in files}
    got = {r["path"]: r["data_set"] for r in trees.owners(df, c, "path").collect()}
    assert got == want | {None: None} and len(set(want.values())) > 5
    near = {r["path"]: r["n"] for r in trees.nearest(df, c, "path", "path", ["n"]).collect()}
    assert near == {f: next((least[u] for u in reversed(ups(f)) if u in least), None) for f in files} | {None: None}


def test_fingerprints(spark):
    files, _ = tree(3)
    rows = [(f, i % 7, f"h{i % 5}") for i, f in enumerate(files)] + [("//x//y/", 1, None), ("/x/y", 1, None), (None, 1, "z"), ("/q/s", None, "c")]
    got = {r["folder"]: (r["files"], r["bytes"], r["fingerprint"]) for r in trees.fingerprints(spark.createDataFrame(rows, "path string, n long, c string").repartition(7), "path", "c", "n").collect()}
    want = {}
    for p, n, c in rows:
        if p is not None:
            p = ups(p)[-1]
            for u in ups(p)[:-1]:
                h = hashlib.sha256(f"{p if u == '/' else p[len(u):]}\0{'' if n is None else n}\0{c or ''}".encode()).hexdigest()
                w = want.setdefault(u, [0, 0, [0] * 8])
                w[0], w[1] = w[0] + 1, w[1] + (n or 0)
                w[2] = [a + int(b, 16) for a, b in zip(w[2], re.findall("." * 8, h), strict=True)]
    assert got == {u: (n, b, hashlib.sha256(",".join(map(str, [n, *lanes])).encode()).hexdigest()) for u, (n, b, lanes) in want.items()}
    moved = lambda top, names: {r["folder"]: r["fingerprint"] for r in trees.fingerprints(spark.createDataFrame([(f"{top}/{n}", 1, "c") for n in names], "path string, n long, c string"), "path", "c", "n").collect()}[top]
    assert moved("/a", ["x/1", "2"]) == moved("/b/c", ["2", "x/1"]) != moved("/a", ["x/1", "3"])
