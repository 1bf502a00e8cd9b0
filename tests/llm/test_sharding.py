import zlib
from collections import Counter

import pytest

from fathomry.llm import sharding as sh


def rows(n):
    return [(i, None if i % 7 == 0 else "é" * (i % 11)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 5, 24, 1000])
def test_counts_slots_and_digests(spark, n):
    data = rows(n) + ([(3, "x")] * 400 + [(None, None)] if n == 1000 else [])
    out = sh.shard(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in data)
    counts = Counter(x["shard"] for x in out)
    sizes = [counts[s] for s in range(24)]
    assert sum(sizes) == len(data) and max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(counts[s]))


def test_keys_go_to_their_arc_unless_it_is_full():
    points = sh.ring(4, 8)
    counts = {a: 3 * (a % 5) for a in range(len(points))}
    total = sum(counts.values())
    runs = sh.place(counts, points, sh.rooms(total, 4))
    assert sum(b - a for _, a, b, *_ in runs) == total
    for arc, n in counts.items():
        mine = sorted(r for r in runs if r[0] == arc)
        assert [r[1] for r in mine] == [0, *[r[2] for r in mine[:-1]]][: len(mine)] and (not n or mine[-1][2] == n)
    loads = Counter()
    for _, a, b, s, _ in runs:
        loads[s] += b - a
    assert max(loads.values()) - min(loads.values()) <= 1


def test_a_shard_more_moves_a_limited_share():
    def owners(shards):
        points = sh.ring(shards)
        counts = Counter(sh.bisect_left([p for p, _ in points], k * 429_497 % 2**32) % len(points) for k in range(10_000))
        where = {}
        for arc, a, b, s, _ in sh.place(counts, points, sh.rooms(10_000, shards)):
            where[arc] = where.get(arc, []) + [(a, b, s)]
        seen, out = Counter(), []
        for k in range(10_000):
            arc = sh.bisect_left([p for p, _ in points], k * 429_497 % 2**32) % len(points)
            r = seen[arc]
            seen[arc] += 1
            out.append(next(s for a, b, s in where[arc] if a <= r < b))
        return out

    a, b = owners(24), owners(25)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.35 * 10_000


def test_arcs_match_a_plain_search(spark):
    points = sh.ring(24)
    positions = [p for p, _ in points]
    hashes = [0, 1, 2**32 - 1, *positions[:50], *(p + 1 for p in positions[-50:]), *range(0, 2**32, 91_234_567)]
    got = spark.createDataFrame([(h,) for h in hashes], "h long").select("h", sh._arc(sh.F.col("h"), points).alias("a")).collect()
    assert all(x["a"] == sh.bisect_left(positions, x["h"]) % len(points) for x in got)
