import gzip
import hashlib
import os
import random
import zlib
from collections import Counter

import pytest

from fathomry.llm import arc_to_warc as aw

V1 = b"URL IP-address Archive-date Content-type Archive-length\n"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def arc(version, docs, date=b"19970102030405"):
    """An ARC file by hand: docs are (url, ip, date, type, document)."""
    body = b"%d 0 Some Archive\n" % version + (V1 if version == 1 else V2) + b"\n"
    extra = b"" if version == 1 else b"200 - - 0 x.arc "
    out = [b"filedesc://x.arc 0.0.0.0 %s text/plain %s%d\n" % (date, extra, len(body)) + body]
    for url, ip, when, kind, doc in docs:
        more = b"" if version == 1 else b"200 abc - 77 x.arc "
        out.append(b"%s %s %s %s %s%d\n" % (url, ip, when, kind, more, len(doc)) + doc + b"\n")
    return out


DOCS = [
    (b"http://a/with blank/x", b"1.2.3.4", b"199803", b"text/html", b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nbody\nhttp://fake 1.1.1.1 19990101000000 text/html 5\n"),
    (b"dns:a", b"-", b"19981231235959", b"text/dns", b"a. 1 IN A 1.2.3.4\n"),
    (b"http://b/", b"0.0.0.0", b"19991399000000", b"no-type", b"\x00\xff\r\n\r\nbinary"),
    (b"http://c/", b"1.2.3.4", b"20000101000000", b"text/html", b"HTTP/1.1 204 No Content\r\nX: y\r\n"),
]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", ["plain", "members", "one member"])
def test_version_blocks_lengths_and_headers(version, pack):
    parts = arc(version, DOCS)
    content = {"plain": b"".join(parts), "members": b"".join(gzip.compress(p) for p in parts), "one member": gzip.compress(b"".join(parts))}[pack]
    got = list(aw.parsed("f.arc", content))
    assert [r.kind for _, r, _ in got] == ["warcinfo", "response", "resource", "resource", "response"]
    assert [r.uri for _, r, _ in got][1:] == [d[0].decode() for d in DOCS]
    assert [r.head + r.payload for _, r, _ in got][1:] == [d[4] for d in DOCS]
    assert [r.date for _, r, _ in got] == ["1997-01-02T03:04:05Z", "1998-03-01T00:00:00Z", "1998-12-31T23:59:59Z", "1997-01-02T03:04:05Z", "2000-01-01T00:00:00Z"]
    assert [r.content_type for _, r, _ in got][2:4] == ["text/dns", "application/octet-stream"]
    assert got[1][1].payload.startswith(b"body\n") and got[4][1].payload == b"" and len({r.id for _, r, _ in got}) == 5
    assert [r.id for _, r, _ in got] == [r.id for _, r, _ in aw.parsed("f.arc", b"".join(parts))]
    back = list(aw.warc_records(b"".join(r.warc(info) for _, r, info in got)))
    assert [b for _, b in back][1:] == [d[4] for d in DOCS]
    for (_, r, info), (h, b) in zip(got, back, strict=True):
        assert h["warc-block-digest"] == "sha256:" + hashlib.sha256(b).hexdigest() and h["warc-record-id"] == r.id
        assert r.kind == "warcinfo" or (h["warc-payload-digest"] == "sha256:" + r.digest and h["warc-warcinfo-id"] == info)
    assert back[1][0]["warc-ip-address"] == "1.2.3.4" and "warc-ip-address" not in back[2][0]


def test_damage():
    whole = b"".join(arc(1, DOCS))
    *_, (_, last, _) = aw.parsed("f", whole[:-12])
    assert not last.whole and b"WARC-Truncated: length" in last.warc("")
    noisy = whole.replace(b"dns:a -", b"what is this\n\n3 4 5\ndns:a -")
    assert [r.uri for _, r, _ in aw.parsed("f", noisy)] == [r.uri for _, r, _ in aw.parsed("f", whole)]
    packed = b"".join(gzip.compress(p) for p in arc(2, DOCS))
    assert [r.uri for _, r, _ in aw.parsed("f", packed[:-30])][:4] == [r.uri for _, r, _ in aw.parsed("f", whole)][:4]
    assert list(aw.parsed("f", b"")) == [] and list(aw.warc_records(b"junk")) == []


def test_members_end_with_zero():
    for n in (0, 1, 70_000, (16 << 20) + 5):
        m = aw.member(b"a" * n)
        assert m[-1] == 0 and gzip.decompress(m) == b"a" * n
    r = aw.Reader(aw.member(b"ab\n" * 400_000) + aw.member(b"end"), piece=1000)
    assert r.line() == b"ab\n" and len(r.read(3 * 399_999)) == 3 * 399_999 and r.line() == b"end" and r.at == 1_200_003


def pages(seed=1):
    r = random.Random(seed)
    noise = ["\r\n\r\n", "WARC/1.0\r\nContent-Length: 3\r\n", "\0", "é", "x" * 200, "http://a 0.0.0.0 20000101000000 text/html 4\n", "filedesc://"]
    same = ["s" * 99, "t" * 100, "é" * 50, ""]
    rows = [(i, f"http://h/{i} a\n", r.choice([r.choice(same), "".join(r.choice(noise) for _ in range(r.choice([0, 1, 30])))])) for i in r.sample(range(-20, 400), 200)]
    rows += [(1000 + i, None, "hot copy " * 20) for i in range(150)]
    return rows + [(None, None, None), (None, "u", "hot copy " * 20), (5000, "x", "long " * 300_000), (5001, "x", "long " * 300_000), (5001, "x", "long " * 300_000), (None, "v", "only null " * 20), (None, "v", "only null " * 20)]


def brute(rows):
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (html or "").encode()
        again = len(b) >= 100 and b in first
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first.get(b) if again else None))
        first.setdefault(b, page)
    return Counter(out)


@pytest.mark.parametrize("o", [aw.Options(volume_bytes=2000, listed_bytes=-1), aw.Options()])
def test_pages_come_back(spark, tmp_path, o):
    rows = pages()
    df = spark.createDataFrame([(h, u, p, "x", 0) for p, u, h in rows], "html string, url string, page_id long, type string, at int").repartition(3)
    assert Counter(tuple(r) for r in aw.archived(df, o).collect()) == brute(rows)
    assert aw.archived(df.limit(0), o).count() == 0


def test_files_and_payloads(spark, tmp_path):
    """The files on disk are gzip members, in both versions; the WARC files hold every payload once."""
    rows = pages(2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    aw.write_volumes(aw.arc_volumes(df, aw.Options(volume_bytes=3000)), f"file://{tmp_path}/arc")
    versions = Counter()
    for f in os.listdir(tmp_path / "arc"):
        if f.startswith("part-"):
            raw = (tmp_path / "arc" / f).read_bytes()
            versions[gzip.decompress(raw).split(b"\n")[1][:1]] += 1
            z = zlib.decompressobj(31)
            z.decompress(raw)
            assert z.eof and z.unused_data  # a member each
    assert set(versions) == {b"1", b"2"}
    aw.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = aw.records(aw.read_volumes(spark, f"file://{tmp_path}/warc"), with_payload=True).collect()
    assert all(r["declared"] == r["digest"] == hashlib.sha256(r["payload"]).hexdigest() for r in got if r["type"] == "response")
    payloads = Counter(bytes(r["payload"]) for r in got if r["type"] == "response")
    assert all(n == 1 for p, n in payloads.items() if len(p) >= 100) and set(payloads) == {(h or "").encode() for _, _, h in rows}
    assert {r["uri"] for r in got if r["uri"]} == {"".join("%20" if c == " " else "%0A" if c == "\n" else c for c in u or "unknown:") for _, u, _ in rows}
