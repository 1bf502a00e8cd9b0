import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.errors import CorruptInput, UsageError
from fathomry.sources import formats, tables


@pytest.mark.parametrize("ext", ["csv", "tsv", "jsonl", "parquet"])
def test_tables_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a,b\"c", 1.5), (2, None, -2.0)], "n long, t string, v double")
    path = str(tmp_path / f"t.{ext}")
    tables.save_table(df, path)
    assert sorted(map(str, tables.read_table(spark, path).select("n", "t", "v").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="exists"):
        tables.save_table(df, path)
    tables.save_table(df, path, overwrite=True)


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("file;condition;condition\n a.fcs ;ctrl;1\nb.fcs;;2\n")
    s = tables.read_sheet(spark, str(tmp_path / "s.csv"))
    assert s.columns == ["file", "condition", "condition_2"] and s.where("condition is null").count() == 1 and dict(s.dtypes)["condition_2"] == "bigint"
    with pytest.raises(UsageError):
        tables.read_table(spark, "x.doc")


def test_crawl_changes_and_sniff(spark, tmp_path):
    for n, c in (("a.fcs", b"FCS3.1xx"), (".hidden", b"x"), ("sub/b.tif", b"II*\x00abc")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(c)
    c = tables.crawl(spark, str(tmp_path))
    assert sorted(r["name"] for r in c.collect()) == ["a.fcs", "b.tif"]
    before = spark.createDataFrame([("x", 1, None, "f1"), ("y", 2, None, "f2")], "path string, size_bytes long, mtime timestamp, fp string")
    now = spark.createDataFrame([("z", 1, None, "f1"), ("w", 3, None, "f3")], "path string, size_bytes long, mtime timestamp, fp string")
    assert {r["path"]: (r["change"], r["moved_from"]) for r in tables.changes(now, before, "fp").collect()} == {"z": ("moved", "x"), "w": ("new", None), "x": ("gone", None), "y": ("gone", None)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert {r[0] for r in files.select(tables.sniff(F.col("content"))).collect()} >= {"fcs", "tiff"}


def test_formats(spark, tmp_path):
    formats.register(spark)
    load = lambda name, text, ext="txt": ((tmp_path / f"{name}.{ext}").write_text(text), spark.read.format(name).load(str(tmp_path / f"{name}.{ext}")).collect())[1]
    q = load("fastq", "@r1 x\nACG\nT\n+\nII@I\n@r2\nA\n+\n@\n")
    assert [(r["id"], r["sequence"], r["quality"]) for r in q] == [("r1", "ACGT", "II@I"), ("r2", "A", "@")]
    assert [r["length"] for r in load("fasta", ">a b\nAC\nGT\n>c\n\n")] == [4, 0]
    m = load("mgf", "BEGIN IONS\nTITLE=t\nPEPMASS=500.5 10\nCHARGE=2+\n100.0 5\n200 7.5\nEND IONS\n")
    assert m[0]["precursor_mz"] == 500.5 and m[0]["charge"] == 2 and m[0]["intensity"] == [5.0, 7.5]
    assert sorted((r["well"], r["value"]) for r in load("plate", "x\n,1,2\nA,0.5,\nB,1,OVER\n")) == [("A01", 0.5), ("B01", 1.0)]
    assert [(r["x"], r["y"]) for r in load("jcamp", "##TITLE=t\n##FIRSTX=0\n##LASTX=2\n##NPOINTS=3\n##YFACTOR=2\n##XYDATA=(X++(Y..Y))\n0 1 2\n2 3\n##END=\n")] == [(0.0, 2.0), (1.0, 4.0), (2.0, 6.0)]
    enc = lambda v: base64.b64encode(np.array(v, "<f8").tobytes()).decode()
    arr = lambda acc, v: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{acc}"/><binary>{enc(v)}</binary></binaryDataArray>'
    x = load("mzml", f'<?xml version="1.0"?><mzML><run><spectrumList><spectrum id="s1"><cvParam accession="MS:1000511" value="1"/><cvParam accession="MS:1000016" value="2" unitAccession="UO:0000031"/>{arr("MS:1000514", [1.0, 2.0])}{arr("MS:1000515", [3.0, 4.0])}</spectrum></spectrumList></run></mzML>')
    assert x[0]["rt_s"] == 120.0 and x[0]["mz"] == [1.0, 2.0] and x[0]["intensity"] == [3.0, 4.0] and x[0]["ms_level"] == 1


def test_fcs(spark, tmp_path):
    formats.register(spark)
    v = np.array([[e * 10 + c + 0.5 for c in range(3)] for e in range(12)])
    formats.write_fcs(str(tmp_path / "a.fcs"), ["FSC-A", "SSC-A", "Time"], v)
    out = spark.read.format("fcs").load(str(tmp_path / "a.fcs")).orderBy("event").collect()
    assert len(out) == 12 and [out[3]["values"][c] for c in ("FSC-A", "SSC-A", "Time")] == v[3].tolist()
    (tmp_path / "bad.fcs").write_bytes(b"nope")
    with pytest.raises(CorruptInput):
        list(formats.fcs(str(tmp_path / "bad.fcs"), {}))
