"""Readers of self-describing lab formats, as Python data sources.

One partition per file; a reader yields Arrow batches or tuples. Register them with ``register(spark)``:
fastq, fasta, mgf, fcs, plate (matrix CSV), mzml, jcamp.
"""

from __future__ import annotations

import base64
import glob
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CorruptInput


class FileReader(DataSourceReader):
    """Lists the files of `path` on the driver, reads each in its own partition."""

    def __init__(self, options: dict, parse):
        self.options, self.parse = options, parse

    def partitions(self):
        path = self.options["path"]
        path = path.removeprefix("file://")
        files = sorted(f for f in glob.glob(path + "/**", recursive=True) if os.path.isfile(f)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [InputPartition(f) for f in files]

    def read(self, partition):
        yield from self.parse(partition.value, self.options)


def _source(short: str, ddl: str, parse):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return short

        def schema(self):
            return ddl

        def reader(self, schema):
            return FileReader(dict(self.options), parse)

    Source.__name__ = f"{short.title()}Source"
    return Source


def fastq(path: str, options: dict) -> Iterator[tuple]:
    """Records whose sequence and quality may span lines."""
    with open(path, encoding="ascii", errors="replace") as f:
        line = f.readline()
        while line:
            if not line.strip():
                line = f.readline()
                continue
            if line[0] != "@":
                raise CorruptInput(f"{path}: a record must begin with @")
            name, seq, line = line[1:].strip(), "", f.readline()
            while line and line[0] != "+":
                seq += line.strip()
                line = f.readline()
            qual, line = "", f.readline()
            while line and len(qual) < len(seq):
                qual += line.rstrip("\r\n")
                line = f.readline()
            yield path, name.split()[0] if name else "", seq, qual, len(seq)


def fasta(path: str, options: dict) -> Iterator[tuple]:
    name, seq = None, []
    with open(path, encoding="ascii", errors="replace") as f:
        for line in f:
            if line.startswith(">"):
                if name is not None:
                    yield path, name, "".join(seq), sum(map(len, seq))
                name, seq = line[1:].strip(), []
            else:
                seq.append(line.strip())
    if name is not None:
        yield path, name, "".join(seq), sum(map(len, seq))


def mgf(path: str, options: dict) -> Iterator[tuple]:
    """BEGIN IONS blocks: title, precursor, charge, retention time, peaks."""
    scan, head, mz, y = 0, None, [], []
    with open(path, encoding="utf-8", errors="replace") as f:
        for raw in f:
            line = raw.strip()
            if line == "BEGIN IONS":
                head, mz, y = {}, [], []
            elif line == "END IONS" and head is not None:
                scan += 1
                q = re.match(r"(\d+)", head.get("CHARGE", ""))
                pm = head.get("PEPMASS", "").split()
                rt = head.get("RTINSECONDS")
                yield path, scan, head.get("TITLE"), float(pm[0]) if pm else None, int(q[1]) if q else None, float(rt) if rt else None, mz, y
                head = None
            elif head is not None and "=" in line and not line[0].isdigit():
                k, v = line.split("=", 1)
                head[k.upper()] = v
            elif head is not None and line:
                a = line.split()
                mz.append(float(a[0]))
                y.append(float(a[1]) if len(a) > 1 else 0.0)


def fcs(path: str, options: dict) -> Iterator[tuple]:
    """Events of FCS 2.0 to 3.1 in list mode: event, and parameter -> value."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:3] != b"FCS":
        raise CorruptInput(f"{path} is no FCS file")
    t0, t1, d0, d1 = (int(raw[a : a + 8]) for a in (10, 18, 26, 34))
    text = raw[t0 : t1 + 1].decode("latin-1")
    sep = text[0]
    parts = re.split(f"(?<!{re.escape(sep)}){re.escape(sep)}(?!{re.escape(sep)})", text[1:].rstrip(sep))
    kv = {parts[i].upper(): parts[i + 1] for i in range(0, len(parts) - 1, 2)}
    d0, d1 = (d0, d1) if d0 else (int(kv["$BEGINDATA"]), int(kv["$ENDDATA"]))
    n, events = int(kv["$PAR"]), int(kv["$TOT"])
    order = "<" if kv["$BYTEORD"].startswith("1") else ">"
    kind = kv["$DATATYPE"].upper()
    kinds = [(f"p{i}", f"{order}f4" if kind == "F" else f"{order}f8" if kind == "D" else f"{order}u{int(kv[f'$P{i}B']) // 8}") for i in range(1, n + 1)]
    data = np.frombuffer(raw[d0 : d1 + 1], np.dtype(kinds), events)
    names = [kv.get(f"$P{i}N", f"P{i}") for i in range(1, n + 1)]
    values = np.stack([data[k].astype(float) for k, _ in kinds], 1) if events else np.zeros((0, n))
    for a in range(0, events, 10_000):
        part = values[a : a + 10_000]
        offs = pa.array(np.arange(len(part) + 1) * n, pa.int32())
        maps = pa.MapArray.from_arrays(offs, pa.array(names * len(part)), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part))), maps], names=["path", "event", "values"])


def plate(path: str, options: dict) -> Iterator[tuple]:
    """A matrix of wells (row letters, column numbers) as well, value."""
    columns: list[str] = []
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        for raw in f:
            cells = [c.strip() for c in re.split(r"[,;\t]", raw.rstrip("\r\n"))]
            numbers = [c for c in cells[1:] if c]
            if numbers and numbers == [str(k) for k in range(1, len(numbers) + 1)]:
                columns = cells[1:]
            elif columns and re.fullmatch(r"[A-Za-z]{1,2}", cells[0] if cells else ""):
                for c, v in zip(columns, cells[1:], strict=False):
                    if c and v:
                        try:
                            yield path, f"{cells[0].upper()}{int(c):02d}", float(v)
                        except ValueError:
                            continue


def mzml(path: str, options: dict) -> Iterator[tuple]:
    """Spectra of an mzML document, streamed element by element."""
    from xml.etree import ElementTree

    def local(e):
        return e.tag.rsplit("}", 1)[-1]

    i = 0
    for _, e in ElementTree.iterparse(path):
        if local(e) != "spectrum":
            continue
        cv, arrays = {}, {}
        for x in e.iter():
            if local(x) == "cvParam":
                cv.setdefault(x.get("accession"), (x.get("value"), x.get("unitAccession")))
        for b in e.iter():
            if local(b) == "binaryDataArray":
                acc = {x.get("accession") for x in b if local(x) == "cvParam"}
                body = next((x.text for x in b if local(x) == "binary"), None) or ""
                data = base64.b64decode(body)
                data = zlib.decompress(data) if "MS:1000574" in acc else data
                v = np.frombuffer(data, "<f8" if "MS:1000523" in acc else "<f4").astype(float)
                arrays["mz" if "MS:1000514" in acc else "y" if "MS:1000515" in acc else "other"] = v.tolist()
        rt = cv.get("MS:1000016")
        pre = cv.get("MS:1000744")
        yield path, i, e.get("id"), int(cv.get("MS:1000511", ("0", None))[0] or 0), (float(rt[0]) * (60 if rt[1] == "UO:0000031" else 1)) if rt else None, "positive" if "MS:1000130" in cv else "negative" if "MS:1000129" in cv else None, float(pre[0]) if pre else None, arrays.get("mz", []), arrays.get("y", [])
        i += 1
        e.clear()


def jcamp(path: str, options: dict) -> Iterator[tuple]:
    """(X++(Y..Y)) and (XY..XY) tables of plain numbers."""
    head, rows, mode = {}, [], None
    with open(path, encoding="latin-1") as f:
        for line in f:
            if line.startswith("##"):
                k, _, v = line[2:].partition("=")
                head[k.strip().upper()] = v.strip()
                mode = v.strip() if k.strip().upper() in ("XYDATA", "XYPOINTS", "PEAK TABLE") else None
            elif mode:
                rows.append((mode, [float(x) for x in re.findall(r"[+-]?\d+\.?\d*(?:[eE][+-]?\d+)?", line)]))
    fx, fy = float(head.get("XFACTOR", 1)), float(head.get("YFACTOR", 1))
    first, last, n = float(head.get("FIRSTX", 0)), float(head.get("LASTX", 0)), int(float(head.get("NPOINTS", 0)))
    i = 0
    for m, v in rows:
        if "X++" in m:
            for y in v[1:]:
                yield path, first + (last - first) * i / max(n - 1, 1), y * fy
                i += 1
        else:
            for x, y in zip(v[::2], v[1::2], strict=False):
                yield path, x * fx, y * fy


SOURCES = {
    "fastq": ("path string, id string, sequence string, quality string, length int", fastq),
    "fasta": ("path string, id string, sequence string, length int", fasta),
    "mgf": ("path string, scan int, title string, precursor_mz double, charge int, rt_s double, mz array<double>, intensity array<double>", mgf),
    "fcs": ("path string, event long, values map<string,double>", fcs),
    "plate": ("path string, well string, value double", plate),
    "mzml": ("path string, scan int, native_id string, ms_level int, rt_s double, polarity string, precursor_mz double, mz array<double>, intensity array<double>", mzml),
    "jcamp": ("path string, x double, y double", jcamp),
}


def register(spark: SparkSession) -> None:
    for name, (ddl, parse) in SOURCES.items():
        spark.dataSource.register(_source(name, ddl, parse))


def write_fcs(path: str, names: list[str], values: np.ndarray) -> None:
    """A small FCS 3.1 file of floats (for tests and exports)."""
    text = "/" + "/".join(["$BEGINDATA", "256000", "$ENDDATA", "0", "$BYTEORD", "1,2,3,4", "$DATATYPE", "F", "$MODE", "L", "$NEXTDATA", "0", "$PAR", str(len(names)), "$TOT", str(len(values)), *(x for i, n in enumerate(names, 1) for x in (f"$P{i}N", n, f"$P{i}B", "32", f"$P{i}R", "262144", f"$P{i}E", "0,0"))]) + "/"
    data = values.astype("<f4").tobytes()
    begin = 58 + len(text) + 64
    text = text.replace("256000", f"{begin:06d}").replace("$ENDDATA/0", f"$ENDDATA/{begin + len(data) - 1}")
    head = b"FCS3.1    " + b"".join(f"{v:>8}".encode() for v in (58, 58 + len(text) - 1, begin, begin + len(data) - 1, 0, 0))
    body = head + text.encode("latin-1")
    with open(path, "wb") as f:
        f.write(body + b" " * (begin - len(body)) + data)
