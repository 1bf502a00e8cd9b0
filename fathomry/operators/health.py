"""Catalog health: duplicates, near-duplicates, data at risk, tallies, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import semantics as S


def fingerprint(content: Column, head: int = 65_536) -> Column:
    """A stable 128-bit name of size, first and last 64 KiB."""
    n = F.octet_length(content)
    return F.md5(F.concat(n.cast("string").cast("binary"), F.substring(content, 1, head), F.substring(content, F.greatest(n - head + 1, F.lit(1)), F.lit(head))))


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_duplicates(df: DataFrame, keys: list[str], size: str, path: str) -> DataFrame:
    """Groups of two or more with equal keys (size over 0): copies, redundant bytes, the first path."""
    out = df.where(F.col(size) > 0).groupBy(*keys, size).agg(F.count("*").alias("copies"), F.min(path).alias("first_path")).where("copies > 1")
    return out.withColumn("redundant_bytes", F.col(size) * (F.col("copies") - 1))


def near_duplicates(df: DataFrame, keys: list[str], fingerprint: str, open_format: str | None = None) -> DataFrame:
    """Groups that share keys, none of them empty, under at least two fingerprints."""
    known = df.dropna(subset=keys)
    extra = [(F.count_distinct(F.when(F.col(open_format), F.col(fingerprint))) > 1).alias("exported_twice")] if open_format else []
    return known.groupBy(*keys).agg(F.count("*").alias("members"), F.count_distinct(fingerprint).alias("versions"), *extra).where("versions > 1")


def at_risk(df: DataFrame, path: str = "path", preservation: str = "preservation") -> DataFrame:
    """Rows in closed formats without an open sibling of the same folder and stem."""
    d = df.withColumn("__dir", S.directory(F.col(path))).withColumn("__stem", F.lower(S.whole_stem(F.col(path))))
    opened = d.where(F.col(preservation) == "open").select("__dir", "__stem").distinct()
    return d.where(F.coalesce(F.col(preservation) != "open", F.lit(True))).join(opened, ["__dir", "__stem"], "left_anti").drop("__dir", "__stem")


def tallies(df: DataFrame, columns: list[str], size: str) -> DataFrame:
    """Counts and bytes by each column on its own, in one pass: what, value, items, bytes."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("items"), F.sum(size).alias("bytes"), F.grouping_id().alias("g"))
    n = len(columns)
    what, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        g = (1 << n) - 1 - (1 << (n - 1 - i))
        what, value = F.when(F.col("g") == g, c).otherwise(what), F.when(F.col("g") == g, F.col(c).cast("string")).otherwise(value)
    return sets.select(what.alias("what"), value.alias("value"), "items", "bytes")


#: What is taken for personal data in free text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(^|[^0-9A-Za-z_+])(\+[0-9]{1,3}[ .()-][0-9 .()-]{7,16}[0-9]|\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4})($|[^0-9A-Za-z])"
BIRTH = r"(?i)\b(dob|date of birth|born)\b\D{0,5}[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"
PATIENT = r"(?i)\b(patient|mrn|medical record)\b\W{0,3}(id|no|number)?\W{0,3}[A-Z]{0,3}[0-9]{4,}"
PII = {"email": EMAIL, "phone": PHONE, "birth_date": BIRTH, "patient_id": PATIENT}


def pii_kinds(text: Column) -> Column:
    """Which kinds a text holds."""
    return F.array_compact(F.array(*(F.when(S.holds(text.rlike(p)), F.lit(k)) for k, p in PII.items())))


def pii_tally(df: DataFrame, text: str) -> DataFrame:
    """kind, rows, matches over a text column: one pass."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for k, p in PII.items()))).alias("x")
    return df.select(kinds).where("x.n > 0").groupBy("x.kind").agg(F.count("*").alias("rows"), F.sum("x.n").alias("matches"))


def redact(text: Column, key: bytes) -> Column:
    """`redacted:` and 16 hex digits of HMAC-SHA256, from nested digests."""
    block = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block)), F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.sha2(F.concat(inner[1], F.unhex(F.sha2(F.concat(inner[0], text.cast("binary")), 256))), 256)
    return F.concat(F.lit("redacted:"), F.substring(digest, 1, 16))


def field_shape(pointer: Column) -> Column:
    """/a/b[3]/c as /a/b[]/c."""
    return F.regexp_replace(pointer, r"\[[0-9]+\]", "[]")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "<email>")
