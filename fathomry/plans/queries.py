"""Every operator of the engine as a query over the driver's tables, with its SQL.

Tables play roles: lineitem and orders are measurement tables, nation and customer
sample sheets, events traces and streams, embeddings spectra, documents and pages texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import semantics as S
from ..operators import assay, catalog, gating, health, joins, layout, link, plots, pointers, qpcr, quantiles, reads, regions, search, series, spectra, summarize, tables, trees
from ..operators.graph import connected_components, shared_folder
from ..sources.journal import Job
from ..streaming import watch
from ..streaming.joins import interval_join
from .batch import Batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns to so many digits, so that orders of summation don't show; no negative zero."""
    return df.select(*((F.round(F.col(f"`{c}`").cast("double"), digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


_DESCRIBE = "count({v}) n, round(avg({v}), 4) + 0.0 mean, round(stddev_samp({v}), 4) + 0.0 sd, round(stddev_samp({v}) / sqrt(count({v})), 4) + 0.0 sem, round(median({v}), 4) + 0.0 median, round(min({v}), 4) + 0.0 min, round(max({v}), 4) + 0.0 max, round(stddev_samp({v}) / abs(avg({v})) * 100, 4) + 0.0 cv_percent"


def _describe(v: str) -> str:
    return _DESCRIBE.replace("{v}", v)


# Summaries


@query(f"SELECT l_returnflag, l_linestatus, 'l_quantity' AS value, {_describe('l_quantity')} FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, l_linestatus, 'l_extendedprice' AS value, {_describe('l_extendedprice')} FROM lineitem GROUP BY ALL")
def summarize_dimensions(spark, sf):
    """By return flag, kept apart by line status because it varies: the flagship summary."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return rounded(summarize.summarize(df, ["l_returnflag"], ["l_quantity", "l_extendedprice"], families=[["l_linestatus"]]))


@query(f"SELECT l_returnflag, 'l_quantity' AS value, {_describe('l_quantity')} FROM lineitem GROUP BY ALL")
def summarize_basic(spark, sf):
    return rounded(summarize.summarize(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"], exact_by=True))


@query("WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) v, count(*) c FROM lineitem GROUP BY ALL) SELECT l_returnflag, 'l_quantity' AS value, count(*) n, CAST(sum(c) AS BIGINT) n_rows, round(avg(v), 4) mean, round(stddev_samp(v), 4) sd, round(stddev_samp(v) / sqrt(count(*)), 4) sem, round(median(v), 4) median, round(min(v), 4) min, round(max(v), 4) max, round(stddev_samp(v) / abs(avg(v)) * 100, 4) cv_percent FROM m GROUP BY ALL")
def summarize_replicates(spark, sf):
    return rounded(summarize.summarize(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"], replicate="l_suppkey", exact_by=True))


@query("""WITH s AS (SELECT o_orderstatus, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY ALL), c AS (SELECT * FROM s WHERE o_orderstatus = 'O')
SELECT s.o_orderstatus, s.n, round(s.m - c.m, 2) diff, round(s.m / c.m, 4) ratio, round((s.m - c.m) / sqrt(s.v / s.n + c.v / c.n), 4) statistic, round(pow(s.v / s.n + c.v / c.n, 2) / (pow(s.v / s.n, 2) / (s.n - 1) + pow(c.v / c.n, 2) / (c.n - 1)), 2) df FROM s, c WHERE s.o_orderstatus <> 'O'""")
def summarize_welch(spark, sf):
    out = summarize.summarize(table(spark, sf, "orders"), ["o_orderstatus"], ["o_totalprice"], control="O", test="welch", exact_by=True)
    return out.where("control is not null").select("o_orderstatus", "n", F.round("diff", 2).alias("diff"), F.round("ratio", 4).alias("ratio"), F.round("statistic", 4).alias("statistic"), F.round("df", 2).alias("df"))


@query("""WITH g AS (SELECT DISTINCT event_type g FROM events WHERE event_type <> 'click'), p AS (SELECT g, event_type = g is_case, value FROM events, g WHERE event_type IN (g, 'click')),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY value) + (count(*) OVER (PARTITION BY g, value) - 1) / 2.0 r FROM p)
SELECT g event_type, CAST(count(*) FILTER (is_case) AS BIGINT) n1, CAST(count(*) FILTER (NOT is_case) AS BIGINT) n2, round(sum(r) FILTER (is_case) - count(*) FILTER (is_case) * (count(*) FILTER (is_case) + 1) / 2.0, 1) u FROM r GROUP BY g""")
def mann_whitney_u(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.lit("value").alias("what"), F.col("value").alias("v"))
    return summarize.mann_whitney(rows, ["event_type", "what"], "event_type", "click").select("event_type", "n1", "n2", F.round("statistic", 1).alias("u"))


@query("SELECT l_shipmode_group, n FROM (SELECT l_linestatus l_shipmode_group, count(*) n FROM lineitem WHERE l_returnflag <> 'A' AND l_quantity = 10 GROUP BY 1)")
def batch_plan(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode_group")
    out = Batch(df, where=["l_returnflag!=a", "l_quantity=10.0"], by=["l_shipmode_group"], values=["l_tax"], summary={"exact_by": True}).run()
    return out.select("l_shipmode_group", "n")


# Selection and the query language


@query("SELECT CAST(count(*) FILTER (l_quantity >= 10 AND l_discount < 0.05 AND l_tax <> 0.02) AS BIGINT) matched, count(*) total, round(count(*) FILTER (l_quantity >= 10 AND l_discount < 0.05 AND l_tax <> 0.02) * 100.0 / count(*), 4) percent FROM lineitem")
def row_filter_count(spark, sf):
    return rounded(tables.count_rows(table(spark, sf, "lineitem"), "l_quantity >= 10 && l_discount < 0.05 and l_tax != 0.02"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE abs(p_size - 15) <= 1e-9 * 15 OR (p_retailprice > 1500 AND NOT abs(p_retailprice - 1500) <= 1e-9 * p_retailprice AND NOT lower(p_brand) = 'brand#12')")
def search_numeric(spark, sf):
    p = table(spark, sf, "part")
    s = search.Search(p, fields={"size": ["p_size"], "price": ["p_retailprice"], "brand": ["p_brand"]})
    return p.where(s.compile("size=15 OR price>1500 -brand=brand#12")).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), '1') OR contains(lower(p_name), '22')) AND NOT contains(lower(p_type), 'steel')")
def search_text(spark, sf):
    p = table(spark, sf, "part")
    s = search.Search(p, fields={"kind": ["p_type"]}, text=["p_name"])
    return p.where(s.compile("1|22 kind!~steel")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE (o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01') OR o_orderdate >= TIMESTAMP '1998-01-01'")
def search_dates(spark, sf):
    o = table(spark, sf, "orders")
    s = search.Search(o, fields={"date": ["o_orderdate"]})
    return o.where(s.compile("date=1996-02 OR date>1997")).select("o_orderkey")


@query("SELECT s_name, s_acctbal, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) total, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) > 10 truncated FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_name LIMIT 10")
def search_top_k(spark, sf):
    out = search.search(table(spark, sf, "supplier"), "bal>0", sort="-bal", limit=10, tie="s_name", fields={"bal": ["s_acctbal"]})
    return out.select("s_name", "s_acctbal", "total", "truncated")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AND event_type <> 'error'")
def search_json_param(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("props", "parameters_json")
    s = search.Search(e, fields={"type": ["event_type"]})
    return e.where(s.compile("param.K>50 type!=error")).select("event_id")


@query("SELECT p_name || ' ' || p_size label, row_number() OVER (ORDER BY p_name, p_size) pos FROM part")
def natural_sort(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("label")).withColumn("k", S.natural_key(F.col("label")))
    return tables.positions(p, [F.col("k"), F.col("label")]).select("label", "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_of_rows(spark, sf):
    return tables.page(table(spark, sf, "orders"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 25, 50).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (SELECT n_name k, 'n' src FROM nation UNION ALL SELECT r_name, 'r' FROM region)")
def assemble_rows(spark, sf):
    return tables.union_all(table(spark, sf, "nation").select(F.col("n_name").alias("k"), F.lit("n").alias("src")), table(spark, sf, "region").select(F.col("r_name").alias("k"), F.lit("r").alias("src")))


@query("(SELECT c_nationkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_operations(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_nationkey")
    s = table(spark, sf, "supplier")
    return tables.difference(tables.intersect(c, s.select(F.col("s_nationkey").alias("c_nationkey"))), s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")))


# Joins


@query("SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def sheet_join_left(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("sample_id", F.col("s_nationkey").cast("string"))
    out, _ = joins.sheet_join(rows, table(spark, sf, "nation"))
    return out.select("s_suppkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def sheet_unmatched(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("sample_id", F.col("s_suppkey").cast("string"))
    _, report = joins.sheet_join(rows, table(spark, sf, "customer"), [("c_custkey", "sample_id")])
    return report.unmatched_sheet.select("c_custkey", "c_name")


@query("SELECT s_suppkey, CASE WHEN count(DISTINCT r) = 1 THEN min(r) END r FROM (SELECT s_suppkey, n_regionkey r FROM supplier LEFT JOIN (SELECT n_nationkey % 12 k, n_regionkey FROM nation) ON s_nationkey = k) GROUP BY s_suppkey")
def sheet_ambiguous(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("sample_id", F.col("s_nationkey").cast("string"))
    sheet = table(spark, sf, "nation").select((F.col("n_nationkey") % 12).alias("k"), F.col("n_regionkey").alias("r"))
    out, _ = joins.sheet_join(rows, sheet, [("k", "sample_id")])
    return out.select("s_suppkey", "r")


@query("SELECT p_partkey, CASE WHEN a AND NOT b THEN 'a' WHEN b AND NOT a THEN 'b' END grp FROM (SELECT p_partkey, regexp_full_match(lower(p_type), 'standard.*') a, regexp_full_match(lower(p_type), '.*brass') b FROM part)")
def glob_join(spark, sf):
    """Types that both patterns match are ambiguous and get nothing."""
    rows = table(spark, sf, "part").withColumn("sample_name", F.col("p_type"))
    sheet = spark.createDataFrame([("STANDARD*", "a"), ("*BRASS", "b")], "name string, grp string")
    out, _ = joins.sheet_join(rows, sheet, [("name", "sample_name")])
    return out.select("p_partkey", "grp")


@query("SELECT e.event_id, e.user_id, p.value last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'")
def as_of_join(spark, sf):
    e = table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return tables.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("SELECT band, count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem JOIN (VALUES ('low', 1000.0, 5000.0), ('mid', 4000.0, 30000.0), ('high', 50000.0, 90000.0)) b(band, lo, hi) ON l_extendedprice BETWEEN lo AND hi GROUP BY band")
def band_join(spark, sf):
    bands = spark.createDataFrame([("low", 1000.0, 5000.0), ("mid", 4000.0, 30000.0), ("high", 50000.0, 90000.0)], "band string, lo double, hi double")
    out = joins.band_join(table(spark, sf, "lineitem").select("l_extendedprice"), bands, "l_extendedprice", "lo", "hi", 10_000.0)
    return out.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT a.event_id, b.event_id event_id_2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000")
def tolerance_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1).cast("double").alias("t"))
    out = joins.within(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), "t", 1_800_000_000.0, ["user_id"])
    return out.select("event_id", "event_id_2")


@query("WITH p AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer) SELECT c_mktsegment, n_name, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def layout_like_join(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(joins.sized(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, chr(CAST(65 + c_nationkey % 5 AS INTEGER)) || lpad(CAST(c_nationkey // 5 + 1 AS VARCHAR), 2, '0') well, CASE WHEN n_regionkey <> 4 THEN n_name END AS role, CAST(CASE WHEN n_regionkey <> 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN 10 + n_nationkey ELSE n_regionkey END END AS INTEGER) dose
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def layout_join(spark, sf):
    """Customers as reads of wells, nations as the layout; a second layout overrides some doses, one region's wells have none."""
    at = lambda k, sep: F.concat(F.chr(65 + F.col(k) % 5), F.lit(sep), (F.expr(f"{k} div 5") + 1).cast("string"))
    reads = table(spark, sf, "customer").select("c_custkey", at("c_nationkey", "").alias("well"))
    known = table(spark, sf, "nation").where("n_regionkey <> 4")
    first = known.select(at("n_nationkey", "0").alias("well"), F.col("n_name").alias("role"), F.col("n_regionkey").cast("int").alias("dose"))
    second = known.where("n_nationkey % 2 = 0").select(at("n_nationkey", "").alias("well"), (F.col("n_nationkey") + 10).cast("int").alias("dose"))
    return joins.layout_join(reads, first, second)


@query()
def link_components(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b"))  # suppliers below 0, so that no number names two things
    return connected_components(e)


@query("WITH v AS (SELECT DISTINCT doc_id id, md5(text) v FROM documents), g AS (SELECT v, min(id) a, count(*) n FROM v GROUP BY v HAVING count(*) > 1) SELECT a, id b, CASE WHEN n > 12 THEN 1 ELSE 3 END confidence FROM v JOIN g USING (v) WHERE id <> a")
def link_shared_values(spark, sf):
    return link.shared_value(table(spark, sf, "documents").withColumn("h", F.md5("text")), "doc_id", F.col("h"), "conversion_source", link.HIGH).select("a", "b", "confidence")


# Health and personal data


@query("SELECT md5(text) fingerprint, n_chars, count(*) copies, min(doc_id) first_path, n_chars * (count(*) - 1) redundant_bytes FROM documents WHERE n_chars > 0 GROUP BY md5(text), n_chars HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return health.exact_duplicates(table(spark, sf, "documents").withColumn("fingerprint", F.md5("text")), ["fingerprint"], "n_chars", "doc_id")


@query("SELECT lang, source, n_chars, count(*) members, count(DISTINCT md5(text)) versions FROM documents GROUP BY ALL HAVING count(DISTINCT md5(text)) > 1")
def near_duplicates(spark, sf):
    return health.near_duplicates(table(spark, sf, "documents").withColumn("fp", F.md5("text")), ["lang", "source", "n_chars"], "fp")


@query("SELECT page_id FROM pages p WHERE page_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND q.page_id // 5 = p.page_id // 5)")
def at_risk(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("d/"), F.floor(F.col("page_id") / 5).cast("string"), F.when(F.col("page_id") % 3 == 0, ".open").otherwise(".raw")).alias("path"), F.when(F.col("page_id") % 3 == 0, "open").otherwise("vendor").alias("preservation"))
    return health.at_risk(p).select("page_id")


@query("SELECT 'lang' what, lang value, count(*) items, CAST(sum(n_chars) AS BIGINT) bytes FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source")
def health_tallies(spark, sf):
    return health.tallies(table(spark, sf, "documents"), ["lang", "source"], "n_chars")


_PII = " UNION ALL ".join(f"SELECT '{k}' kind, count(*) AS rows, CAST(sum(n) AS BIGINT) matches FROM (SELECT len(regexp_extract_all(text, '{p}')) n FROM documents) WHERE n > 0" for k, p in health.PII.items())


@query(f"SELECT * FROM ({_PII}) WHERE rows > 0")
def pii_tally(spark, sf):
    return health.pii_tally(table(spark, sf, "documents"), "text")


# Ordered computations


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) run_order FROM events")
def run_order(spark, sf):
    return series.run_order(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "run_order")


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def average_rank(spark, sf):
    return series.average_rank(table(spark, sf, "events"), ["event_type"], "value").select("event_id", F.col("rank").cast("double").alias("rank"))


_T = "(epoch_us(ts) / 1000000.0)"


@query(f"WITH i AS (SELECT *, t - lag(t) OVER w isi FROM (SELECT *, {_T} t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, round(isi, 3) isi, round(isi / nullif(lag(isi) OVER (PARTITION BY user_id ORDER BY t, event_id), 0), 3) isi_ratio FROM i")
def intervals(spark, sf):
    return rounded(series.intervals(_timed(spark, sf), ["user_id"], ["t", "event_id"], "t").select("event_id", "isi", "isi_ratio"), 3)


def _timed(spark, sf):
    return table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@query(f"WITH i AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) gap FROM (SELECT *, {_T} t FROM events)) SELECT event_id, round(gap / nullif(quantile_cont(gap, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING), 0), 3) ratio FROM i")
def interval_ratio(spark, sf):
    return rounded(series.interval_ratio(_timed(spark, sf), ["user_id"], ["t", "event_id"], "t").select("event_id", "ratio"), 3)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events), s AS (SELECT user_id, i, regr_slope(value, i) OVER w slope, count(*) OVER w c FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT user_id, round(max(slope), 4) slope FROM s WHERE c = 5 GROUP BY user_id")
def sliding_slope(spark, sf):
    x = series.run_order(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return rounded(series.sliding_slope(x, ["user_id"], ["run_order"], "run_order", "value", 5).select("user_id", "slope"))


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) running_median FROM events")
def running_median(spark, sf):
    return rounded(series.running_median(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", "running_median"))


@query("""WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events), w AS (SELECT *, least(16, greatest(n, 3)) size FROM r),
g AS (SELECT *, size // 2 half, greatest(size // 8, 1) step FROM w), v AS (SELECT g.user_id, g.i, list_sort(list(x.value))[CAST(floor((count(*) - 1) * 0.1 + 0.5) AS INTEGER) + 1] q FROM g JOIN r x ON x.user_id = g.user_id AND x.i BETWEEN g.i - g.half AND g.i + g.half WHERE g.i % g.step = 0 OR g.i = g.n - 1 GROUP BY g.user_id, g.i)
SELECT event_id, round(CASE WHEN g.i = g.n - 1 OR g.i % step = 0 THEN o.q ELSE a.q + (b.q - a.q) * (g.i - a.i) / (b.i - a.i) END, 4) baseline FROM g LEFT JOIN v o ON o.user_id = g.user_id AND o.i = g.i LEFT JOIN v a ON a.user_id = g.user_id AND a.i = g.i // step * step LEFT JOIN v b ON b.user_id = g.user_id AND b.i = least(g.i // step * step + step, g.n - 1)""")
def running_baseline(spark, sf):
    return rounded(series.running_quantile(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 16, 0.1).select("event_id", "baseline"))


@query("WITH i AS (SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) isi FROM (SELECT *, epoch_us(ts) / 1000000.0 t FROM events)), n AS (SELECT *, lead(isi) OVER (PARTITION BY user_id ORDER BY t, event_id) nx FROM i) SELECT user_id, round(avg((nx - isi) / nullif(nx + isi, 0)), 6) + 0.0 adaptation FROM n GROUP BY user_id")
def adaptation_index(spark, sf):
    gaps = series.intervals(_timed(spark, sf), ["user_id"], ["t", "event_id"], "t")
    return rounded(series.adaptation_index(gaps, ["user_id"], ["t", "event_id"]), 6)


@query("WITH d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) d FROM events) SELECT user_id, round(median(d) / 0.6745 / sqrt(2), 4) noise FROM d GROUP BY user_id")
def difference_noise(spark, sf):
    return rounded(series.difference_noise(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query("""SELECT event_id, round(CASE WHEN lag(value, 2) OVER w IS NOT NULL AND lead(value, 2) OVER w IS NOT NULL THEN (-3.0 * lag(value, 2) OVER w + 12.0 * lag(value) OVER w + 17.0 * value + 12.0 * lead(value) OVER w - 3.0 * lead(value, 2) OVER w) / 35.0 ELSE value END, 4) AS smooth,
round(CASE WHEN lag(value, 3) OVER w IS NOT NULL AND lead(value, 3) OVER w IS NOT NULL THEN (-2.0 * (lag(value, 3) OVER w + lead(value, 3) OVER w) + 3.0 * (lag(value, 2) OVER w + lead(value, 2) OVER w) + 6.0 * (lag(value) OVER w + lead(value) OVER w) + 7.0 * value) / 21.0
  WHEN lag(value, 2) OVER w IS NOT NULL AND lead(value, 2) OVER w IS NOT NULL THEN (-3.0 * (lag(value, 2) OVER w + lead(value, 2) OVER w) + 12.0 * (lag(value) OVER w + lead(value) OVER w) + 17.0 * value) / 35.0 ELSE value END, 4) wider FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def savitzky_golay(spark, sf):
    d = series.savitzky_golay(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    wider = series.savitzky_golay(d.withColumnRenamed("smooth", "first"), ["user_id"], ["ts", "event_id"], "value", 6)
    return rounded(wider.select("event_id", F.col("first").alias("smooth"), F.col("smooth").alias("wider")))


@query("WITH m AS (SELECT event_id, value, max(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) nx, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) px FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM m WHERE value >= coalesce(nx, value) AND value > coalesce(px, value - 1)")
def local_maxima(spark, sf):
    return series.local_maxima(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id")


@query(f"WITH a AS (SELECT user_id, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 a FROM (SELECT *, {_T} t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(coalesce(sum(a), 0), 1) auc FROM a GROUP BY user_id")
def trapezoid_auc(spark, sf):
    return rounded(series.trapezoid(_timed(spark, sf), ["user_id"], "t", "value"), 1)


@query("WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) y FROM events), c AS (SELECT *, lag(y) OVER w py, lag(i) OVER w pi, lead(y) OVER w ny FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i)), u AS (SELECT user_id, i, pi + (i - pi) * CASE WHEN py > 0 THEN (ln(200) - ln(py)) / (ln(y) - ln(py)) ELSE (200 - py) / (y - py) END cq FROM c WHERE py < 200 AND y >= 200 AND ny >= 200) SELECT user_id, round(arg_min(cq, i), 4) cq FROM u GROUP BY user_id")
def threshold_crossing(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("i"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    return rounded(series.first_crossing(x, ["user_id"], "i", "y", F.lit(200.0)))


@query("WITH b AS (SELECT user_id, value, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) bucket FROM events) SELECT user_id, bucket, min(value) lo, max(value) hi FROM b GROUP BY ALL")
def envelope(spark, sf):
    return series.envelope(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 4)


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (ORDER BY value) - 1 k, count(*) OVER () n FROM events WHERE value IS NOT NULL), m AS (SELECT count(DISTINCT event_type) m FROM v),
q AS (SELECT max(value) FILTER (k = floor((n - 1) * 0.0005 + 0.5)) lo, max(value) FILTER (k = floor((n - 1) * 0.9995 + 0.5)) hi, max(n) n FROM v), b AS (SELECT lo, hi, CAST(least(160, greatest(24, floor(sqrt(n / m)))) AS BIGINT) bins FROM q, m),
s AS (SELECT event_type, count(*) size FROM v GROUP BY event_type), c AS (SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) bin, count(*) c FROM v, b WHERE value BETWEEN lo AND hi GROUP BY ALL),
g AS (SELECT event_type, size, unnest(range(bins)) bin, lo, (hi - lo) / bins step FROM s, b)
SELECT event_type, bin, round(lo + bin * step, 4) + 0.0 AS "start", round(lo + (bin + 1) * step, 4) + 0.0 AS "end", round(coalesce(c, 0) * (100.0 / size), 4) + 0.0 height FROM g LEFT JOIN c USING (event_type, bin)""")
def shared_histogram(spark, sf):
    return rounded(series.shared_histogram(table(spark, sf, "events"), ["event_type"], "value"))


@query("SELECT l_suppkey % 7 AS k, count(*) n, round(quantile_cont(l_extendedprice, 0.01), 4) p1, round(quantile_cont(l_extendedprice, 0.5), 4) median, round(quantile_cont(l_extendedprice, 0.99), 4) p99 FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf):
    """Seven large groups, none of them gathered before few values are left."""
    d = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("k"), "l_extendedprice")
    return rounded(quantiles.quantiles(d, ["k"], "l_extendedprice", {"p1": 0.01, "median": 0.5, "p99": 0.99}, small=1000))


@query("SELECT event_type, count(*) samples, count(value) finite, round(min(value), 4) min, round(max(value), 4) max, round(avg(value), 4) mean, round(stddev_pop(value), 4) std, arg_min(event_id, (value, event_id)) x_at_min, arg_max(event_id, (value, -event_id)) x_at_max FROM events GROUP BY ALL")
def trace_statistics(spark, sf):
    return rounded(series.trace_statistics(table(spark, sf, "events"), ["event_type"], "event_id", "value"))


@query("SELECT l_returnflag, count(*) AS count, min(l_quantity) min, max(l_quantity) max, round(avg(l_quantity), 4) mean, round(stddev_pop(l_quantity), 4) std, " + ", ".join(f"round(quantile_cont(l_quantity, {p / 100}), 4) p{p}" for p in (1, 5, 50, 95, 99)) + ", round(count(*) FILTER (l_quantity = 0) / count(*), 4) zero_fraction, round(count(*) FILTER (l_quantity >= 50) / count(*), 4) saturated_fraction FROM lineitem GROUP BY ALL")
def pixel_statistics(spark, sf):
    return rounded(series.pixel_statistics(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 50.0))


@query("SELECT l_returnflag, parameter, count(v) events, round(median(v), 4) median, round(avg(v), 4) mean, round(stddev_samp(v), 4) sd, round(min(v), 4) min, round(max(v), 4) max FROM (SELECT l_returnflag, 'l_discount' parameter, l_discount v FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY ALL")
def parameter_summary(spark, sf):
    return rounded(series.parameter_summary(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_discount", "l_tax"]))


@query("SELECT o_orderkey, round(o_totalprice * 100 / sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) area_percent FROM orders")
def area_percent(spark, sf):
    return rounded(series.percent_of_total(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "area_percent"))


@query("SELECT l_suppkey, l_linenumber, max(l_quantity) l_quantity FROM lineitem GROUP BY ALL")
def max_projection(spark, sf):
    return series.max_projection(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], "l_quantity")


# Spectra: an embedding's places are m/z, its absolute values intensities


def _spectra(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("scan"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double")).alias("mz"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("intensity"), (F.col("label") % 50).cast("double").alias("precursor_mz"))


_LONG = "SELECT vec_id scan, CAST(unnest(range(0, len(embedding))) AS DOUBLE) mz, abs(CAST(unnest(embedding) AS DOUBLE)) y, label FROM embeddings"


@query(f"SELECT scan, round(sum(y), 4) tic, round(max(y), 6) bpc, round(coalesce(sum(y) FILTER (mz BETWEEN 10 AND 12.5), 0), 4) xic FROM ({_LONG}) GROUP BY scan")
def chromatograms(spark, sf):
    out = spectra.chromatograms(_spectra(spark, sf), {"xic": (10.0, 12.5)})
    return out.select("scan", F.round("tic", 4).alias("tic"), F.round("bpc", 6).alias("bpc"), F.round("xic", 4).alias("xic"))


@query("SELECT label % 3 + 1 ms_level, count(*) scans, CAST(sum(len(embedding)) AS BIGINT) points FROM embeddings GROUP BY 1")
def scan_counts(spark, sf):
    e = _spectra(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("scan"), (F.col("label") % 3 + 1).alias("ms_level")), "scan")
    return spectra.level_counts(e, [])


@query(f"SELECT scan, mz, round(y, 6) intensity FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY y DESC, mz) r FROM ({_LONG})) WHERE r <= 5")
def top_peaks(spark, sf):
    return rounded(spectra.top_peaks(_spectra(spark, sf), 5).select("scan", F.explode("peaks").alias("p")).select("scan", "p.*"), 6)


@query(f"SELECT scan, round(CASE WHEN bool_and(abs(label % 50 - 3) <= 1) THEN coalesce(max(y) FILTER (mz = 20), 0) END, 6) a FROM ({_LONG}) GROUP BY scan")
def transitions(spark, sf):
    return rounded(spectra.transitions(_spectra(spark, sf), {"a": (3.0, 20.2, 1.0)}).select("scan", "a"), 6)


@query(f"SELECT scan, CAST(least(floor(mz * 8 / 63), 7) AS BIGINT) slice, round(max(y), 6) intensity FROM ({_LONG}) GROUP BY ALL")
def thinned_spectra(spark, sf):
    return rounded(spectra.thinned(_spectra(spark, sf), ["scan"], 8).select("scan", F.col("slice").cast("long").alias("slice"), "intensity"), 6)


@query(f"WITH p AS (SELECT scan, mz, y FROM ({_LONG}) WHERE mz BETWEEN 5 AND 15), e AS (SELECT scan, arg_min(y, mz) y0, arg_max(y, mz) y1 FROM p GROUP BY scan), v AS (SELECT scan, mz, y - (y0 + (y1 - y0) * (mz - 5) / 10) v FROM p JOIN e USING (scan)), a AS (SELECT scan, mz, v, (mz - lag(mz) OVER w) * (v + lag(v) OVER w) / 2 a FROM v WINDOW w AS (PARTITION BY scan ORDER BY mz)) SELECT scan, round(sum(a), 4) + 0.0 area, round(sum(mz * v) / nullif(sum(v), 0), 3) + 0.0 centroid, round(max(v), 4) + 0.0 height FROM a GROUP BY scan")
def spectral_bands(spark, sf):
    points = _spectra(spark, sf).select("scan", F.explode(spectra.pairs()).alias("p")).select("scan", "p.*")
    b = rounded(spectra.bands(points, ["scan"], "mz", "intensity", 5.0, 15.0).withColumn("centroid", F.round("centroid", 3)))
    return b.select("scan", "area", "centroid", "height")


@query("SELECT vec_id, arg_min(i, abs(x - CAST(0.1 AS DOUBLE))) i FROM (SELECT vec_id, unnest(range(0, len(embedding))) i, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings) GROUP BY vec_id")
def nearest_row(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    return tables.nearest(p.withColumn("d", F.col("x").cast("double")), ["vec_id"], "d", 0.1).select("vec_id", "i")


# Assays and qPCR: event types are roles and targets, users are plates and samples


def _plate(spark, sf):
    role = F.create_map(*[F.lit(x) for kv in {"error": "negative", "purchase": "positive", "click": "blank"}.items() for x in kv])
    return table(spark, sf, "events").select((F.col("user_id") % 20).alias("plate"), F.coalesce(F.try_element_at(role, "event_type"), F.lit("sample")).alias("role"), "value", "event_id", "ts")


_PLATE = "(SELECT user_id % 20 plate, CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' WHEN 'click' THEN 'blank' ELSE 'sample' END role, value, event_id, ts FROM events)"


_QUALITY = f"""
WITH m AS (
  SELECT plate, avg(value) FILTER (role = 'positive') mp, stddev_samp(value) FILTER (role = 'positive') sp, avg(value) FILTER (role = 'negative') mn,
    stddev_samp(value) FILTER (role = 'negative') sn, avg(value) FILTER (role = 'sample') ms, stddev_samp(value) FILTER (role = 'sample') ss
  FROM {_PLATE} GROUP BY plate
), z AS (SELECT *, 1 - 3 * (sp + sn) / nullif(abs(mp - mn), 0) z FROM m), c AS (
  SELECT plate, median(cv) * 100 cv FROM (SELECT plate, role, stddev_samp(value) / nullif(abs(avg(value)), 0) cv FROM {_PLATE} GROUP BY plate, role) GROUP BY plate
)
SELECT plate, round(z, 2) z_prime, CASE WHEN z >= 0.5 THEN 'excellent' WHEN z > 0 THEN 'marginal' WHEN z IS NOT NULL THEN 'unusable' END assessment,
  round(1 - 3 * (ss + sn) / nullif(abs(ms - mn), 0), 2) z_factor, round(mp / nullif(mn, 0), 4) signal_to_background, round((mp - mn) / nullif(sn, 0), 4) signal_to_noise,
  round((mp - mn) / nullif(sqrt(sp * sp + sn * sn), 0), 4) ssmd, round(cv, 4) median_replicate_cv_percent
FROM z LEFT JOIN c USING (plate)
"""


@query(_QUALITY)
def assay_quality(spark, sf):
    q = assay.quality(_plate(spark, sf), ["plate"], "value", group=["role"])
    return q.select("plate", "assessment", *(F.round(c, 2).alias(c) for c in ("z_prime", "z_factor")), *(F.round(c, 4).alias(c) for c in ("signal_to_background", "signal_to_noise", "ssmd", "median_replicate_cv_percent")))


@query(f"WITH b AS (SELECT plate, avg(value) b FROM {_PLATE} WHERE role = 'blank' GROUP BY plate) SELECT event_id, round(value - b, 9) + 0.0 corrected FROM {_PLATE} JOIN b USING (plate)")
def blank_subtraction(spark, sf):
    return rounded(assay.subtract_blank(_plate(spark, sf), ["plate"], "value").select("event_id", "corrected"), 9)


@query(f"WITH m AS (SELECT *, median(value) OVER (PARTITION BY plate) m FROM {_PLATE}), d AS (SELECT *, abs(value - m) d FROM m), s AS (SELECT *, 0.6745 * d / median(d) OVER (PARTITION BY plate) z, count(*) OVER (PARTITION BY plate) n FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY z DESC, value) r FROM s) SELECT event_id FROM r WHERE r = 1 AND n >= 5 AND z > 3.5")
def mad_outliers(spark, sf):
    return assay.outliers(_plate(spark, sf), ["plate"], "value", "mad").where("outlier").select("event_id")


@query(f"WITH w AS (SELECT plate, avg(value) FILTER (role = 'negative') n, avg(value) FILTER (role = 'positive') p FROM {_PLATE} GROUP BY plate) SELECT event_id, round((value - n) * 100 / (p - n), 1) + 0.0 effect FROM {_PLATE} JOIN w USING (plate)")
def percent_effect(spark, sf):
    return rounded(assay.percent_effect(_plate(spark, sf), ["plate"], "value").select("event_id", "effect"), 1)


@query(f"WITH x AS (SELECT user_id, {_T} t, value y FROM events), a AS (SELECT *, (t - lag(t) OVER w) * (y + lag(y) OVER w) / 2 a FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(arg_min(y, t), 4) \"first\", round(arg_max(y, t), 4) \"last\", round(min(y), 4) min, round(max(y), 4) max, round(avg(y), 4) mean, round(regr_slope(y, t) * 86400, 4) + 0.0 slope_a_day, round(coalesce(sum(a), 0), 1) auc FROM a GROUP BY user_id")
def kinetic_reduction(spark, sf):
    k = assay.reduce_kinetic(_timed(spark, sf), ["user_id"], "t", "value")
    return k.select("user_id", *(F.round(c, 4).alias(c) for c in ("first", "last", "min", "max", "mean")), (F.round(F.col("mean_slope") * 86_400, 4) + 0.0).alias("slope_a_day"), F.round("auc", 1).alias("auc"))


def _reactions(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 8).cast("string").alias("sample"), F.col("event_type").alias("target"), (F.col("value") / 10 + 20).alias("cq"), F.pow(F.lit(10.0), F.col("user_id") % 5).alias("quantity"))


_RX = "(SELECT CAST(user_id % 8 AS VARCHAR) AS sample, event_type target, value / 10 + 20 cq, pow(10, user_id % 5) quantity FROM events)"


@query(f"""WITH p AS (SELECT sample, target, avg(cq) m, coalesce(stddev_samp(cq), 0) s, count(cq) n FROM {_RX} GROUP BY ALL), r AS (SELECT sample, avg(m) rm, sqrt(sum(s * s)) / count(*) rs FROM p WHERE target IN ('click', 'view') GROUP BY sample),
d AS (SELECT p.sample, target, n, m, m - rm dc, sqrt(s * s + rs * rs) sd FROM p JOIN r USING (sample) WHERE target NOT IN ('click', 'view')), c AS (SELECT target, dc cal FROM d WHERE sample = '0')
SELECT sample, target, n, round(m, 4) mean_cq, round(dc, 4) + 0.0 delta_cq, round(sd, 4) sd, round(dc - cal, 4) + 0.0 ddcq, round(pow(2, cal - dc), 4) rq, round(pow(2, cal - dc - sd), 4) rq_min, round(pow(2, cal - dc + sd), 4) rq_max FROM d LEFT JOIN c USING (target)""")
def delta_delta_cq(spark, sf):
    return rounded(qpcr.delta_delta_cq(_reactions(spark, sf), ["click", "view"], "0").select("sample", "target", "n", "mean_cq", "delta_cq", "sd", "ddcq", "rq", "rq_min", "rq_max"))


@query(f"WITH d AS (SELECT target, log10(quantity) l, cq FROM {_RX}) SELECT target, count(DISTINCT l) levels, round(regr_slope(cq, l), 4) + 0.0 slope, round(regr_intercept(cq, l), 4) intercept, round(regr_r2(cq, l), 6) r2 FROM d GROUP BY target")
def standard_curve(spark, sf):
    c = qpcr.standard_curve(_reactions(spark, sf), ["target"])
    return c.select("target", "levels", (F.round("slope", 4) + 0.0).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


# Cytometry: line items are events, price and quantity parameters

_GATES = [
    gating.Gate("a", "rectangle", {"l_quantity": (10.0, 40.0)}),
    gating.Gate("b", "rectangle", {"l_discount": (None, 0.05)}, "a"),
    gating.Gate("c", "polygon", ("l_quantity", "l_extendedprice", [(5.0, 1000.0), (45.0, 5000.0), (30.0, 60000.0)]), "a"),
    gating.Gate("d", "boolean", ("or", ["b", "c"])),
    gating.Gate("e", "complement", "d"),
]


@query("""WITH m AS (SELECT l_returnflag, l_extendedprice, coalesce(l_quantity >= 10 AND l_quantity < 40, false) a, coalesce(l_discount < 0.05, false) b0,
 (l_quantity BETWEEN 5 AND 45 AND l_extendedprice BETWEEN 1000 AND 60000 AND (CAST(l_extendedprice >= 1000 AND l_extendedprice < 5000 AND l_quantity < 5 + (l_extendedprice - 1000) * (40.0 / 4000) AS INT)
 + CAST(l_extendedprice >= 5000 AND l_extendedprice < 60000 AND l_quantity < 45 + (l_extendedprice - 5000) * (-15.0 / 55000) AS INT) + CAST(l_extendedprice >= 1000 AND l_extendedprice < 60000 AND l_quantity < 30 + (l_extendedprice - 60000) * (-25.0 / -59000) AS INT)) % 2 = 1) c0 FROM lineitem),
g AS (SELECT l_returnflag, a, a AND b0 b, a AND c0 c, (a AND b0) OR (a AND c0) d, NOT ((a AND b0) OR (a AND c0)) e FROM m),
w AS (SELECT l_returnflag, count(*) t, CAST(sum(a::INT) AS BIGINT) a, CAST(sum(b::INT) AS BIGINT) b, CAST(sum(c::INT) AS BIGINT) c, CAST(sum(d::INT) AS BIGINT) d, CAST(sum(e::INT) AS BIGINT) e FROM g GROUP BY 1)
SELECT l_returnflag, population, x AS count, round(x * 100.0 / p, 4) percent_of_parent, round(x * 100.0 / t, 4) percent_of_total FROM (SELECT l_returnflag, t, unnest(['a', 'b', 'c', 'd', 'e']) population, unnest([a, b, c, d, e]) x, unnest([t, a, a, t, t]) p FROM w)""")
def gate_populations(spark, sf):
    return rounded(gating.populations(table(spark, sf, "lineitem"), _GATES, ["l_returnflag"]).select("l_returnflag", "population", "count", "percent_of_parent", "percent_of_total"))


@query("SELECT round(sum(asinh(l_quantity / 5)), 3) asinh_sum, round(sum((l_extendedprice + 0) / 100000), 3) linear_sum, round(sum(CASE WHEN l_extendedprice > 0 THEN log10(l_extendedprice / 100000) / 4.5 + 1 END), 3) log_sum FROM lineitem")
def flow_transforms(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.agg(F.round(F.sum(gating.cofactor_arcsinh(F.col("l_quantity"))), 3).alias("asinh_sum"), F.round(F.sum(gating.linear(F.col("l_extendedprice"), 100000.0)), 3).alias("linear_sum"), F.round(F.sum(gating.logarithmic(F.col("l_extendedprice"), 100000.0, 4.5)), 3).alias("log_sum"))


@query("SELECT round(sum((l_quantity * 0.9 - l_tax * 0.2) / 0.88), 2) l_quantity, round(sum((l_tax - l_quantity * 0.1) / 0.88), 2) l_tax FROM lineitem")
def compensation(spark, sf):
    d = gating.compensate(table(spark, sf, "lineitem").select("l_quantity", "l_tax"), ["l_quantity", "l_tax"], [[1.0, 0.1], [0.2, 0.9]])
    return d.agg(F.round(F.sum("l_quantity"), 2).alias("l_quantity"), F.round(F.sum("l_tax"), 2).alias("l_tax"))


# Streams, as recorded


@query("SELECT time_bucket(INTERVAL 1 day, ts) start, event_type, count(*) n, round(avg(value), 6) mean FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return rounded(watch.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz")), 6)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 hour THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g) SELECT user_id, min(ts) start, count(*) n FROM s GROUP BY user_id, s")
def session_windows(spark, sf):
    return watch.sessions(table(spark, sf, "events"), "ts", "12 hours", ["user_id"]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) g FROM events) WHERE g >= 86400000000 * 3")
def stream_stalls(spark, sf):
    return watch.stalls(table(spark, sf, "events"), ["user_id"], "ts", 3 * 86_400.0).select("event_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n FROM events), b AS (SELECT user_id, median(value) b FROM r WHERE n < 3 GROUP BY user_id) SELECT event_id, CAST(n AS INTEGER) n FROM r JOIN b USING (user_id) WHERE n >= 3 AND value / b < 0.5")
def quality_rules_stream(spark, sf):
    d = watch.baseline_ratio(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 3)
    m = d.select("event_id", "n", F.lit("sharpness_ratio").alias("metric"), F.col("ratio").alias("value"))
    return watch.judge(m).select("event_id", F.col("n").cast("int").alias("n"))


@query("""WITH q AS (SELECT doc_id, bool_or(quality = 0) bad FROM labels GROUP BY doc_id), d AS (SELECT coalesce(source, '') || '/' || doc_id path, lang, n_chars, coalesce(bad, FALSE) bad FROM documents LEFT JOIN q USING (doc_id))
SELECT path, row_number() OVER (ORDER BY path) seq, n_chars + CAST(bad AS INTEGER) size_bytes, CASE WHEN lang = 'de' THEN 'new' WHEN bad THEN 'changed' ELSE 'same' END change, n_chars + CASE WHEN lang = 'de' OR bad THEN CAST(bad AS INTEGER) ELSE 0 END AS read FROM d""")
def crawl_journal(spark, sf):
    """Two crawls of the documents: the first knows no German ones, in the second the bad ones have grown; stopped at its cap and resumed."""
    bad = table(spark, sf, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 0).alias("bad"))
    d = table(spark, sf, "documents").join(bad, "doc_id", "left").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "lang", F.col("n_chars").alias("size_bytes"), F.coalesce("bad", F.lit(False)).alias("bad"), F.lit(0.0).alias("mtime"))
    job = Job(shared_folder(spark), lambda items: items.withColumn("read", F.col("size_bytes")), chunk_items=5000)
    job.run(d.where("lang IS NULL OR lang <> 'de'").drop("bad"))
    again = d.withColumn("size_bytes", F.col("size_bytes") + F.col("bad").cast("long")).drop("bad")
    done = job.run(again, max_items=1)
    while not done.finished:
        done = job.run(again, max_items=20_000)
    return job.records(spark).select("path", "seq", "size_bytes", "change", "read")


_LOOKS = """WITH e AS (SELECT *, 'user ' || user_id path, epoch_us(ts) / 1e6 tm, row_number() OVER w poll, count(*) FILTER (event_type = 'purchase') OVER w * 100 size, count(*) FILTER (event_type = 'view') OVER w seen,
  coalesce(max(epoch_us(ts) / 1e6) FILTER (event_type = 'purchase') OVER w, first_value(epoch_us(ts) / 1e6) OVER w) mtime FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
#: The state machine once more, as a recursion over each data set's polls.
_WATCHED = """WITH RECURSIVE looks AS MATERIALIZED (""" + _LOOKS + """ SELECT path, poll, tm, size, mtime, event_type = 'error' bad, CASE event_type WHEN 'signup' THEN 'in_progress' WHEN 'click' THEN 'interrupted' ELSE 'complete' END state,
  CASE WHEN event_type = 'view' THEN seen - 1 END unit, value tic FROM e),
opened AS (SELECT * FROM (SELECT path, 0::BIGINT poll, NULL::BIGINT size, NULL::DOUBLE mtime, NULL::DOUBLE grown, NULL::VARCHAR phase, FALSE announced, 0 stable, 0::BIGINT told, []::DOUBLE[] base,
    NULL::DOUBLE tm, NULL::VARCHAR state, FALSE e_new, FALSE e_scan, NULL::DOUBLE e_qc, FALSE e_complete, FALSE e_cut, FALSE e_stalled, FALSE e_error, FALSE recent FROM (SELECT DISTINCT path FROM looks))
  UNION ALL
  SELECT path, poll, size, mtime, grown, CASE WHEN now_stalled THEN 'stalled' ELSE after END, announced OR opens, stable, CASE WHEN says THEN unit + 1 ELSE told END,
    CASE WHEN says AND len(base) < 5 THEN list_append(base, tic) ELSE base END, tm, state, opens AND NOT announced, says,
    CASE WHEN says AND len(base) >= 5 AND list_median(base) > 0 AND tic / list_median(base) < 0.2 THEN tic / list_median(base) END,
    opens AND after = 'complete' AND before <> 'complete', opens AND state = 'interrupted' AND before <> 'stalled', now_stalled, looks AND bad AND after = 'failed' AND phase <> 'failed', recent
  FROM (SELECT *, after = 'in_progress' AND tm - grown >= 432000 now_stalled FROM (SELECT *, CASE WHEN NOT looks THEN phase WHEN bad THEN CASE WHEN recent THEN 'pending' ELSE 'failed' END
      WHEN state = 'complete' AND before <> 'complete' THEN CASE WHEN stable >= 1 THEN 'complete' ELSE 'in_progress' END WHEN state = 'interrupted' THEN 'stalled' ELSE before END after
    FROM (SELECT *, looks AND NOT bad opens, looks AND NOT bad AND unit IS NOT NULL AND unit >= told says, CASE WHEN state = 'in_progress' AND looks AND NOT bad AND (phase <> 'stalled' OR stable = 0) THEN 'in_progress' ELSE phase END before
      FROM (SELECT *, changed OR phase IN ('pending', 'in_progress') looks FROM (SELECT l.path, l.poll, l.tm, l.size, l.mtime, l.bad, l.state, l.unit, l.tic, coalesce(o.phase, 'pending') phase, o.announced, o.told, o.base,
          CASE WHEN o.size IS NULL OR o.size <> l.size OR o.mtime <> l.mtime THEN TRUE ELSE FALSE END changed, CASE WHEN o.size IS NULL OR o.size <> l.size OR o.mtime <> l.mtime THEN l.tm ELSE o.grown END grown,
          CASE WHEN o.size IS NULL OR o.size <> l.size OR o.mtime <> l.mtime THEN 0 ELSE o.stable + 1 END stable, l.tm - l.mtime <= 172800 recent FROM opened o JOIN looks l ON l.path = o.path AND l.poll = o.poll + 1)))))),
said AS (SELECT * FROM opened WHERE poll > 0)
SELECT path, poll, 'dataset_new' event, state, NULL::BIGINT AS "index", 0::BIGINT complete, NULL::DOUBLE idle_s, NULL::VARCHAR rule, NULL::DOUBLE AS value FROM said WHERE e_new
UNION ALL SELECT path, poll, 'scan_new', state, told - 1, told, NULL, NULL, NULL FROM said WHERE e_scan
UNION ALL SELECT path, poll, 'qc', state, told - 1, NULL, NULL, 'tic_drop', round(e_qc, 6) FROM said WHERE e_qc IS NOT NULL
UNION ALL SELECT path, poll, 'dataset_complete', 'complete', NULL, 0, NULL, NULL, NULL FROM said WHERE e_complete
UNION ALL SELECT path, poll, 'dataset_stalled', 'interrupted', NULL, 0, round_even(tm - mtime, 0), NULL, NULL FROM said WHERE e_cut
UNION ALL SELECT path, poll, 'dataset_stalled', 'in_progress', NULL, 0, round_even(tm - grown, 1), NULL, NULL FROM said WHERE e_stalled
UNION ALL SELECT path, poll, 'error', CASE WHEN recent THEN 'in_progress' END, NULL, NULL, NULL, NULL, NULL FROM said WHERE e_error"""


@query(_WATCHED)
def watch_events(spark, sf):
    """Each user's events as polls of a data set: purchases let it grow, views are scans, sign-ups find it running, clicks interrupted, errors unreadable."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = lambda k: F.col("event_type") == k
    e = table(spark, sf, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("path"), F.row_number().over(upto).cast("long").alias("poll"), at.alias("at"), F.count(F.when(kind("view"), 1)).over(upto).alias("views"),
        (F.count(F.when(kind("purchase"), 1)).over(upto) * 100).alias("size_bytes"), F.coalesce(F.max(F.when(kind("purchase"), at)).over(upto), F.first(at).over(upto)).alias("mtime"),
        F.when(kind("signup"), "in_progress").when(kind("click"), "interrupted").otherwise("complete").alias("state"), F.lit(None).cast("long").alias("expected"), F.when(kind("error"), "unreadable").alias("error"), "event_type", "value",
    )
    scan = "array(named_struct('kind', 'scan', 'run', 0, 'index', views - 1, 'c', cast(null as int), 'z', cast(null as int), 't', cast(null as int), 'ms_level', 1, 'tic', value, 'saturated_fraction', cast(null as double), 'sharpness', cast(null as double)))"
    looks = e.withColumn("units", F.when(kind("view"), F.expr(scan)))
    events = watch.replay(looks, watch.Options(stall_s=432_000.0, live_s=172_800.0, max_tracked=1 << 40))
    return events.select("path", "poll", "event", "state", "index", "complete", "idle_s", "rule", "value")


@query("SELECT p.event_id, v.event_id view_id FROM events p LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts BETWEEN p.ts - INTERVAL 36 hour AND p.ts + INTERVAL 90 minute WHERE p.event_type = 'purchase'")
def stream_interval_join(spark, sf):
    """Purchases with their user's views from 36 hours before to 90 minutes after; the same function joins streams."""
    e = table(spark, sf, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return interval_join(buys, views, ["user_id"], "ts", "seen", 36 * 3600, 90 * 60, how="left_outer").select("event_id", "view_id")


@query("SELECT event_id, props AS root, regexp_extract(props, '([0-9]+)', 1) k, '[' || regexp_extract(props, '([0-9]+)', 1) || ']' AS each, ['/no/0'] missing FROM events")
def json_pick(spark, sf):
    d = pointers.pick(table(spark, sf, "events").select("event_id", "props"), "props", ["", "/k", "/*", "/no/0"])
    return d.select("event_id", F.replace(F.col("picked")[""], F.lit(":"), F.lit(": ")).alias("root"), F.col("picked")["/k"].alias("k"), F.col("picked")["/*"].alias("each"), "missing")


@query("""WITH l AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) i, CAST(l_quantity AS BIGINT) q, l_suppkey s, l_returnflag, l_tax FROM lineitem)
SELECT l_orderkey, '/lines/' || i pointer, '{"q":' || q || ',"s":' || s || ',"x":1}' ours, NULL theirs FROM l WHERE i >= 5 UNION ALL
SELECT l_orderkey, '/lines/' || i || '/q', CAST(q AS VARCHAR), CAST(q + 1 AS VARCHAR) FROM l WHERE i < 5 AND l_returnflag = 'R' UNION ALL SELECT l_orderkey, '/lines/' || i || '/s', CAST(s AS VARCHAR), NULL FROM l WHERE i < 5 AND l_tax = 0""")
def json_diff(spark, sf):
    """Orders as nested documents against copies with other quantities, members that are gone, fewer lines, and members to ignore."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity").cast("long")
    lines = table(spark, sf, "lineitem").withColumn("i", F.row_number().over(w) - 1)
    # an order's lines are few
    doc = lambda q, s, x: F.to_json(F.struct(F.col("l_orderkey").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q"), s.alias("s"), x.alias("x")))), lambda r: F.struct(r["q"], r["s"], r["x"])).alias("lines")))
    ours = lines.groupBy("l_orderkey").agg(doc(q, F.col("l_suppkey"), F.lit(1)).alias("j"))
    changed = F.when(F.col("l_returnflag") == "R", q + 1).otherwise(q)
    theirs = lines.where("i < 5").groupBy("l_orderkey").agg(doc(changed, F.when(F.col("l_tax") != 0, F.col("l_suppkey") * F.lit(1.0)), F.lit(2)).alias("j"))
    return pointers.diff(ours, theirs, ["l_orderkey"], "j", ignore=["/lines/*/x"])


@query("""WITH e AS (SELECT vec_id // 16 image, vec_id % 4 * 8 x, vec_id % 16 // 4 * 8 y, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 i FROM embeddings), px AS MATERIALIZED (SELECT image, x + i % 8 px, y + i // 8 py, v FROM e),
r AS (SELECT c_custkey, c_custkey % (SELECT max(image) + 1 FROM px) image, c_custkey % 50 // 2 x0, least((c_custkey % 50 + c_nationkey + 2) // 2, 32) x1, c_custkey % 43 // 2 y0, least((c_custkey % 43 + c_custkey % 17 + 2) // 2, 32) y1 FROM customer),
g AS (SELECT c_custkey, image, x0, x1, unnest(range(y0, y1)) py, y0 FROM r)
SELECT c_custkey, g.py - any_value(y0) AS "row", any_value(x1 - x0) n, round(coalesce(sum(CAST(v AS DOUBLE)), 0), 4) + 0.0 total FROM g LEFT JOIN px ON px.image = g.image AND px.py = g.py AND px.px >= x0 AND px.px < x1 GROUP BY c_custkey, g.py""")
def region_rows(spark, sf):
    """Embeddings as tiles of 8 x 8, sixteen of them a plane; a rectangle a customer, given on a level of twice the size."""
    v = F.col("vec_id")
    tiles = table(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("image"), (v % 4 * 8).alias("x"), (F.expr("vec_id % 16 div 4") * 8).alias("y"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("pixels"))
    images = tiles.agg((F.max("image") + 1).alias("images"))
    k = F.col("c_custkey")
    (x, w), (y, h) = (regions.rescaled(a, b, F.lit(64), F.lit(32)) for a, b in ((k % 50, F.col("c_nationkey") + 1), (k % 43, k % 17 + 1)))
    asked = table(spark, sf, "customer").crossJoin(F.broadcast(images)).select("c_custkey", (k % F.col("images")).alias("image"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))  # one row
    got = regions.read(tiles, asked, ["image"], ["c_custkey"], 16)
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return rounded(got.select("c_custkey", "row", F.size("values").cast("long").alias("n"), total.alias("total")))


_TREE = "'/' || coalesce(lang, 'und') || '/' || coalesce(source, 'none') || '/' || n_chars % 5 || '/' || doc_id"


@query(f"""WITH d AS (SELECT doc_id, source, string_split({_TREE}, '/') p FROM documents), s AS (SELECT p[2] lang, p[3] source, bool_or(q.quality = 0) bad FROM d JOIN labels q USING (doc_id) GROUP BY ALL), t AS (SELECT lang, source, TRUE definite FROM s WHERE bad),
v AS (SELECT DISTINCT p[2] lang, p[3] source, p[4] part FROM d WHERE p[4] = '1'), w AS (SELECT DISTINCT p[2] lang, p[3] source FROM d)
SELECT doc_id, CASE WHEN t.definite THEN '/' || p[2] || '/' || p[3] WHEN v.part IS NOT NULL THEN '/' || p[2] || '/' || p[3] || '/1' WHEN NOT EXISTS (SELECT 1 FROM v x WHERE x.lang = p[2] AND x.source = p[3]) THEN '/' || p[2] || '/' || p[3] END data_set
FROM d LEFT JOIN t ON t.lang = p[2] AND t.source = p[3] LEFT JOIN v ON v.lang = p[2] AND v.source = p[3] AND v.part = p[4]""")
def data_set_owners(spark, sf):
    """Documents as files of a tree: each source's folder is claimed, with certainty where a bad document lies in it; so are folders 1, and the languages', with less."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(_TREE).alias("path"))
    parts = F.split("path", "/")
    at = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    bad = d.join(table(spark, sf, "labels").where("quality = 0"), "doc_id").select(at(3).alias("path"), F.lit(True).alias("definite"))
    weak = d.select(F.explode(F.array(at(2), at(3), F.when(parts[3] == "1", at(4)))).alias("path"), F.lit(False).alias("definite"))
    return trees.owners(d, bad.unionByName(weak), "path").select("doc_id", "data_set")


@query(f"""WITH d AS (SELECT {_TREE} p, n_chars s, sha256(coalesce(text, '')) c FROM documents), f AS (SELECT p, s, c, unnest([1, 2, 3, 4]) n, string_split(p, '/') x FROM d), u AS (SELECT CASE WHEN n = 1 THEN '/' ELSE array_to_string(x[1 : n], '/') END folder, s, sha256('/' || array_to_string(x[n + 1 :], '/') || chr(0) || s || chr(0) || c) h FROM f),
g AS (SELECT folder, count(*) files, CAST(sum(s) AS BIGINT) bytes, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) l{i}" for i in range(8))} FROM u GROUP BY folder)
SELECT folder, files, bytes, sha256(concat_ws(',', files, l0, l1, l2, l3, l4, l5, l6, l7)) fingerprint FROM g""")
def folder_fingerprints(spark, sf):
    d = table(spark, sf, "documents").select(F.expr(_TREE).alias("path"), "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("c"))
    return trees.fingerprints(d, "path", "c", "n_chars")


def _second(d: str) -> str:
    """The nine-point second derivative of y, or with seven points the slope and curvature of d, as SQL."""
    at = lambda c, j: c if not j else f"lag({c}, {-j}) OVER w" if j < 0 else f"lead({c}, {j}) OVER w"
    if d == "y":
        return "(" + " + ".join(f"({k}) * ({at('y', j)} - y)" for j, k in zip(range(-4, 5), (28, 7, -8, -17, -20, -17, -8, 7, 28), strict=True)) + ") / 462.0"
    weights = [(j, j if d == "tilt" else j * j - 4) for j in range(-3, 4)]
    return "(" + " + ".join(f"({k}) * {at('s', j)}" for j, k in weights) + f") / {28.0 if d == 'tilt' else 84.0}"


@query(f"""WITH e AS (SELECT user_id // 4 reaction, CAST(row_number() OVER (PARTITION BY user_id // 4 ORDER BY ts, event_id) AS DOUBLE) x, CAST(count(*) OVER (PARTITION BY user_id // 4) AS DOUBLE) n, value FROM events),
c AS (SELECT reaction, x, n, 500.0 + value / 1000.0 + 2000.0 * (reaction % 3) / (1.0 + exp((0.6 * n - x) / 1.7)) y FROM e),
f AS (SELECT reaction, regr_slope(y, x) b, regr_intercept(y, x) a, avg(y) level FROM c WHERE x BETWEEN 3 AND 15 GROUP BY reaction), r AS (SELECT reaction, stddev_samp(y - a - b * x) sd FROM c JOIN f USING (reaction) WHERE x BETWEEN 3 AND 15 GROUP BY reaction),
s AS (SELECT *, {_second("y")} s FROM c WINDOW w AS (PARTITION BY reaction ORDER BY x)), t AS (SELECT *, {_second("tilt")} tilt, {_second("bend")} bend FROM s WINDOW w AS (PARTITION BY reaction ORDER BY x)),
p AS (SELECT * FROM t WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reaction ORDER BY s DESC, x DESC) = 1), g AS (SELECT reaction, max(n) n, max(y) highest FROM c GROUP BY reaction),
o AS (SELECT reaction, x, tilt, bend, CASE WHEN g.n < 18 OR sd IS NULL THEN 'undetermined' WHEN highest - level <= 50 * sd OR s <= 0 THEN 'none' WHEN bend < 0 AND abs(tilt / (2 * bend)) <= 3 THEN 'cq' ELSE 'undetermined' END outcome FROM g LEFT JOIN f USING (reaction) LEFT JOIN r USING (reaction) LEFT JOIN p USING (reaction))
SELECT reaction, outcome, round(CASE WHEN outcome = 'cq' THEN x - tilt / (2 * bend) END, 4) cq FROM o""")
def second_derivative_cq(spark, sf):
    """Four users' events as the cycles of a reaction; a third of them do not amplify."""
    g = F.expr("user_id div 4")
    e = table(spark, sf, "events").select(g.alias("reaction"), F.row_number().over(Window.partitionBy(g).orderBy("ts", "event_id")).cast("double").alias("x"), F.count("*").over(Window.partitionBy(g)).cast("double").alias("n"), "value")
    y = 500.0 + F.col("value") / 1000.0 + 2000.0 * (F.col("reaction") % 3) / (1.0 + F.exp((0.6 * F.col("n") - F.col("x")) / 1.7))
    return rounded(qpcr.second_derivative_cq(e.withColumn("y", y), ["reaction"], "x", "y"))


# Scalar functions


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) norm, lower(regexp_replace(p_brand, '[^\\p{L}\\p{N}]+', '', 'g')) alnum FROM part")
def text_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.normal_text(F.col("p_name")).alias("norm"), S.alphanumeric(F.col("p_brand")).alias("alnum"))


@query("SELECT p_partkey, chr(CAST(65 + p_partkey % 8 AS INTEGER)) || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') well FROM part")
def well_names(spark, sf):
    p = F.col("p_partkey")
    raw = F.when(p % 2 == 0, F.concat(F.chr(65 + p % 8), F.lit("-"), (p % 12 + 1).cast("string"))).otherwise(F.concat(F.lit("r"), (p % 8 + 1).cast("string"), F.lit("C"), (p % 12 + 1).cast("string")))
    return table(spark, sf, "part").select("p_partkey", S.well(raw).alias("well"))


@query("SELECT conv_id, turn, CASE WHEN len(words) > 0 THEN words[1] END w FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') words FROM conversations)")
def first_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), F.lit(0)).alias("w"))


# Fits and pattern analyses


_KINETICS = f"""
WITH e AS (SELECT user_id, {_T} t, value v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, v) i, count(*) OVER (PARTITION BY user_id) n, min(t) OVER (PARTITION BY user_id) t0 FROM e),
h AS (SELECT *, t - t0 x, least(greatest(5, CAST(ceil(n / 10.0) AS INTEGER)), n) h FROM n),
w AS (SELECT *, regr_slope(v, x) OVER f slope, avg(x) OVER f xm, avg(v) OVER f vm FROM h WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND h - 1 FOLLOWING)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slope DESC NULLS LAST, i) r FROM w WHERE i + h - 1 <= n),
s AS (SELECT * FROM b WHERE r = 1),
base AS (SELECT user_id, min(w.v) base FROM w JOIN s USING (user_id) WHERE w.i <= s.i + s.h - 1 GROUP BY user_id),
area AS (SELECT user_id, sum(a) auc FROM (SELECT user_id, (x - lag(x) OVER o) * (v + lag(v) OVER o) / 2 a FROM h WINDOW o AS (PARTITION BY user_id ORDER BY i)) GROUP BY user_id)
SELECT u.user_id, round(CASE WHEN n >= 2 THEN slope END * 86400, 4) + 0.0 vmax_a_day, round(CASE WHEN n >= 2 AND slope > 0 THEN t0 + xm - (vm - base) / slope END, 1) lag,
  round(CASE WHEN n >= 2 THEN t0 + xm END, 1) t_vmax, round(CASE WHEN n >= 2 THEN auc END, 1) + 0.0 auc
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id) LEFT JOIN base USING (user_id) LEFT JOIN area USING (user_id)
"""


@query(_KINETICS)
def kinetics(spark, sf):
    k = assay.kinetics(_timed(spark, sf), ["user_id"], "t", "value")
    return k.select("user_id", (F.round(F.col("vmax") * 86400, 4) + 0.0).alias("vmax_a_day"), *((F.round(c, 1) + 0.0).alias(c) for c in ("lag", "t_vmax", "auc")))


@query()
def growth(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf, "events").select("user_id", F.row_number().over(w).cast("double").alias("t"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    return assay.growth(x, ["user_id"], "t", "y")


_LINES = """
WITH s AS (
  SELECT l_suppkey, CAST(count(*) AS INTEGER) n, CAST(count(DISTINCT l_linenumber) AS INTEGER) levels, CAST(min(l_linenumber) AS DOUBLE) x_min, CAST(max(l_linenumber) AS DOUBLE) x_max,
    regr_intercept(l_quantity, l_linenumber) a, regr_slope(l_quantity, l_linenumber) b, regr_r2(l_quantity, l_linenumber) r2,
    regr_sxx(l_quantity, l_linenumber) sxx, regr_syy(l_quantity, l_linenumber) - regr_sxy(l_quantity, l_linenumber) ** 2 / regr_sxx(l_quantity, l_linenumber) sse, regr_avgx(l_quantity, l_linenumber) mx
  FROM lineitem GROUP BY l_suppkey
)
SELECT l_suppkey, round(a, 9) a, round(b, 9) b, CAST(NULL AS DOUBLE) c, CAST(NULL AS DOUBLE) d, CAST(NULL AS DOUBLE) g, round(sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) se_a,
  round(sqrt(sse / (n - 2) / sxx), 4) se_b, CAST(NULL AS DOUBLE) se_c, CAST(NULL AS DOUBLE) se_d, CAST(NULL AS DOUBLE) se_g, round(r2, 9) r2, round(sse, 4) sse,
  round(sqrt(sse / (n - 2)), 4) residual_se, n - 2 AS df, n, levels, x_min, x_max
FROM s
"""


@query(_LINES)
def curve_fits(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    lines = assay.fit(d, ["l_suppkey"], "x", "y", "linear")
    return rounded(lines, 9).withColumns({c: F.round(c, 4) for c in ("se_a", "se_b", "sse", "residual_se")})


_BACK = """
WITH f AS (SELECT l_suppkey, regr_intercept(l_extendedprice, l_quantity) a, regr_slope(l_extendedprice, l_quantity) b, min(l_quantity) x0, max(l_quantity) x1 FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_suppkey),
c AS (SELECT l_orderkey, l_linenumber, l_quantity, x0, x1, (l_extendedprice - a) / nullif(b, 0) x FROM lineitem JOIN f USING (l_suppkey) WHERE l_linenumber > 3)
SELECT l_orderkey, l_linenumber, round(x, 4) + 0.0 back_calculated, CASE WHEN x < x0 THEN 'below_range' WHEN x > x1 THEN 'above_range' WHEN x IS NULL THEN 'not_computable' ELSE 'in_range' END flag,
  round(2 * x, 4) + 0.0 final_concentration, round(100 * x / l_quantity, 4) + 0.0 recovery_percent
FROM c
"""


@query(_BACK)
def back_calculation(spark, sf):
    """Lines of up to three as standards of each supplier, the others read back from price."""
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.lit(2.0).alias("dilution"))
    lines = assay.fit(d.where("l_linenumber <= 3"), ["l_suppkey"], "x", "y", "linear")
    got = assay.back_calculate(d.where("l_linenumber > 3"), lines, ["l_suppkey"], "y", "linear", "x", "dilution")
    return rounded(got.select("l_orderkey", "l_linenumber", "back_calculated", "flag", "final_concentration", "recovery_percent"))


@query()
def dose_responses(spark, sf):
    """Prices of each supplier over quantity; no SQL says the fit."""
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.avg("l_extendedprice").alias("y"))
    return assay.dose_response(d.withColumn("x", F.col("l_quantity").cast("double")), ["l_suppkey"], "x", "y")


@query()
def chromatographic_peaks(spark, sf):
    from ..operators import signal

    p = _spectra(spark, sf).select("scan", F.explode(spectra.pairs()).alias("p")).select("scan", F.col("p.mz").alias("t"), F.col("p.intensity").alias("y"))
    return signal.peaks(p, ["scan"], "t", "y")


@query()
def isotope_charges(spark, sf):
    return spectra.charges(_spectra(spark, sf), 5)


# Catalog rows, reads, figures


@query("SELECT o_custkey, min(o_orderkey) o_orderkey, count(*) streams, round(sum(o_totalprice), 2) o_totalprice FROM orders GROUP BY o_custkey")
def series_totals(spark, sf):
    return rounded(catalog.series_totals(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"]), 2)


@query("SELECT l_suppkey, count(DISTINCT (l_linenumber, l_returnflag)) present, count(DISTINCT l_linenumber) * count(DISTINCT l_returnflag) - count(DISTINCT (l_linenumber, l_returnflag)) missing FROM lineitem GROUP BY l_suppkey")
def missing_planes(spark, sf):
    return catalog.missing_planes(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_linenumber", "l_returnflag"])


@query("SELECT s_suppkey, 's_acctbal' AS \"column\", CAST(s_acctbal AS VARCHAR) AS \"left\", CAST(b AS VARCHAR) AS \"right\" FROM (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 7 = 0 THEN 0.5 ELSE s_acctbal END b FROM supplier) WHERE s_acctbal <> b")
def table_comparison(spark, sf):
    a = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return catalog.compare(a, a.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, 0.5).otherwise(F.col("s_acctbal"))), ["s_suppkey"])


@query("SELECT event_id, '/k' pointer, json_extract_string(props, '$.k') AS \"left\", '1' AS \"right\" FROM events WHERE json_extract_string(props, '$.k') <> '1'")
def json_comparison(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    return catalog.json_compare(e, e.withColumn("props", F.lit('{"k": 1}')), "event_id", "props")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity q, b.l_tax t FROM lineitem a FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber < 3) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def session_composition(spark, sf):
    d = table(spark, sf, "lineitem")
    return catalog.session(d.withColumn("v", F.col("l_quantity")), d.where("l_linenumber < 3").withColumn("v", F.col("l_tax")), ["l_orderkey", "l_linenumber"], "v", ("q", "t"))


_READS = "(SELECT lang, regexp_replace(upper(text), '[^ACGTN]', '', 'g') s FROM documents)"


@query(f"SELECT lang, count(*) reads, CAST(sum(length(s)) AS BIGINT) bases, CAST(min(length(s)) AS INTEGER) shortest, CAST(max(length(s)) AS INTEGER) longest, round(avg(length(s)), 4) mean_length, round(sum(len(regexp_extract_all(s, '[GC]'))) * 100.0 / sum(len(regexp_extract_all(s, '[ACGT]'))), 4) gc_percent, round(sum(len(regexp_extract_all(s, 'N'))) * 100.0 / sum(length(s)), 4) n_percent, round(sum(len(regexp_extract_all(s, '[ACG]'))) * 100.0 / sum(length(s)), 4) q20_percent, round(sum(len(regexp_extract_all(s, '[CG]'))) * 100.0 / sum(length(s)), 4) q30_percent FROM {_READS} GROUP BY lang")
def read_statistics(spark, sf):
    s = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    d = table(spark, sf, "documents").select("lang", s.alias("sequence"), F.translate(s, "ACGTN", "5?I+!").alias("quality"))  # scores 20, 30, 40, 10 and 0
    return rounded(reads.summary(d, ["lang"]))


@query("WITH r AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem) SELECT l_returnflag, CAST(least(floor((l_quantity - x0) * 16 / (x1 - x0)), 15) AS INTEGER) bx, CAST(least(floor((l_extendedprice - y0) * 16 / (y1 - y0)), 15) AS INTEGER) AS \"by\", count(*) AS count FROM lineitem, r GROUP BY ALL")
def event_density(spark, sf):
    return plots.density(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 16)


@query("SELECT event_type, count(value) n, round(avg(value), 4) mean, round(stddev_samp(value), 4) sd, round(stddev_samp(value) / sqrt(count(value)), 4) sem, round(min(value), 4) lo, round(max(value), 4) hi FROM events GROUP BY event_type")
def group_spread(spark, sf):
    return rounded(plots.spread(table(spark, sf, "events"), ["event_type"], "value"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) r FROM events) WHERE r = 1")
def trace_apex(spark, sf):
    return plots.apex(table(spark, sf, "events"), ["user_id"], "event_id", "value")


# Layouts, licences, checks


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'blank' WHEN 1 THEN 'standard' WHEN 2 THEN 'positive' WHEN 3 THEN 'control' WHEN 4 THEN 'sample' ELSE 'negative' END AS role, CASE WHEN p_partkey % 6 IN (0, 5) THEN NULL WHEN p_partkey % 6 = 1 THEN 'standard' WHEN p_partkey % 6 = 2 THEN 'positive' WHEN p_partkey % 6 = 3 THEN 'control' ELSE 'sample' END written FROM part")
def well_roles(spark, sf):
    p = F.col("p_partkey")
    name = F.element_at(F.array(F.concat(F.lit("Blank "), p), F.concat(F.lit("STD-"), p), F.lit("Pos. Ctrl"), F.lit("DMSO"), F.lit("Unknown"), F.lit("negative control N")), (p % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", layout.role_of_name(name).alias("role"), layout.role(F.when(p % 6 == 1, "Std. curve").otherwise(name)).alias("written"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size / 2.0 ELSE 4.0 END factor, p_retailprice number, 'mg/' || p_size rest FROM part")
def dilutions(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(p % 3 == 0, F.concat(F.lit("1:"), size)).when(p % 3 == 1, F.concat(F.lit(" 2 / "), size)).otherwise(F.lit("0.25x"))
    number, rest = S.leading_number(F.concat(F.col("p_retailprice").cast("string"), F.lit(" mg/"), size))
    return table(spark, sf, "part").select("p_partkey", S.dilution(text).alias("factor"), number.alias("number"), rest.alias("rest"))


@query("SELECT p_partkey, chr(CAST(65 + r AS INTEGER)) || lpad(CAST(c AS VARCHAR), 2, '0') well, CAST(96 AS INTEGER) plate FROM part, range(0, 8) t(r), range(1, 13) u(c) WHERE r BETWEEN p_partkey % 4 AND p_partkey % 4 + p_size % 3 AND c BETWEEN 2 AND 3 + p_size % 5")
def well_ranges(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.chr(65 + p % 4), (3 + size % 5).cast("string"), F.lit(":"), F.chr(65 + p % 4 + size % 3), F.lit("2"))
    return table(spark, sf, "part").select("p_partkey", F.explode(S.well_range(text)).alias("well"), S.plate_size(F.lit(8), F.lit(12)).alias("plate"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'MIT' WHEN doc_id % 4 = 1 THEN 'CC-BY-SA-4.0' WHEN doc_id % 4 = 2 THEN 'CC-BY-4.0' END licence FROM documents")
def licences(spark, sf):
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, "The MIT License").when(d % 4 == 1, "CC BY 4.0, no: Creative Commons Attribution-ShareAlike 4.0").when(d % 4 == 2, "Under CC BY 4.0")
    return table(spark, sf, "documents").select("doc_id", catalog.licence(text).alias("licence"))


@query("SELECT s_suppkey, coalesce(e, 0) = 0 ok, coalesce(e, 0) errors, coalesce(w, 0) warnings, coalesce(i, 0) infos FROM supplier LEFT JOIN (SELECT l_suppkey s_suppkey, count(*) FILTER (l_quantity > 49) e, count(*) FILTER (l_quantity BETWEEN 40 AND 49) w, count(*) FILTER (l_quantity < 40) i FROM lineitem WHERE l_returnflag = 'A' AND l_tax > 0.07 GROUP BY 1) USING (s_suppkey)")
def integrity(spark, sf):
    q = F.col("l_quantity")
    findings = table(spark, sf, "lineitem").where("l_returnflag = 'A' and l_tax > 0.07").select(F.col("l_suppkey").alias("s_suppkey"), F.when(q > 49, "error").when(q >= 40, "Warning").otherwise("info").alias("severity"))
    return catalog.integrity(table(spark, sf, "supplier"), findings, "s_suppkey")


@query("SELECT l_orderkey, count(*) image_count, arg_max(l_quantity, (l_quantity * l_suppkey, -l_linenumber, l_quantity, l_suppkey)) size_x, arg_max(l_suppkey, (l_quantity * l_suppkey, -l_linenumber, l_quantity, l_suppkey)) size_y FROM lineitem GROUP BY l_orderkey")
def image_summary(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("size_x"), F.col("l_suppkey").alias("size_y"))
    return catalog.image_summary(d, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND (l_suppkey % 10 BETWEEN 2 AND 5 OR l_suppkey % 10 = 8)")
def plane_selection(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("c"), (F.col("l_suppkey") % 10).alias("z"), F.lit(0).alias("t"))
    return tables.planes(d, "c=1,3,z=2-5", "z=8").select("l_orderkey", "l_linenumber")


@query("SELECT event_type, count(*) n, round(corr(event_id, value), 6) r FROM events WHERE value IS NOT NULL GROUP BY event_type")
def pearson(spark, sf):
    return rounded(series.pearson(table(spark, sf, "events"), ["event_type"], "event_id", "value"), 6)


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) fields, count(*) AS count, round(avg(l_quantity), 4) mean, round(stddev_pop(l_quantity), 4) std, min(l_quantity) min, max(l_quantity) max FROM lineitem GROUP BY l_returnflag")
def well_statistics(spark, sf):
    q = F.col("l_quantity").cast("double")
    fields = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("count"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"), F.min(q).alias("min"), F.max(q).alias("max"))
    return rounded(series.merged_statistics(fields, ["l_returnflag"]))


@query("SELECT round(sum((log10(greatest(l_extendedprice, 2000)) - log10(2000)) / 4.5), 3) log_sum, round(sum(2.0 * (l_extendedprice - 1) / nullif(l_quantity - 3, 0)), 1) ratio_sum FROM lineitem")
def offset_log_and_ratio(spark, sf):
    x, y = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return table(spark, sf, "lineitem").agg(F.round(F.sum(gating.offset_log(x, 2000.0, 4.5)), 3).alias("log_sum"), F.round(F.sum(gating.ratio(x, y, 2.0, 1.0, 3.0)), 1).alias("ratio_sum"))


@query("""WITH f AS (SELECT s_suppkey file_key, 'a' || s_suppkey % 60 AS file, ' n' || s_nationkey || ' ' AS fil FROM supplier), s AS (SELECT n_nationkey k, 'a' || n_nationkey a, 'a' || 2 * n_nationkey b, 'n' || n_nationkey % 20 fil FROM nation),
n AS (SELECT file, min(k) k FROM (SELECT k, a AS file FROM s UNION SELECT k, b FROM s) GROUP BY file HAVING count(*) = 1), g AS (SELECT fil, min(k) k FROM s GROUP BY fil HAVING count(*) = 1)
SELECT f.file, coalesce(n.k, g.k) AS sample FROM f LEFT JOIN n ON f.file = n.file LEFT JOIN g ON trim(f.fil) = g.fil""")
def sample_matches(spark, sf):
    k = F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    files = table(spark, sf, "supplier").select(name("a", F.col("s_suppkey") % 60).alias("file"), F.concat(name(" n", F.col("s_nationkey")), F.lit(" ")).alias("fil"))
    return gating.match_samples(files, table(spark, sf, "nation").select(k.alias("sample"), name("a", k).alias("name"), name("a", k * 2).alias("uri_name"), name("n", k % 20).alias("fil")))
