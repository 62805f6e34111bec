"""Queries of lookups in tables of any size, of hot accounts, and of counts taken while rows pass."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sieveline.functions import contact, dims, text
from sieveline.operators import lookups, selection
from sieveline.plans import oracle as o
from sieveline.session import checkpoint_dir, load


def domain_list(spark, sf_dir):
    """Hosts of pages and of orders' shops against a list of platforms, of pages' domains and of one domain per customer in credit."""
    p, c, x = (load(spark, sf_dir, t) for t in ("pages", "customer", "orders"))
    host = contact.host(F.col("url"))
    shop = F.concat(F.element_at(F.array(F.lit(""), F.lit("www."), F.lit("shop.a."), F.lit("x")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("firm"), F.col("o_custkey").cast("string"), F.lit(".fr"))
    hosts = p.select(host.alias("host")).unionByName(x.select(shop.alias("host")))
    fixed = p.select(F.explode(F.array(*[F.lit(d) for d in dims.PLATFORM_DOMAINS])).alias("domain")).distinct()
    domains = fixed.unionByName(p.where("page_id % 2 = 0").select(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))).unionByName(c.where("c_acctbal > 0").select(F.concat(F.lit("Firm"), F.col("c_custkey").cast("string"), F.lit(".FR")).alias("domain")))
    return lookups.on_list(hosts, "host", domains).groupBy("host", "listed").agg(F.count("*").alias("n"))


DOMAIN_LIST = f"""
WITH h AS (SELECT {o.host('url')} AS host FROM pages UNION ALL SELECT list_extract(['', 'www.', 'shop.a.', 'x'], (o_orderkey % 4 + 1)::INTEGER) || 'firm' || o_custkey || '.fr' FROM orders),
d AS (SELECT unnest([{o.names(dims.PLATFORM_DOMAINS)}]) AS s UNION SELECT regexp_extract({o.host('url')}, '([^.]+\\.[^.]+)$', 1) FROM pages WHERE page_id % 2 = 0 UNION SELECT 'firm' || c_custkey || '.fr' FROM customer WHERE c_acctbal > 0),
g AS (SELECT host, count(*) AS n FROM h GROUP BY host),
s AS (SELECT host, array_to_string(l[i:], '.') AS s, i FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT host, string_split(regexp_replace(lower(host), '^www\\.', ''), '.') AS l FROM g WHERE host <> ''))),
b AS (SELECT host, arg_min(s, i) AS listed FROM s JOIN d USING (s) WHERE s <> '' GROUP BY host)
SELECT host, listed, n FROM g LEFT JOIN b USING (host)
"""


def phrase_hits(spark, sf_dir):
    """Phrases of 1 to 5 words drawn from every benchmark item, in all documents: where they stand, longest first."""
    w = text.tokens(F.col("text"))
    b = load(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 0)
    start, n = F.pmod(F.col("item_id") * 7, F.size("w")), F.pmod(F.col("item_id"), F.lit(5)) + 1
    one = b.select(F.col("item_id").alias("phrase_id"), F.slice("w", (start + 1).cast("int"), n.cast("int")).alias("t"))
    two = b.select((F.col("item_id") + 100000).alias("phrase_id"), F.slice("w", F.lit(1), F.least(F.size("w"), F.lit(2))).alias("t"))
    return lookups.match_phrases(load(spark, sf_dir, "documents"), one.unionByName(two), "doc_id", w, F.col("t"))


PHRASE_HITS = f"""
WITH RECURSIVE i AS (SELECT item_id, {o.tokens('text')} AS w FROM benchmark),
p0 AS (SELECT item_id AS id, w[item_id * 7 % len(w) + 1 : item_id * 7 % len(w) + item_id % 5 + 1] AS t FROM i WHERE len(w) > 0 UNION ALL SELECT item_id + 100000, w[1:2] FROM i WHERE len(w) > 0),
p AS (SELECT array_to_string(t, ' ') AS g, len(t) AS n, min(id) AS phrase_id FROM p0 GROUP BY ALL),
d AS (SELECT doc_id, {o.tokens('text')} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS t1, unnest(range(len(w))) AS pos FROM d),
g AS MATERIALIZED (SELECT doc_id, pos, t1, t1 || ' ' || lead(t1, 1) OVER o AS t2, t1 || ' ' || lead(t1, 1) OVER o || ' ' || lead(t1, 2) OVER o AS t3, t1 || ' ' || lead(t1, 1) OVER o || ' ' || lead(t1, 2) OVER o || ' ' || lead(t1, 3) OVER o AS t4,
  t1 || ' ' || lead(t1, 1) OVER o || ' ' || lead(t1, 2) OVER o || ' ' || lead(t1, 3) OVER o || ' ' || lead(t1, 4) OVER o AS t5 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos, p.n, phrase_id FROM g JOIN p ON p.n = 1 AND p.g = t1 UNION ALL SELECT doc_id, pos, p.n, phrase_id FROM g JOIN p ON p.n = 2 AND p.g = t2 UNION ALL SELECT doc_id, pos, p.n, phrase_id FROM g JOIN p ON p.n = 3 AND p.g = t3
  UNION ALL SELECT doc_id, pos, p.n, phrase_id FROM g JOIN p ON p.n = 4 AND p.g = t4 UNION ALL SELECT doc_id, pos, p.n, phrase_id FROM g JOIN p ON p.n = 5 AND p.g = t5),
x AS (SELECT doc_id, pos, max(n) AS n, arg_max(phrase_id, n) AS phrase_id FROM h GROUP BY doc_id, pos),
y AS (SELECT doc_id, pos, n, phrase_id, coalesce(max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= pos, true) AS free FROM x),
z AS MATERIALIZED (SELECT *, sum(free::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS chain FROM y),
r AS (SELECT doc_id, chain, pos, n, phrase_id FROM z WHERE free UNION ALL SELECT doc_id, chain, min(z.pos), arg_min(z.n, z.pos), arg_min(z.phrase_id, z.pos) FROM r JOIN z USING (doc_id, chain) WHERE z.pos >= r.pos + r.n GROUP BY doc_id, chain, r.pos)
SELECT doc_id, pos::INTEGER AS pos, n::INTEGER AS n, phrase_id FROM r
"""


def _point(k, a, b):
    """Coordinates made of a row's key and balance, some 30 km around one town."""
    return (48.1 + (F.pmod(k * a, F.lit(4001)) - 2000) / 10000.0).alias("lat"), (-1.7 + (F.pmod(F.floor(b).cast("long") * 13 + k, F.lit(6001)) - 3000) / 10000.0).alias("lng")


def _point_sql(k, a, b):
    return f"48.1::DOUBLE + ((({k} * {a}) % 4001) - 2000) / 10000.0::DOUBLE AS lat, -1.7::DOUBLE + ((((floor({b})::BIGINT * 13 + {k}) % 6001) + 6001) % 6001 - 3000) / 10000.0::DOUBLE AS lng"


def _points(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), *_point(F.col("s_suppkey"), 7919, F.col("s_acctbal"))), c.select(F.col("c_custkey").alias("id"), *_point(F.col("c_custkey"), 104729, F.col("c_acctbal")))


_SUPPLIERS, _CUSTOMERS = f"SELECT s_suppkey AS id, {_point_sql('s_suppkey', 7919, 's_acctbal')} FROM supplier", f"SELECT c_custkey AS id, {_point_sql('c_custkey', 104729, 'c_acctbal')} FROM customer"


def radius_pairs(spark, sf_dir):
    """Customers within 1.5 km of each supplier."""
    s, c = _points(spark, sf_dir)
    return lookups.within(s, c, 1500.0).select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("c_custkey"), (F.floor(F.col("metres") * 1000 + 0.5) / 1000).alias("metres"))


RADIUS_PAIRS = f"""
WITH s AS ({_SUPPLIERS}), c AS ({_CUSTOMERS}),
p AS (SELECT s.id AS s_suppkey, c.id AS c_custkey, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lng - s.lng) / 2), 2)))) AS m FROM s, c)
SELECT s_suppkey, c_custkey, round(m, 3) AS metres FROM p WHERE m <= 1500
"""


def geo_grid(spark, sf_dir):
    """Customers per cell of a spiral search grid of 5 km around a town, by the number of the cell."""
    _, c = _points(spark, sf_dir)
    return c.select(lookups.spiral_cell(F.col("lat"), F.col("lng"), 48.1, -1.7, 5000.0).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


GEO_GRID = f"""
WITH g AS (SELECT x, y, greatest(abs(x), abs(y)) AS r FROM range(-8, 9) a(x), range(-8, 9) b(y)),
o AS (SELECT *, row_number() OVER (ORDER BY r, CASE WHEN abs(y) = r THEN 0 ELSE 1 END, CASE WHEN abs(y) = r THEN x ELSE y END, CASE WHEN abs(y) = r THEN -sign(y) ELSE -sign(x) END) - 1 AS cell FROM g),
c AS ({_CUSTOMERS}),
q AS (SELECT floor((lng - -1.7::DOUBLE) * 111320.0::DOUBLE * greatest(0.01::DOUBLE, cos(radians(48.1::DOUBLE))) / 5000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS x, floor((lat - 48.1::DOUBLE) * 111320.0::DOUBLE / 5000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS y FROM c)
SELECT cell, count(*) AS n FROM q JOIN o USING (x, y) GROUP BY cell
"""

_START = "2024-01-01 00:00:00"


def cached_pages(spark, sf_dir):
    """Each event asks for a cached page of its key: the newest landed before it, if that is not older than seven days."""
    p, e = load(spark, sf_dir, "pages"), load(spark, sf_dir, "events")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.col("page_id") * 7919, F.lit(2592000)))
    v = p.select(F.pmod("page_id", F.lit(97)).alias("key"), (F.lit(_START).cast("timestamp_ntz") + seconds).cast("timestamp").alias("ts"), F.col("page_id").alias("version"))
    r = e.select("event_id", F.when(F.col("event_type") == "view", F.lit(1)).otherwise(F.pmod("user_id", F.lit(97))).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return lookups.newest_within(r, v, "key", "ts", 7 * 86400).select("event_id", "key", "version", F.col("version_ts").cast("timestamp_ntz").alias("version_ts"))


CACHED_PAGES = f"""
WITH v AS (SELECT page_id % 97 AS key, TIMESTAMP '{_START}' + to_seconds(page_id * 7919 % 2592000) AS vts, max(page_id) AS version FROM pages GROUP BY ALL),
r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE user_id % 97 END AS key, ts FROM events)
SELECT event_id, r.key, CASE WHEN vts >= ts - INTERVAL 7 DAY THEN version END AS version, CASE WHEN vts >= ts - INTERVAL 7 DAY THEN vts END AS version_ts FROM r ASOF LEFT JOIN v ON r.key = v.key AND r.ts >= v.vts
"""


def hot_account(spark, sf_dir):
    """Nine of ten events belong to one account: its events in 24 hours, and its running amount while within a quota."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 10 != 0, 0).otherwise(F.col("user_id")).alias("account"), F.col("value").cast("decimal(18,2)").alias("amount"))
    r = selection.rolling_count(e, ["account"])
    used = selection.running_quota(r, ["account"], [F.col("ts"), F.col("event_id")], F.col("amount"), F.lit(200000), hot=True)
    return used.select("event_id", "account", "n_window", F.col("used").cast("double").alias("used"))


HOT_ACCOUNT = """
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 10 <> 0 THEN 0 ELSE user_id END AS account, value::DECIMAL(18,2) AS amount FROM events),
w AS (SELECT event_id, account, count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_window, sum(amount) OVER (PARTITION BY account ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM e)
SELECT event_id, account, n_window, used::DOUBLE AS used FROM w WHERE used <= 200000
"""


def run_counters(spark, sf_dir):
    """Customers tagged by the first rule they break, written in one pass; the counts are those taken while they passed."""
    c = load(spark, sf_dir, "customer").withColumn("emails", F.when(F.col("c_custkey") % 4 != 0, F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@firm.fr")))))
    tagged, seen = selection.observed(c, {"no_email": selection.has_email(), "in_debt": F.col("c_acctbal") >= 0, "closed": F.col("c_mktsegment") != "MACHINERY"})
    tagged.write.parquet(f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet")
    return spark.createDataFrame([(k, v) for k, v in seen.get.items()], "counter string, n long")


RUN_COUNTERS = """
WITH t AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'n_no_email' WHEN c_acctbal < 0 THEN 'n_in_debt' WHEN c_mktsegment = 'MACHINERY' THEN 'n_closed' ELSE 'n_accepted' END AS counter FROM customer),
k AS (SELECT unnest(['n_no_email', 'n_in_debt', 'n_closed', 'n_accepted']) AS counter)
SELECT counter, (SELECT count(*) FROM t WHERE t.counter = k.counter) AS n FROM k UNION ALL SELECT 'n', (SELECT count(*) FROM customer)
"""

_PAIRS = (
    (domain_list, DOMAIN_LIST), (phrase_hits, PHRASE_HITS), (radius_pairs, RADIUS_PAIRS), (geo_grid, GEO_GRID), (cached_pages, CACHED_PAGES), (hot_account, HOT_ACCOUNT), (run_counters, RUN_COUNTERS))
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
