"""Queries of resolution, selection, quota, routing, matching and output operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import classify, contact, dims, text
from sieveline.operators import entities, matching, selection
from sieveline.plans import oracle as o
from sieveline.session import load
from sieveline.sources import files, sinks
from sieveline.streaming import events as stream


def dimension_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' country label, else their region's, else the raw code: some nations are left out on purpose."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    reg = c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey, "left")
    levels = [n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), r.where("r_regionkey <> 2").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))]
    out = matching.label(reg, F.col("c_nationkey").cast("string"), levels, [F.col("c_nationkey"), F.col("n_regionkey")])
    return out.groupBy("label").agg(F.count("*").alias("n"))


DIMENSION_LABEL = """
SELECT coalesce(a.n_name, b.r_name, c.c_nationkey::VARCHAR) AS label, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) a ON a.n_nationkey = c.c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) b ON b.r_regionkey = n.n_regionkey GROUP BY 1
"""

#: part types as trades: an ordered rule list of the same shape as the trade classifier
PART_RULES = (("plated", ("PLATED",)), ("metal", ("BRASS", "COPPER", "STEEL")), ("economy", ("ECONOMY", "PROMO")), ("tin", ("TIN",)))


def rule_classifier(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return p.select("p_partkey", classify.first_rule(F.upper("p_type"), PART_RULES, "other").alias("category"), classify.trade_category(F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in _TRADES]), (F.col("p_partkey") % len(_TRADES) + 1).cast("int")), "p_name")).alias("trade"))


_TRADES = ("Plombier chauffagiste", "Avocat à la cour", "Fleuriste", "Ostéopathe", "Architecte d’intérieur", "Expert-comptable", "Métier inconnu", "Bœuf : boucherie", "Électricien", "DJ mariage", "", "BOULANGERIE-PÂTISSERIE", "Ébéniste & menuisier", "体育", "Coach sportif", "Agent immobilier", "Food-truck à burgers", "Pompe à chaleur", "Courtier en assurance", "Toilettage canin", "Garage auto")
_rules = lambda c, rules, default: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{'|'.join(s).replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, s in rules) + f" ELSE '{default}' END"
RULE_CLASSIFIER = f"""
WITH t AS (SELECT p_partkey, p_type, replace(strip_accents(replace(lower(list_extract([{o.names(_TRADES)}], (p_partkey % {len(_TRADES)} + 1)::INTEGER) || ' ' || p_name), 'œ', 'oe')), '’', '''') AS s FROM part)
SELECT p_partkey, {_rules('upper(p_type)', PART_RULES, 'other')} AS category, {_rules('s', dims.TRADE_RULES, '')} AS trade FROM t
"""


def entity_components(spark, sf_dir):
    """Customers that share a key, directly or through others: chains of keys across the whole table."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    keys = F.array(F.concat_ws(":", F.lit("a"), F.floor(k / 8).cast("string")), F.when(k % 7 == 0, F.concat_ws(":", F.lit("b"), F.floor(k / 14).cast("string"))))
    return entities.resolve(c.select("c_custkey", F.array_compact(keys).alias("keys")), "c_custkey", "keys").select(F.col("id"), "component")


ENTITY_COMPONENTS = """
WITH RECURSIVE k AS (SELECT c_custkey AS id, 'a:' || (c_custkey // 8) AS key FROM customer UNION ALL SELECT c_custkey, 'b:' || (c_custkey // 14) FROM customer WHERE c_custkey % 7 = 0),
m AS (SELECT key, min(id) AS low FROM k GROUP BY key), e AS (SELECT id AS x, low AS y FROM k JOIN m USING (key) UNION SELECT low, id FROM k JOIN m USING (key)),
r(id, reach) AS (SELECT DISTINCT id, id FROM k UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT id, min(reach) AS component FROM r GROUP BY id
"""


def entity_merge(spark, sf_dir):
    """Orders as records of their customer: first values, maxima and lists merged per customer."""
    x = load(spark, sf_dir, "orders")
    rows = x.select(
        F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).alias("name"),
        F.floor(F.col("o_totalprice") / 1000).alias("score"), F.col("o_orderpriority").alias("score_label"), F.col("o_orderdate").alias("last_contact_at"),
        F.element_at(F.array(*[F.lit(s) for s in ("new", "qualified", "contacted", "replied", "won", "unsubscribed")]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"), F.array(F.lower(F.substring("o_orderpriority", 3, 20))).alias("tags"))
    m = entities.merge(rows)
    return m.select("component", "n_rows", "name", "score", "score_label", "last_contact_at", "status", F.array_join("tags", ",").alias("tags"))


ENTITY_MERGE = """
WITH r AS (SELECT o_custkey AS component, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'n' || o_orderkey END AS name, floor(o_totalprice / 1000)::BIGINT AS score, o_orderpriority AS l, o_orderdate AS d,
  list_extract(['new','qualified','contacted','replied','won','unsubscribed'], (o_orderkey % 6 + 1)::INTEGER) AS s, lower(substr(o_orderpriority, 3, 20)) AS tag FROM orders),
k AS (SELECT *, CASE s WHEN 'unsubscribed' THEN 101 WHEN 'new' THEN 0 WHEN 'qualified' THEN 1 WHEN 'contacted' THEN 2 WHEN 'replied' THEN 3 ELSE 4 END AS rk FROM r),
g AS (SELECT component, count(*) AS n_rows, arg_min(name, seq) FILTER (name IS NOT NULL) AS name, max(score) AS score, max(d) AS last_contact_at, max(rk) AS rk FROM k GROUP BY component),
b AS (SELECT component, l AS score_label FROM k QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, seq) = 1),
t AS (SELECT component, string_agg(tag, ',' ORDER BY seq) AS tags FROM (SELECT component, tag, min(seq) AS seq FROM k GROUP BY ALL) GROUP BY component)
SELECT g.component, n_rows, name, score, score_label, last_contact_at, CASE rk WHEN 101 THEN 'unsubscribed' WHEN 0 THEN 'new' WHEN 1 THEN 'qualified' WHEN 2 THEN 'contacted' WHEN 3 THEN 'replied' ELSE 'won' END AS status, tags
FROM g JOIN b USING (component) JOIN t USING (component)
"""


def anti_known(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return selection.anti_known(c, load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


ANTI_KNOWN = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1"


def eligible_first_contact(spark, sf_dir):
    c, x = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    e = c.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 4 != 0, F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@firm.fr")))).otherwise(F.array(F.lit(" "))).alias("emails"), F.when(F.col("c_acctbal") > 0, "new").otherwise("lost").alias("status"))
    sent = x.where("o_orderstatus = 'F' and o_totalprice > 100000").select(F.col("o_custkey").alias("entity_id"))
    drafts = x.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_custkey").alias("entity_id"))
    return selection.eligible(e, sent, drafts).select("entity_id", "status")


ELIGIBLE = """
SELECT c_custkey AS entity_id, 'new' AS status FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal > 0
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND ((o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND o_totalprice > 300000)))
"""


def followup_due(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.when(F.col("event_id") % 29 == 0, "email_sent").otherwise("other").alias("kind"), "ts", F.when(F.col("event_id") % 58 == 0, "pro_relance_j5").otherwise("pro").alias("template_key"))
    return selection.followup_due(e, F.lit("2024-02-02 00:00:00").cast("timestamp"), 5)


FOLLOWUP_DUE = """
SELECT user_id AS entity_id, max(ts) AS last_sent FROM events WHERE event_id % 29 = 0 GROUP BY user_id
HAVING NOT bool_or(event_id % 58 = 0) AND max(ts) < TIMESTAMP '2024-02-02 00:00:00' - INTERVAL 5 DAY
"""


def reply_match(spark, sf_dir):
    """Conversation turns as replies to sent events: by message id, else by address."""
    conv, ev = load(spark, sf_dir, "conversations"), load(spark, sf_dir, "events")
    sent = ev.select(F.col("user_id").alias("entity_id"), F.concat(F.lit("<m"), F.col("event_id").cast("string"), F.lit("@x>")).alias("message_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.fr")).alias("to_addr"))
    uid = F.col("conv_id") * 1000 + F.col("turn")
    reply = conv.select(uid.alias("uid"), F.concat(F.lit("A <U"), (F.col("conv_id") % 300).cast("string"), F.lit("@mail.fr>")).alias("from_addr"), F.when(F.col("turn") == 0, F.concat(F.lit("<m"), (F.col("conv_id") * 7).cast("string"), F.lit("@x>"))).otherwise("").alias("in_reply_to"))
    return matching.match_replies(reply, sent)


REPLY_MATCH = """
WITH s AS (SELECT user_id, 'm' || event_id || '@x' AS mid FROM events), i AS (SELECT mid, min(user_id) AS e1 FROM s GROUP BY mid), u AS (SELECT DISTINCT user_id FROM events),
r AS (SELECT conv_id * 1000 + turn AS uid, conv_id % 300 AS a, CASE WHEN turn = 0 THEN 'm' || conv_id * 7 || '@x' ELSE '' END AS mid FROM conversations)
SELECT uid, coalesce(e1, user_id) AS entity_id, CASE WHEN e1 IS NOT NULL THEN 'message_id' WHEN user_id IS NOT NULL THEN 'address' ELSE 'none' END AS matched_by
FROM r LEFT JOIN i USING (mid) LEFT JOIN u ON u.user_id = r.a
"""


def evidence_verdict(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    z = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ev = s.select(
        "s_suppkey", F.when(k % 5 != 0, z(k, 9)).otherwise("").alias("siren"), F.when(k % 3 != 0, z(k * 97 % 100000, 5)).otherwise("").alias("postal"), F.concat(F.lit("Firm "), k.cast("string")).alias("name"),
        F.concat(F.lit("https://www.firm"), k.cast("string"), F.lit(".fr/")).alias("url"), F.when(k % 4 == 1, F.array(F.concat(F.lit("info@firm"), k.cast("string"), F.lit(".fr")))).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(k % 7 == 1, F.array(z(k, 9))).when(k % 7 == 2, F.array(F.lit("999999999"))).otherwise(F.array().cast("array<string>")).alias("ids"), F.when(k % 7 == 3, F.array(F.concat(z(k, 9), F.lit("00012")))).otherwise(F.array().cast("array<string>")).alias("sites"),
        F.when(k % 2 == 0, F.array(z(k * 97 % 100000, 5))).otherwise(F.array(z(k * 89 % 100000, 5))).alias("codes"))
    v = matching.verdict(*[F.col(c) for c in ("siren", "postal", "name", "url", "emails", "ids", "sites", "codes")])
    return ev.select("s_suppkey", v.alias("verdict"))


EVIDENCE_VERDICT = """
WITH v AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN lpad(s_suppkey::VARCHAR, 9, '0') ELSE '' END AS siren, CASE WHEN s_suppkey % 3 <> 0 THEN lpad((s_suppkey * 97 % 100000)::VARCHAR, 5, '0') ELSE '' END AS postal,
  CASE WHEN s_suppkey % 2 = 0 THEN lpad((s_suppkey * 97 % 100000)::VARCHAR, 5, '0') ELSE lpad((s_suppkey * 89 % 100000)::VARCHAR, 5, '0') END AS code FROM supplier)
SELECT k AS s_suppkey, CASE WHEN siren = '' AND postal = '' THEN 'low' WHEN siren <> '' AND k % 7 = 1 THEN 'high' WHEN siren <> '' AND k % 7 = 3 THEN 'high' WHEN siren <> '' AND k % 7 = 2 THEN 'reject'
  WHEN k % 4 = 1 THEN 'high' WHEN postal = '' THEN 'low' WHEN code = postal THEN 'ok' WHEN substr(code, 1, 2) = substr(postal, 1, 2) THEN 'low' ELSE 'reject' END AS verdict FROM v
"""


def status_rank_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    s = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    r = e.select("user_id", "event_id", F.coalesce(s, F.lit("new")).alias("s"))
    return r.groupBy("user_id").agg(F.max_by("s", F.struct(classify.status_rank(F.col("s")), -F.col("event_id"))).alias("status"), F.count("*").alias("n"))


_STATUS = {"view": "qualified", "click": "contacted", "purchase": "won", "signup": "replied", "error": "bounced"}
_rank = "CASE s WHEN 'unsubscribed' THEN 101 WHEN 'bounced' THEN 100 WHEN 'new' THEN 0 WHEN 'qualified' THEN 1 WHEN 'contacted' THEN 2 WHEN 'replied' THEN 3 WHEN 'won' THEN 4 END"
STATUS_RANK = f"""
WITH r AS (SELECT user_id, event_id, coalesce({o.case_map('event_type', {k: "'" + v + "'" for k, v in _STATUS.items()}, 'NULL')}, 'new') AS s FROM events)
SELECT user_id, arg_max(s, {_rank}) AS status, count(*) AS n FROM r GROUP BY user_id
"""


def rolling_24h(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return selection.rolling_count(e, ["user_id"]).select("event_id", "n_window")


ROLLING_24H = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_window FROM events"


def daily_cap(spark, sf_dir):
    """The first 3 events of each user and day."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return selection.capped(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")], F.lit(3)).select("event_id", "user_id", "day", "slot")


DAILY_CAP = "SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS slot FROM events QUALIFY slot <= 3"


def running_quota(spark, sf_dir):
    x = load(spark, sf_dir, "orders")
    return selection.running_quota(x.select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("amount")), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("amount"), F.lit(400000)).select("o_orderkey", F.col("used").cast("double").alias("used"))


RUNNING_QUOTA = "SELECT o_orderkey, used::DOUBLE AS used FROM (SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 400000"


def pool_cap(spark, sf_dir):
    """Messages per sender account within what its cap leaves."""
    c = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("account"))
    a = c.select("account").distinct().withColumn("left_", F.col("account") * 10 + 2)
    return selection.capped(c.join(a, "account"), ["account"], [F.col("c_custkey")], F.col("left_")).select("c_custkey", "account", "slot")


POOL_CAP = "SELECT c_custkey, c_custkey % 5 AS account, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey)::INTEGER AS slot FROM customer QUALIFY slot <= (c_custkey % 5) * 10 + 2"


def round_robin(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = selection.numbered(c, [F.col("c_name"), F.col("c_custkey")])
    return n.select("c_custkey", (F.col("rank") % 7).alias("slot"))


ROUND_ROBIN = "SELECT c_custkey, (row_number() OVER (ORDER BY c_name, c_custkey) - 1) % 7 AS slot FROM customer"


def stable_bucket(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", selection.stable_bucket(F.col("c_custkey"), 11).alias("bucket"))


STABLE_BUCKET = "SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 11 AS bucket FROM customer"


def seeded_page(spark, sf_dir):
    return selection.seeded_page(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 42, 9, 7)


SEEDED_PAGE = """
WITH r AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY md5(s_suppkey || '|42'), s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, s_name FROM r WHERE (k - 9 % n + n) % n < 7
"""


def sender_routing(spark, sf_dir):
    """Customers' messages to the accounts of the domain that their template names: some domains have no account, some no quota."""
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    m = c.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit("team@d"), (F.col("c_custkey") % 30).cast("string"), F.lit(".fr"))).when(F.col("c_custkey") % 12 == 0, "").alias("template_from"))
    a = s.select(F.concat(F.lit("acc"), F.col("s_suppkey").cast("string")).alias("account_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@D"), (F.col("s_suppkey") % 20).cast("string"), F.lit(".fr")).alias("from_email"), F.when(F.col("s_suppkey") % 20 == 3, 0).otherwise(F.col("s_suppkey") % 3).alias("remaining"))
    return selection.route(m, a)


SENDER_ROUTING = """
WITH a AS (SELECT 'acc' || s_suppkey AS id, 'd' || (s_suppkey % 20) || '.fr' AS d, CASE WHEN s_suppkey % 20 = 3 THEN 0 ELSE s_suppkey % 3 END AS left_ FROM supplier),
g AS (SELECT d, list(id ORDER BY id) FILTER (left_ > 0) AS free, min(id) AS first_ FROM a GROUP BY d),
m AS (SELECT c_custkey AS e, CASE WHEN c_custkey % 6 <> 0 THEN 'team@d' || (c_custkey % 30) || '.fr' WHEN c_custkey % 12 = 0 THEN '' END AS f, CASE WHEN c_custkey % 6 <> 0 THEN 'd' || (c_custkey % 30) || '.fr' END AS d FROM customer)
SELECT e AS entity_id, f AS template_from, CASE WHEN coalesce(f, '') = '' THEN 'none' WHEN first_ IS NULL THEN 'missing' WHEN free IS NULL THEN 'cap' ELSE 'ok' END AS state,
  CASE WHEN coalesce(f, '') = '' OR first_ IS NULL THEN NULL WHEN free IS NULL THEN first_ ELSE free[('0x' || substr(md5(e::VARCHAR), 1, 8))::BIGINT % len(free) + 1] END AS account_id
FROM m LEFT JOIN g USING (d)
"""


def render_outbox(spark, sf_dir):
    """Rendered messages; those with a placeholder left or a refusal are held back."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    t = F.when(F.col("c_custkey") % 10 == 0, "Bonjour {name}, {unknown} à {city}").otherwise("Bonjour {name} de {city} : {balance}")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    body = text.render(t, {"name": F.initcap(F.lower("c_name")), "city": F.initcap(F.lower("n_name")), "balance": F.floor("c_acctbal")})
    r = j.select("c_custkey", body.alias("body"))
    return r.select("c_custkey", "body", text.unfilled_placeholder(F.col("body")).alias("unfilled")).withColumn("state", F.when((F.col("unfilled") != "") | text.looks_like_refusal(F.col("body")), "held").otherwise("ready"))


RENDER_OUTBOX = """
WITH j AS (SELECT c_custkey, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS city, floor(c_acctbal)::BIGINT AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Bonjour ' || name || ', {unknown} à ' || city ELSE 'Bonjour ' || name || ' de ' || city || ' : ' || b END AS body FROM j)
SELECT c_custkey, body, CASE WHEN c_custkey % 10 = 0 THEN '{unknown}' ELSE '' END AS unfilled, CASE WHEN c_custkey % 10 = 0 THEN 'held' ELSE 'ready' END AS state FROM r
"""


def event_extra_map(spark, sf_dir):
    """Event properties as a map: known fields keep columns, the rest stays in ``extra``, flattened again."""
    e = load(spark, sf_dir, "events")
    payload = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("subject"), F.concat(F.lit("s"), F.col("user_id").cast("string"))))
    r = e.select("event_id", *sinks.event_row(payload))
    flat = sinks.flatten_event(F.create_map(F.lit("kind"), F.col("kind")), F.col("extra"))
    return r.select("event_id", "kind", "subject", F.coalesce(F.try_element_at("extra", F.lit("k")), F.lit("")).alias("k"), F.size("extra").alias("n_extra"), F.size(flat).alias("n_flat"))


EVENT_EXTRA = """
SELECT event_id, event_type AS kind, 's' || user_id AS subject, coalesce(json_extract_string(props, '$.k'), '') AS k, len(json_keys(props))::INTEGER AS n_extra, len(json_keys(props))::INTEGER + 1 AS n_flat FROM events
"""


def import_mapping(spark, sf_dir):
    """Customers as an imported sheet: headers are mapped, cells split and cleaned."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    sheet = c.select(F.col("c_name").alias("Raison Sociale"), F.concat_ws(" ; ", F.concat(F.lit("Contact@Firm"), k, F.lit(".fr")), F.concat(F.lit("marie@firm"), k, F.lit(".fr"))).alias("E-mail"), F.concat(F.lit("06"), F.lpad(k, 8, "0")).alias("Téléphone"), F.col("c_mktsegment").alias("Secteur d'activité"))
    r = files.import_mapped(sheet, files.suggest_mapping(sheet.columns))
    return sinks.export_rows(r.withColumn("sources", F.array("source"))).select("legal_name", "email", "phone", "industry", "sources")


IMPORT_MAPPING = """
SELECT c_name AS legal_name, 'marie@firm' || c_custkey || '.fr' AS email, '+336' || lpad(c_custkey::VARCHAR, 8, '0') AS phone, c_mktsegment AS industry, 'file' AS sources FROM customer
"""


def review_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"score": '), (F.col("user_id") % 15).cast("string"), F.lit(', "comment": "a } b", "modif_type": "Transition allégée"}\n```'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Voici : {"verdict": "OK", "score": '), (F.col("user_id") % 9).cast("string"), F.lit("}"))).otherwise("rien")
    r = e.select("event_id", text.parse_review(raw).alias("r"))
    return r.select("event_id", "r.score", "r.verdict", "r.comment", "r.edit")


REVIEW_PARSE = """
SELECT event_id, (CASE event_id % 3 WHEN 0 THEN least(10, user_id % 15) WHEN 1 THEN user_id % 9 ELSE 0 END)::INTEGER AS score,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 15 >= 7 THEN 'ok' ELSE 'draft' END WHEN 1 THEN 'ok' ELSE 'draft' END AS verdict,
  CASE WHEN event_id % 3 = 0 THEN 'a } b' ELSE '' END AS comment, CASE WHEN event_id % 3 = 0 THEN 'fluidité' ELSE '' END AS edit FROM events
"""


def answer_fallback(spark, sf_dir):
    """The first successful answer by provider rank: line items as attempts of an order."""
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("provider"), F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("answer"), (F.col("l_quantity") > 25).alias("ok"))
    return matching.first_answer(l.groupBy("k", "rank").agg(F.min(F.struct("provider", "answer", "ok")).alias("s")).select("k", "rank", "s.*"), "k")


ANSWER_FALLBACK = """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS rank, min({'a': 'p' || l_suppkey, 'b': 'a' || l_partkey, 'c': l_quantity > 25}) AS s FROM lineitem GROUP BY ALL)
SELECT k, arg_min(s.b, rank) FILTER (s.c) AS answer, arg_min(s.a, rank) FILTER (s.c) AS provider, count(*) FILTER (NOT s.c) AS n_failed FROM r GROUP BY k
"""


def nested_children(spark, sf_dir):
    """Customers with their orders nested in date order, reported flat."""
    c, x = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders")
    n = matching.nest(c, x.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus"), "c_custkey", ["o_orderdate", "o_orderkey"], "history")
    return n.select("c_custkey", F.size("history").alias("n"), F.array_join(F.transform(F.slice("history", 1, 3), lambda h: h["o_orderkey"].cast("string")), ",").alias("first3"))


NESTED_CHILDREN = """
SELECT c_custkey, count(o_orderkey)::INTEGER AS n, coalesce(array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderdate, o_orderkey) FILTER (o_orderkey IS NOT NULL)[1:3], ','), '') AS first3 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
"""


def upsert_counts(spark, sf_dir):
    """Customers put under orders' keys: orders still pending name entities that are not known yet."""
    x = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("k"))
    return sinks.upsert_counts(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), x, "k")


UPSERT_COUNTS = """
WITH n AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_custkey END AS k FROM orders), h AS (SELECT c_custkey AS k FROM customer)
SELECT count(*) FILTER (h.k IS NULL) AS created, count(*) FILTER (h.k IS NOT NULL) AS merged, (SELECT count(*) FROM h) + count(*) FILTER (h.k IS NULL) AS total FROM n LEFT JOIN h USING (k)
"""


def send_window(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy(classify.send_window(F.col("ts"), 9, 18).alias("office"), classify.send_window(F.col("ts"), 22, 6).alias("night")).agg(F.count("*").alias("n"))


SEND_WINDOW = """
WITH h AS (SELECT hour((ts::TIMESTAMP + INTERVAL 1 HOUR)) AS h FROM events)
SELECT h >= 9 AND h < 18 AS office, h >= 22 OR h < 6 AS night, count(*) AS n FROM h GROUP BY ALL
"""


def _events(spark, sf_dir):
    # a pattern, as the table may be one file and a stream reads folders or patterns
    return stream.read_events(spark, f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *cols):
    """Times as the tables have them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


#: what is final in a stream that has read all events: watermarks trail the latest one by a day
_FINAL = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"


def stream_sessions(spark, sf_dir):
    """Sessions of each user by a streaming query over the landed events; those the watermark has closed."""
    return _plain(stream.land(stream.sessions(_events(spark, sf_dir), "user_id", "2 hours")), "start", "end")


STREAM_SESSIONS = f"""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= {_FINAL}
"""


def stream_windows(spark, sf_dir):
    """Daily counts by a streaming query over the landed events; the days the watermark has closed."""
    return _plain(stream.land(stream.windowed(_events(spark, sf_dir), ["event_type"], "1 day")), "start", "end").select("event_type", "start", "end", "n", F.round("total", 4).alias("total"))


STREAM_WINDOWS = f"""
WITH d AS (SELECT event_type, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM d WHERE "end" <= {_FINAL}
"""


def stream_dedupe(spark, sf_dir):
    """Events that arrive twice, counted once, by a streaming query."""
    e = _events(spark, sf_dir)
    return stream.land(stream.dedupe(e.unionByName(_events(spark, sf_dir).where("event_type <> 'view'")))).groupBy("event_type").agg(F.count("*").alias("n"))


STREAM_DEDUPE = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


def stream_status(spark, sf_dir):
    """The status of each user after all landed events, as a streaming query keeps it: the highest rank wins."""
    s = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    e = _events(spark, sf_dir).select("user_id", F.coalesce(s, F.lit("new")).alias("status"))
    return stream.latest(stream.status_machine(e, key="user_id"), "user_id")


STREAM_STATUS = f"""
WITH r AS (SELECT user_id, coalesce({o.case_map('event_type', {k: "'" + v + "'" for k, v in _STATUS.items()}, 'NULL')}, 'new') AS s FROM events)
SELECT user_id, arg_max(s, {_rank}) AS status FROM r GROUP BY user_id
"""


def guessed_first(spark, sf_dir):
    """Sending order: confirmed addresses before guessed ones, then redo tags, then key; the first 100."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    e = F.when(k % 3 == 0, F.concat(F.lit("contact@f"), k.cast("string"), F.lit(".fr"))).otherwise(F.concat(F.lit("anna@f"), k.cast("string"), F.lit(".fr")))
    r = c.select("c_custkey", contact.is_guessed(e, F.when(k % 5 == 0, "guess").otherwise("web")).alias("guessed"), F.when(k % 4 == 0, F.array(F.lit("redo"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return r.orderBy(*selection.send_order(F.col("guessed"), F.col("tags"), k)).limit(100).select("c_custkey", "guessed")


GUESSED_FIRST = "SELECT c_custkey, (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS guessed FROM customer ORDER BY guessed::INTEGER, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END, c_custkey LIMIT 100"

_PAIRS = (
    (dimension_label, DIMENSION_LABEL), (rule_classifier, RULE_CLASSIFIER), (entity_components, ENTITY_COMPONENTS), (entity_merge, ENTITY_MERGE), (anti_known, ANTI_KNOWN), (eligible_first_contact, ELIGIBLE), (followup_due, FOLLOWUP_DUE), (reply_match, REPLY_MATCH),
    (evidence_verdict, EVIDENCE_VERDICT), (status_rank_merge, STATUS_RANK), (rolling_24h, ROLLING_24H), (daily_cap, DAILY_CAP), (running_quota, RUNNING_QUOTA), (pool_cap, POOL_CAP), (round_robin, ROUND_ROBIN), (stable_bucket, STABLE_BUCKET), (seeded_page, SEEDED_PAGE),
    (sender_routing, SENDER_ROUTING), (render_outbox, RENDER_OUTBOX), (event_extra_map, EVENT_EXTRA), (import_mapping, IMPORT_MAPPING), (review_parse, REVIEW_PARSE), (answer_fallback, ANSWER_FALLBACK), (nested_children, NESTED_CHILDREN), (upsert_counts, UPSERT_COUNTS),
    (send_window, SEND_WINDOW), (stream_sessions, STREAM_SESSIONS), (stream_windows, STREAM_WINDOWS), (stream_dedupe, STREAM_DEDUPE), (stream_status, STREAM_STATUS), (guessed_first, GUESSED_FIRST),
)
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
