"""Queries of records, templates, sites, cursors and landed sources over the star schema.

Where an operator works on written-out texts, a list of cases is dealt over a whole table by its key;
the SQL then names the result of each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import classify, contact, text
from sieveline.operators import entities, records, sites, templates
from sieveline.plans import oracle as o
from sieveline.plans.text_queries import RAW_EMAILS, page_text
from sieveline.session import load
from sieveline.sources import profiles, sinks
from sieveline.streaming import cursors


def _lit(v) -> Column:
    return F.lit(v) if v is not None else F.lit(None).cast("string")


def _case(key: str, values) -> Column:
    return F.element_at(F.array(*[_lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else ("true" if v else "false") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _case_sql(key: str, values) -> str:
    return f"list_extract([{', '.join(map(_sql, values))}], ({key} % {len(values)} + 1)::INTEGER)"


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' JSON records as entities, as table rows, and back: unknown fields, absent ones, old provenance, malformed text."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    good = F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('", "emails": ["C'), k, F.lit('@firm.fr"], "emails_meta": [{"email": "c@firm.fr", "source": "WEB"}, {"source": "x"}], "siren": "'), k, F.lit('", "website": "https://www.firm'), k,
                    F.lit('.fr/?a=1", "odd": 1, "status": "'), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("contacted"), F.lit('", "last_contact_at": "2024-01-0'), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit('T10:00:00"}'))
    r = c.select("c_custkey", records.from_json_record(F.when(F.col("c_custkey") % 5 == 0, F.lit("no json")).otherwise(good)).alias("e")).where("e is not null").select("c_custkey", "e.*")
    rows = records.to_rows(r)
    back = records.from_rows(rows).select(F.col("c_custkey").alias("k"), F.col("last_contact_at").alias("iso"))
    return rows.join(back, F.col("c_custkey") == F.col("k")).select("c_custkey", "name", "status", "score", F.size("emails_meta").alias("n_meta"), F.col("emails_meta")[0]["source"].alias("origin"), F.array_join("match_keys", " ").alias("keys"), "iso")


RECORD_ROWS = """
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'contacted' END AS status, 0 AS score, 1 AS n_meta, 'web' AS origin,
  'email:c' || c_custkey || '@firm.fr siren:' || c_custkey || ' web:firm' || c_custkey || '.fr' AS keys, '2024-01-0' || (c_custkey % 9 + 1) || 'T10:00:00' AS iso FROM customer WHERE c_custkey % 5 <> 0
"""


def gained_contacts(spark, sf_dir):
    """What a site visit adds to a record: new addresses with provenance, capped lists, an address only where none was."""
    # a row's work is large beside its bytes: keys are dealt out, however few files they come from
    c = load(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    k = F.col("c_custkey")
    s = k.cast("string")
    own = F.concat(F.lit("a"), s, F.lit("@firm.fr"))
    entry = F.struct(own.alias("email"), F.when(k % 2 == 0, "file").otherwise("").alias("source"), *[F.lit("").alias(f) for f in ("source_id", "url", "context", "found_at")])
    many = F.transform(F.sequence(F.lit(1), (k % 12).cast("int") + 1), lambda i: F.concat(F.lit("m"), i.cast("string"), F.lit("@firm.fr")))
    e = c.select(
        "c_custkey", F.array(own).alias("emails"), F.array(entry).alias("emails_meta"), F.array(F.lit("+33612345678")).alias("phones"), F.when(k % 3 == 0, "1 rue A").otherwise("").alias("address"), (k % 4 == 0).alias("has_legal_mentions"),
        F.concat(F.array(F.upper(own)), F.when(k % 5 != 0, many).otherwise(F.array().cast("array<string>"))).alias("found_emails"), F.array(F.lit("+33612345678"), F.lit("+33700000000")).alias("found_phones"), F.lit("2 rue B").alias("found_address"), (k % 6 == 0).alias("found_legal"),
        F.lit("https://firm.fr").alias("visit_url"), F.lit("web").alias("visit_source"), F.lit("contact").alias("visit_context"))
    v = records.visited(e)
    return v.select("c_custkey", F.size("emails").alias("n_emails"), "n_gained", F.array_join("emails", ",").alias("emails"), F.array_join(F.transform("emails_meta", lambda m: F.concat_ws("/", m["email"], m["source"], m["context"])), ",").alias("meta"),
                    records.email_origin(F.col("emails_meta"), F.upper(own))["source"].alias("origin"), F.array_join("phones", ",").alias("phones"), "address", F.col("has_legal_mentions").alias("legal"))


GAINED_CONTACTS = """
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 12 + 1)::INTEGER ELSE 0 END AS g, 'a' || c_custkey || '@firm.fr' AS own, CASE WHEN c_custkey % 2 = 0 THEN 'file' ELSE '' END AS src FROM customer),
l AS (SELECT *, list_transform(range(1, least(g, 7) + 1), lambda i: 'm' || i || '@firm.fr') AS more FROM m)
SELECT c_custkey, (1 + len(more))::INTEGER AS n_emails, g AS n_gained, array_to_string([own] || more, ',') AS emails,
  array_to_string([own || '/' || src || '/'] || list_transform(more, lambda e: e || '/web/contact'), ',') AS meta, src AS origin, '+33612345678,+33700000000' AS phones,
  CASE WHEN c_custkey % 3 = 0 THEN '1 rue A' ELSE '2 rue B' END AS address, c_custkey % 4 = 0 OR c_custkey % 6 = 0 AS legal FROM l
"""


def site_outcome(spark, sf_dir):
    """Website, other URLs and tags after a verdict on a site that was given or guessed."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    e = c.select("c_custkey", F.when(k % 2 == 0, "https://old.fr").otherwise("").alias("website"), none.alias("other_urls"), F.lit("https://new.fr").alias("url"), (k % 3 == 0).alias("guessed"), _case("c_custkey", ("high", "ok", "low", "reject")).alias("verdict"),
                 F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("site_unverified"))).when(k % 5 == 1, F.array(F.lit("site_verified"))).otherwise(none).alias("tags"))
    return records.site_outcome(e).select("c_custkey", "website", F.array_join("other_urls", ",").alias("others"), F.array_join("tags", ",").alias("tags"))


SITE_OUTCOME = f"""
WITH v AS (SELECT c_custkey AS k, {_case_sql('c_custkey', ('high', 'ok', 'low', 'reject'))} AS v, c_custkey % 3 = 0 AS g FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 2 = 0 THEN 'https://old.fr' WHEN v = 'reject' OR (g AND v = 'low') THEN '' ELSE 'https://new.fr' END AS website, CASE WHEN k % 2 = 1 AND g AND v = 'low' THEN 'https://new.fr' ELSE '' END AS others,
 CASE k % 5 WHEN 0 THEN CASE v WHEN 'high' THEN 'a,site_verified' WHEN 'ok' THEN 'a,site_unverified,site_postal_match' ELSE 'a,site_unverified' END
  WHEN 1 THEN CASE v WHEN 'ok' THEN 'site_verified,site_postal_match' WHEN 'low' THEN 'site_verified,site_unverified' ELSE 'site_verified' END
  ELSE CASE v WHEN 'high' THEN 'site_verified' WHEN 'ok' THEN 'site_postal_match' WHEN 'low' THEN 'site_unverified' ELSE '' END END AS tags FROM v
"""

_STATES = ("new", "qualified", "contacted", "replied", "won", "lost", "refused", "unsubscribed", "bounced")


def status_guard(spark, sf_dir):
    """A record's status after a reply, after its history turned up, and whether a draft to it may still be approved."""
    x = load(spark, sf_dir, "orders").select("o_orderkey", _case("o_orderkey", _STATES).alias("s"), F.when(F.col("o_orderkey") % 4 == 0, "client").when(F.col("o_orderkey") % 4 == 1, "mail").alias("last"))
    h = records.after_history(F.col("s"), F.lit("old"), F.col("last"), F.when(F.col("o_orderkey") % 8 < 4, "t"))
    return x.select("o_orderkey", records.after_reply(F.col("s")).alias("replied"), records.blocked(F.col("s")).alias("blocked"), h["status"].alias("known"), h["last_contact_at"].alias("at"))


STATUS_GUARD = f"""
WITH x AS (SELECT o_orderkey AS k, {_case_sql('o_orderkey', _STATES)} AS s FROM orders)
SELECT k AS o_orderkey, CASE WHEN s IN ('replied', 'won', 'lost', 'refused') THEN s ELSE 'replied' END AS replied, CASE WHEN s IN ('unsubscribed', 'bounced', 'refused', 'won', 'lost') THEN s END AS blocked,
  CASE k % 4 WHEN 0 THEN 'won' WHEN 1 THEN 'contacted' ELSE s END AS known, CASE WHEN k % 4 <= 1 AND k % 8 < 4 THEN 't' ELSE 'old' END AS at FROM x
"""

_TEMPLATES = (("crea_1", "creator", ""), ("old_2", None, ""), ("pro_commerce_1", "pro", ""), ("pro_artisan_1", "PRO", ""), ("pro_any", "pro", "sites"), ("voix_courtier", "pro", "voix"), ("voix_courtier_deja", "pro", "voix"), ("voix_immo_vide", "pro", "voix"), ("crea_voix_deja", "creator", "voix"))
_MARKS = {"cited": "_deja", "none": "_vide"}
_CATS, _SEGS, _ISSUES = ("commerce", "artisan", "cabinet", ""), ("courtier", "immo", "avocat", ""), ("cited", "none", "rivals", None, "")


def template_choice(spark, sf_dir):
    """The templates open to each customer: by audience, trade, and an offer that never mixes with the others."""
    k = F.col("c_custkey")
    e = load(spark, sf_dir, "customer").select(k.alias("entity_id"), F.when(k % 7 == 0, "creator").otherwise("pro").alias("audience"), _case("c_custkey", _CATS).alias("category"), F.element_at(F.array(*[_lit(s) for s in _SEGS]), (F.floor(k / 4) % 4 + 1).cast("int")).alias("segment"), (k % 3 == 0).alias("has_offer"), _case("c_custkey", _ISSUES).alias("issue"))
    t = spark.createDataFrame(list(_TEMPLATES), "key string, audience string, product string")
    return templates.template_pool(e, t, "voix", _MARKS)


TEMPLATE_CHOICE = f"""
WITH t(key, audience, product) AS (VALUES {', '.join('(' + ', '.join(_sql(v) for v in r) + ')' for r in _TEMPLATES)}), u AS (SELECT key, lower(coalesce(audience, 'creator')) AS a, product FROM t),
e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'creator' ELSE 'pro' END AS a, {_case_sql('c_custkey', _CATS)} AS cat, list_extract([{o.names(_SEGS)}], (c_custkey // 4 % 4 + 1)::INTEGER) AS seg, c_custkey % 3 = 0 AS has, {_case_sql('c_custkey', _ISSUES)} AS issue FROM customer),
j AS (SELECT e.*, key, product, a = 'pro' AND cat <> '' AND contains(key, cat) AS c FROM e JOIN u USING (a)),
n AS (SELECT *, bool_or(c) OVER (PARTITION BY id) AS any_cat FROM j), p AS (SELECT * FROM n WHERE c OR NOT any_cat),
q AS (SELECT *, count(*) FILTER (product = 'voix') OVER (PARTITION BY id) AS n_own, bool_or(product = 'voix' AND seg <> '' AND contains(key, seg)) OVER (PARTITION BY id) AS any_seg FROM p)
SELECT id AS entity_id, key FROM q WHERE CASE WHEN n_own = 0 THEN true WHEN NOT has THEN product <> 'voix'
 ELSE product = 'voix' AND coalesce(issue, '') <> '' AND (NOT any_seg OR contains(key, seg)) AND CASE issue WHEN 'cited' THEN contains(key, '_deja') WHEN 'none' THEN contains(key, '_vide') ELSE NOT contains(key, '_deja') AND NOT contains(key, '_vide') END END
"""

_FLOORS = ("8", "-1", "0", "", None, "x", "44")


def draft_columns(spark, sf_dir):
    """Draft rows for a table without the latest columns: brand, sender address, review, its floor and its context."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    account = _case("c_custkey", ("primary", "north", "south"))
    review = F.when(k % 4 != 0, F.struct((k % 11).cast("int").alias("score"), F.lit("ok").alias("verdict"), F.lit("fine").alias("comment"), (k % 4 == 1).alias("engine_down")))
    body = templates.rebrand(F.concat(F.lit("Grand House and GRAND HOUSE for "), F.col("c_name")), account, {"north": "Nord Studio"}, "Grand House")
    d = c.select(k.alias("prospect_id"), F.repeat(F.col("c_name"), 20).alias("subject"), body.alias("body"), templates.draft_sender(F.when(k % 5 == 0, " t@x.fr ").otherwise(""), account, F.concat(account, F.lit("@x.fr"))).alias("sender_address"),
                 templates.review_columns(review).alias("r"), _case("c_custkey", _FLOORS).alias("floor"), F.when(k % 2 == 0, "c_city").alias("city"))
    d = d.select("*", "r.review_score", "r.review_verdict", "r.review_comment", F.lit("<p>").alias("body_html"), F.lit(1).alias("review_score_after"))
    rows = templates.draft_rows(d, ["prospect_id", "subject", "body", "body_html", "review_score", "review_verdict", "review_comment", "sender_address", "review_score_after"])
    extra = d.select(F.col("prospect_id").alias("k"), templates.review_floor(F.col("floor")).alias("floor"), F.length(templates.review_context(F.lit(""), F.lit("Legal"), F.col("city"), F.lit(None).cast("string"), F.repeat(F.lit("d"), 300))).alias("context"))
    return rows.join(extra, F.col("prospect_id") == F.col("k")).select("prospect_id", F.length("subject").alias("n_subject"), "body", "kind", "status", "sender_address", "review_score", "review_verdict", "review_comment", F.lit(len(rows.columns)).alias("n_columns"), "floor", "context")


DRAFT_COLUMNS = f"""
WITH a AS (SELECT c_custkey AS k, c_name, {_case_sql('c_custkey', ('primary', 'north', 'south'))} AS account FROM customer)
SELECT k AS prospect_id, least(200, 20 * len(c_name))::INTEGER AS n_subject, CASE WHEN account = 'north' THEN 'Nord Studio and NORD STUDIO for ' ELSE 'Grand House and GRAND HOUSE for ' END || c_name AS body, 'first_contact' AS kind, 'pending' AS status,
  CASE WHEN k % 5 = 0 THEN 't@x.fr' WHEN account <> 'primary' THEN account || '@x.fr' END AS sender_address, CASE WHEN k % 4 IN (2, 3) THEN (k % 11)::INTEGER END AS review_score, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'engine_down' ELSE 'ok' END AS review_verdict,
  CASE WHEN k % 4 <> 0 THEN 'fine' END AS review_comment, 14 AS n_columns, {_case_sql('k', (8, 0, 7, 7, 7, 7, 10))} AS floor, (len('Nom: Legal' || chr(10) || 'Ville: ' || CASE WHEN k % 2 = 0 THEN 'c_city' ELSE '?' END || chr(10) || 'Secteur: ?' || chr(10) || 'Description: ') + 200)::INTEGER AS context FROM a
"""


def site_contacts(spark, sf_dir):
    """Contacts by site: pages of one host together, addresses of the site's own domain first."""
    p = load(spark, sf_dir, "pages").select(contact.host(F.col("url")).alias("site"), "url", "html")
    s = sites.site_contacts(p)
    return s.select("site", F.array_join("emails", ",").alias("emails"), F.array_join("postal_codes", ",").alias("postal_codes"), F.array_join("company_ids", ",").alias("company_ids"), "has_legal", "n_pages", "first_url")


SITE_CONTACTS = f"""
WITH src AS (SELECT {o.host('url')} AS site, url, {page_text('html')} AS text, list_transform(regexp_extract_all(html, '(?i)mailto:([^"''?>\\s]+)', 1), lambda x: lower(x)) AS ml FROM pages), {o.clean_emails('src', 'site', RAW_EMAILS + ' || ml')},
em AS (SELECT site, list_distinct(list(e)) AS es FROM cleaned GROUP BY site),
g AS (SELECT site, list_sort(list_distinct(list_filter(flatten(list(regexp_extract_all(text, '\\b(\\d{{5}})\\b', 1))), lambda x: x >= '01000'))) AS pc,
  list_sort(list_distinct(list_transform(flatten(list(regexp_extract_all(text, '{contact.COMPANY_ID}', 1))), lambda x: regexp_replace(x, '[^0-9]', '', 'g')))) AS ci,
  bool_or(regexp_matches(text, '{contact.LEGAL.replace("(?iu)", "(?i)")}')) AS has_legal, count(*) AS n_pages, min(url) AS first_url FROM src GROUP BY site)
SELECT g.site, coalesce(array_to_string(list_transform(list_sort(list_transform(es, lambda x: CASE WHEN ends_with(x, '@' || g.site) THEN '0' ELSE '1' END || x))[1:5], lambda x: substr(x, 2)), ','), '') AS emails,
  array_to_string(pc, ',') AS postal_codes, array_to_string(ci, ',') AS company_ids, has_legal, n_pages, first_url FROM g LEFT JOIN em USING (site)
"""


def page_outbound(spark, sf_dir):
    """Distinct links of each page to other, non-social hosts, and its inner links that promise contact details."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.size(sites.outbound_links(F.col("html"), F.col("url"))).alias("n_outbound"), F.size(sites.priority_links(F.col("html"), F.col("url"))).alias("n_priority"))


_PATHS = "|".join(p.replace("-", r"\-") for p in sites.dims.PRIORITY_PATHS)
PAGE_OUTBOUND = f"""
WITH a AS (SELECT page_id, {o.host('url')} AS own, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>')) AS tag FROM pages),
l AS (SELECT page_id, own, trim(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS h, lower(regexp_replace(regexp_extract(tag, '(?s)^[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g')) AS t FROM a),
x AS (SELECT *, h = '' OR regexp_matches(h, '(?i)^(javascript:|mailto:|tel:|#)') AS skip, split_part(h, '#', 1) AS u FROM l),
y AS (SELECT *, NOT regexp_matches(u, '(?i)^(https?:)?//') OR {o.host("regexp_replace(u, '^//', '')")} = own AS inner_, regexp_matches(regexp_extract(lower(u), '^https?://([^/\\s?#]+)', 1), '(?:^|\\.)(?:{o.alternation(sites.dims.HUB_SOCIAL_DOMAINS)})$') AS social FROM x WHERE NOT skip),
z AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(lower(CASE WHEN regexp_matches(u, '(?i)^https?://') THEN regexp_replace(u, '(?i)^https?://[^/?#]+', '') ELSE u END), '^[^?#]*'), '^([^/])', '/\\1'), '/+$', '') AS p FROM y),
q AS (SELECT page_id, count(DISTINCT p) FILTER (inner_ AND (regexp_matches(p, '^(?:{_PATHS})(?:/|$)') OR regexp_matches(t, '{"|".join(sites.dims.PRIORITY_WORDS)}'))) AS np, count(DISTINCT u) FILTER (NOT inner_ AND NOT social) AS no FROM z GROUP BY page_id)
SELECT page_id, coalesce(no, 0)::INTEGER AS n_outbound, least(5, coalesce(np, 0))::INTEGER AS n_priority FROM (SELECT page_id FROM pages) LEFT JOIN q USING (page_id)
"""

#: URL, is it a hub, is it a network that a hub's links are not followed to, is it social
_URLS = (("https://linktr.ee/x", True, False, False), ("linktr.ee/x", True, False, False), ("https://my.carrd.co", True, False, False), ("https://www.instagram.com/a", False, True, True), ("instagram.com/a", False, False, False), ("https://notlinktr.ee/", False, False, False),
         ("https://x.com/a", False, True, True), ("https://github.com/a", False, False, True), ("", False, False, False), ("https://firm.fr", False, False, False), ("https://discord.com", False, True, True), ("https://kick.com/b", False, False, True), (None, False, False, False))


def url_kinds(spark, sf_dir):
    """Hub, followed network and social network: three lists, three predicates."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [u[0] for u in _URLS]).alias("u"))
    return c.select("c_custkey", sites.is_hub(F.col("u")).alias("hub"), F.coalesce(sites.is_social_link(F.col("u")), F.lit(False)).alias("network"), contact.is_social(F.col("u")).alias("social"))


URL_KINDS = "SELECT c_custkey, " + ", ".join(f"{_case_sql('c_custkey', [u[i] for u in _URLS])} AS {n}" for i, n in ((1, "hub"), (2, "network"), (3, "social"))) + " FROM customer"


def find_known(spark, sf_dir):
    """Suppliers looked up among customers by their keys: the earliest key that is known decides."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.concat(F.lit("b:"), (F.col("s_suppkey") * 31).cast("string")), F.concat(F.lit("a:"), (F.col("s_suppkey") % 70).cast("string"))).alias("keys"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("a:"), (F.col("c_custkey") % 50).cast("string")), F.concat(F.lit("b:"), F.col("c_custkey").cast("string"))).alias("keys"))
    return entities.find_first(s, c)


FIND_KNOWN = """
WITH a AS (SELECT c_custkey % 50 AS m, min(c_custkey) AS low FROM customer GROUP BY 1)
SELECT s_suppkey AS id, coalesce(c_custkey, low) AS known_id FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 31 LEFT JOIN a ON a.m = s_suppkey % 70
"""


def upsert_rows(spark, sf_dir):
    """Suppliers put over customers by key: new ones added, values replaced where they are not null."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("balance"))
    return sinks.upsert(c, s, "k")


UPSERT_ROWS = """
SELECT coalesce(s_suppkey * 3, c_custkey) AS k, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance
FROM customer FULL JOIN supplier ON s_suppkey * 3 = c_custkey
"""

_NAMES = (("à la mesure du bois", "À la Mesure du Bois"), ("dilya's cake", "Dilya's Cake"), ("saint-jean-de-luz", "Saint-Jean-de-Luz"), ("l'atelier de maud", "L'Atelier de Maud"), ("Déjà Écrit", "Déjà Écrit"), ("SARL DUPONT", "SARL DUPONT"),
          ("un nom de plus de six mots ici", "un nom de plus de six mots ici"), ("1234", "1234"), (None, None))


def display_names(spark, sf_dir):
    """Display case of names, and the name used in messages' first words."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [n[0] for n in _NAMES]).alias("n"))
    return c.select("c_custkey", text.display_name(F.col("n")).alias("name"), text.first_name(F.concat(F.lit("SARL "), F.col("n"))).alias("first"))


DISPLAY_NAMES = f"SELECT c_custkey, {_case_sql('c_custkey', [n[1] for n in _NAMES])} AS name, {_case_sql('c_custkey', ('À', "Dilya's", 'Saint-jean-de-luz', "L'atelier", 'Déjà', 'Dupont', 'Un', '', ''))} AS first FROM customer"

_PLACES = (("65 Rue de Paris, 35000 Rennes, France", "35000", "Rennes"), ("1 r, 35510 Chapelle (La)", "35510", "La Chapelle"), ("x 72000 Mans (Le", "72000", "Le Mans"), ("9, 75001 PARIS CEDEX 01", "75001", "PARIS"), ("rien", "", ""), (None, "", ""))
_CODES = (("4776z", "47.76Z"), (" 43.21A ", "43.21A"), ("47.76Z", "47.76Z"), ("x", "X"), ("", ""), (None, ""))


def codes_addresses(spark, sf_dir):
    """French addresses and activity codes in their canonical form."""
    c = load(spark, sf_dir, "customer").select("c_custkey", contact.split_address(_case("c_custkey", [p[0] for p in _PLACES])).alias("a"), classify.activity_code(_case("c_custkey", [p[0] for p in _CODES])).alias("code"))
    return c.select("c_custkey", F.col("a.postal_code").alias("postal_code"), F.col("a.city").alias("city"), "code")


CODES_ADDRESSES = f"SELECT c_custkey, {_case_sql('c_custkey', [p[1] for p in _PLACES])} AS postal_code, {_case_sql('c_custkey', [p[2] for p in _PLACES])} AS city, {_case_sql('c_custkey', [p[1] for p in _CODES])} AS code FROM customer"

#: old text, new text, HTML, the HTML after the edit
_EDITS = (("Bonjour, je vous propose un site.", "Bonjour, je vous offre un site.", "<p>Bonjour, je vous propose un site.</p>", "<p>Bonjour, je vous offre un site.</p>"), ("C'est l'offre !", "C'est l'idée !", "<p>C&rsquo;est l&rsquo;offre&nbsp;!</p>", "<p>C&rsquo;est l&rsquo;idée&nbsp;!</p>"),
          ("abc", "abc", "<p>abc</p>", "<p>abc</p>"), ("abc", "abcd", "<p>abc</p>", "<p>abc</p>"), ("un deux trois", "un trois", "<p>un deux trois</p>", "<p>un trois</p>"), ("le texte", "un texte", "<p>autre</p>", "<p>autre</p>"), (None, "x", "<p>", "<p>"), ("aXa", "aYa", "X aXa X", "Y aXa X"), ("d'a!", "d'b!", "d&#39;a!", "d&#39;b!"))


def edits_in_place(spark, sf_dir):
    """A text's one changed span, carried into its HTML under the ways it may be written there."""
    c = load(spark, sf_dir, "customer").select("c_custkey", *[_case("c_custkey", [e[i] for e in _EDITS]).alias(n) for i, n in enumerate(("old", "new", "page"))])
    return templates.edit_in_place(c, "old", "new", "page").select("c_custkey", F.col("edited").alias("html"), "applied")


EDITS_IN_PLACE = f"SELECT c_custkey, {_case_sql('c_custkey', [e[3] for e in _EDITS])} AS html, {_case_sql('c_custkey', [e[2] != e[3] for e in _EDITS])} AS applied FROM customer"


def cursor_walk(spark, sf_dir):
    """Cursors after a run: over code, region and page; over a shuffled listing; over a grid; reset where the criteria changed."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    h = [cursors.criteria_hash({"q": "x", "n": i, "none": None}) for i in range(2)]
    saved = s.select(k.alias("source"), F.lit(h[0]).alias("criteria_hash"), F.struct((k % 4).alias("code"), (k % 3).alias("region"), (k % 5 + 1).alias("page")).alias("place"))
    wanted = s.select(k.alias("source"), F.when(k % 6 == 0, h[1]).otherwise(h[0]).alias("criteria_hash"))
    now = cursors.load(saved, wanted)
    step = cursors.next_page(F.col("place"), F.col("source") % 2 == 0, F.lit(None).cast("long"), F.lit(3), F.lit(4))
    after = cursors.save(saved, now.select("source", "criteria_hash", step.alias("place")).where("source % 10 <> 9"))
    return after.select("source", "place.code", "place.region", "place.page", cursors.next_offset(F.col("source") * 10, F.lit(30), F.lit(500)).alias("offset"), cursors.next_cell(F.col("source")).alias("cell"))


CURSOR_WALK = """
WITH p AS (SELECT s_suppkey AS k, s_suppkey % 6 = 0 AS gone, s_suppkey % 10 = 9 AS same FROM supplier),
q AS (SELECT *, CASE WHEN gone THEN 0 ELSE k % 4 END AS c, CASE WHEN gone THEN 0 ELSE k % 3 END AS r, CASE WHEN gone THEN 1 ELSE k % 5 + 1 END AS g FROM p)
SELECT k AS source, CASE WHEN same THEN k % 4 WHEN k % 2 = 0 AND (r + 1) % 3 = 0 THEN (c + 1) % 4 ELSE c END AS code, CASE WHEN same THEN k % 3 WHEN k % 2 = 0 THEN (r + 1) % 3 ELSE r END AS region, CASE WHEN same THEN k % 5 + 1 WHEN k % 2 = 0 THEN 1 ELSE g + 1 END AS page,
  CASE WHEN k * 10 + 30 >= 500 THEN 0 ELSE k * 10 + 30 END AS "offset", (k % 49 + 1) % 49 AS cell FROM q
"""


def run_statistics(spark, sf_dir):
    """Counts of each kind of event by user, and the last one seen."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("uid"))
    return records.run_stats(e, ["view", "click", "purchase"], ["user_id"])


RUN_STATISTICS = "SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) AS n_all, max(event_id) AS max_uid FROM events GROUP BY user_id"

_SOURCES = (("yt_main", "creator"), ("Twitch", "creator"), ("registry", "pro"), ("file", "pro"), (None, "pro"))


def audience_counts(spark, sf_dir):
    """Customers by audience, from the names of their sources."""
    c = load(spark, sf_dir, "customer").select(F.array(F.lit("other"), _case("c_custkey", [s[0] for s in _SOURCES])).alias("s"))
    return records.audience_counts(c, classify.audience(F.col("s"), ("yt_", "twitch")))


AUDIENCE_COUNTS = f"SELECT {_case_sql('c_custkey', [s[1] for s in _SOURCES])} AS audience, count(*) AS n FROM customer GROUP BY 1"

_LABELS = (("web", "", "page contact ou mentions légales du site officiel"), ("WEB", "vu", "vu"), ("maps", None, "fiche Google Maps de l'établissement"), ("shared_twitch", "", "profil twitch (base partagée)"), ("odd", "", "odd"), ("", "", "source inconnue"), (None, None, "source inconnue"))


def source_words(spark, sf_dir):
    """Provenance in words, and a record's distinct sources in words."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [s[0] for s in _LABELS]).alias("s"), _case("c_custkey", [s[1] for s in _LABELS]).alias("x"))
    via = {"shared": "base partagée"}
    return c.select("c_custkey", templates.source_label(F.col("s"), F.col("x"), via).alias("label"), F.array_join(templates.source_labels(F.array(F.lit("File"), F.col("s"), F.lit("file")), via), ", ").alias("all"))


SOURCE_WORDS = f"""SELECT c_custkey, {_case_sql('c_custkey', [s[2] for s in _LABELS])} AS label, 'fichier importé' || {_case_sql('c_custkey', [', ' + _LABELS[0][2], ', ' + _LABELS[0][2], ', ' + _LABELS[2][2], ', ' + _LABELS[3][2], ', odd', '', ''])} AS "all" FROM customer"""


def package_search(spark, sf_dir):
    """Parts as packages: names that hold a word of the query."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), r"\s+", "-").alias("name"))
    return profiles.match_packages(p, "steel small, x")


PACKAGE_SEARCH = "SELECT p_partkey, regexp_replace(lower(p_name), '\\s+', '-', 'g') AS name FROM part WHERE regexp_matches(regexp_replace(lower(p_name), '\\s+', '-', 'g'), '(^|[^a-z0-9])(steel|small)([^a-z0-9]|$)')"


def package_profiles(spark, sf_dir):
    """Package metadata of suppliers as profiles."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    m = s.select(F.concat(F.lit("pkg"), k).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("Ann "), k, F.lit(" <a@b.fr>"))).alias("author"), F.when(F.col("s_suppkey") % 2 == 0, "Max").alias("maintainer"),
                 F.concat(F.lit("Ann <A"), k, F.lit("@dev.io>, b@dev.io")).alias("author_email"), F.lit("b@dev.io").alias("maintainer_email"), F.lit("short").alias("summary"), F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.lit("y"), 2000)).alias("description"),
                 F.when(F.col("s_suppkey") % 5 == 0, "ftp://x").otherwise("https://home").alias("home_page"), F.create_map(F.lit("docs"), F.lit("https://docs"), F.lit("bad"), F.lit("none")).alias("project_urls"))
    return profiles.from_packages(m).select("handle", "name", F.length("description").alias("n"), F.array_join("emails", ",").alias("emails"), F.array_join("urls_in_bio", ",").alias("urls"), "website")


PACKAGE_PROFILES = """
SELECT 'pkg' || s_suppkey AS handle, CASE WHEN s_suppkey % 3 <> 0 THEN 'Ann ' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'Max' ELSE 'pkg' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 1807 ELSE 5 END AS n,
  'a' || s_suppkey || '@dev.io,b@dev.io' AS emails, CASE WHEN s_suppkey % 5 = 0 THEN 'https://docs' ELSE 'https://home,https://docs' END AS urls, CASE WHEN s_suppkey % 5 = 0 THEN 'https://docs' ELSE 'https://home' END AS website FROM supplier
"""

_OLD = (("à contacter", "qualified"), ("Contacté", "contacted"), ("refus", "refused"), ("?", "new"), (None, "new"))


def legacy_import(spark, sf_dir):
    """Records of an older collection as entities: given provenance stays, else the profile is the source of every address."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    record = F.concat(F.lit('{"platform": "'), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("twitch"), F.lit('", "id": '), k, F.lit(', "name": "'), F.col("c_name"), F.lit('", "emails": ["c'), k, F.lit('@firm.fr"], "urls_in_bio": ["https://a", null]'),
                      F.when(F.col("c_custkey") % 4 == 0, F.lit(', "emails_meta": [{"email": "c@firm.fr", "source": "web"}, {"email": ""}]')).otherwise(""), F.lit("}"))
    raw = c.select(F.from_json(record, profiles.LEGACY_RECORD).alias("r"), _case("c_custkey", [s[0] for s in _OLD]).alias("s")).select("r.*", "s").drop("status").withColumnRenamed("s", "status")
    e = profiles.from_legacy(raw)
    return e.select(F.col("sources")[0]["source_id"].alias("id"), "name", "status", "industry", F.array_join(F.transform("emails_meta", lambda m: F.concat_ws("/", m["email"], m["source"], m["context"])), ",").alias("meta"), F.size("other_urls").alias("n_urls"))


LEGACY_IMPORT = f"""
WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'twitch' END AS p FROM customer)
SELECT p || '|' || c_custkey AS id, c_name AS name, {_case_sql('c_custkey', [s[1] for s in _OLD])} AS status, p AS industry,
  CASE WHEN c_custkey % 4 = 0 THEN 'c@firm.fr/web' WHEN p = '' THEN 'c' || c_custkey || '@firm.fr/profile/profil créateur' ELSE 'c' || c_custkey || '@firm.fr/profile_twitch/bio / profil twitch' END AS meta, 1 AS n_urls FROM c
"""


def scraped_contacts(spark, sf_dir):
    """Addresses seen on a page, at most three, else guessed ones under a provenance of their own; guessed ones counted."""
    k = F.col("c_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit("@f.fr")))).alias("seen"), F.when(k % 2 == 0, F.array(F.lit("contact@f.fr"))).alias("guess"))
    r = records.scraped_or_inferred(F.col("seen"), F.col("guess"), F.lit("https://f.fr"), F.lit("web"), F.lit("page"), F.lit("domain"))
    return c.select("c_custkey", F.array_join(r["emails"], ",").alias("emails"), F.array_join(F.transform(r["meta"], lambda m: F.concat_ws("/", m["source"], m["context"])), ",").alias("meta"), r["inferred"].alias("inferred"))


SCRAPED_CONTACTS = """
WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE least(3, c_custkey % 5 + 1) END AS n FROM customer)
SELECT k AS c_custkey, CASE WHEN n > 0 THEN array_to_string(list_transform(range(1, n + 1), lambda i: 's' || i || '@f.fr'), ',') WHEN k % 2 = 0 THEN 'contact@f.fr' ELSE '' END AS emails,
  CASE WHEN n > 0 THEN array_to_string(list_transform(range(1, n + 1), lambda i: 'web/page'), ',') WHEN k % 2 = 0 THEN 'web_inferred/domain' ELSE '' END AS meta, n = 0 AND k % 2 = 0 AS inferred FROM n
"""


def writer_prompts(spark, sf_dir):
    """What a writer is told of each customer, and library items stacked over a request."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    r = {"name": F.when(k % 3 == 0, "").otherwise(F.col("c_name")), "legal_name": F.lit("LEGAL (x)"), "city": F.lit(None).cast("string"), "industry": F.col("c_mktsegment"), "description": F.repeat(F.lit("d"), 400), "website": F.lit(""),
         "audience": F.when(k % 2 == 0, "creator").otherwise("pro"), "origins": F.array(F.lit("a"), F.lit("b")), "email": F.lit("x@y.fr"), "email_origin": F.lit("bio"), "subscribers": k * 1000, "sender": F.lit("Ann")}
    prompt = templates.writer_prompt(r, "VOUS", F.lit("court"))
    items = F.when(k % 4 == 0, F.array().cast("array<struct<id:string,name:string,content:string>>")).otherwise(F.array(F.struct(F.lit("i").alias("id"), F.lit("N").alias("name"), F.lit(" do ").alias("content"))))
    lines = F.split(prompt, "\n")
    return c.select("c_custkey", F.size(lines).alias("n_lines"), F.element_at(lines, 2).alias("who"), F.length(F.element_at(lines, 5)).alias("n_description"), F.array_join(F.filter(lines, lambda x: x.startswith("- Abonnés")), "").alias("followers"),
                    F.size(F.split(templates.stacked_prompt(F.lit(" ask "), items), "\n")).alias("n_stacked"))


WRITER_PROMPTS = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN 13 ELSE 12 END AS n_lines, '- Nom / entreprise : ' || CASE WHEN c_custkey % 3 = 0 THEN 'Legal' ELSE c_name END AS who, 316 AS n_description,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN '- Abonnés : ' || replace(format('{:,}', c_custkey * 1000), ',', ' ') ELSE '' END AS followers, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 6 END AS n_stacked FROM customer
"""

_PAIRS = (
    (record_rows, RECORD_ROWS), (gained_contacts, GAINED_CONTACTS), (site_outcome, SITE_OUTCOME), (status_guard, STATUS_GUARD), (template_choice, TEMPLATE_CHOICE), (draft_columns, DRAFT_COLUMNS), (site_contacts, SITE_CONTACTS), (page_outbound, PAGE_OUTBOUND),
    (url_kinds, URL_KINDS), (find_known, FIND_KNOWN), (upsert_rows, UPSERT_ROWS), (display_names, DISPLAY_NAMES), (codes_addresses, CODES_ADDRESSES), (edits_in_place, EDITS_IN_PLACE), (cursor_walk, CURSOR_WALK), (run_statistics, RUN_STATISTICS),
    (audience_counts, AUDIENCE_COUNTS), (source_words, SOURCE_WORDS), (package_search, PACKAGE_SEARCH), (package_profiles, PACKAGE_PROFILES), (legacy_import, LEGACY_IMPORT), (scraped_contacts, SCRAPED_CONTACTS), (writer_prompts, WRITER_PROMPTS),
)
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
