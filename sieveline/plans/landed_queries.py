"""Queries of landed sources, eligibility and text repairs: cases dealt over whole tables, the SQL names each case's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import classify, contact, text
from sieveline.operators import entities, selection
from sieveline.plans.record_queries import _case, _case_sql
from sieveline.session import load
from sieveline.sources import profiles


def _s(c: str):
    return F.col(c).cast("string")


def landed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as creator profiles: contacts and commercial signals of the description; records without an id go."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    told = F.when(k % 4 == 0, F.concat(F.lit("ma boutique https://s"), _s("c_custkey"), F.lit(".fr jo"), _s("c_custkey"), F.lit("@firm.fr 06 12 34 56 78"))).when(k % 4 == 1, "rien").when(k % 4 == 2, F.concat(F.lit("ann (at) shop"), _s("c_custkey"), F.lit(" (dot) fr")))
    raw = c.select(F.lit("kick").alias("platform"), F.when(k % 9 == 0, " ").otherwise(_s("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("handle"), told.alias("description"), F.lit(5).cast("long").alias("subscribers"), F.lit("fr").alias("language"), F.lit("FR").alias("country"), F.lit("u").alias("url"))
    p = profiles.from_profiles(raw)
    return p.select("name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.array_join("other_urls", ",").alias("urls"), "monetized", F.array_join("monetization_reasons", ";").alias("reasons"), F.array_join(F.transform("emails_meta", lambda m: F.concat_ws("/", m["source"], m["source_id"])), ",").alias("meta"), F.col("sources")[0]["source_id"].alias("id"))


LANDED_PROFILES = """
SELECT c_name AS name, CASE k % 4 WHEN 0 THEN 'jo' || k || '@firm.fr' WHEN 2 THEN 'ann@shop' || k || '.fr' ELSE '' END AS emails, CASE WHEN k % 4 = 0 THEN '+33612345678' ELSE '' END AS phones, CASE WHEN k % 4 = 0 THEN 'https://s' || k || '.fr' ELSE '' END AS urls,
  k % 4 = 0 AS monetized, CASE WHEN k % 4 = 0 THEN 'site:https://s' || k || '.fr;word:boutique;word:ma boutique' ELSE '' END AS reasons, CASE WHEN k % 4 IN (0, 2) THEN 'profile_kick/' || k ELSE '' END AS meta, k::VARCHAR AS id
FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 9 <> 0
"""


def landed_companies(spark, sf_dir):
    """Suppliers as company registry records: name from either field, label by code, section or the code itself."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    siege = F.struct(_s("s_suppkey").alias("numero_voie"), F.lit("RUE").alias("type_voie"), F.when(k % 2 == 0, "DU BOIS").alias("libelle_voie"), F.lit("35000").alias("code_postal"), F.lit("RENNES").alias("libelle_commune"))
    raw = s.select(F.when(k % 7 == 0, "").otherwise(_s("s_suppkey")).alias("siren"), F.when(k % 3 == 0, " ").otherwise(F.col("s_name")).alias("nom_complet"), F.when(k % 5 != 0, F.concat(F.lit("L"), _s("s_suppkey"))).alias("nom_raison_sociale"), F.when(k % 4 != 0, siege).alias("siege"),
                   _case("s_suppkey", ("47.76Z", "99.99Z", None)).alias("activite_principale"), F.lit("?").alias("section_activite_principale"))
    labels = spark.createDataFrame([("47.76Z", "Fleuriste")], "k string, v string")
    return profiles.from_registry(raw, labels).select("siren", "name", "address", "city", "industry", "description")


LANDED_COMPANIES = """
WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN s_name WHEN s_suppkey % 5 <> 0 THEN 'L' || s_suppkey END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Fleuriste' WHEN 1 THEN '99.99Z' ELSE '' END AS ind, s_suppkey % 4 <> 0 AS has FROM supplier)
SELECT k::VARCHAR AS siren, name, CASE WHEN has THEN k || ' RUE' || CASE WHEN k % 2 = 0 THEN ' DU BOIS' ELSE '' END ELSE '' END AS address, CASE WHEN has THEN 'RENNES' ELSE '' END AS city, ind AS industry,
  CASE WHEN ind <> '' THEN ind || ' · ' ELSE '' END || 'SIREN ' || k || CASE WHEN has THEN ' · RENNES' ELSE '' END AS description FROM c WHERE k % 7 <> 0 AND name IS NOT NULL
"""


def landed_places(spark, sf_dir):
    """Suppliers as map places: closed and nameless ones go, the international number wins."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    raw = s.select(_s("s_suppkey").alias("id"), F.struct(F.when(k % 6 != 0, F.col("s_name")).alias("text")).alias("displayName"), F.when(k % 2 == 0, "12 rue X, 35000 Rennes, France").otherwise("ailleurs").alias("formattedAddress"), F.lit("short").alias("shortFormattedAddress"),
                   F.when(k % 4 == 0, "+33 2").alias("internationalPhoneNumber"), F.lit("02").alias("nationalPhoneNumber"), F.lit("w").alias("websiteUri"), F.when(k % 3 == 0, "bakery").alias("primaryType"), F.array(F.lit("cafe"), F.lit("bar"), F.lit("x")).alias("types"),
                   F.when(k % 5 == 0, "CLOSED_PERMANENTLY").otherwise("OPERATIONAL").alias("businessStatus"), F.when(k % 2 == 0, 4.5).alias("rating"), F.lit(3).alias("userRatingCount"))
    return profiles.from_places(raw).select("name", F.array_join("phones", ",").alias("phones"), "city", "postal_code", "industry", "description")


LANDED_PLACES = """
SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN '+33 2' ELSE '02' END AS phones, CASE WHEN s_suppkey % 2 = 0 THEN 'Rennes' ELSE '' END AS city, CASE WHEN s_suppkey % 2 = 0 THEN '35000' ELSE '' END AS postal_code,
  CASE WHEN s_suppkey % 3 = 0 THEN 'bakery' ELSE 'cafe' END AS industry, CASE WHEN s_suppkey % 3 = 0 THEN 'bakery' ELSE 'cafe / bar' END || CASE WHEN s_suppkey % 2 = 0 THEN ' · ⭐ 4.5 (3 avis)' ELSE '' END AS description
FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 5 <> 0
"""


def landed_points(spark, sf_dir):
    """Suppliers as points of interest, twice over: one per type and id, with an address and a name."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    tags = F.map_from_arrays(F.array(*[F.lit(x) for x in ("name", "contact:email", "email", "website", "shop", "addr:street", "addr:housenumber")]),
                             F.array(F.when(k % 6 != 0, F.col("s_name")).otherwise(""), F.when(k % 4 != 0, "Z@a.fr; y@a.fr").otherwise(""), F.when(k % 8 != 0, "z@a.fr").otherwise("no"), F.lit("a.fr"), F.when(k % 3 == 0, "").otherwise("bakery"), F.lit("R"), _s("s_suppkey")))
    raw = s.select(F.lit("node").alias("type"), k.alias("id"), tags.alias("tags"))
    return profiles.from_points(raw.unionByName(raw)).select("id", "name", F.array_join("emails", ",").alias("emails"), "website", F.replace("description", F.lit("\n"), F.lit("|")).alias("description"), "country", "language")


LANDED_POINTS = """
SELECT 'osm:node:' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'z@a.fr,y@a.fr' ELSE 'z@a.fr' END AS emails, 'https://a.fr' AS website, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'shop=bakery|' END || s_suppkey || ' R' AS description, 'FR' AS country, 'fr' AS language
FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 8 <> 0
"""


def shared_search(spark, sf_dir):
    """Customers as the shared base under all of its predicates."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    e = c.select(k.alias("entity_id"), F.when(k % 2 == 0, "Kick").otherwise("x").alias("industry"), F.floor("c_acctbal").cast("long").alias("subscribers"), _case("c_custkey", ("fr", "FR", "de", None)).alias("country"), F.lit("FR").alias("language"),
                 F.when(k % 3 != 0, F.array(F.lit("a@b.fr"))).otherwise(F.array().cast("array<string>")).alias("emails"), _case("c_custkey", ("new", "won", None, "Qualified", "lost")).alias("status"), (k % 7 != 0).alias("monetized"))
    return profiles.search_shared(e, "KICK ", 0, 8000, "Fr", "fr", True, True, True).select("entity_id", "subscribers")


SHARED_SEARCH = """
SELECT c_custkey AS entity_id, floor(c_acctbal)::BIGINT AS subscribers FROM customer WHERE c_custkey % 2 = 0 AND floor(c_acctbal) BETWEEN 0 AND 8000 AND c_custkey % 4 IN (0, 1) AND c_custkey % 3 <> 0 AND c_custkey % 5 IN (0, 2, 3) AND c_custkey % 7 <> 0
"""

#: name, is it polluted, its clean part, the rest
_POLLUTED = (("FABBI PEINTURE: Artisan peintre en bâtiment", True, "FABBI PEINTURE", "Artisan peintre en bâtiment"), ("Dupont", False, None, None), ("Le Jardin · fleuriste et décoration à Rennes", True, "Le Jardin", "fleuriste et décoration à Rennes"), ("x" * 61, True, None, None), ("Dupont: court", False, None, None), ("", False, None, None), (None, False, None, None))
#: proposed, original, is every word of it there; and an industry, is it sane
_REPAIRS = (("Dupont Peinture", "DUPONT PÉINTURE, Rennes", True), ("Dupont SARL", "Dupont", False), ("", "Dupont", False), (None, "x", False), ("été", "Ete 2024", True))
_SANE = (("Peinture & déco", True), ("x", False), ("a1", False), ("", False), (None, False), ("Bâtiment - travaux", True), ("y" * 41, False))


def name_repairs(spark, sf_dir):
    """Names run together with a description, cut; proposals that invent no word; industries that are one."""
    c = load(spark, sf_dir, "customer").select("c_custkey", *[_case("c_custkey", [r[i] for r in v]).alias(n) for n, v, i in (("n", _POLLUTED, 0), ("a", _REPAIRS, 0), ("b", _REPAIRS, 1), ("i", _SANE, 0))])
    s = text.split_polluted(F.col("n"))
    return c.select("c_custkey", text.name_is_polluted(F.col("n")).alias("polluted"), s["name"].alias("name"), s["rest"].alias("rest"), text.words_subset(F.col("a"), F.col("b")).alias("subset"), text.industry_is_sane(F.col("i")).alias("sane"))


NAME_REPAIRS = "SELECT c_custkey, " + ", ".join(f"{_case_sql('c_custkey', [r[i] for r in v])} AS {n}" for n, v, i in (("polluted", _POLLUTED, 1), ("name", _POLLUTED, 2), ("rest", _POLLUTED, 3), ("subset", _REPAIRS, 2), ("sane", _SANE, 1))) + " FROM customer"

#: trade, segment of the exclusive offer
_OFFERS = (("Courtier en travaux", ""), ("Courtier", "courtier"), ("Expert-comptable", "comptable"), ("Diagnostic immobilier", ""), ("Agence immobilière", "immo"), ("Avocat à la cour", "avocat"), ("Boulanger", ""), (None, ""))


def offer_segments(spark, sf_dir):
    """The segment of the exclusive offer, and who must get that offer: a segment and a site of its own."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [x[0] for x in _OFFERS]).alias("t"), F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, "https://f.fr").alias("w"))
    return c.select("c_custkey", classify.offer_segment(F.col("t")).alias("segment"), classify.offer_required(F.col("t"), F.col("w")).alias("required"))


OFFER_SEGMENTS = f"SELECT c_custkey, {_case_sql('c_custkey', [x[1] for x in _OFFERS])} AS segment, CASE WHEN c_custkey % 3 = 1 AND {_case_sql('c_custkey', [x[1] for x in _OFFERS])} <> '' THEN 'advisory' ELSE '' END AS required FROM customer"


def creator_eligibility(spark, sf_dir):
    """Creators who may be written to: an address, a fresh status, verified, nothing sent, no draft, no community account."""
    c, x = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    e = c.select(k.alias("entity_id"), _case("c_custkey", ("Ann", "r/paris", "Bob", None)).alias("name"), _case("c_custkey", ("ann", "x", "/r/lyon", "q", "bob")).alias("handle"), _case("c_custkey", ("https://reddit.com/r/x", "https://reddit.com/user/ann/r/", "https://a.fr", None, "", "b")).alias("platform_url"),
                 F.when(k % 7 != 0, F.array(F.lit("a@b.fr"))).otherwise(F.array(F.lit(" "))).alias("emails"), F.when(F.col("c_acctbal") > 0, "new").otherwise("lost").alias("status"), F.when(k % 2 == 0, F.array(F.lit("site_verified"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    sent = x.where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("entity_id"))
    own = selection.eligible_creators(e, sent).select("entity_id", F.lit("creator").alias("kind"))
    return own.unionByName(selection.eligible(e, sent, only_verified=True).select("entity_id", F.lit("verified").alias("kind")))


CREATOR_ELIGIBILITY = """
WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0 AND c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000))
SELECT k AS entity_id, 'creator' AS kind FROM e WHERE k % 4 <> 1 AND k % 5 <> 2 AND k % 6 <> 0 UNION ALL SELECT k, 'verified' FROM e WHERE k % 2 = 0
"""


def enrichment_queue(spark, sf_dir):
    """Records to enrich: no address, and a site of their own or a name and a city."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    e = c.select(k.alias("entity_id"), F.when(k % 2 == 0, F.array(F.lit("a@b.fr"))).otherwise(F.array(F.lit(" "))).alias("emails"), _case("c_custkey", ("https://a.fr", "https://instagram.com/x", None)).alias("u"), F.when(k % 5 == 0, "w").alias("website"), _case("c_custkey", ("N", "", None, "M")).alias("name"), _case("c_custkey", ("", "Rennes", "Lyon", "Paris", None, "Brest", "X")).alias("city"))
    return selection.enrichment_candidates(e.withColumn("other_urls", F.array_compact(F.array("u")))).select("entity_id")


ENRICHMENT_QUEUE = "SELECT c_custkey AS entity_id FROM customer WHERE c_custkey % 2 = 1 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR (c_custkey % 4 = 3 AND c_custkey % 7 NOT IN (0, 4)))"

_BIOS = (("<p>a<br/>b &amp; c</p>", "a|b & c", "Univ. Lyon", "FR"), ("plain", "plain", "MIT, USA", "US"), ("", "", "x", ""), (None, None, None, ""), ("<b>x</b>&nbsp;<i>y</i>", "x   y", "Berlin, Deutschland", "DE"))
_FEEDS = (("<rss><channel><link>https://p.fr</link><language>fr</language><itunes:owner><itunes:email> Jo@P.fr </itunes:email></itunes:owner><item><link>https://no.fr</link></item></channel></rss>", "jo@p.fr", "https://p.fr", "fr"), ("<rss>me@x.fr", "me@x.fr", None, None), ("<rss>", None, None, None), ("<item>a@b.fr", None, None, None))
_ABOUT = ((r'x "/redirect?event=a&q=https%3A%2F%2Fshop.fr%2F#t" "/redirect?a=1&q=https%3A%2F%2Fyoutube.com%2Fy" Business:\nbusiness@firm.com business@firm.comnyc', "https://shop.fr", "business@firm.com"), ("", "", ""), ("jo@firm.fr", "", "jo@firm.fr"))


def landed_pages(spark, sf_dir):
    """Bios, feed heads and about pages as text, links and addresses; a country by its names."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [b[0] for b in _BIOS]).alias("bio"), _case("c_custkey", [b[2] for b in _BIOS]).alias("place"), _case("c_custkey", [f[0] for f in _FEEDS]).alias("feed"), _case("c_custkey", [a[0] for a in _ABOUT]).alias("page"))
    a = profiles.about_page(F.col("page"))
    f = profiles.feed_head(c, "c_custkey", "feed").withColumnsRenamed({"c_custkey": "k"})
    r = c.select("c_custkey", F.replace(profiles.bio_text(F.col("bio")), F.lit("\n"), F.lit("|")).alias("bio"), profiles.infer_country(F.col("place")).alias("country"), F.array_join(a["links"], ",").alias("links"), F.array_join(a["emails"], ",").alias("emails"))
    return r.join(f, F.col("c_custkey") == F.col("k")).drop("k")


LANDED_PAGES = "SELECT c_custkey, " + ", ".join(f"{_case_sql('c_custkey', [r[i] for r in v])} AS {n}" for n, v, i in (("bio", _BIOS, 1), ("country", _BIOS, 3), ("links", _ABOUT, 1), ("emails", _ABOUT, 2), ("email", _FEEDS, 1), ("link", _FEEDS, 2), ("language", _FEEDS, 3))) + " FROM customer"


def contact_keys(spark, sf_dir):
    """Match keys in priority order, and keys across platforms."""
    c = load(spark, sf_dir, "customer")
    k, s = F.col("c_custkey"), _s("c_custkey")
    none = F.array().cast("array<string>")
    keys = entities.match_keys(F.array(F.concat(F.lit(" A"), s, F.lit("@X.fr")), F.lit("bad")), F.when(k % 2 == 0, F.array(F.lit("06 12 34 56 78"), F.lit("12"))).otherwise(none), F.when(k % 3 == 0, "").otherwise(s), F.lit("https://www.W.fr/"), F.array(F.struct(F.lit("maps").alias("name"), F.when(k % 5 == 0, "").otherwise(s).alias("source_id"))))
    cross = entities.cross_platform_keys(F.array(F.lit("A@b.fr"), F.lit("")), F.concat(F.lit("@@An"), s), F.array(F.lit("https://www.own.fr/x"), F.lit("https://youtube.com/c")), F.when(k % 2 == 0, "https://own.fr").otherwise("https://site.fr/a"))
    return c.select("c_custkey", F.array_join(keys, " ").alias("keys"), F.array_join(cross, " ").alias("cross_keys"))


CONTACT_KEYS = """
SELECT k AS c_custkey, 'email:a' || k || '@x.fr' || CASE WHEN k % 2 = 0 THEN ' phone:+33612345678' ELSE '' END || CASE WHEN k % 3 = 0 THEN '' ELSE ' siren:' || k END || ' web:w.fr' || CASE WHEN k % 5 = 0 THEN '' ELSE ' src:maps:' || k END AS keys,
  'email:a@b.fr' || CASE WHEN len('an' || k) >= 4 THEN ' h:an' || k ELSE '' END || CASE WHEN k % 2 = 0 THEN ' host:own.fr' ELSE ' host:site.fr host:own.fr' END AS cross_keys FROM (SELECT c_custkey AS k FROM customer)
"""

_ANSWERS = (("OBJET : Un site\nBonjour,\nvoici.", "Un site", "Bonjour,|voici."), ("Subject: Hi \n\nText", "Hi", "Text"), ("no line", "", "no line"), ("", "", ""), (None, None, None))
_TALK = (("06 12 34 56 78 or 0612345678 or +44 20 7946 0958", "+33612345678,+442079460958"), ("12345", ""), ("call 02.99.00.11.22 now", "+33299001122"), ("", ""))


def answers_phones(spark, sf_dir):
    """A writer's answer as subject and body; phone numbers in free text."""
    c = load(spark, sf_dir, "customer").select("c_custkey", _case("c_custkey", [a[0] for a in _ANSWERS]).alias("a"), _case("c_custkey", [t[0] for t in _TALK]).alias("t"))
    s = text.split_answer(F.col("a"))
    return c.select("c_custkey", s["subject"].alias("subject"), F.replace(s["body"], F.lit("\n"), F.lit("|")).alias("body"), F.array_join(contact.text_phones(F.col("t")), ",").alias("phones"))


ANSWERS_PHONES = f"SELECT c_custkey, {_case_sql('c_custkey', [a[1] for a in _ANSWERS])} AS subject, {_case_sql('c_custkey', [a[2] for a in _ANSWERS])} AS body, {_case_sql('c_custkey', [t[1] for t in _TALK])} AS phones FROM customer"

_PAIRS = (
    (landed_profiles, LANDED_PROFILES), (landed_companies, LANDED_COMPANIES), (landed_places, LANDED_PLACES), (landed_points, LANDED_POINTS), (shared_search, SHARED_SEARCH), (name_repairs, NAME_REPAIRS), (offer_segments, OFFER_SEGMENTS),
    (creator_eligibility, CREATOR_ELIGIBILITY), (enrichment_queue, ENRICHMENT_QUEUE), (landed_pages, LANDED_PAGES), (contact_keys, CONTACT_KEYS), (answers_phones, ANSWERS_PHONES),
)
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
