"""Queries of the text and contact operators over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import classify, contact, dims, score, text
from sieveline.operators import selection
from sieveline.plans import oracle as o
from sieveline.session import load
from sieveline.sources.files import union_sources as union

QUERY = "the and that der nicht"


def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most relevant documents to a query; the score is computed once per row, top-k without a full sort."""
    d = load(spark, sf_dir, "documents")
    # words once per row: an expression used twice inside lambdas is evaluated twice
    d = d.withColumns({"own_words": text.tokens(F.col("source")), "words": text.tokens(F.col("text"))})
    s = score.relevance(F.col("source"), F.col("source"), F.col("text"), F.lit(""), F.col("n_chars"), F.col("lang"), F.lit(""), F.lit(False), F.col("text").contains("@"), QUERY, "en",
                        words=(F.col("own_words"), F.col("own_words"), F.col("words")))
    r = d.select("doc_id", "source", "n_chars", s.alias("raw"))
    top = r.orderBy(F.desc("raw"), F.desc("n_chars"), "source", "doc_id").limit(50)
    return top.select("doc_id", "source", "n_chars", F.round("raw", 6).alias("score"), score.relevance_label(F.col("raw")).alias("label"))


_T = o.tokens("text")
_Q = "['the', 'and', 'that', 'der', 'nicht']"
RELEVANCE = f"""
WITH d AS (SELECT *, len(list_intersect({_Q}, {_T})) AS k, len(text) AS n FROM documents),
s AS (SELECT *, CASE WHEN k > 0 THEN 25.0::DOUBLE * k / 5.0::DOUBLE WHEN regexp_matches(lower(strip_accents(text)), 'and|der|nicht|that|the') THEN 5 ELSE 0 END
  + CASE WHEN n_chars > 0 THEN least(15.0::DOUBLE, 2.0::DOUBLE * log10(greatest(1, n_chars)::DOUBLE)) ELSE 0 END
  + CASE WHEN substr(lower(lang), 1, 2) = 'en' THEN 5 ELSE 0 END
  + CASE WHEN n > 200 THEN 5 WHEN n > 50 THEN 2 ELSE 0 END + CASE WHEN contains(text, '@') THEN 5 ELSE 0 END - CASE WHEN n = 0 THEN 5 ELSE 0 END AS v FROM d),
r AS (SELECT *, greatest(0, least(100, v))::DOUBLE AS raw FROM s)
SELECT doc_id, source, n_chars, round(raw, 6) AS score,
  CASE WHEN raw >= 65 THEN 'très pertinent' WHEN raw >= 45 THEN 'pertinent' WHEN raw >= 25 THEN 'moyen' ELSE 'faible' END AS label
FROM r ORDER BY raw DESC, n_chars DESC, source, doc_id LIMIT 50
"""


def query_language(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    w = d.select("lang", "text", text.tokens(F.col("text")).alias("words"))
    return w.groupBy(text.query_language(F.col("text"), F.col("words")).alias("hint"), "lang").agg(F.count("*").alias("n"))


_count = lambda hints: f"len(list_filter(t, lambda x: x IN ({o.names(dict.fromkeys(hints))})))"
QUERY_LANGUAGE = f"""
WITH d AS (SELECT lang, text, {_T} AS t FROM documents),
c AS (SELECT lang, text, {_count(dims.FRENCH_HINTS)} AS fr, {_count(dims.ENGLISH_HINTS)} AS en FROM d)
SELECT CASE WHEN fr > en THEN 'fr' WHEN en > fr THEN 'en' WHEN regexp_matches(text, '[éèêëàâäîïôöùûüç]') THEN 'fr' ELSE '' END AS hint, lang, count(*) AS n FROM c GROUP BY ALL
"""


def extract_emails(spark, sf_dir):
    """Cleaned addresses of each document, written plainly or spelled out."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(contact.text_emails(F.col("text")), ",").alias("emails")).where("emails <> ''")


RAW_EMAILS = f"(list_transform(regexp_extract_all(text, '{contact.EMAIL_WORD}'), lambda x: lower(x)) || list_transform(regexp_extract_all(text, '{contact.SPELLED}'), lambda x: lower(regexp_replace(x, '{contact.SPELLED}', '\\1@\\2.\\3'))))"
EXTRACT_EMAILS = f"""
WITH {o.clean_emails('documents', 'doc_id', RAW_EMAILS)}
SELECT doc_id, array_to_string(list_sort(list_distinct(list(e)))[1:5], ',') AS emails FROM cleaned GROUP BY doc_id
"""


def clean_email_list(spark, sf_dir):
    """Addresses of each source, cleaned, distinct, best first."""
    d = load(spark, sf_dir, "documents")
    e = d.select("source", F.explode(contact.raw_emails(F.col("text"))).alias("r")).select("source", contact.clean_email(F.col("r")).alias("e")).where("e is not null").distinct()
    return e.select("source", F.col("e").alias("email"), contact.email_rank(F.col("e")).alias("priority"))


CLEAN_EMAIL_LIST = f"""
WITH {o.clean_emails('documents', 'source', RAW_EMAILS)}
SELECT DISTINCT source, e AS email, {o.case_map("split_part(e, '@', 1)", dims.EMAIL_PRIORITY, '10')} AS priority FROM cleaned
"""


def email_status(spark, sf_dir):
    """Customers' written-out addresses under every rejection rule: what cleaning gives for raw variants."""
    c = load(spark, sf_dir, "customer")
    n = F.col("c_custkey") % len(_RAW)
    raw = F.element_at(F.array(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in _RAW]), (n + 1).cast("int"))
    return c.select("c_custkey", F.replace(raw, F.lit("#"), F.col("c_custkey").cast("string")).alias("raw")).select("c_custkey", contact.clean_email(F.col("raw")).alias("email"), F.coalesce(contact.guess_email(F.concat(F.lit("https://www.shop.firm"), F.col("c_custkey").cast("string"), F.lit(".fr/x?y=1"))), F.lit("")).alias("guess"))


#: address variants: plain, noisy, accented, platform, placeholder, glued, technical; `#` is the key
_RAW = ("Jean.#@Firm#.fr", "  contact@links.firm#.io ", "write to anna#@firm.com now", "andré#@firm.fr", "x#@sub.skool.com", "a#@example.com", "b#@gmail.comwebmaster", "only@firm#.fr", ".c#@firm.fr", "d#@www.firm.fr", "e#@o1.ingest.sentry.io", "info#@firm.bretagne",
        "", "  ", None, "Élodie.#@firm.fr", "a#@b#@firm.fr", "œuvre#@firm.fr", "x#@münchen.de", "no address #", "A#@FIRM.COM,b@firm.com", "tel#@shop.firm.co.uk", "user+tag#@firm.museum", "<c#@firm.de>", "c#@firm", "体育#@firm.fr", "q#@firm.fr体")
EMAIL_STATUS = f"""
WITH src AS (SELECT c_custkey, [replace(list_extract([{', '.join('NULL' if x is None else o.names([x]) for x in _RAW)}], (c_custkey % {len(_RAW)} + 1)::INTEGER), '#', c_custkey::VARCHAR)] AS rs FROM customer), {o.clean_emails('src', 'c_custkey', 'rs')}
SELECT c.c_custkey, e AS email, 'contact@firm' || c.c_custkey || '.fr' AS guess FROM customer c LEFT JOIN cleaned k ON c.c_custkey = k.c_custkey
"""


def html_text(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    t = text.html_text(F.col("html"))
    return p.select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


def page_text(c: str) -> str:
    t = f"regexp_replace({c}, '<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<noscript\\b[^>]*>.*?</noscript>|<!--.*?-->', ' ', 'gis')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for a, b in text.ENTITIES:
        t = f"replace({t}, '{a}', '{b}')" if b != "'" else f"replace({t}, '{a}', '''')"
    return f"trim(regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


HTML_TEXT = f"SELECT page_id, md5(t) AS digest, len(t)::BIGINT AS n FROM (SELECT page_id, {page_text('html')} AS t FROM pages)"


def page_contacts(spark, sf_dir):
    """E-mails, phones and ids that each page's visible text shows."""
    p = load(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    e = contact.page_evidence(F.col("t"))
    r = p.select("page_id", e.alias("e"))
    return r.select("page_id", F.array_join("e.emails", ",").alias("emails"), F.array_join("e.postal_codes", ",").alias("postal_codes"), F.array_join("e.company_ids", ",").alias("company_ids"), F.col("e.has_legal").alias("has_legal"))


PAGE_CONTACTS = f"""
WITH src AS (SELECT page_id, {page_text('html')} AS text FROM pages), {o.clean_emails('src', 'page_id', RAW_EMAILS)},
em AS (SELECT page_id, array_to_string(list_sort(list_distinct(list(e)))[1:5], ',') AS emails FROM cleaned GROUP BY page_id)
SELECT s.page_id, coalesce(emails, '') AS emails,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\\b(\\d{{5}})\\b', 1), lambda x: x >= '01000'))), ',') AS postal_codes,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{contact.COMPANY_ID}', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')))), ',') AS company_ids,
  regexp_matches(text, '{contact.LEGAL.replace("(?iu)", "(?i)")}') AS has_legal
FROM src s LEFT JOIN em USING (page_id)
"""


def page_links(spark, sf_dir):
    """Links of each page to its own host and to other, non-social hosts."""
    p = load(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    l = p.select("page_id", contact.host(F.col("url")).alias("h"), F.explode(hrefs).alias("u")).where(~F.col("u").rlike("(?i)^(javascript|mailto|tel):"))
    own = ~F.col("u").rlike("^https?://") | (contact.host(F.col("u")) == F.col("h"))
    return l.groupBy("page_id").agg(F.count_if(own).alias("internal"), F.count_if(~own & ~contact.is_social(F.col("u"))).alias("outbound"))


PAGE_LINKS = f"""
WITH l AS (SELECT page_id, {o.host('url')} AS h, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS u FROM pages),
k AS (SELECT *, (NOT regexp_matches(u, '^https?://')) OR {o.host('u')} = h AS own, regexp_matches(regexp_extract(lower(u), '^(?:https?://(?:www\\.)?|www\\.)([^/\\s]+)', 1), '(?:^|\\.)(?:{o.alternation(dims.SOCIAL_DOMAINS)})$') AS social
      FROM l WHERE NOT regexp_matches(u, '(?i)^(javascript|mailto|tel):'))
SELECT page_id, count(*) FILTER (own) AS internal, count(*) FILTER (NOT own AND NOT social) AS outbound FROM k GROUP BY page_id
"""


def norm_url_dedupe(spark, sf_dir):
    """Pages by normal URL, the first of each."""
    p = load(spark, sf_dir, "pages").select("page_id", contact.norm_url(F.col("url")).alias("key"))
    return p.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


NORM_URL_DEDUPE = f"SELECT {o.norm_url('url')} AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1"


def commercial_signals(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", classify.commercial_signals(F.concat_ws(" ", "url", text.html_text(F.col("html")))).alias("c"))
    return p.select("page_id", F.col("c.monetized").alias("monetized"), F.size("c.urls").alias("n_urls"), F.array_join("c.reasons", "; ").alias("reasons"))


_URL = contact.URL.replace("(?i)", "").replace("'", "''")
_words = " || ".join(f"CASE WHEN regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_]){k.replace('.', chr(92) + '.')}(?:$|[^\\p{{L}}\\p{{N}}_])') THEN ['word:{k}'] ELSE [] END" for k in dict.fromkeys(dims.COMMERCIAL_WORDS))
COMMERCIAL_SIGNALS = f"""
WITH t AS (SELECT page_id, concat_ws(' ', url, {page_text('html')}) AS t FROM pages),
u AS (SELECT *, regexp_extract_all(t, '(?i){_URL}') AS urls, lower(t) AS low FROM t),
m AS (SELECT *, list_filter(urls, lambda x: regexp_matches(x, '{classify.COMMERCIAL}')) AS paid,
  list_filter(urls, lambda x: NOT regexp_matches(x, '{classify.COMMERCIAL}') AND NOT regexp_matches(regexp_extract(lower(x), '^(?:https?://(?:www\\.)?|www\\.)([^/\\s]+)', 1), '(?:^|\\.)(?:{o.alternation(dims.SOCIAL_DOMAINS)})$')) AS own FROM u),
r AS (SELECT *, list_transform(paid, lambda x: 'link:' || substr(x, 1, 60)) || list_transform(own, lambda x: 'site:' || substr(x, 1, 60)) || {_words}
  || CASE WHEN regexp_matches(low, '{classify.PRO_MAILBOX}') THEN ['mailbox'] ELSE [] END AS reasons FROM m)
SELECT page_id, len(reasons) > 0 AS monetized, least(8, len(list_distinct(urls)))::INTEGER AS n_urls, array_to_string(reasons[1:6], '; ') AS reasons FROM r
"""


def keyword_guard(spark, sf_dir):
    """Documents whose words meet any benchmark word, by source: how many, and how many distinct words they meet."""
    words = load(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct()
    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("w"))
    return d.join(words, "w").groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_hits"))


KEYWORD_GUARD = f"""
WITH w AS (SELECT DISTINCT unnest({_T}) AS w FROM benchmark),
d AS (SELECT source, doc_id, unnest(list_distinct({_T})) AS w FROM documents)
SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM d JOIN w USING (w) GROUP BY source
"""


def prefix_collapse(spark, sf_dir):
    """The distinct words of each source that no shorter word of the source begins, from 3 letters on."""
    d = load(spark, sf_dir, "documents").select("source", F.explode(text.tokens(F.col("text"))).alias("w")).where("length(w) >= 3")
    return selection.without_longer(d, ["source"], "w", 3)


PREFIX_COLLAPSE = f"""
WITH k AS MATERIALIZED (SELECT DISTINCT source, w FROM (SELECT source, unnest({_T}) AS w FROM documents) WHERE len(w) >= 3),
p AS (SELECT source, w, substr(w, 1, n::INTEGER) AS pre FROM (SELECT source, w, unnest(range(3, len(w))) AS n FROM k)),
x AS (SELECT DISTINCT coalesce('s' || p.source, '') AS s, p.w FROM p JOIN k ON coalesce('s' || k.source, '') = coalesce('s' || p.source, '') AND k.w = p.pre)
SELECT k.source, k.w FROM k LEFT JOIN x ON x.s = coalesce('s' || k.source, '') AND x.w = k.w WHERE x.w IS NULL
"""


def union_sources(spark, sf_dir):
    d, p, b = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages"), load(spark, sf_dir, "benchmark")
    parts = [d.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text", "lang"), p.select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"), "url"), b.select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")]
    u = union(parts)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("lang").alias("n_lang"), F.count("url").alias("n_url"))


UNION_SOURCES = """
SELECT kind, count(*) AS n, sum(len(text))::BIGINT AS chars, count(lang) AS n_lang, count(url) AS n_url FROM (
 SELECT 'documents' AS kind, text, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'pages', html, NULL, url FROM pages UNION ALL SELECT 'benchmark', text, NULL, NULL FROM benchmark) GROUP BY kind
"""


#: phone variants; `#` is the key in eight digits
_PHONES = ("06 12 #", "0033-1#", "+1 (555) #", "12-34", "", None, "+33 (0)6 #", "00 44 20 #", "tel. 0#6", "０６#", "+#", "07.#", "33 6 # ext 2", " # ", "ABC")


def phone_normalise(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    raw = F.element_at(F.array(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in _PHONES]), (F.col("c_custkey") % len(_PHONES) + 1).cast("int"))
    return c.select("c_custkey", contact.norm_phone(F.replace(raw, F.lit("#"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("phone"))


PHONE_NORMALISE = f"""
WITH p AS (SELECT c_custkey, replace(list_extract([{', '.join('NULL' if x is None else o.names([x]) for x in _PHONES)}], (c_custkey % {len(_PHONES)} + 1)::INTEGER), '#', lpad(c_custkey::VARCHAR, 8, '0')) AS raw FROM customer)
SELECT c_custkey, {o.norm_phone('raw')} AS phone FROM p
"""


def domain_candidates(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    name = F.concat_ws(" ", F.lit("Maison"), F.element_at(F.split("s_name", "#"), 1), F.col("s_suppkey").cast("string"))
    c = s.select("s_suppkey", name.alias("name"))
    r = c.select("s_suppkey", "name", F.posexplode(contact.domain_candidates(F.col("name"))).alias("pos", "domain"))
    return r.select("s_suppkey", "pos", "domain", contact.site_score(F.col("domain"), F.col("name")).alias("score"))


_N = "'Maison ' || split_part(s_name, '#', 1) || ' ' || s_suppkey"
DOMAIN_CANDIDATES = f"""
WITH c AS (SELECT s_suppkey, {_N} AS name FROM supplier),
b AS (SELECT s_suppkey, {o.slug('name')} AS s, 'maison' AS f, array_to_string(list_transform(list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}')), lambda w: substr(w, 1, 1)), '') AS i FROM c),
l AS (SELECT s_suppkey, s, list_filter([s, f, i], lambda x: len(x) >= 3) AS bs FROM b),
e AS (SELECT s_suppkey, s, unnest(list_transform(range(0, 2 * len(bs)), lambda k: {{'pos': k::INTEGER, 'h': bs[(k // 2 + 1)::INTEGER], 'domain': bs[(k // 2 + 1)::INTEGER] || CASE k % 2 WHEN 0 THEN '.fr' ELSE '.com' END}})) AS x FROM l)
SELECT s_suppkey, x.pos AS pos, x.domain AS domain,
 CASE WHEN s = x.h THEN 5 WHEN contains(s, x.h) THEN 3 ELSE 1 END + CASE WHEN ends_with(x.domain, '.fr') THEN 2 ELSE 1 END AS score
FROM e
"""

QUERIES = {f.__name__: f for f in (relevance_topk, query_language, extract_emails, clean_email_list, email_status, html_text, page_contacts, page_links, norm_url_dedupe, commercial_signals, keyword_guard, prefix_collapse, union_sources, phone_normalise, domain_candidates)}
ORACLES = {
    "relevance_topk": RELEVANCE, "query_language": QUERY_LANGUAGE, "extract_emails": EXTRACT_EMAILS, "clean_email_list": CLEAN_EMAIL_LIST, "email_status": EMAIL_STATUS, "html_text": HTML_TEXT, "page_contacts": PAGE_CONTACTS,
    "page_links": PAGE_LINKS, "norm_url_dedupe": NORM_URL_DEDUPE, "commercial_signals": COMMERCIAL_SIGNALS, "keyword_guard": KEYWORD_GUARD, "prefix_collapse": PREFIX_COLLAPSE, "union_sources": UNION_SOURCES, "phone_normalise": PHONE_NORMALISE, "domain_candidates": DOMAIN_CANDIDATES,
}
