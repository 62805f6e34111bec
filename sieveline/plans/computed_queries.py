"""Rules of names, addresses, links, edits and statuses on texts of the tables, with SQL that works the rule out itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import classify, contact, dims, text
from sieveline.operators import completion, records, sites, templates
from sieveline.plans import oracle as o
from sieveline.session import load
from sieveline.sources import profiles


def _sentences(spark, sf_dir):
    """Every sentence of every document in lower case, with elided articles and hyphens put in for some small words."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?;\n]+")).alias("i", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    joined = F.regexp_replace(F.regexp_replace(F.lower("s"), " (?:la|that|das) ", " l'"), " (?:de|the|der) ", "-de-")
    return d.withColumn("n", F.when(F.col("i") % 5 == 4, F.col("s")).otherwise(joined))


_SENTENCES = r"""
d0 AS (SELECT doc_id, unnest(l) AS s0, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split_regex(text, '[.!?;\n]+') AS l FROM documents WHERE text IS NOT NULL)),
d AS (SELECT doc_id, i, trim(s0, ' ') AS s FROM d0 WHERE trim(s0, ' ') <> ''),
x AS (SELECT doc_id, i, s, CASE WHEN i % 5 = 4 THEN s ELSE regexp_replace(regexp_replace(lower(s), ' (?:la|that|das) ', ' l''', 'g'), ' (?:de|the|der) ', '-de-', 'g') END AS n FROM d)"""


def sentence_names(spark, sf_dir):
    """Sentences as names: which are garbage, their display case, and the first name a message would use."""
    s = _sentences(spark, sf_dir)
    return s.select("doc_id", "i", text.display_name(F.col("n")).alias("name"), text.first_name(F.col("n")).alias("first"))


_SMALL, _ELIDED = o.names(dims.SMALL_WORDS), o.names(dims.ELISIONS)
SENTENCE_NAMES = rf"""
WITH {_SENTENCES},
p AS (SELECT *, regexp_extract_all(n, '([\s''’-]*)([^\s''’-]+)', 1) AS j, regexp_extract_all(n, '([\s''’-]*)([^\s''’-]+)', 2) AS w FROM x),
q AS (SELECT *, list_transform(range(1, len(w) + 1), lambda k: regexp_replace(j[k], '\s+', ' ', 'g') || CASE
   WHEN k > 1 AND (CASE WHEN j[k] IN ('''', '’') THEN w[k - 1] NOT IN ({_ELIDED}) WHEN k < len(w) AND j[k + 1] IN ('''', '’') THEN w[k] IN ({_ELIDED}) ELSE w[k] IN ({_SMALL}) END) THEN w[k]
   ELSE replace(upper(substr(w[k], 1, 1)), 'ẞ', 'SS') || substr(w[k], 2) END) AS parts FROM p),
f AS (SELECT *, list_filter(string_split_regex(n, '\s+'), lambda v: regexp_matches(regexp_replace(lower(v), '^[.,()\[\]]+|[.,()\[\]]+$', '', 'g'), '\pL')
   AND regexp_replace(lower(v), '^[.,()\[\]]+|[.,()\[\]]+$', '', 'g') NOT IN ({o.names(text.NO_FIRST_NAME)}))[1] AS fw FROM q)
SELECT doc_id, i::INTEGER AS i, CASE WHEN regexp_matches(n, '\pL') AND NOT regexp_matches(n, '\p{{Lu}}') AND len(n) <= 55 AND len(string_split_regex(n, '\s+')) <= 6 THEN array_to_string(parts, '') || regexp_extract(n, '[\s''’-]*$') ELSE n END AS name,
  coalesce(replace(upper(substr(fw, 1, 1)), 'ẞ', 'SS') || lower(substr(fw, 2)), '') AS first FROM f
"""


def sentence_repairs(spark, sf_dir):
    """Names run together with what follows, proposals against the words they may use, and trades that are one."""
    s = _sentences(spark, sf_dir).withColumn("run", F.concat("s", F.element_at(F.array(*[F.lit(m) for m in (" | ", " — ", ", ", ": ")]), (F.col("i") % 4 + 1).cast("int")), "n"))
    cut = text.split_polluted(F.col("run"))
    fewer = F.regexp_replace("n", r"^\S+\s*", "")
    return s.select("doc_id", "i", text.name_is_polluted(F.col("run")).alias("polluted"), cut["name"].alias("name"), cut["rest"].alias("rest"), text.words_subset(fewer, F.col("s")).alias("subset"), text.industry_is_sane(F.col("s")).alias("sane"))


_WORDS = "list_distinct(regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+'))"
SENTENCE_REPAIRS = rf"""
WITH {_SENTENCES},
y AS (SELECT *, s || list_extract([' | ', ' — ', ', ', ': '], (i % 4 + 1)::INTEGER) || n AS run, regexp_replace(n, '^\S+\s*', '') AS fewer FROM x),
z AS (SELECT *, regexp_matches(trim(run, ' '), '{text.POLLUTED}') AS hit, regexp_extract(trim(run, ' '), '{text.POLLUTED}', 1) AS a, trim(regexp_extract(trim(run, ' '), '{text.POLLUTED}', 2), ' ') AS b FROM y),
c AS (SELECT *, regexp_replace(a, '^[ .,—·|-]+|[ .,—·|-]+$', '', 'g') AS name0 FROM z)
SELECT doc_id, i::INTEGER AS i, len(trim(run, ' ')) > 60 OR hit AS polluted, CASE WHEN hit AND len(name0) BETWEEN 2 AND 60 THEN name0 END AS name, CASE WHEN hit AND len(name0) BETWEEN 2 AND 60 THEN b END AS rest,
  len({_WORDS.format('fewer')}) > 0 AND len(list_filter({_WORDS.format('fewer')}, lambda v: NOT list_contains({_WORDS.format('s')}, v))) = 0 AS subset,
  len(s) BETWEEN 2 AND 40 AND regexp_matches(s, '^[a-zA-ZÀ-ÿ'' \-/&]+$') AS sane FROM c
"""

_DOMAINS = tuple(dict.fromkeys((*dims.HUB_DOMAINS, *dims.HUB_SOCIAL_DOMAINS, *dims.SOCIAL_DOMAINS)))


def link_kinds(spark, sf_dir):
    """Every link of every page, on its own host and on known hubs and networks: which of the three lists it falls under."""
    a = load(spark, sf_dir, "pages").select("page_id", F.posexplode(sites.anchors(F.col("html"))).alias("i", "a"))
    k = F.pmod(F.col("page_id") + 3 * F.col("i"), F.lit(len(_DOMAINS) + 5))
    start = F.element_at(F.array(*[F.lit(x) for x in ("https://", "http://www.", "", "HTTPS://my.", "https://not")]), (F.pmod(F.col("page_id") + F.col("i"), F.lit(5)) + 1).cast("int"))
    other = F.when(k < len(_DOMAINS), F.element_at(F.array(*[F.lit(d) for d in _DOMAINS]), F.least(k + 1, F.lit(len(_DOMAINS))).cast("int"))).otherwise("firm.example")
    u = a.select("page_id", "i", F.concat(start, other, F.lit("/"), F.regexp_replace("a.text", r"\s+", "-")).alias("u"))
    return u.select("page_id", "i", sites.is_hub(F.col("u")).alias("hub"), F.coalesce(sites.is_social_link(F.col("u")), F.lit(False)).alias("network"), contact.is_social(F.col("u")).alias("social"))


_UNDER = "regexp_matches({h}, '(?:^|\\.)(?:{names})$')"
LINK_KINDS = rf"""
WITH t AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>') AS l FROM pages)),
v AS (SELECT page_id, i, regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?s)^[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), '\s+', '-', 'g') AS txt, (page_id + 3 * i) % {len(_DOMAINS) + 5} AS k FROM t),
u AS (SELECT page_id, i, list_extract(['https://', 'http://www.', '', 'HTTPS://my.', 'https://not'], ((page_id + i) % 5 + 1)::INTEGER) || coalesce(list_extract([{o.names(_DOMAINS)}], (k + 1)::INTEGER), 'firm.example') || '/' || txt AS u FROM v),
h AS (SELECT *, regexp_extract(lower(u), '^(?:https?://)?([^/\s?#]+)', 1) AS h1, regexp_extract(lower(u), '^(?:https?://(?:www\.)?|www\.)([^/\s]+)', 1) AS h2 FROM u)
SELECT page_id, i::INTEGER AS i, {_UNDER.format(h='h1', names=o.alternation(dims.HUB_DOMAINS))} AS hub, regexp_matches(u, '(?i)^https?://') AND {_UNDER.format(h='h1', names=o.alternation(dims.HUB_SOCIAL_DOMAINS))} AS network,
  {_UNDER.format(h='h2', names=o.alternation(dims.SOCIAL_DOMAINS))} AS social FROM h
"""


def order_addresses(spark, sf_dir):
    """Addresses put together from each order's columns: postal code and town, and the activity code in its canonical form."""
    x = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(s) for s in v]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    town = F.concat(F.initcap(F.lower(F.substring("o_orderpriority", 3, 20))), pick(5, "", " CEDEX 09", " (Le)", " cedex", " (L')"))
    a = F.concat((k % 1000).cast("string"), F.lit(" rue X"), pick(3, ", ", " ", ", bat 2, "), F.lpad((F.col("o_custkey") * 97 % 100000).cast("string"), 5, "0"), F.lit(" "), town, pick(4, "", ", France", " , FRANCE ", " "))
    code = F.concat(pick(2, "", " "), F.lpad((k % 10000).cast("string"), 4, "0"), pick(3, "z", "A", ""))
    code = F.when(k % 7 == 0, F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 9))).otherwise(code)
    s = contact.split_address(a)
    return x.select("o_orderkey", s["postal_code"].alias("postal_code"), s["city"].alias("city"), classify.activity_code(code).alias("code"))


ORDER_ADDRESSES = r"""
WITH b AS (SELECT o_orderkey AS k, lpad((o_custkey * 97 % 100000)::VARCHAR, 5, '0') AS postal, array_to_string(list_transform(string_split(lower(substr(o_orderpriority, 3, 20)), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS town,
  CASE WHEN o_orderkey % 2 = 1 THEN ' ' ELSE '' END || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || list_extract(['z', 'A', ''], (o_orderkey % 3 + 1)::INTEGER) AS c0 FROM orders),
c AS (SELECT *, replace(replace(upper(trim(CASE WHEN k % 7 = 0 THEN substr(c0, 1, 3) || '.' || substr(c0, 4, 9) ELSE c0 END)), ' ', ''), '.', '') AS c1 FROM b)
SELECT k AS o_orderkey, postal AS postal_code, CASE k % 5 WHEN 2 THEN 'Le ' || town WHEN 4 THEN 'L''' || town ELSE town END AS city, substr(c1, 1, 2) || '.' || substr(c1, 3) AS code FROM c
"""


def turn_edits(spark, sf_dir):
    """Every turn with its first small word exchanged, carried into the turn's HTML, where apostrophes and blanks are entities."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("L'avis : "), F.col("text")).alias("old"))
    c = c.withColumn("new", F.regexp_replace("old", r"^(.*?) (?:la|le|the|to|der|die|que|de) ", "$1 l'ancien "))
    html = F.replace(F.replace("old", F.lit("'"), F.element_at(F.array(F.lit("'"), F.lit("&rsquo;"), F.lit("&#39;")), (F.col("turn") % 3 + 1).cast("int"))), F.lit(" :"), F.lit("&nbsp;:"))
    e = templates.edit_in_place(c.withColumn("page", F.concat(F.lit("<p>"), html, F.lit("</p>"))), "old", "new", "page")
    return e.select("conv_id", "turn", F.sha2("edited", 256).alias("edited"), "applied")


TURN_EDITS = r"""
WITH c AS (SELECT conv_id, turn, 'L''avis : ' || text AS old FROM conversations),
n AS (SELECT *, regexp_replace(old, '^(.*?) (?:la|le|the|to|der|die|que|de) ', '\1 l''ancien ') AS new, '<p>' || replace(replace(old, '''', list_extract(['''', '&rsquo;', '&#39;'], (turn % 3 + 1)::INTEGER)), ' :', '&nbsp;:') || '</p>' AS page FROM c),
a AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(old), len(new)) + 1), lambda i: old[i] <> new[i]), true) - 1, least(len(old), len(new))) AS p FROM n),
b AS (SELECT *, substr(old, p + 1) AS o1, substr(new, p + 1) AS n1 FROM a),
d AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(o1), len(n1)) + 1), lambda i: o1[-i] <> n1[-i]), true) - 1, least(len(o1), len(n1))) AS q FROM b),
e AS (SELECT *, substr(o1, 1, len(o1) - q) AS o2, substr(n1, 1, len(n1) - q) AS n2 FROM d),
f AS (SELECT *, instr(page, o2) AS pos, trim(old, ' ') <> trim(new, ' ') AND trim(o2, ' ') <> '' AND instr(page, o2) > 0 AS ok FROM e)
SELECT conv_id, turn, sha256(CASE WHEN ok THEN substr(page, 1, pos - 1) || n2 || substr(page, pos + len(o2)) ELSE page END) AS edited, ok AS applied FROM f
"""


def source_audiences(spark, sf_dir):
    """Documents by the audience that their sources' names stand for, and those names in words."""
    d = load(spark, sf_dir, "documents")
    s = F.array(F.concat(F.lit("YT_"), "source"), F.col("lang"))
    own = F.element_at(F.array(F.lit("web"), F.lit("MAPS"), F.concat(F.lit("shared_"), "source"), F.col("source"), F.lit("sirene")), (F.length("text") % 5 + 1).cast("int"))
    marked = classify.audience(F.filter(s, lambda x: x.isNotNull() & (F.length(F.col("text")) % 2 == 0)), ("yt_src1", "fr"))
    via = {"shared": "base partagée"}
    words = F.concat_ws("; ", templates.source_label(own, F.when(F.col("lang") == "de", "vu"), via), F.array_join(templates.source_labels(F.array(own, F.upper(own), F.lit("file")), via), ", "))
    return records.audience_counts(d.withColumn("label", words), marked).join(d.select(words.alias("label"), marked.alias("audience")).groupBy("audience", "label").agg(F.count("*").alias("n_label")), "audience")


_LABEL = "CASE " + " ".join(f"WHEN {{0}} = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in templates.SOURCE_LABELS.items()) + " WHEN starts_with({0}, 'shared_') THEN 'profil ' || substr({0}, 8) || ' (base partagée)' ELSE coalesce(nullif({1}, ''), 'source inconnue') END"
SOURCE_AUDIENCES = f"""
WITH d AS (SELECT *, list_extract(['web', 'MAPS', 'shared_' || source, source, 'sirene'], (len(text) % 5 + 1)::INTEGER) AS own, CASE WHEN len(text) % 2 = 0 AND (starts_with(lower('YT_' || source), 'yt_src1') OR coalesce(starts_with(lower(lang), 'fr'), false)) THEN 'creator' ELSE 'pro' END AS audience FROM documents),
e AS (SELECT audience, concat_ws('; ', CASE WHEN lang = 'de' THEN 'vu' ELSE {_LABEL.format('lower(own)', 'own')} END, CASE WHEN coalesce(own, '') = '' THEN '' ELSE {_LABEL.format('lower(own)', 'lower(own)')} || CASE WHEN lower(own) = 'file' THEN '' ELSE ', ' END END || CASE WHEN lower(coalesce(own, '')) = 'file' THEN '' ELSE '{templates.SOURCE_LABELS["file"].replace(chr(39), chr(39) * 2)}' END) AS label FROM d)
SELECT audience, label, count(*) AS n_label, sum(count(*)) OVER (PARTITION BY audience)::BIGINT AS n FROM e GROUP BY audience, label
"""


def user_statuses(spark, sf_dir):
    """Each user's status by the last event, what a reply and a known history make of it, and whether drafts are blocked."""
    e = load(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts", "value"), F.struct("ts", "event_id")).alias("l"), F.max(F.when(F.col("value") > 100, F.col("ts"))).alias("at"))
    status = F.when(F.col("l.event_type") == "purchase", "won").when(F.col("l.event_type") == "error", "Bounced").when(F.col("l.event_type") == "signup", "replied").when(F.col("l.value") > 60, "refused").otherwise("contacted")
    kind = F.when(F.col("l.value") > 150, "client").when(F.col("l.value") > 30, "mail")
    r = last.select("user_id", status.alias("s"), kind.alias("kind"), F.date_format("at", "yyyy-MM-dd").alias("at"))
    h = records.after_history(F.col("s"), F.lit("old"), F.col("kind"), F.col("at"))
    return r.select("user_id", records.after_reply(F.col("s")).alias("replied"), records.blocked(F.col("s")).alias("blocked"), h["status"].alias("known"), h["last_contact_at"].alias("contacted_at"))


USER_STATUSES = """
WITH l AS (SELECT user_id, arg_max({'t': event_type, 'v': value}, {'a': ts, 'b': event_id}) AS l, strftime(max(ts) FILTER (value > 100), '%Y-%m-%d') AS seen FROM events GROUP BY user_id),
r AS (SELECT user_id, seen, l.v AS v, CASE WHEN l.t = 'purchase' THEN 'won' WHEN l.t = 'error' THEN 'Bounced' WHEN l.t = 'signup' THEN 'replied' WHEN l.v > 60 THEN 'refused' ELSE 'contacted' END AS s FROM l)
SELECT user_id, CASE WHEN s IN ('replied', 'won', 'lost', 'refused') THEN s ELSE 'replied' END AS replied, CASE WHEN lower(s) IN ('unsubscribed', 'bounced', 'refused', 'won', 'lost') THEN lower(s) END AS blocked,
  CASE WHEN v > 150 THEN 'won' WHEN v > 30 THEN 'contacted' ELSE s END AS known, CASE WHEN v > 30 THEN coalesce(seen, 'old') ELSE 'old' END AS contacted_at FROM r
"""

_TRADES = ("courtier", "Courtage en énergie", "Expert-comptable", "avocat", "Agence immobilière", "diagnostiqueur", "agent", "mandataire immo", "IOBSP", "boulanger")


def trade_offers(spark, sf_dir):
    """Trades put together from each part's columns: the segment of the exclusive offer, and who must get it."""
    p = load(spark, sf_dir, "part")
    t = F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in _TRADES]), (F.pmod(F.col("p_size") + F.col("p_partkey"), F.lit(len(_TRADES))) + 1).cast("int")), F.col("p_name"), F.when(F.col("p_retailprice") % 3 < 1, "travaux").when(F.col("p_retailprice") % 3 < 2, "DPE"))
    w = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("https://"), F.regexp_replace("p_brand", "#", ""), F.lit(".fr"))).when(F.col("p_size") % 3 == 1, " ")
    return p.select("p_partkey", classify.offer_segment(t).alias("segment"), classify.offer_required(t, w).alias("required"))


TRADE_OFFERS = f"""
WITH t AS (SELECT p_partkey, p_size, lower(strip_accents(list_extract([{o.names(_TRADES)}], ((p_size + p_partkey) % {len(_TRADES)} + 1)::INTEGER) || ' ' || p_name || CASE WHEN p_retailprice % 3 < 1 THEN ' travaux' WHEN p_retailprice % 3 < 2 THEN ' DPE' ELSE '' END)) AS s FROM part),
g AS (SELECT *, CASE WHEN regexp_matches(s, 'diagnost|dpe') THEN '' WHEN regexp_matches(s, 'courtier|courtage|iobsp') THEN CASE WHEN regexp_matches(s, 'travaux|energie|demenag') THEN '' ELSE 'courtier' END WHEN contains(s, 'comptab') THEN 'comptable'
  WHEN contains(s, 'avocat') THEN 'avocat' WHEN regexp_matches(s, 'agence immobiliere|agent immobilier|mandataire immo|immobilier') THEN 'immo' ELSE '' END AS segment FROM t)
SELECT p_partkey, segment, CASE WHEN segment <> '' AND p_size % 3 = 0 THEN 'advisory' ELSE '' END AS required FROM g
"""


def turn_answers(spark, sf_dir):
    """Every turn as a writer's answer, its first sentence as the subject line: subject and body apart."""
    c = load(spark, sf_dir, "conversations")
    mark = F.element_at(F.array(F.lit("OBJET : "), F.lit("subject:"), F.lit("  Objet： "), F.lit("Sujet : ")), (F.col("turn") % 4 + 1).cast("int"))
    s = text.split_answer(F.concat(F.when(F.col("conv_id") % 2 == 0, "\n").otherwise(""), mark, F.regexp_extract("text", r"^[^.\n]*", 0), F.lit("  \n\n"), F.col("text"), F.lit("\n ")))
    return c.select("conv_id", "turn", s["subject"].alias("subject"), F.sha2(s["body"], 256).alias("body"))


TURN_ANSWERS = r"""
WITH a AS (SELECT conv_id, turn, text, list_extract(['OBJET : ', 'subject:', '  Objet： ', 'Sujet : '], (turn % 4 + 1)::INTEGER) AS mark, regexp_extract(text, '^[^.\n]*') AS first FROM conversations),
b AS (SELECT *, turn % 4 < 3 AND trim(first, ' ') <> '' AS has FROM a)
SELECT conv_id, turn, CASE WHEN has THEN trim(first, ' ') ELSE '' END AS subject, sha256(regexp_replace(CASE WHEN has THEN text ELSE mark || first || '  ' || chr(10) || chr(10) || text END, '^\s+|\s+$', '', 'g')) AS body FROM b
"""


def page_bios(spark, sf_dir):
    """Every page read as a bio: its text, and the country that its words name."""
    p = load(spark, sf_dir, "pages").withColumn("b", profiles.bio_text(F.regexp_replace(F.col("html"), "[\r\n]+", " ")))
    place = F.concat_ws(" ", F.element_at(F.array(F.lit("Lyon"), F.lit("U.S.A"), F.lit("Germany"), F.lit("United Kingdom"), F.lit("")), (F.length("b") % 5 + 1).cast("int")), "b")
    return p.select("page_id", F.sha2("b", 256).alias("bio"), profiles.infer_country(place).alias("country"))


PAGE_BIOS = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '[\r\n]+', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\s+\n', chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '^\s+|\s+$', '', 'g') AS b FROM b),
d AS (SELECT *, lower(list_extract(['Lyon', 'U.S.A', 'Germany', 'United Kingdom', ''], (len(b) % 5 + 1)::INTEGER) || ' ' || b) AS p FROM c)
SELECT page_id, sha256(b) AS bio, CASE WHEN regexp_matches(p, 'france|paris|lyon|marseille') THEN 'FR' WHEN regexp_matches(p, 'u\.s\.a|usa|united states') THEN 'US' WHEN regexp_matches(p, 'united kingdom|u\.k\.') THEN 'GB' WHEN regexp_matches(p, 'deutschland|germany') THEN 'DE' ELSE '' END AS country FROM d
"""



def own_sites(spark, sf_dir):
    """The first link of each page that leads to a site of its own: neither social nor hosted elsewhere."""
    a = load(spark, sf_dir, "pages").select("page_id", sites.anchors(F.col("html")).alias("a"))
    start = F.array(*[F.lit(x) for x in ("https://", "http://www.", "", "https://my.", "https://[")])
    hosts = F.array(*[F.lit(d) for d in (*_DOMAINS, *dims.PLATFORM_DOMAINS, "firm.example", "")])
    n = len(set(_DOMAINS)) + len(dims.PLATFORM_DOMAINS) + 2
    # a page tries few of its links on its own host, most on others'
    made = F.transform("a", lambda x, i: F.concat(F.element_at(start, (F.pmod(F.col("page_id") + i, F.lit(5)) + 1).cast("int")), F.element_at(hosts, (F.pmod(F.col("page_id") * 7 + 11 * i, F.lit(n)) + 1).cast("int")), F.lit("/"), F.regexp_replace(x["text"], r"\s+", "-")))
    return a.select("page_id", completion.first_own_site(made).alias("site"), F.size(F.filter(made, completion.hosted_elsewhere)).alias("n_elsewhere"))


_ALL = (*_DOMAINS, *dims.PLATFORM_DOMAINS, "firm.example", "")
OWN_SITES = rf"""
WITH t AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>') AS l FROM pages)),
v AS (SELECT page_id, i, regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?s)^[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), '\s+', '-', 'g') AS txt FROM t),
u AS (SELECT page_id, i, list_extract(['https://', 'http://www.', '', 'https://my.', 'https://['], ((page_id + i) % 5 + 1)::INTEGER) || list_extract([{o.names(_ALL)}], ((page_id * 7 + 11 * i) % {len(_ALL)} + 1)::INTEGER) || '/' || txt AS u FROM v),
n AS (SELECT *, regexp_extract(CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || u END, '^https?://([^/?#]*)', 1) AS net, CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || u END AS w FROM u),
h AS (SELECT *, CASE WHEN net <> '' THEN net ELSE regexp_extract(w, '^https?://([^?#]*)', 1) END AS host, regexp_extract(lower(u), '^(?:https?://(?:www\.)?|www\.)([^/\s]+)', 1) AS soc FROM n),
d AS (SELECT *, {o.norm_domain('host')} AS nd FROM h),
e AS (SELECT page_id, i, u, NOT contains(net, '[') AND {o.platform('nd')} AS elsewhere, {_UNDER.format(h='soc', names=o.alternation(dims.SOCIAL_DOMAINS))} AS social FROM d)
SELECT page_id, arg_min(u, i) FILTER (NOT elsewhere AND NOT social) AS site, (count(i) FILTER (elsewhere))::INTEGER AS n_elsewhere FROM (SELECT page_id FROM pages) LEFT JOIN e USING (page_id) GROUP BY page_id
"""


def repair_patches(spark, sf_dir):
    """Sentences as records that a reviewer sent back: cut where two things run together, else repaired by what is proposed, and once only."""
    s = _sentences(spark, sf_dir)
    i = F.col("i")
    r = s.select(
        "doc_id", "i", F.when(i % 3 == 0, F.concat("s", F.lit(" | "), "n")).otherwise(F.col("s")).alias("name"), F.when(i % 2 == 0, F.lit(" ")).otherwise(F.col("n")).alias("description"), F.lit("métier").alias("industry"),
        F.when(i % 7 == 6, F.array(F.lit("x"), F.lit(completion.REPAIRED))).when(i % 7 == 5, F.array(F.lit("x"))).alias("tags"), F.when(i % 4 == 3, "ok").otherwise("draft").alias("verdict"), (i % 11 == 10).alias("engine_down"),
        F.when(i % 5 == 1, F.regexp_replace("s", r"^\S+\s*", "")).when(i % 5 == 2, F.concat("s", F.lit(" zzz"))).alias("proposed_name"), F.when(i % 6 < 3, F.substring("s", 1, 12)).alias("proposed_industry"))
    p = completion.repaired(r)
    return p.select("doc_id", "i", "name", "description", "industry", F.array_join("repaired_fields", ",").alias("fields"), F.array_join("tags", ",").alias("tags"))


REPAIR_PATCHES = rf"""
WITH {_SENTENCES},
r AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN s || ' | ' || n ELSE s END AS name, CASE WHEN i % 2 = 0 THEN ' ' ELSE n END AS description, i % 7 AS tag, i % 4 <> 3 AND i % 11 <> 10 AND i % 7 <> 6 AS due,
  CASE WHEN i % 5 = 1 THEN regexp_replace(s, '^\S+\s*', '') WHEN i % 5 = 2 THEN s || ' zzz' END AS pn, CASE WHEN i % 6 < 3 THEN substr(s, 1, 12) END AS pi FROM x),
z AS (SELECT *, regexp_matches(trim(name, ' '), '{text.POLLUTED}') AS hit, regexp_replace(regexp_extract(trim(name, ' '), '{text.POLLUTED}', 1), '^[ .,—·|-]+|[ .,—·|-]+$', '', 'g') AS a, trim(regexp_extract(trim(name, ' '), '{text.POLLUTED}', 2), ' ') AS b FROM r),
k AS (SELECT *, due AND hit AND len(a) BETWEEN 2 AND 60 AS cut, name || ' ' || description || ' métier' AS own FROM z),
q AS (SELECT *, CASE WHEN cut THEN a WHEN due AND len({_WORDS.format("coalesce(pn, '')")}) > 0 AND len(list_filter({_WORDS.format("coalesce(pn, '')")}, lambda v: NOT list_contains({_WORDS.format('own')}, v))) = 0 THEN pn END AS nn,
  CASE WHEN cut AND trim(description, ' ') = '' THEN b END AS nd, CASE WHEN due AND NOT cut AND len(trim(coalesce(pi, ''), ' ')) BETWEEN 2 AND 40 AND regexp_matches(trim(pi, ' '), '^[a-zA-ZÀ-ÿ'' \-/&]+$') THEN pi END AS ni FROM k)
SELECT doc_id, i::INTEGER AS i, coalesce(nn, name) AS name, coalesce(nd, description) AS description, coalesce(ni, 'métier') AS industry,
  nullif(concat_ws(',', CASE WHEN nd IS NOT NULL THEN 'description' END, CASE WHEN ni IS NOT NULL THEN 'industry' END, CASE WHEN nn IS NOT NULL THEN 'name' END), '') AS fields,
  CASE WHEN coalesce(nn, nd, ni) IS NOT NULL THEN concat_ws(',', CASE WHEN tag = 5 THEN 'x' END, '{completion.REPAIRED}') WHEN tag = 6 THEN 'x,{completion.REPAIRED}' WHEN tag = 5 THEN 'x' END AS tags FROM q
"""


def federated_accounts(spark, sf_dir):
    """Accounts of three listings as one: the first listing that has a key gives the row, and how many each may still write to."""
    c, x, e = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), load(spark, sf_dir, "events")
    key = lambda k: completion.platform_key(F.when(k % 3 == 0, "live").when(k % 3 == 1, "video"), k)
    one = e.select(key(F.col("user_id") * 2).alias("key"), F.col("event_id").alias("place"), F.col("event_type").alias("name"))
    two = x.select(key(F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("name"))
    three = c.select(key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("place"), F.col("c_name").alias("name"))
    r = completion.first_of_sources([one, two, three], "key", "place")
    cap = completion.effective_cap(F.lit(40), F.lit(30), F.when(F.col("source_no") < 2, F.pmod("place", F.lit(50))), F.length("name"))
    return r.select("key", "source_no", "place", "name", cap.cast("long").alias("cap"))


FEDERATED_ACCOUNTS = """
WITH u AS (SELECT user_id * 2 AS k, 0 AS source_no, event_id AS place, event_type AS name FROM events UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderpriority FROM orders UNION ALL SELECT c_custkey, 2, c_custkey, c_name FROM customer),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_no, place, name) = 1)
SELECT CASE k % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'video' ELSE '' END || '|' || k AS key, source_no, place, name, greatest(0, least(40, 30 - CASE WHEN source_no < 2 THEN place % 50 ELSE 0 END, len(name)))::BIGINT AS cap FROM f
"""


def filled_contacts(spark, sf_dir):
    """Customers' lists filled from a bio where they are empty."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    s = k.cast("string")
    bio = F.concat(F.lit("Pro "), "c_mktsegment", F.lit(" anna"), s, F.lit("@firm"), s, F.lit(".fr, 06 "), F.regexp_replace(F.lpad(s, 8, "0"), "(..)(..)(..)(..)", "$1 $2 $3 $4"), F.lit(" https://firm"), s, F.lit(".fr/x"))
    none = F.array().cast("array<string>")
    given = lambda n, v: F.when(k % n == 0, F.array(F.lit(v))).when(k % n == 1, none)
    r = completion.filled_from_bio(c.select("c_custkey", bio.alias("description"), given(3, "a@b.fr").alias("emails"), given(4, "+33100000000").alias("phones"), given(5, "https://own.fr").alias("urls_in_bio")))
    return r.select("c_custkey", *[F.array_join(x, ",").alias(x) for x in ("emails", "phones", "urls_in_bio")])


FILLED_CONTACTS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.fr' ELSE 'anna' || c_custkey || '@firm' || c_custkey || '.fr' END AS emails,
  CASE WHEN c_custkey % 4 = 0 THEN '+33100000000' ELSE '+336' || lpad(c_custkey::VARCHAR, 8, '0') END AS phones, CASE WHEN c_custkey % 5 = 0 THEN 'https://own.fr' ELSE 'https://firm' || c_custkey || '.fr/x' END AS urls_in_bio FROM customer
"""

_PAIRS = (
    (sentence_names, SENTENCE_NAMES), (sentence_repairs, SENTENCE_REPAIRS), (link_kinds, LINK_KINDS), (order_addresses, ORDER_ADDRESSES), (turn_edits, TURN_EDITS), (source_audiences, SOURCE_AUDIENCES), (user_statuses, USER_STATUSES),
    (trade_offers, TRADE_OFFERS), (turn_answers, TURN_ANSWERS), (page_bios, PAGE_BIOS),
    (own_sites, OWN_SITES), (repair_patches, REPAIR_PATCHES), (federated_accounts, FEDERATED_ACCOUNTS), (filled_contacts, FILLED_CONTACTS))
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
