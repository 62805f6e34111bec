"""Landed profile sources: raw JSON, XML or page records as entity rows. Projections only, no network.

Each function takes a DataFrame of landed records and returns entity columns; records that the
source's rules drop are filtered, so predicates and column pruning reach the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.classify import commercial_signals, section_label
from sieveline.functions.contact import EMAIL, clean_email, collapse_prefixes, is_social, text_emails, text_phones
from sieveline.functions.text import blank

_NONE = "array<string>"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast(_NONE)


def from_profiles(raw: DataFrame, include_commercial: bool = True) -> DataFrame:
    """Creator profiles: contacts and commercial signals from the description; records without an id go.

    ``raw`` has ``platform, id, name, handle, description, subscribers, language, country, url``.
    """
    s = commercial_signals(F.col("description"))
    out = raw.where(blank(F.col("id").cast("string")).isNotNull()).withColumn("_s", s)
    if not include_commercial:
        out = out.where(~F.col("_s.monetized"))
    emails = F.coalesce(text_emails(F.col("description")), F.array().cast(_NONE))
    meta = F.transform(emails, lambda e: F.struct(e.alias("email"), F.concat_ws("_", F.lit("profile"), blank(F.col("platform"))).alias("source"), F.col("id").cast("string").alias("source_id"), _text("url").alias("url")))
    return out.select(
        _text("name").alias("name"), _text("handle").alias("handle"), emails.alias("emails"), meta.alias("emails_meta"), F.coalesce(text_phones(F.col("description")), F.array().cast(_NONE)).alias("phones"),
        F.slice("_s.urls", 1, 8).alias("other_urls"), _text("country").alias("country"), _text("language").alias("language"), _text("platform").alias("industry"), F.substring(_text("description"), 1, 2000).alias("description"),
        F.col("_s.monetized").alias("monetized"), F.col("_s.reasons").alias("monetization_reasons"), "subscribers", _text("url").alias("platform_url"), F.array(F.struct(_text("platform").alias("name"), F.col("id").cast("string").alias("source_id"))).alias("sources"))


def from_registry(items: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Company registry records; those without an id or a name go.

    ``items`` has ``siren, nom_complet, nom_raison_sociale, siege (struct), activite_principale,
    section_activite_principale``; ``labels`` is an optional ``(k, v)`` table of activity labels,
    looked up before the section label and the raw code.
    """
    name = F.coalesce(blank(F.col("nom_complet")), blank(F.col("nom_raison_sociale")))
    r = items.where(blank(F.col("siren")).isNotNull() & name.isNotNull())
    code = F.col("activite_principale")
    known = F.lit(None).cast("string")
    if labels is not None:
        r = r.join(labels.select(F.col("k").alias("_k"), F.col("v").alias("_v")), code == F.col("_k"), "left")
        known = F.col("_v")
    industry = F.coalesce(known, section_label(F.col("section_activite_principale")), code, F.lit(""))
    part = lambda k: blank(F.col(f"siege.{k}").cast("string"))
    city = F.coalesce(F.col("siege.libelle_commune"), F.lit(""))
    return r.select(
        name.alias("name"), name.alias("legal_name"), "siren", F.concat_ws(" ", part("numero_voie"), part("type_voie"), part("libelle_voie")).alias("address"), F.coalesce(F.col("siege.code_postal"), F.lit("")).alias("postal_code"),
        city.alias("city"), F.lit("FR").alias("country"), industry.alias("industry"), F.coalesce(code, F.lit("")).alias("naf_code"), F.concat_ws(" · ", blank(industry), F.concat(F.lit("SIREN "), "siren"), blank(city)).alias("description"), F.lit("fr").alias("language"),
        F.array(F.struct(F.lit("sirene").alias("name"), F.col("siren").alias("source_id"))).alias("sources"))


def from_places(items: DataFrame) -> DataFrame:
    """Map places; nameless and closed ones go. The international phone number wins over the national one."""
    r = items.where(blank(F.col("displayName.text")).isNotNull() & ~F.coalesce("businessStatus", F.lit("")).isin("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY"))
    address = F.coalesce(blank(F.col("formattedAddress")), F.col("shortFormattedAddress"))
    part = F.try_element_at(F.filter(F.transform(F.split(address, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{5}\s+.+$")), F.lit(1))
    kind = F.coalesce(blank(F.col("primaryType")), F.try_element_at("types", F.lit(1)), F.lit(""))
    rating = F.when(F.col("rating") > 0, F.concat(F.lit("⭐ "), F.col("rating").cast("string"), F.lit(" ("), F.coalesce("userRatingCount", F.lit(0)).cast("string"), F.lit(" avis)")))
    bits = F.coalesce(blank(F.col("primaryType")), F.array_join(F.slice("types", 1, 2), " / "))
    return r.select(
        F.col("displayName.text").alias("name"), _list(F.coalesce(blank(F.col("internationalPhoneNumber")), blank(F.col("nationalPhoneNumber")))).alias("phones"), _text("websiteUri").alias("website"), _text("formattedAddress").alias("address"),
        F.coalesce(F.trim(F.regexp_extract(part, r"^\d{5}\s+(.+)$", 1)), F.lit("")).alias("city"), F.coalesce(F.regexp_extract(part, r"^(\d{5})", 1), F.lit("")).alias("postal_code"), F.lit("FR").alias("country"), kind.alias("industry"),
        F.concat_ws(" · ", blank(bits), rating).alias("description"), F.lit("fr").alias("language"), F.array(F.struct(F.lit("maps").alias("name"), _text("id").alias("source_id"))).alias("sources"))


#: tags that say what a point of interest is, in order; fixed values
POI_KINDS = ("amenity", "shop", "craft", "office", "tourism", "healthcare", "leisure")


def from_points(elements: DataFrame, require_email: bool = True) -> DataFrame:
    """Points of interest from tag maps, one per type and id; nameless ones go, and by default those without e-mail."""
    tag = lambda k: F.trim(F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")))
    mails = F.split(F.concat_ws(";", tag("contact:email"), tag("email")), ";")
    emails = F.array_distinct(F.filter(F.transform(mails, lambda e: F.lower(F.trim(e))), lambda e: e.contains("@")))
    site = F.coalesce(blank(tag("contact:website")), tag("website"))
    site = F.when((site != "") & ~site.rlike("^https?://"), F.concat(F.lit("https://"), site)).otherwise(site)
    kind = F.coalesce(*[F.when(tag(k) != "", F.concat_ws("=", F.lit(k), tag(k))) for k in POI_KINDS])
    street = F.when(tag("addr:street") != "", F.concat_ws(" ", blank(tag("addr:housenumber")), tag("addr:street"), blank(tag("addr:postcode")), blank(tag("addr:city"))))
    cuisine = F.when(tag("cuisine") != "", F.concat(F.lit("cuisine: "), tag("cuisine")))
    country = F.coalesce(blank(F.upper(tag("addr:country"))), F.lit("FR"))
    r = elements.where(tag("name") != "").dropDuplicates(["type", "id"])
    out = r.select(
        F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), tag("name").alias("name"), F.substring(F.concat_ws("\n", kind, blank(tag("description")), cuisine, street), 1, 2000).alias("description"), emails.alias("emails"),
        F.array_distinct(_list(blank(tag("contact:phone")), blank(tag("phone")))).alias("phones"), site.alias("website"), tag("addr:city").alias("city"), tag("addr:postcode").alias("postal_code"), country.alias("country"), F.when(country == "FR", "fr").otherwise("").alias("language"))
    return out.where(F.size("emails") > 0) if require_email else out


def feed_head(feeds: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Owner address, link and language of a podcast feed, from what stands before its first item."""
    head = F.substring_index(F.col(body_col), "<item", 1)
    one = lambda p: blank(F.trim(F.regexp_extract(head, p, 1)))
    email = F.coalesce(one(r"(?is)<itunes:owner>.*?<itunes:email>\s*([^<]+)</itunes:email>"), one(r"(?is)<itunes:email>\s*([^<]+)</itunes:email>"), blank(F.regexp_extract(head, r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0)))
    return feeds.select(id_col, F.lower(email).alias("email"), one(r"(?is)<link>\s*([^<\s]+)\s*</link>").alias("link"), one(r"(?i)<language>\s*([a-z\-]+)\s*</language>").alias("language"))


def about_page(html: Column, own_hosts: str = r"youtube\.com|youtu\.be", redirect: str = r"/redirect\?[^\"'\s]*?[?&]q=([^&\"'\s]+)") -> Column:
    """``struct(emails, links)`` of a channel's about page: redirects unwrapped, own links dropped, addresses cleaned."""
    t = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("\\u0026", "&"), ("&amp;", "&"), ("\\n", " "), ("\\r", " "), ("\\t", " ")), html)
    links = F.transform(F.regexp_extract_all(t, F.lit(redirect), F.lit(1)), lambda u: F.regexp_replace(F.substring_index(F.try_url_decode(u), "#", 1), "/+$", ""))
    links = F.array_distinct(F.filter(links, lambda u: (F.coalesce(u, F.lit("")) != "") & ~u.rlike(own_hosts)))
    raw = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), F.lit(0)), lambda e: F.lower(e)))
    emails = F.array_distinct(F.filter(F.transform(collapse_prefixes(raw), clean_email), lambda e: e.isNotNull()))
    return F.struct(F.slice(emails, 1, 5).alias("emails"), F.slice(links, 1, 10).alias("links"))


def bio_text(html: Column) -> Column:
    """Text of a short HTML bio; line and paragraph ends become new lines."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+\n", "\n"), r"[ \t]+", " ")
    t = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")), t)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def join_fields(fields: Column) -> Column:
    """``name: value`` lines of a list of ``struct(name, value)``; valueless ones are left out."""
    line = lambda f: F.when(bio_text(f["value"]) != "", F.concat_ws(": ", blank(f["name"]), bio_text(f["value"])))
    return F.array_join(F.array_compact(F.transform(fields, line)), "\n")


def infer_country(c: Column) -> Column:
    a = F.lower(F.coalesce(c, F.lit("")))
    return F.when(a.rlike("france|paris|lyon|marseille"), "FR").when(a.rlike(r"u\.s\.a|usa|united states"), "US").when(a.rlike(r"united kingdom|u\.k\."), "GB").when(a.rlike("deutschland|germany"), "DE").otherwise("")


#: status words of older collections; fixed values
LEGACY_STATUS = {
    "new": "new", "à contacter": "qualified", "a contacter": "qualified", "to_contact": "qualified", "contacté": "contacted", "contacte": "contacted", "contacted": "contacted",
    "a répondu": "replied", "a repondu": "replied", "replied": "replied", "refus": "refused", "refused": "refused",
}


def legacy_status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = None
    for k, v in LEGACY_STATUS.items():
        out = F.when(s == k, v) if out is None else out.when(s == k, v)
    return out.otherwise("new")


def search_shared(entities: DataFrame, platform: str = "", min_subscribers: int | None = None, max_subscribers: int | None = None, country: str = "", language: str = "",
                  only_with_email: bool = False, only_uncontacted: bool = True, monetized_only: bool = False) -> DataFrame:
    """The shared base under up to eight predicates; paging is ``selection.seeded_page``."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    tests = [
        (platform, lambda: low("industry") == platform.strip().lower()), (min_subscribers is not None, lambda: F.col("subscribers") >= min_subscribers), (max_subscribers is not None, lambda: F.col("subscribers") <= max_subscribers),
        (country, lambda: low("country") == country.strip().lower()), (language, lambda: low("language") == language.strip().lower()), (only_with_email, lambda: F.size("emails") > 0),
        (only_uncontacted, lambda: low("status").isin("new", "qualified", "")), (monetized_only, lambda: F.col("monetized")),
    ]
    return reduce(lambda d, t: d.where(t[1]()) if t[0] else d, tests, entities)


def enrich(left: DataFrame, right: DataFrame, key: str, text: str = "description") -> DataFrame:
    """Left rows with the text of the right appended on a new line where the key is known; the first text per key counts."""
    r = right.groupBy(key).agg(F.min(text).alias("_t"))
    return left.join(r, key, "left").withColumn(text, F.concat_ws("\n", blank(F.col(text)), blank(F.col("_t")))).drop("_t")


def own_site(urls: Column) -> Column:
    """The first URL that leads to no social host, null if none."""
    return F.try_element_at(F.filter(urls, lambda u: ~is_social(u)), F.lit(1))


LEGACY_RECORD = ("platform string, id string, name string, handle string, emails array<string>, emails_meta array<struct<email:string,source:string,source_id:string,url:string,context:string,found_at:string>>, "
                 "phones array<string>, urls_in_bio array<string>, country string, language string, description string, monetized boolean, monetization_reasons array<string>, subscribers long, url string, "
                 "status string, tags array<string>, notes string, found_at string")


def from_legacy(raw: DataFrame, origin: str = "profile", source: str = "legacy") -> DataFrame:
    """Records of the older collection (``LEGACY_RECORD``) as entities.

    An address keeps the provenance it has; where the record has none, every address comes from the
    profile it stood in. Statuses map by ``legacy_status``; descriptions are cut at 2,000.
    """
    none = lambda c: F.coalesce(F.col(c), F.array().cast(_NONE))
    platform = _text("platform")
    given = F.filter(F.coalesce("emails_meta", F.array()), lambda m: F.coalesce(m["email"], F.lit("")) != "")
    own = F.transform(F.filter(none("emails"), lambda e: e != ""), lambda e: F.struct(
        e.alias("email"), F.when(platform != "", F.concat_ws("_", F.lit(origin), platform)).otherwise(origin).alias("source"), _text("id").alias("source_id"), _text("url").alias("url"),
        F.when(platform != "", F.concat(F.lit("bio / profil "), platform)).otherwise("profil créateur").alias("context"), _text("found_at").alias("found_at")))
    return raw.select(
        _text("name").alias("name"), _text("handle").alias("handle"), none("emails").alias("emails"), F.when(F.size(F.coalesce("emails_meta", F.array())) > 0, given).otherwise(own).alias("emails_meta"), none("phones").alias("phones"),
        F.lit("").alias("website"), F.filter(none("urls_in_bio"), lambda u: u.isNotNull()).alias("other_urls"), _text("country").alias("country"), _text("language").alias("language"), platform.alias("industry"),
        F.substring(_text("description"), 1, 2000).alias("description"), F.coalesce("monetized", F.lit(False)).alias("monetized"), none("monetization_reasons").alias("monetization_reasons"), F.col("subscribers").cast("long").alias("subscribers"),
        _text("url").alias("platform_url"), legacy_status(F.col("status")).alias("status"), none("tags").alias("tags"), _text("notes").alias("notes"),
        F.array(F.struct(F.lit(source).alias("name"), F.concat_ws("|", platform, _text("id")).alias("source_id"), _text("url").alias("url"), _text("found_at").alias("found_at"))).alias("sources"))


def match_packages(packages: DataFrame, query: str) -> DataFrame:
    """Packages whose name holds a word of the query between separators, or begins or ends with it at a dash."""
    words = [re.escape(t.lower()) for t in re.split(r"\W+", query) if len(t) >= 2]
    if not words:
        return packages.limit(0)
    return packages.where(F.lower(F.trim("name")).rlike(rf"(?:^|[\W_])(?:{'|'.join(words)})(?:[\W_]|$)"))


def from_packages(meta: DataFrame) -> DataFrame:
    """Package metadata as profiles: author's name, addresses of author and maintainer, first links, summary and text.

    ``meta`` has ``name, author, maintainer, author_email, maintainer_email, summary, description,
    home_page, project_urls`` (a map).
    """
    mails = lambda c: F.regexp_extract_all(_text(c), F.lit(EMAIL), F.lit(0))
    emails = F.array_distinct(F.transform(F.concat(mails("author_email"), mails("maintainer_email")), lambda e: F.lower(e)))
    who = F.trim(F.substring_index(F.coalesce(blank(F.col("author")), blank(F.col("maintainer")), F.lit("")), "<", 1))
    web = F.array_distinct(F.filter(F.concat(F.array(_text("home_page")), F.coalesce(F.map_values("project_urls"), F.array().cast(_NONE))), lambda u: u.startswith("http")))
    text = F.substring(F.concat_ws("\n\n", F.nullif(_text("summary"), F.lit("")), F.nullif(F.substring(_text("description"), 1, 1800), F.lit(""))), 1, 4000)
    return meta.select(F.lit("package").alias("platform"), F.col("name").alias("handle"), F.when(who != "", who).otherwise(F.col("name")).alias("name"), text.alias("description"), emails.alias("emails"),
                       F.slice(web, 1, 5).alias("urls_in_bio"), F.coalesce(F.try_element_at(web, F.lit(1)), F.lit("")).alias("website"), F.lit("en").alias("language"))
