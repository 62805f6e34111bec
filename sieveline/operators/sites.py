"""Sites and link hubs from landed pages: links, contacts by site, contacts by hub. Nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import dims
from sieveline.functions.contact import clean_email, host, mailto, page_evidence, raw_emails
from sieveline.functions.text import html_text
from sieveline.session import written


def on_host(url: Column, domains) -> Column:
    """Is the URL's host one of ``domains``, or under one? False without a host."""
    names = "|".join(d.replace(".", r"\.") for d in domains)
    return F.coalesce(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:https?://)?([^/\s?#]+)", 1).rlike(rf"(?:^|\.)(?:{names})$"), F.lit(False))


def is_hub(url: Column) -> Column:
    """Does the URL lead to a page that only lists links? With or without a scheme."""
    return on_host(url, dims.HUB_DOMAINS)


def is_social_link(url: Column) -> Column:
    """Does an absolute URL lead to a network that a hub's links are not followed to?"""
    return url.rlike("(?i)^https?://") & on_host(url, dims.HUB_SOCIAL_DOMAINS)


def anchors(html: Column) -> Column:
    """``array<struct<href,text>>`` of a page's links, in order."""
    link = r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))
    return F.transform(F.regexp_extract_all(html, F.lit(link), F.lit(0)), lambda a: F.struct(F.trim(F.regexp_extract(a, link, 1)).alias("href"), clean(F.regexp_extract(a, link, 2)).alias("text")))


def absolute(href: Column, base: Column) -> Column:
    """A link as it stands on the page ``base``: absolute, scheme-relative, from the root, or from the page's folder; no fragment."""
    h = F.substring_index(href, "#", 1)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(F.substring_index(F.substring_index(base, "#", 1), "?", 1), r"(?i)^(https?://[^/]+)$", "$1/")
    return (F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), h)).when(h.startswith("/"), F.concat(root, h))
            .when(h == "", base).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), h)))


_SKIP = "(?i)^(javascript:|mailto:|tel:|#)"


def outbound_links(html: Column, base: Column) -> Column:
    """Distinct links of a page to other, non-social hosts, in order of the page."""
    full = F.transform(F.filter(F.transform(anchors(html), lambda a: a["href"]), lambda h: (h != "") & ~h.rlike(_SKIP)), lambda h: absolute(h, base))
    return F.array_distinct(F.filter(full, lambda u: (host(u) != "") & (host(u) != host(base)) & ~is_social_link(u)))


def priority_links(html: Column, base: Column, most: int = 5) -> Column:
    """Links of a page inside its own host whose path or words promise contact details: the first of each path, at most ``most``, in order of the page."""
    paths = "|".join(p.replace("-", r"\-") for p in dims.PRIORITY_PATHS)
    words = "|".join(dims.PRIORITY_WORDS)
    found = F.filter(anchors(html), lambda a: (a["href"] != "") & ~a["href"].rlike("(?i)^(javascript:|mailto:|tel:)"))
    path = lambda u: F.regexp_replace(F.regexp_extract(F.lower(u), r"^https?://[^/?#]+(/[^?#]*)?", 1), "/+$", "")
    full = F.transform(found, lambda a: F.struct(absolute(a["href"], base).alias("u"), F.lower(a["text"]).alias("t")))
    full = F.transform(F.filter(full, lambda a: host(a["u"]) == host(base)), lambda a: F.struct(a["u"].alias("u"), a["t"].alias("t"), path(a["u"]).alias("p")))
    own = F.filter(full, lambda a: a["p"].rlike(rf"^(?:{paths})(?:/|$)") | a["t"].rlike(words))
    first = F.filter(own, lambda a, i: ~F.exists(F.slice(own, 1, i), lambda b: b["p"] == a["p"]))
    return F.slice(F.transform(first, lambda a: a["u"]), 1, most)


def _page(pages: DataFrame) -> DataFrame:
    text = pages.withColumn("__text", html_text(F.col("html")))
    return text.withColumns({"__found": page_evidence(F.col("__text")), "__raw": F.concat(raw_emails(F.col("__text")), mailto(F.col("html")))})


def _contacts(found: DataFrame, key: str, order: list[Column], most_emails: int, most_phones: int) -> DataFrame:
    """Contacts of a group of read pages. What pages say is told apart before it is ranked, and ranked before it is gathered.

    So a site's row holds its first addresses and phones, however many pages and addresses it has; of
    its other ids and codes it holds each once.
    """
    # what was found is read several times; pages are searched once
    found = written(found.select(F.col(key).alias("__g"), "url", F.struct(*order).alias("__order"), "__raw", "__found"))
    per = found.groupBy("__g").agg(F.bool_or("__found.has_legal").alias("has_legal"), F.count("*").alias("n_pages"), F.min_by("url", "__order").alias("first_url"))
    lists = ("phones", "company_ids", "site_ids", "postal_codes")
    said = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    items = found.select("__g", F.explode(F.concat(said("emails", F.transform("__raw", clean_email)), *[said(c, F.col(f"__found.{c}")) for c in lists])).alias("x"))
    items = items.select("__g", "x.kind", "x.v").where("v is not null").distinct()
    home = per.select(F.col("__g").alias("__h"), F.concat(F.lit("@"), host(F.col("first_url"))).alias("own"))
    items = items.join(home, F.col("__g").eqNullSafe(F.col("__h"))).withColumn("far", F.when((F.col("kind") == "emails") & ~F.coalesce(F.endswith("v", "own"), F.lit(False)), 1).otherwise(0))
    few = {"emails": most_emails, "phones": most_phones}
    # a bound on the rank alone lets every task drop what cannot be among the first
    ranked = items.where(F.col("kind").isin(*few)).withColumn("i", F.row_number().over(Window.partitionBy("__g", "kind").orderBy("far", "v"))).where(F.col("i") <= max(few.values()))
    ranked = ranked.where(" or ".join(f"(kind = '{k}' and i <= {n})" for k, n in few.items())).drop("i")
    kept = ranked.unionByName(items.where(~F.col("kind").isin(*few)))
    gathered = kept.groupBy(F.col("__g").alias("__i")).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("far", "v")))), lambda x: x["v"]).alias(c) for c in ("emails", *lists)])
    out = per.join(gathered, F.col("__g").eqNullSafe(F.col("__i")), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("__g").alias(key), *[F.coalesce(c, none).alias(c) for c in lists], "has_legal", "n_pages", "first_url", F.coalesce("emails", none).alias("emails"))


def site_contacts(pages: DataFrame, site: str = "site", order: list[Column] | None = None, most_emails: int = 5, most_phones: int = 3) -> DataFrame:
    """One row per site from its landed pages: ``emails, phones, company_ids, site_ids, postal_codes, has_legal, n_pages, first_url``.

    ``pages`` has ``site, url, html``: the pages to count, the home page first in ``order``. Addresses of
    the home page's domain come first, then by letter; phones are told apart by their normal form.
    """
    return _contacts(_page(pages), site, order or [F.col("url")], most_emails, most_phones)


def hub_contacts(hubs: DataFrame, pages: DataFrame, most_outbound: int = 4) -> DataFrame:
    """One row per hub page: its own contacts and those of the first ``most_outbound`` pages it links to, and the first that has landed.

    ``hubs`` and ``pages`` have ``url, html``; links meet pages by equi-join on the URL.
    """
    links = hubs.select(F.col("url").alias("hub"), F.posexplode(F.slice(outbound_links(F.col("html"), F.col("url")), 1, most_outbound)).alias("pos", "url"))
    landed = pages.groupBy("url").agg(F.min("html").alias("html"))
    reached = links.join(landed, "url")
    both = hubs.select(F.col("url").alias("hub"), F.lit(-1).alias("pos"), "url", "html").unionByName(reached)
    per = _contacts(_page(both), "hub", [F.col("pos")], 5, 3)
    first = reached.groupBy("hub").agg(F.min_by("url", "pos").alias("primary_url"))
    # an address of a hub has no domain of its own: by letter alone
    return per.withColumn("emails", F.array_sort("emails")).drop("first_url").join(first, "hub", "left")


def unwrapped(href: Column, field: str = "uddg") -> Column:
    """The target of a search engine's redirect link; other links as they are."""
    q = F.regexp_extract(href, rf"[?&]{field}=([^&#]*)", 1)
    return F.when(href.rlike(r"^(?://[^/]+)?/l/"), F.coalesce(F.try_url_decode(q), F.lit(""))).otherwise(href)


def search_results(html: Column, most: int = 10) -> Column:
    """Distinct targets of a landed result page, in order, at most ``most``."""
    # the class and the link of an anchor may come in either order
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda a: a.rlike(r'(?i)class="[^"]*\bresult__a\b'))
    found = F.transform(tags, lambda a: unwrapped(F.replace(F.regexp_extract(a, r'(?i)href="([^"]+)"', 1), F.lit("&amp;"), F.lit("&"))))
    return F.slice(F.array_distinct(F.filter(found, lambda u: u != "")), 1, most)


