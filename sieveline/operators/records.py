"""Entity records: their form, contacts with provenance, and what a visit, a reply or a draft does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.contact import norm_email
from sieveline.operators.entities import match_keys

META = "array<struct<email:string,source:string,source_id:string,url:string,context:string,found_at:string>>"
SOURCES = "array<struct<name:string,source_id:string,url:string,found_at:string>>"
#: text, list and flag fields of an entity, with the default of an absent value
TEXTS = ("name", "handle", "legal_name", "siren", "website", "address", "city", "postal_code", "country", "industry", "naf_code", "description", "language",
         "score_label", "platform_url", "notes", "contact_channel", "demo_url")
LISTS = ("emails", "phones", "other_urls", "monetization_reasons", "tags")
FLAGS = ("monetized", "has_legal_mentions")
TIMES = ("last_contact_at", "next_follow_up_at")
SCHEMA = ", ".join([*(f"{c} string" for c in (*TEXTS, *TIMES, "status")), *(f"{c} array<string>" for c in LISTS), *(f"{c} boolean" for c in FLAGS), "score double", "subscribers long", f"emails_meta {META}", f"sources {SOURCES}"])


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def clean_meta(meta: Column) -> Column:
    """Provenance entries that name an address, each field a string, the source in lower case; null gives none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    entry = lambda m: F.struct(text(m["email"]).alias("email"), F.lower(text(m["source"])).alias("source"), *[text(m[f]).alias(f) for f in ("source_id", "url", "context", "found_at")])
    return F.transform(F.filter(F.coalesce(meta, _none(META)), lambda m: F.coalesce(m["email"], F.lit("")) != ""), entry)


def from_json_record(c: Column) -> Column:
    """An entity as a struct from its JSON text: unknown fields go, absent ones get their default; malformed text gives null."""
    j = F.from_json(c, SCHEMA)
    return F.when(F.get_json_object(c, "$").startswith("{"), F.struct(*[x.alias(n) for n, x in _defaults(lambda f: j[f]).items()]))


def _defaults(get) -> dict[str, Column]:
    out = {c: F.coalesce(get(c), F.lit("")) for c in TEXTS}
    out |= {c: F.coalesce(get(c), _none()) for c in LISTS}
    out |= {c: F.coalesce(get(c), F.lit(False)) for c in FLAGS}
    out["score"] = F.coalesce(get("score").cast("int"), F.lit(0))
    out["subscribers"] = get("subscribers").cast("long")
    out["status"] = F.when(F.coalesce(get("status"), F.lit("")) == "", "new").otherwise(get("status"))
    out["emails_meta"] = clean_meta(get("emails_meta"))
    out["sources"] = F.coalesce(get("sources"), _none(SOURCES))
    return out | {c: F.coalesce(get(c), F.lit("")) for c in TIMES}


def to_rows(entities: DataFrame) -> DataFrame:
    """Entities as table rows: defaults for what is absent, times as timestamps or null, and the match keys."""
    have = set(entities.columns)
    kind = {**dict.fromkeys(LISTS, "array<string>"), **dict.fromkeys(FLAGS, "boolean"), "emails_meta": META, "sources": SOURCES, "score": "double", "subscribers": "long"}
    row = _defaults(lambda f: F.col(f) if f in have else F.lit(None).cast(kind.get(f, "string")))
    row |= {c: F.try_to_timestamp(F.nullif(row[c].cast("string"), F.lit(""))) for c in TIMES}
    keep = [c for c in entities.columns if c not in row]
    out = entities.select(*keep, *[x.alias(c) for c, x in row.items()])
    return out.withColumn("match_keys", match_keys(F.col("emails"), F.col("phones"), F.col("siren"), F.col("website"), F.col("sources")))


def from_rows(rows: DataFrame) -> DataFrame:
    """Table rows as entities: times as ISO text, empty where null; the match keys go."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return rows.withColumns({c: iso(c) for c in TIMES}).drop("match_keys")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row, however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low(emails: Column) -> Column:
    return F.transform(emails, lambda e: F.coalesce(F.lower(F.trim(e)), F.lit("")))


def add_emails(emails: Column, meta: Column, found: Column, most: int | None = None) -> Column:
    """``struct(emails, meta)`` after adding ``found`` (a list of provenance entries), in order.

    An address already known is not added again; its entry is filled in only where it names no
    source, and added where there is none: the first source that found an address keeps the
    credit. ``most`` keeps the first addresses and the entries of those.
    """
    keyed = F.transform(clean_meta(found), lambda m: F.struct(norm_email(m["email"]).alias("k"), m.alias("m")))
    x = F.struct(F.coalesce(emails, _none()).alias("emails"), clean_meta(meta).alias("meta"), F.filter(keyed, lambda f: f["k"] != "").alias("found"))
    # found keys have the strict form, so others equal one if they do once trimmed and in lower case
    named = lambda x: F.filter(x["found"], lambda f: f["m"]["source"] != "")
    keys = lambda x: F.struct(x["found"]["k"].alias("found"), _low(x["emails"]).alias("own"), _low(x["meta"]["email"]).alias("meta"), named(x).alias("named"), named(x)["k"].alias("named_keys"))
    return _let(x, lambda x: _let(keys(x), lambda k: _added(x, k, most)))


def _added(x: Column, k: Column, most: int | None) -> Column:
    """The result of ``add_emails`` from its lists ``x`` and their keys ``k``."""
    place = lambda keys, key: (F.array_position(keys, key) - 1).cast("int")
    # of entries for one address, the first that names a source; if none does, the first
    best = lambda key: F.coalesce(F.get(k["named"], place(k["named_keys"], key))["m"], F.get(x["found"], place(k["found"], key))["m"])
    first = F.filter(x["found"], lambda f, i: place(k["found"], f["k"]) == i)
    known = F.transform(x["meta"], lambda m, i: F.when((m["source"] == "") & F.array_contains(k["found"], F.get(k["meta"], i)), best(F.get(k["meta"], i))).otherwise(m))
    fresh = lambda first: F.transform(F.filter(first, lambda f: ~F.array_contains(k["meta"], f["k"])), lambda f: best(f["k"]))
    more = lambda first: F.transform(F.filter(first, lambda f: ~F.array_contains(k["own"], f["k"])), lambda f: F.trim(f["m"]["email"]))
    out = _let(first, lambda first: F.struct(F.concat(x["emails"], more(first)).alias("emails"), F.concat(known, fresh(first)).alias("meta")))
    if most is None:
        return out
    cut = lambda o: F.struct(F.slice(o["emails"], 1, most).alias("emails"), o["meta"].alias("meta"))
    return _let(out, lambda o: _let(cut(o), lambda c: F.struct(c["emails"].alias("emails"), F.filter(c["meta"], lambda m: F.array_contains(c["emails"], m["email"])).alias("meta"))))


def email_origin(meta: Column, email: Column) -> Column:
    """The provenance entry of an address, null if unknown."""
    own = lambda k: F.filter(F.coalesce(meta, _none(META)), lambda m: F.lower(F.trim(m["email"])) == k)
    return _let(norm_email(email), lambda k: F.when(k != "", F.get(own(k), F.lit(0))))


def gained(found: Column, known: Column) -> Column:
    """Addresses of ``found`` that are not among ``known``, whatever their case; in order."""
    low = F.transform(F.coalesce(known, _none()), lambda e: F.lower(e))
    return _let(low, lambda low: F.filter(F.coalesce(found, _none()), lambda e: ~F.array_contains(low, F.lower(e))))


def visited(entities: DataFrame, most_emails: int = 8, most_phones: int = 5) -> DataFrame:
    """Entities after a site visit.

    ``entities`` has ``emails, emails_meta, phones, address, has_legal_mentions`` and the visit's
    ``found_emails, found_phones, found_address, found_legal, visit_url, visit_source, visit_context``. New
    addresses come with the visit as their provenance, at most ``most_emails`` in all; an address is
    set only where there was none; a legal notice once seen stays.
    """
    entry = lambda e: F.struct(e.alias("email"), F.col("visit_source").alias("source"), F.lit("").alias("source_id"), F.col("visit_url").alias("url"), F.col("visit_context").alias("context"), F.lit("").alias("found_at"))
    # worked out before any column changes: a lambda resolves a name to the changed column of its own projection
    v = entities.withColumns({"__new": gained(F.col("found_emails"), F.col("emails")), "__phones": F.coalesce("phones", _none())})
    v = v.withColumns({"__entries": F.transform("__new", entry), "__more": F.filter(F.coalesce("found_phones", _none()), lambda p: ~F.array_contains("__phones", p))})
    v = v.withColumns({"__both": add_emails(F.col("emails"), F.col("emails_meta"), F.col("__entries"), most_emails), "__meta": clean_meta(F.col("emails_meta"))})
    has = F.size("__new") > 0
    return v.withColumns({
        "emails": F.when(has, F.col("__both.emails")).otherwise(F.coalesce("emails", _none())), "emails_meta": F.when(has, F.col("__both.meta")).otherwise(F.col("__meta")),
        "phones": F.when(F.size("__more") > 0, F.slice(F.concat("__phones", "__more"), 1, most_phones)).otherwise(F.col("__phones")),
        "address": F.when(F.coalesce("address", F.lit("")) == "", F.coalesce("found_address", F.lit(""))).otherwise(F.col("address")),
        "has_legal_mentions": F.coalesce("has_legal_mentions", F.lit(False)) | F.coalesce("found_legal", F.lit(False)), "n_gained": F.size("__new"),
    }).drop("__new", "__phones", "__entries", "__more", "__both", "__meta")


VERIFIED, POSTAL, UNVERIFIED = "site_verified", "site_postal_match", "site_unverified"


def site_tags(tags: Column, verdict: Column) -> Column:
    """Tags after a verdict on the site: verified takes the place of unverified; each tag stands once, at the end if new."""
    tags = F.coalesce(tags, _none())
    put = lambda base, tag: F.when(F.array_contains(base, tag), base).otherwise(F.concat(base, F.array(F.lit(tag))))
    return F.when(verdict == "high", put(F.filter(tags, lambda t: t != UNVERIFIED), VERIFIED)).when(verdict == "ok", put(tags, POSTAL)).when(verdict == "low", put(tags, UNVERIFIED)).otherwise(tags)


def site_outcome(entities: DataFrame) -> DataFrame:
    """Entities after a verdict: ``website, other_urls, tags``.

    ``entities`` has those, ``url``, ``guessed`` and ``verdict``. A rejected site changes nothing. A
    site of its own is set where there is none and the address was not guessed or the verdict is
    high or ok; a guessed one that is only low is kept among the other URLs.
    """
    open_ = (F.coalesce("website", F.lit("")) == "") & (F.col("verdict") != "reject")
    sure = ~F.coalesce("guessed", F.lit(False)) | F.col("verdict").isin("high", "ok")
    others = F.coalesce("other_urls", _none())
    return entities.withColumn("__tags", site_tags(F.col("tags"), F.col("verdict"))).withColumns({
        "website": F.when(open_ & sure, F.col("url")).otherwise(F.coalesce("website", F.lit(""))),
        "other_urls": F.when(open_ & ~sure & ~F.array_contains(others, F.col("url")), F.concat(others, F.array("url"))).otherwise(others),
        "tags": F.col("__tags")}).drop("__tags")


def after_reply(status: Column) -> Column:
    """A reply makes a record ``replied`` unless it has replied before or is closed."""
    return F.when(status.isin("replied", "won", "lost", "refused"), status).otherwise("replied")


def after_history(status: Column, last_contact: Column, last_kind: Column, last_ts: Column) -> Column:
    """``struct(status, last_contact_at)`` of a record that turns out to be known: a client is won, others contacted; null kind changes nothing."""
    return F.struct(F.when(last_kind.isNull(), status).when(last_kind == "client", "won").otherwise("contacted").alias("status"), F.when(last_kind.isNotNull(), F.coalesce(last_ts, last_contact)).otherwise(last_contact).alias("last_contact_at"))


#: statuses in which no draft may be approved
CLOSED = ("unsubscribed", "bounced", "refused", "won", "lost")


def blocked(status: Column) -> Column:
    """The status that forbids approving a draft, null if none does."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin(*CLOSED), s)


def scraped_or_inferred(scraped: Column, inferred: Column, url: Column, source: Column, context: Column, inferred_context: Column, most: int = 3) -> Column:
    """``struct(emails, meta, inferred)``: at most ``most`` addresses seen on a page, else the guessed ones, each with its provenance."""
    scraped, inferred = F.coalesce(scraped, _none()), F.coalesce(inferred, _none())
    seen = F.size(scraped) > 0
    own = F.when(seen, F.slice(scraped, 1, most)).otherwise(inferred)
    meta = F.transform(own, lambda e: F.struct(e.alias("email"), F.when(seen, source).otherwise("web_inferred").alias("source"), F.lit("").alias("source_id"), url.alias("url"), F.when(seen, context).otherwise(inferred_context).alias("context"), F.lit("").alias("found_at")))
    return F.struct(own.alias("emails"), meta.alias("meta"), (~seen & (F.size(inferred) > 0)).alias("inferred"))


def audience_counts(entities: DataFrame, audience: Column) -> DataFrame:
    return entities.groupBy(audience.alias("audience")).agg(F.count("*").alias("n"))


def run_stats(events: DataFrame, kinds: list[str], by: list[str] | None = None) -> DataFrame:
    """How many events of each kind a run has seen, a column for each, and the largest ``uid`` if there is one."""
    more = [F.max("uid").alias("max_uid")] if "uid" in events.columns else []
    return events.groupBy(*(by or [])).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_all"), *more)


def recent(history: DataFrame, most: int | None = None, ts: str = "ts") -> DataFrame:
    """History, newest first; ``most`` rows where a listing wants a bound (a top-k, no full sort)."""
    out = history.orderBy(F.desc(ts), *[c for c in history.columns if c != ts])
    return out.limit(most) if most is not None else out
