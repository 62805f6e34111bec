"""Entity resolution: match keys, components over shared keys, and the merge of a component's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.classify import status_rank
from sieveline.functions.contact import norm_email, norm_phone, norm_url
from sieveline.operators.components import connected_components

#: first non-empty value in row order
SCALARS = ("name", "legal_name", "handle", "siren", "website", "address", "city", "postal_code", "country", "industry", "naf_code", "description", "language", "platform_url", "contact_channel", "demo_url")


def match_keys(emails: Column, phones: Column, siren: Column, website: Column, sources: Column) -> Column:
    """Keys in priority order: e-mails, phones, company id, site, then source ids; empty ones left out."""
    tag = lambda t, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(t + ":"), c))
    none = F.array().cast("array<string>")
    many = lambda c, f: F.coalesce(F.transform(c, f), none)
    return F.array_distinct(F.array_compact(F.concat(
        many(emails, lambda e: tag("email", norm_email(e))), many(phones, lambda p: tag("phone", norm_phone(p))),
        F.array(tag("siren", F.trim(siren)), tag("web", norm_url(website))),
        many(sources, lambda s: F.when((s["name"] != "") & (s["source_id"] != ""), F.concat_ws(":", F.lit("src"), s["name"], s["source_id"]))))))


def resolve(rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    """``(id, component)``: rows that share a key, directly or through others, get one component.

    Each key links its rows to the smallest of them (a star, never all pairs), so a key shared by
    a third of all rows costs one edge per row; the minimum per key combines in the map tasks.
    """
    keyed = rows.select(F.col(id_col).alias("id"), F.explode(keys_col).alias("key")).distinct()
    low = keyed.groupBy("key").agg(F.min("id").alias("low"))
    edges = keyed.join(low, "key").where("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst"))
    parts = connected_components(edges)
    return rows.select(F.col(id_col).alias("id")).join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def find_first(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """For each incoming ``(id, keys)`` the known row matched by its earliest key: ``(id, known_id)``, null if none.

    A key held by several known rows belongs to the smallest id.
    """
    bridge = known.select(F.col("id").alias("known_id"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("known_id").alias("known_id"))
    probe = incoming.select("id", F.posexplode("keys").alias("pos", "key")).join(bridge, "key")
    best = probe.groupBy("id").agg(F.min_by("known_id", "pos").alias("known_id"))
    return incoming.select("id").join(best, "id", "left")


def ordered_union(rows: DataFrame, by: str, seq: str, items: Column, norm) -> DataFrame:
    """``(by, items)``: the distinct items of a group in order of row and place, told apart by ``norm``."""
    flat = rows.select(by, seq, F.posexplode(items).alias("pos", "v")).withColumn("k", norm(F.col("v"))).where("k <> ''")
    first = flat.groupBy(by, "k").agg(F.min(F.struct(seq, "pos", "v")).alias("s"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("items"))


def merge(rows: DataFrame, component: str = "component", seq: str = "seq") -> DataFrame:
    """One row per component: scalars by first non-empty, lists by ordered union, maxima, and status by rank.

    An opt-out or a bounce absorbs every other status. The score carries the label of the row that
    has it, the earliest on ties. ``next_follow_up_at`` is the last non-empty one.
    """
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(seq))).alias(c)
    have = set(rows.columns)
    aggs = [first(c) for c in SCALARS if c in have]
    if "score" in have:
        best = F.max(F.struct(F.col("score"), (-F.col(seq)).alias("s"), F.col("score_label").alias("l")))
        aggs += [best["score"].alias("score"), best["l"].alias("score_label")]
    aggs += [F.max(c).alias(c) for c in ("subscribers", "last_contact_at") if c in have]
    aggs += [F.bool_or(c).alias(c) for c in ("monetized", "has_legal_mentions") if c in have]
    if "next_follow_up_at" in have:
        aggs.append(F.max_by("next_follow_up_at", F.when(F.col("next_follow_up_at").isNotNull(), F.col(seq))).alias("next_follow_up_at"))
    if "status" in have:
        aggs.append(F.max_by("status", F.struct(status_rank(F.col("status")), -F.col(seq))).alias("status"))
    out = rows.groupBy(component).agg(F.count("*").alias("n_rows"), *aggs)
    for c, norm in (("emails", norm_email), ("phones", norm_phone), ("other_urls", norm_url), ("tags", lambda v: v)):
        if c in have:
            lists = ordered_union(rows, component, seq, F.col(c), norm).withColumnRenamed("items", c)
            out = out.join(lists, component, "left")
    return out


def cross_platform_keys(emails: Column, handle: Column, urls: Column, website: Column) -> Column:
    """Keys that tie profiles of one person across platforms: addresses, long handles, hosts of their own."""
    shared = r"youtube\.com|twitch\.tv|reddit\.com|bsky\.app|mastodon|kick\.com|dailymotion\.com|github\.com|apple\.com"
    h = F.trim(F.regexp_replace(F.lower(handle), "^@+", ""))
    own = lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:www\.)?([^/\s]+)", 1)
    hosts = F.transform(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: ~F.lower(u).rlike(shared)), lambda u: F.when(own(u) != "", F.concat(F.lit("host:"), own(u))))
    return F.array_distinct(F.array_compact(F.concat(
        F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.when(e != "", F.concat(F.lit("email:"), F.lower(e)))),
        F.array(F.when(F.length(h) >= 4, F.concat(F.lit("h:"), h)), F.when(own(website) != "", F.concat(F.lit("host:"), own(website)))), hosts)))



def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``: the whole row through a map-side minimum, not a window."""
    cols = rows.columns
    names = [f"o{i}" for i in range(len(order))]
    packed = F.struct(*[o.alias(n) for o, n in zip(order, names)], *[F.col(c) for c in cols if c not in key])
    return rows.groupBy(*key).agg(F.min(packed).alias("r")).select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in cols])
