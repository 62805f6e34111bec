"""Joins with fallbacks: replies to messages, dimension labels, evidence verdicts, ranked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.contact import from_address, host, message_id
from sieveline.functions.text import slug


def match_replies(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """``(uid, entity_id, matched_by)``: each reply by the message it answers, else by its sender.

    ``replies`` has ``uid, from_addr, in_reply_to``; ``sent`` has ``entity_id, message_id, to_addr``.
    A message id or address used for several entities belongs to the smallest id. Both lookups are
    equi-joins on pre-aggregated tables; the exact one wins.
    """
    by_id = sent.groupBy(message_id(F.col("message_id")).alias("mid")).agg(F.min("entity_id").alias("e1"))
    by_addr = sent.groupBy(F.lower(F.trim("to_addr")).alias("addr")).agg(F.min("entity_id").alias("e2"))
    r = replies.select("uid", message_id(F.col("in_reply_to")).alias("mid"), from_address(F.col("from_addr")).alias("addr"))
    out = r.join(by_id.where("mid <> ''"), "mid", "left").join(by_addr.where("addr <> ''"), "addr", "left")
    how = F.when(F.col("e1").isNotNull(), "message_id").when(F.col("e2").isNotNull(), "address").otherwise("none")
    return out.select("uid", F.coalesce("e1", "e2").alias("entity_id"), how.alias("matched_by"))


def label(rows: DataFrame, code: Column, levels: list[DataFrame], keys: list[Column], name: str = "label") -> DataFrame:
    """Label by the first dimension that knows the key, else the raw code.

    ``levels`` are ``(k, v)`` tables, from the most to the least specific, with ``keys`` the
    columns to look up; Spark broadcasts those that are small.
    """
    for i, (dim, key) in enumerate(zip(levels, keys)):
        d = dim.select(F.col("k").alias(f"_k{i}"), F.col("v").alias(f"_v{i}"))
        rows = rows.join(d, key == F.col(f"_k{i}"), "left")
    n = len(levels)
    out = rows.withColumn(name, F.coalesce(*[F.col(f"_v{i}") for i in range(n)], code))
    return out.drop(*[f"_{x}{i}" for i in range(n) for x in "kv"])


def verdict(siren: Column, postal: Column, name: Column, url: Column, emails: Column, company_ids: Column, site_ids: Column, postal_codes: Column) -> Column:
    """``high``, ``ok``, ``low`` or ``reject``: does a site belong to the registered firm?"""
    none = F.array().cast("array<string>")
    siren, postal = F.coalesce(siren, F.lit("")), F.coalesce(postal, F.lit(""))
    emails, company_ids, site_ids, postal_codes = (F.coalesce(c, none) for c in (emails, company_ids, site_ids, postal_codes))
    h = host(url)
    own = (h != "") & F.exists(emails, lambda e: F.lower(e).endswith(F.concat(F.lit("@"), h)))
    a, b = slug(name), slug(F.substring_index(h, ".", 1))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    alike = (a != "") & (b != "") & ((a == b) | ((ratio >= 0.7) & (a.contains(b) | b.contains(a))))
    return (
        F.when((siren == "") & (postal == ""), "low")
        .when((siren != "") & F.array_contains(company_ids, siren), "high")
        .when((siren != "") & F.exists(site_ids, lambda s: s.startswith(siren)), "high")
        .when((siren != "") & (F.size(company_ids) > 0), "reject")
        .when(own & alike, "high")
        .when((postal == "") | (F.size(postal_codes) == 0), "low")
        .when(F.array_contains(postal_codes, postal), "ok")
        .when(F.exists(postal_codes, lambda p: F.substring(p, 1, 2) == F.substring(postal, 1, 2)), "low")
        .otherwise("reject")
    )


def first_answer(answers: DataFrame, by: str) -> DataFrame:
    """The best-ranked successful answer of each key: ``(by, answer, provider, n_failed)``."""
    ok = F.when(F.col("ok"), F.col("rank"))
    return answers.groupBy(by).agg(F.min_by("answer", ok).alias("answer"), F.min_by("provider", ok).alias("provider"), F.count_if(~F.col("ok")).alias("n_failed"))


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with their children as a list in ``order``; none gives an empty list."""
    fields = [c for c in children.columns if c != key and c not in order]
    s = F.struct(*order, *fields)
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
