"""Records completed from what is at hand: contacts from a bio, a site of one's own, repairs, and one listing out of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.classify import commercial_signals
from sieveline.functions.contact import is_platform, is_social, norm_domain, text_emails, text_phones
from sieveline.functions.text import industry_is_sane, name_is_polluted, split_polluted, words_subset

REPAIRED = "fiche_reparee"


def platform_key(platform: Column, ident: Column) -> Column:
    """``platform|id`` of a profile; missing parts are empty."""
    return F.concat_ws("|", F.coalesce(platform, F.lit("")), F.coalesce(ident.cast("string"), F.lit("")))


def filled_from_bio(rows: DataFrame, bio: str = "description") -> DataFrame:
    """Lists ``urls_in_bio``, ``emails`` and ``phones`` that are null or empty, filled with what the bio holds; others stay."""
    found = {"urls_in_bio": commercial_signals(F.col(bio))["urls"], "emails": text_emails(F.coalesce(bio, F.lit(""))), "phones": text_phones(F.coalesce(bio, F.lit("")))}
    return rows.withColumns({c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(v) for c, v in found.items()})


def hosted_elsewhere(url: Column) -> Column:
    """Does a URL lead to a platform, shortener or host of others? An empty one does, one that cannot be read does not."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    host = F.when(netloc != "", netloc).otherwise(F.regexp_extract(rest, r"^(?://)?([^?#]*)", 1))
    unreadable = netloc.contains("[") != netloc.contains("]")
    return F.when(u == "", True).when(unreadable, False).otherwise(is_platform(norm_domain(host)))


def first_own_site(urls: Column) -> Column:
    """The first URL of a list that is neither social nor hosted elsewhere, null if none."""
    return F.try_element_at(F.filter(urls, lambda u: (F.coalesce(u, F.lit("")) != "") & ~is_social(u) & ~hosted_elsewhere(u)), F.lit(1))


def repaired(rows: DataFrame) -> DataFrame:
    """Records whose message a reviewer sent back, repaired once from their own data: adds ``repaired_fields``, null where nothing changed.

    ``rows`` has ``name, description, industry, tags, verdict, engine_down`` and a proposal ``proposed_name,
    proposed_industry`` (null if there is none). A name run together with a description is cut, and the
    rest becomes the description where there is none. Else the proposal counts: a name only of words that the
    record has, an industry only if it is one. A repaired record carries a tag and is never repaired again.
    """
    due = (F.col("verdict") == "draft") & ~F.coalesce("engine_down", F.lit(False)) & ~F.coalesce(F.array_contains("tags", REPAIRED), F.lit(False))
    cut = F.when(due & name_is_polluted(F.col("name")), split_polluted(F.col("name")))
    r = rows.withColumns({"__due": F.coalesce(due, F.lit(False)), "__cut": cut})
    own = F.concat_ws(" ", "name", "description", "industry")
    bare = F.trim(F.coalesce("description", F.lit(""))) == ""
    by_cut = {"name": F.col("__cut.name"), "description": F.when(bare, F.col("__cut.rest"))}
    named = F.when(words_subset(F.col("proposed_name"), own), F.col("proposed_name"))
    by_proposal = {"name": named, "industry": F.when(industry_is_sane(F.col("proposed_industry")), F.col("proposed_industry"))}
    change = {c: F.when(F.col("__cut").isNotNull(), by_cut.get(c, F.lit(None))).when(F.col("__due"), by_proposal.get(c, F.lit(None))) for c in ("description", "industry", "name")}
    r = r.withColumns({f"__new_{c}": v for c, v in change.items()})
    fields = F.array_compact(F.array(*[F.when(F.col(f"__new_{c}").isNotNull(), F.lit(c)) for c in change]))
    r = r.withColumn("repaired_fields", F.when(F.size(fields) > 0, fields))
    done = F.col("repaired_fields").isNotNull()
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return r.withColumns({**{c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in change}, "tags": F.when(done, F.concat(tags, F.array(F.lit(REPAIRED)))).otherwise(F.col("tags"))}).drop("__due", "__cut", *[f"__new_{c}" for c in change])


def first_of_sources(sources: list[DataFrame], key: str, order: str, limit: int | None = None) -> DataFrame:
    """One listing out of several: of rows that share ``key`` the one of the earliest source stays, there the first by ``order``.

    ``limit`` takes the first rows by source and order. Null keys are no rows. The choice is a minimum that
    combines in the map tasks; no key's rows are gathered.
    """
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    cols = [c for c in all_.columns if c not in (key, "source_no", order)]
    best = all_.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("source_no", order, *cols)).alias("r")).select(key, "r.*")
    return best.orderBy("source_no", order, key).limit(limit) if limit is not None else best


def effective_cap(target: Column, daily: Column, sent_today: Column, available: Column) -> Column:
    """How many may go out now: the target, what the day's cap leaves, and what is there; never below none."""
    return F.greatest(F.lit(0), F.least(target, daily - F.coalesce(sent_today, F.lit(0)), available))
