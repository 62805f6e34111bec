"""Which message a record gets: template pools, offers that never mix, senders' brands, drafts and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import dims
from sieveline.functions.text import message_name, shared_start


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def issue_matches(key: Column, issue: Column, named: dict[str, str]) -> Column:
    """Does a template's key fit an audit's outcome? ``named`` maps outcomes to marks in keys; any other outcome wants a key without marks."""
    key = _low(key)
    unmarked = reduce(lambda a, m: a & ~key.contains(m), named.values(), F.lit(True))
    out = reduce(lambda a, kv: a.when(issue == kv[0], key.contains(kv[1])), named.items(), F.when(F.lit(False), F.lit(False)))
    return out.otherwise(unmarked)


def template_pool(entities: DataFrame, templates: DataFrame, product: str, marks: dict[str, str]) -> DataFrame:
    """The templates open to each record: ``(entity_id, key)``; records without any are left out.

    ``entities`` has ``entity_id, audience, category`` (trade category, empty if unknown), ``segment``
    (of the exclusive offer, empty if none), ``has_offer`` (must get the exclusive offer) and ``issue``
    (outcome of its audit, null without one). ``templates`` has ``key, audience, product``; no audience
    means ``creator``.

    1. Templates of the record's audience.
    2. For ``pro`` records, those whose key names the trade category, if there are any.
    3. If the pool holds ``product``: a record that must get it keeps those alone, narrowed to its
       segment if that leaves any, and to its audit's outcome in any case (no audit, no message); every
       other record loses them, and gets nothing rather than the wrong offer.

    Templates are a small table with one row per template; each step is a rank or a flag over a record's
    own pool, worked out in one aggregate, with no pairs beyond record x template of its audience.
    """
    t = templates.select(F.col("key"), F.coalesce(F.nullif(_low(F.col("audience")), F.lit("")), F.lit("creator")).alias("of"), F.trim(F.coalesce("product", F.lit(""))).alias("product"))
    pools = t.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("key", "product"))).alias("pool"))
    e = entities.join(pools, F.lower(entities["audience"]) == pools["of"])
    narrowed = lambda pool, keep: F.when(F.size(F.filter(pool, keep)) > 0, F.filter(pool, keep)).otherwise(pool)
    cat, seg = _low(F.col("category")), _low(F.col("segment"))
    e = e.withColumn("pool", F.when((F.lower("audience") == "pro") & (cat != ""), narrowed(F.col("pool"), lambda x: _low(x["key"]).contains(cat))).otherwise(F.col("pool")))
    own = F.filter("pool", lambda x: x["product"] == product)
    rest = F.filter("pool", lambda x: x["product"] != product)
    e = e.withColumns({"__own": own, "__rest": rest})
    e = e.withColumn("__own", F.when(seg != "", narrowed(F.col("__own"), lambda x: _low(x["key"]).contains(seg))).otherwise(F.col("__own")))
    offered = F.when(F.coalesce(F.col("issue"), F.lit("")) != "", F.filter("__own", lambda x: issue_matches(x["key"], F.col("issue"), marks)))
    pool = F.when(F.size("__own") == 0, F.col("pool")).when(F.col("has_offer"), offered).otherwise(F.col("__rest"))
    return e.select("entity_id", F.explode(F.transform(pool, lambda x: x["key"])).alias("key"))


def needs_identity(subject: Column, body: Column, html: Column, placeholders=("{nom}", "{name}", "{entreprise}", "{company}")) -> Column:
    """Does a template name the person or firm it is sent to?"""
    blob = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (subject, body, html)])
    return reduce(lambda a, p: a | blob.contains(p), placeholders, F.lit(False))


def overlay(defaults: DataFrame, own: DataFrame, key: str = "key") -> DataFrame:
    """Templates, where the user's own take the place of defaults with the same key."""
    return defaults.join(own.select(key), key, "left_anti").unionByName(own, allowMissingColumns=True)


def rebrand(text: Column, account: Column, brands: dict[str, str], house: str) -> Column:
    """The house's name in a text, plain and in capitals, as the sending account's brand; other accounts change nothing."""
    brand = reduce(lambda a, kv: a.when(account == kv[0], kv[1]), brands.items(), F.when(F.lit(False), ""))
    return F.when(brand.isNull(), text).otherwise(F.replace(F.replace(text, F.lit(house.upper()), F.upper(brand)), F.lit(house), brand))


def draft_sender(required: Column, account: Column, account_address: Column, primary: str = "primary") -> Column:
    """The address a draft must go out from: the template's, else the chosen account's unless that is the primary one; else null."""
    return F.coalesce(F.nullif(F.trim(required), F.lit("")), F.when(account != primary, F.nullif(F.trim(account_address), F.lit(""))))


def review_columns(review: Column) -> Column:
    """``struct(review_score, review_verdict, review_comment)``; a reviewer that was down leaves no score."""
    down = F.coalesce(review["engine_down"], F.lit(False))
    return F.when(review.isNotNull(), F.struct(F.when(~down, review["score"]).alias("review_score"), F.when(down, "engine_down").otherwise(review["verdict"]).alias("review_verdict"), review["comment"].alias("review_comment")))


def review_floor(raw: Column, usual: int = 7) -> Column:
    """The score a message needs: negative switches reviews off (0), none or invalid is the usual one, 10 at most."""
    n = F.coalesce(raw.try_cast("int"), F.lit(0))
    return F.when(n < 0, 0).when(n == 0, usual).otherwise(F.least(F.lit(10), n))


def review_context(name: Column, legal: Column, city: Column, industry: Column, description: Column) -> Column:
    """What the reviewer is told of a record; unknown facts show as a question mark."""
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("?"))
    return F.concat(F.lit("Nom: "), some(name, legal), F.lit("\nVille: "), some(city), F.lit("\nSecteur: "), some(industry), F.lit("\nDescription: "), F.substring(F.coalesce(description, F.lit("")), 1, 200))


#: draft columns that every table version has, and those of later ones, in order of coming
DRAFT = ("prospect_id", "subject", "body", "template_key", "provider", "model", "kind", "status", "created_by")
DRAFT_LATER = (("body_html", "review_score", "review_verdict", "review_comment", "sender_address"), ("review_score_before", "review_score_after", "review_modif_type", "review_modif_applied"))


def draft_rows(drafts: DataFrame, table_columns: list[str]) -> DataFrame:
    """Drafts as rows of a table that may lack later columns: whole groups of them go, never a part; subjects are cut at 200."""
    groups = [g for g in DRAFT_LATER if set(g) <= set(table_columns)]
    have = set(drafts.columns)
    usual = {"kind": "first_contact", "status": "pending"}
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string"), F.lit(usual.get(c, "")))
    base = [F.substring(text(c), 1, 200).alias(c) if c == "subject" else F.col(c) if c == "prospect_id" else text(c).alias(c) for c in DRAFT]
    return drafts.select(*base, *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for g in groups for c in g])


#: where an address comes from, as told to a writer; fixed values
SOURCE_LABELS = {
    "web": "page contact ou mentions légales du site officiel", "web_inferred": "adresse devinée à partir du domaine du site (non vérifiée)", "sirene": "annuaire d'entreprises SIRENE",
    "maps": "fiche Google Maps de l'établissement", "file": "fichier importé", "linktree": "hub de liens (Linktree, Beacons, etc.)", "bio": "bio / description du profil",
}


def source_label(source: Column, context: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A provenance in words: the stored context, else the label of the source, else ``profil <platform>`` for a known prefix, else the source as it is."""
    s = _low(source)
    out = F.when(F.coalesce(context, F.lit("")) != "", context)
    for k, v in SOURCE_LABELS.items():
        out = out.when(s == k, v)
    for p, via in (prefixes or {}).items():
        out = out.when(s.startswith(p + "_"), F.concat(F.lit("profil "), F.substring(s, len(p) + 2, 1 << 20), F.lit(f" ({via})")))
    return out.otherwise(F.coalesce(F.nullif(source, F.lit("")), F.lit("source inconnue")))


def source_labels(names: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Distinct source names, in order, in words."""
    low = F.array_distinct(F.filter(F.transform(names, _low), lambda n: n != ""))
    return F.transform(low, lambda n: source_label(n, F.lit(""), prefixes))


def offer_block(forced: Column, catalogue: Column, forced_text: str, catalogue_text: str) -> Column:
    """The offer a writer is told to make: one that is forced, else a choice from the catalogue, else nothing. Texts hold ``{offer}``."""
    fill = lambda text, c: F.replace(F.lit(text), F.lit("{offer}"), F.trim(c))
    return F.when(F.trim(F.coalesce(forced, F.lit(""))) != "", fill(forced_text, forced)).when(F.trim(F.coalesce(catalogue, F.lit(""))) != "", fill(catalogue_text, catalogue)).otherwise("")


def writer_prompt(r: dict[str, Column], instructions: str, brief: Column) -> Column:
    """The request to a writer about a record: who it is, where it and its address come from, how to write and what.

    ``r`` has ``name, legal_name, city, industry, description, website, audience, origins`` (list)``,
    email, email_origin, subscribers, sender``.
    """
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    name = message_name(F.coalesce(F.nullif(r["name"], F.lit("")), F.nullif(r["legal_name"], F.lit("")), F.lit("(sans nom)")))
    kind = F.when(r["audience"] == "pro", "Pro / Entreprise").when(r["audience"] == "creator", "Créateur / Influenceur").otherwise("Inconnue")
    lines = [
        F.lit("PROSPECT :"), F.concat(F.lit("- Nom / entreprise : "), name), F.concat(F.lit("- Ville : "), dash(r["city"])), F.concat(F.lit("- Secteur : "), dash(r["industry"])),
        F.concat(F.lit("- Description : "), F.substring(dash(r["description"]), 1, 300)), F.concat(F.lit("- Site web : "), dash(r["website"])), F.concat(F.lit("- Type de prospect : "), kind),
        F.when(F.size(r["origins"]) > 0, F.concat(F.lit("- Origine : "), F.array_join(r["origins"], ", "))),
        F.when((F.coalesce(r["email"], F.lit("")) != "") & (F.coalesce(r["email_origin"], F.lit("")) != ""), F.concat(F.lit("- Origine de l'adresse ("), r["email"], F.lit(") : "), r["email_origin"])),
        F.when((r["subscribers"] > 0) & (r["audience"] == "creator"), F.concat(F.lit("- Abonnés : "), F.replace(F.format_number(r["subscribers"], 0), F.lit(","), F.lit(" ")))),
        F.concat(F.lit("EXPÉDITEUR : "), F.coalesce(F.nullif(r["sender"], F.lit("")), F.lit("(non renseigné)"))), F.lit(instructions), F.concat(F.lit("CONSIGNES : "), brief),
    ]
    return F.concat_ws("\n", *lines)


def stacked_prompt(user: Column, parts: Column) -> Column:
    """A request behind its instruction sets ``(id, name, content)``, each between tags that name it.

    Sets come in their order; unnamed ones go by their id. No sets leave the request as it is, an empty request gives null.
    """
    ask = F.nullif(F.trim(user), F.lit(""))
    named = lambda p: F.replace(F.coalesce(p["name"], p["id"], F.lit("")), F.lit('"'), F.lit("'"))
    tagged = F.transform(parts, lambda p: F.concat(F.lit('<instructions name="'), named(p), F.lit('">\n'), F.trim(F.coalesce(p["content"], F.lit(""))), F.lit("\n</instructions>")))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.array_join(F.concat(tagged, F.array(F.concat(F.lit("<request>\n"), ask, F.lit("\n</request>")))), "\n")).otherwise(ask)


def valid_library(items: DataFrame) -> DataFrame:
    """Library items that have an id, a name and a content."""
    return items.where("id is not null and name is not null and content is not null")


def find_item(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids with their library item, null if there is none; of items that share an id the first by name."""
    first = items.groupBy("id").agg(F.min(F.struct("name", "content")).alias("i")).select("id", "i.name", "i.content")
    return wanted.join(first, "id", "left")


def unsubscribe_headers(headers: Column, sender: Column) -> Column:
    """Mail headers with a way to unsubscribe, unless they have one already or there is no sender."""
    have = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    own = F.map_contains_key(have, F.lit("List-Unsubscribe")) | (F.trim(F.coalesce(sender, F.lit(""))) == "")
    return F.when(own, have).otherwise(F.map_concat(have, F.create_map(F.lit("List-Unsubscribe"), F.concat(F.lit("<mailto:"), F.trim(sender), F.lit("?subject=unsubscribe>")))))


def chosen_model(provider: Column, usual: dict[str, str], cheap: dict[str, str] | None = None) -> Column:
    """A provider's model: the cheap one for simple work where it is listed, else its usual one, else empty."""
    pick = lambda table: reduce(lambda a, kv: a.when(provider == kv[0], kv[1]), table.items(), F.when(F.lit(False), ""))
    return F.coalesce(pick(cheap), pick(usual), F.lit("")) if cheap else F.coalesce(pick(usual), F.lit(""))


def _found_in_html(text: str) -> Column:
    """A pattern for the text in column ``text`` as HTML may write it: every apostrophe and every blank before French punctuation in any form."""
    any_of = lambda forms: "(?:" + "|".join(forms) + ")"
    quoted = F.regexp_replace(text, r"([^\p{L}\p{N}\s'’])", r"\\$1")
    blank = F.regexp_replace(quoted, rf" (?=\\[{dims.FRENCH_MARKS}])", any_of(dims.BLANKS))
    return F.regexp_replace(blank, "['’]", any_of(dims.APOSTROPHES))


def edit_in_place(rows: DataFrame, old: str, new: str, html: str) -> DataFrame:
    """Adds ``edited, applied``: the one span in which ``new`` differs from ``old``, replaced once in ``html``.

    The span's first place in the HTML is found whatever forms its apostrophes and blanks have there, mixed
    ones too. The new text takes the form of the first apostrophe that it replaces, and of the first blank.
    Where the span is not found, or would only insert, nothing changes.
    Each step is a projection of its own, as it is read several times by the next.
    """
    r = rows.withColumns({f"__{k}": F.coalesce(F.col(c), F.lit("")) for k, c in (("o", old), ("n", new), ("h", html))})
    r = r.withColumn("__at", shared_start(F.col("__o"), F.col("__n")))
    r = r.withColumns({f"__{k}": F.substr(F.col(f"__{k}"), F.col("__at") + 1) for k in "on"} | {"__same": F.trim("__o") == F.trim("__n"), "__empty": (F.col("__h") == "") | (F.trim("__n") == "")})
    r = r.withColumn("__end", shared_start(F.reverse("__o"), F.reverse("__n")))
    r = r.withColumns({f"__{k}": F.left(F.col(f"__{k}"), F.length(f"__{k}") - F.col("__end")) for k in "on"})
    r = r.withColumn("__pattern", _found_in_html("__o"))
    r = r.withColumn("__hit", F.expr("regexp_extract(__h, __pattern, 0)"))
    form = F.regexp_extract("__hit", "|".join(dims.APOSTROPHES[2:]), 0)
    r = r.withColumn("__n", F.when(form != "", F.replace(F.replace("__n", F.lit("’"), F.lit("'")), F.lit("'"), form)).otherwise(F.col("__n")))
    r = r.withColumn("__n", F.when(F.col("__hit").contains(dims.BLANKS[1]), F.regexp_replace("__n", f" ([{dims.FRENCH_MARKS}])", dims.BLANKS[1] + "$1")).otherwise(F.col("__n")))
    ok = (F.col("__hit") != "") & ~F.col("__same") & ~F.col("__empty") & (F.trim("__o") != "")
    at = F.instr("__h", F.col("__hit"))
    r = r.withColumns({"applied": ok, "edited": F.when(ok, F.concat(F.left(F.col("__h"), at - 1), F.col("__n"), F.substr(F.col("__h"), at + F.length("__hit")))).otherwise(F.col("__h"))})
    return r.drop("__o", "__n", "__h", "__at", "__end", "__same", "__empty", "__pattern", "__hit")
