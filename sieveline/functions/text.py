"""Text expressions: folding, tokens, names, templates, model answers. All native columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import dims


def _fold_table() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter and combining marks, by rule."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()
COMBINING = "[\\u0300-\\u036f]"


def blank(c: Column) -> Column:
    """Null for null or blank text: the engine's one notion of empty."""
    return F.when(F.trim(c) != "", c)


def fold(c: Column) -> Column:
    """Accents removed; null stays null."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), COMBINING, "")


def tokens(c: Column) -> Column:
    """Distinct-order list of folded lower-case words of more than one character; null gives none."""
    return F.filter(F.regexp_extract_all(F.lower(fold(F.coalesce(c, F.lit("")))), F.lit(r"([a-z0-9_]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def _hits(words: Column, hints) -> Column:
    return F.size(F.filter(words, lambda t: t.isin(*hints)))


def query_language(c: Column, words: Column | None = None) -> Column:
    """``fr``, ``en`` or empty, by hint words and then by accented letters; ``words`` are the tokens of ``c`` where they are a column."""
    w = tokens(c) if words is None else words
    fr, en = _hits(w, dims.FRENCH_HINTS), _hits(w, dims.ENGLISH_HINTS)
    return F.when(fr > en, "fr").when(en > fr, "en").when(c.rlike("[éèêëàâäîïôöùûüç]"), "fr").otherwise("")


def handle(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(c)), "^@+", ""))


def slug(c: Column) -> Column:
    """Letters and digits only, folded, of what stands before a parenthesis."""
    return F.regexp_replace(F.lower(fold(F.substring_index(F.coalesce(c, F.lit("")), "(", 1))), "[^a-z0-9]", "")


#: what stands between the words of a name, and a word
_JOINTS = r"([\s'’-]*)([^\s'’-]+)"


def display_name(c: Column) -> Column:
    """A display case for names wholly in lower case; other names, and over-long ones, stay as they are.

    A name is read once as pairs of a joint and a word, and each word is capitalised or not by its
    neighbours: behind an apostrophe, only after an elided article; elsewhere always, but for a small word
    or an elided article that is not the first word. Runs of blanks become one.
    """
    s = F.trim(c)
    words, joints = (F.regexp_extract_all(s, F.lit(_JOINTS), F.lit(g)) for g in (2, 1))
    at = lambda xs, i: F.try_element_at(xs, i.cast("int"))
    hung = lambda i: F.coalesce(at(joints, i).isin("'", "’"), F.lit(False))
    # the word before i (from 0) is number i (from 1); with none before it, it is the first
    elided = lambda i: F.coalesce(at(words, i).isin(*dims.ELISIONS), F.lit(False))

    def cased(pair, i):
        small = F.when(hung(i + 2), elided(i + 1)).otherwise(pair["w"].isin(*dims.SMALL_WORDS))
        low = F.when(i == 0, False).when(hung(i + 1), ~elided(i)).otherwise(small)
        big = F.concat(F.upper(F.substring(pair["w"], 1, 1)), F.substring(pair["w"], 2, 1 << 20))
        return F.concat(F.regexp_replace(pair["j"], r"\s+", " "), F.when(low, pair["w"]).otherwise(big))

    pairs = F.arrays_zip(joints.alias("j"), words.alias("w"))
    out = F.concat(F.array_join(F.transform(pairs, cased), ""), F.regexp_extract(s, r"[\s'’-]*$", 0))
    fixable = s.rlike(r"\p{L}") & ~s.rlike(r"\p{Lu}") & (F.length(s) <= 55) & (F.size(F.split(s, r"\s+")) <= 6)
    return F.when(fixable, out).otherwise(c)


POLLUTED = r"^(.{2,60}?)\s*[.;|·:—–]\s+(.{15,})$"


def name_is_polluted(c: Column) -> Column:
    """A name that is over-long, or a name and a description run together."""
    n = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(n) > 60) | n.rlike(POLLUTED)


def split_polluted(c: Column) -> Column:
    """``struct(name, rest)``, null where no clean cut exists."""
    n = F.trim(c)
    name = F.regexp_replace(F.regexp_extract(n, POLLUTED, 1), r"^[ .,—·|-]+|[ .,—·|-]+$", "")
    ok = n.rlike(POLLUTED) & F.length(name).between(2, 60)
    return F.when(ok, F.struct(name.alias("name"), F.trim(F.regexp_extract(n, POLLUTED, 2)).alias("rest")))


def words_subset(proposed: Column, original: Column) -> Column:
    """Is every word of ``proposed`` in ``original``, and is there one?"""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(fold(F.coalesce(c, F.lit("")))), F.lit("([a-z0-9]+)"), F.lit(1)))
    p = words(proposed)
    return (F.size(p) > 0) & (F.size(F.array_except(p, words(original))) == 0)


def industry_is_sane(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.length(s).between(2, 40) & s.rlike(r"^[a-zA-ZÀ-ÿ' \-/&]+$")


PLACEHOLDER = r"\{\{?[A-Za-z_][A-Za-z0-9_]*\}?\}"
#: phrases with which a model declines, looked for in the first 400 characters; fixed values
REFUSALS = (
    "**probleme majeur**", "**problème majeur**", "problème majeur :", "probleme majeur :", "je ne peux pas rediger", "je ne peux pas rédiger",
    "impossible de rediger", "impossible de rédiger", "aucune info exploitable", "contradiction directe dans les consignes", "je n'ai pas assez d'info", "je manque d'info pour",
)


def unfilled_placeholder(*cols: Column) -> Column:
    """The first placeholder left in the texts, empty if none."""
    return F.regexp_extract(F.concat_ws("\n", *cols), PLACEHOLDER, 0)


def looks_like_refusal(c: Column) -> Column:
    head = F.substring(F.lower(F.trim(F.coalesce(c, F.lit("")))), 1, 400)
    return reduce(lambda a, p: a | head.contains(p), REFUSALS, F.lit(False))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders; unknown ones survive, null values become empty."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)


#: the named entities that occur in page text; fixed values
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Visible text of a page: no scripts, styles, tags or runs of blanks."""
    t = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: edit categories and the stems that lead to them, in order; fixed values
EDIT_TYPES = (
    ("fluidité", ("fluid", "transition", "enchain", "tournure")), ("répétition", ("repet", "répét", "redond")),
    ("personnalisation", ("personnalis", "prospect", "métier", "metier", "ville")),
    ("clarté", ("clart", "clair", "offre", "formul", "précis", "precis", "compréhen", "comprehen")),
    ("ton", ("ton", "chaleur", "insist", "impérat", "imperat", "pousse", "douceur")),
    ("concision", ("concis", "court", "raccourc", "superflu", "longueur", "allég", "alleg", "retir", "supprim")), ("accroche", ("accroch", "objet", "ouvertur", "début", "debut")),
)


def edit_type(c: Column) -> Column:
    """One of the fixed edit categories; empty for empty text, ``autre`` for unknown."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(s == "", "")
    for cat, _ in EDIT_TYPES:
        out = out.when(s.contains(cat), cat)
    for cat, stems in EDIT_TYPES:
        out = out.when(reduce(lambda a, k: a | s.contains(k), stems, F.lit(False)), cat)
    return out.otherwise("autre")


def parse_review(c: Column) -> Column:
    """``struct(score, verdict, comment, edit)`` of a model's JSON review, tolerant of fences and chatter."""
    body = F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?im)^```(?:json)?\s*|\s*```$", ""), r"(?s)\{.*\}", 0)
    j = F.from_json(body, "score string, verdict string, comment string, modif_type string")
    score = F.coalesce(F.least(F.lit(10), F.greatest(F.lit(0), j["score"].try_cast("int"))), F.lit(0))
    said = F.lower(F.trim(F.coalesce(j["verdict"], F.lit(""))))
    verdict = F.when(body == "", "draft").when(said.isin("ok", "draft"), said).otherwise(F.when(score >= 7, "ok").otherwise("draft"))
    return F.struct(score.alias("score"), verdict.alias("verdict"), F.substring(F.trim(F.coalesce(j["comment"], F.lit(""))), 1, 300).alias("comment"), edit_type(j["modif_type"]).alias("edit"))


def split_list(c: Column, pattern: str = r"[,;|/]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


#: legal forms and articles that are no first name; fixed values
NO_FIRST_NAME = ("sarl", "sas", "eurl", "sa", "sci", "snc", "the", "le", "la", "les")


def first_name(c: Column) -> Column:
    """The first word of a firm's name that has a letter and is no legal form or article, else empty."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,()\[\]]+|[.,()\[\]]+$", "")
    w = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: bare(x).rlike(r"\p{L}") & ~bare(x).isin(*NO_FIRST_NAME))
    first = F.try_element_at(w, F.lit(1))
    return F.coalesce(F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1 << 20))), F.lit(""))


def message_name(c: Column) -> Column:
    """The name used in messages: up to a parenthesis; ALL CAPS word by word, lower case by the display rule."""
    n = F.regexp_replace(F.substring_index(F.coalesce(c, F.lit("")), "(", 1), r"^[ .-]+|[ .-]+$", "")
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    caps = F.array_join(F.transform(F.split(n, r"\s+"), word), " ")
    return F.when((n != "") & (n == F.upper(n)), caps).otherwise(display_name(n))


def split_answer(c: Column) -> Column:
    """``struct(subject, body)`` of a model's mail: the subject line, and the rest."""
    line = r"(?im)^\s*(?:OBJET|SUBJECT)\s*[:：]\s*(.+?)\s*$"
    return F.struct(F.regexp_extract(c, line, 1).alias("subject"), F.regexp_replace(F.regexp_replace(c, line, ""), r"^\s+|\s+$", "").alias("body"))



def shared_start(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), 1)
    return F.when(n == 0, 0).when(differs == 0, n).otherwise(differs - 1).cast("int")
