"""Rule classifiers as ordered when-chains, one native expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import dims
from sieveline.functions.contact import URL, is_social
from sieveline.functions.text import fold


def _plain(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.replace(F.replace(s, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.replace(fold(s), F.lit("’"), F.lit("'"))


def first_rule(text: Column, rules, default: str = "") -> Column:
    """The category of the first ``(category, patterns)`` rule with a pattern in ``text``."""
    out = None
    for cat, stems in rules:
        hit = text.rlike("|".join(stems))
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out.otherwise(default)


def trade_category(c: Column) -> Column:
    """``artisan``, ``cabinet``, ``commerce`` or empty for a trade's description."""
    return first_rule(_plain(c), dims.TRADE_RULES)


def offer_segment(c: Column) -> Column:
    """Segment of the advisory offer a trade belongs to, empty if none."""
    s = _plain(c)
    broker = s.rlike("courtier|courtage|iobsp")
    return (
        F.when(s.rlike("diagnost|dpe"), "").when(broker & s.rlike("travaux|energie|demenag"), "").when(broker, "courtier").when(s.contains("comptab"), "comptable")
        .when(s.contains("avocat"), "avocat").when(s.rlike("agence immobiliere|agent immobilier|mandataire immo|immobilier"), "immo").otherwise("")
    )


def offer_required(trade: Column, website: Column, product: str = "advisory") -> Column:
    """The product a record must be offered: the advisory one for its segments, if there is a site."""
    return F.when((offer_segment(trade) != "") & (F.trim(F.coalesce(website, F.lit(""))) != ""), product).otherwise("")


def audience(sources: Column, creator_markers: tuple[str, ...], override: str = "") -> Column:
    """``creator`` if a source name is, or starts with, a marker, else ``pro``; an override wins."""
    if override in ("creator", "pro"):
        return F.lit(override)
    hit = F.exists(sources, lambda s: reduce(lambda a, m: a | F.lower(s).startswith(m), creator_markers, F.lit(False)))
    return F.when(F.coalesce(hit, F.lit(False)), "creator").otherwise("pro")


#: one alternation over all commercial link patterns
COMMERCIAL = "(?i)" + "|".join(dims.COMMERCIAL_URLS)
PRO_MAILBOX = r"\b(?:contact|pro|business|partenariat|partnership|sponsor|booking|management|biz|hello)@"


def commercial_signals(text: Column) -> Column:
    """``struct(monetized, reasons, urls)``: links, then words, then a business mailbox; six reasons at most."""
    t = F.coalesce(text, F.lit(""))
    urls = F.regexp_extract_all(t, F.lit(URL), F.lit(0))
    paid = F.transform(F.filter(urls, lambda u: u.rlike(COMMERCIAL)), lambda u: F.concat(F.lit("link:"), F.substring(u, 1, 60)))
    own = F.transform(F.filter(urls, lambda u: ~u.rlike(COMMERCIAL) & ~is_social(u)), lambda u: F.concat(F.lit("site:"), F.substring(u, 1, 60)))
    low = F.lower(t)
    # Java's \b is ASCII; borders are spelled out so that accented words end where they end. One pass
    # finds every place where some word of the list stands, in a look-ahead, so that words that
    # overlap are all met; then the list's order, not the text's, decides
    names = list(dict.fromkeys(dims.COMMERCIAL_WORDS))
    by_length = sorted(names, key=len, reverse=True)
    alone = lambda k: rf"{k.replace('.', chr(92) + '.')}(?![\p{{L}}\p{{N}}_])"
    met = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])(?=(" + "|".join(alone(k) for k in by_length) + "))"), F.lit(1)))
    # a longer word may hide shorter ones that end inside it at a border
    inner = {k: [w for w in names if w != k and k.startswith(w) and not k[len(w)].isalnum() and k[len(w)] != "_"] for k in names}
    shown = lambda k: reduce(lambda a, longer: a | F.array_contains(met, longer), [b for b in names if k in inner[b]], F.array_contains(met, k))
    words = F.when(F.size(met) > 0, F.array_compact(F.array(*[F.when(shown(k), F.lit("word:" + k)) for k in names]))).otherwise(F.array().cast("array<string>"))
    mail = F.when(low.rlike(PRO_MAILBOX), F.array(F.lit("mailbox"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(paid, own, words, mail)
    return F.struct((F.size(reasons) > 0).alias("monetized"), F.slice(reasons, 1, 6).alias("reasons"), F.slice(F.array_distinct(urls), 1, 8).alias("urls"))


def activity_code(c: Column) -> Column:
    """Dotted upper-case form of an activity code: ``4776z`` gives ``47.76Z``."""
    k = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[ .]", "")
    return F.when(k.rlike("^[0-9]{2}..") , F.concat_ws(".", F.substring(k, 1, 2), F.substring(k, 3, 64))).otherwise(k)


def section_label(c: Column) -> Column:
    """Label of an activity section letter, null if unknown."""
    letter = F.substring(F.upper(F.trim(c)), 1, 1)
    out = None
    for k, v in dims.SECTION_LABELS.items():
        out = F.when(letter == k, v) if out is None else out.when(letter == k, v)
    return out


def status_rank(c: Column) -> Column:
    out = F.when(c == "unsubscribed", 101).when(c == "bounced", 100)
    for i, s in enumerate(dims.STATUSES):
        out = out.when(c == s, i)
    return out.otherwise(-1)


def send_window(ts: Column, start: int, end: int, zone: str = "Europe/Paris") -> Column:
    """Is the local hour within ``[start, end)``? The window may pass midnight; equal ends never match."""
    a, b = max(0, min(23, start)), max(0, min(24, end))
    h = F.hour(F.from_utc_timestamp(ts, zone))
    if a == b:
        return F.lit(False)
    return (h >= a) & (h < b) if a < b else (h >= a) | (h < b)
