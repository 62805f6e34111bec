"""Fragments of oracle SQL that several queries share."""

from __future__ import annotations

from sieveline.functions import dims
from sieveline.functions.contact import EMAIL


def names(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def alternation(items) -> str:
    return "|".join(i.replace(".", r"\.") for i in items)


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[a-z0-9_]+'), lambda x: len(x) > 1)"


def slug(c: str) -> str:
    return f"regexp_replace(lower(strip_accents(split_part(coalesce({c}, ''), '(', 1))), '[^a-z0-9]', '', 'g')"


def host(c: str) -> str:
    return f"regexp_extract(lower(trim(coalesce({c}, ''))), '^(?:https?://)?(?:www\\.)?([^/\\s?#]+)', 1)"


def norm_url(c: str) -> str:
    u = f"regexp_replace(lower(trim(coalesce({c}, ''))), '^https?://(?:www\\.)?', '')"
    return f"regexp_replace(split_part(split_part({u}, '?', 1), '#', 1), '/+$', '')"


def norm_phone(c: str) -> str:
    d = f"regexp_replace(regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g'), '^00', '')"
    d = f"CASE WHEN len({d}) = 10 AND starts_with({d}, '0') THEN '33' || substr({d}, 2, 9) ELSE {d} END"
    return f"CASE WHEN len({d}) >= 8 THEN '+' || {d} ELSE '' END"


def _bare(d: str) -> str:
    return f"regexp_replace(regexp_replace(lower({d}), '^\\.+', ''), '^www\\.', '')"


def platform(d: str) -> str:
    return f"({d} = '' OR regexp_matches({_bare(d)}, '(?:^|\\.)(?:{alternation(dims.PLATFORM_DOMAINS)})$'))"


def placeholder(d: str) -> str:
    return f"({d} = '' OR {_bare(d)} IN ({names(dims.FAKE_DOMAINS)}))"


def norm_domain(c: str) -> str:
    d = f"regexp_replace(regexp_replace(trim(lower({c})), '^\\.+', ''), '^www\\.', '')"
    pre = f"^(?:{alternation(dims.FLATTEN_PREFIXES)})\\."
    return f"CASE WHEN regexp_matches({d}, '{pre}[^.]*\\.') THEN regexp_replace({d}, '{pre}', '') ELSE {d} END"


def clean_emails(source: str, key: str, raw: str) -> str:
    """CTEs ending in ``cleaned(key, i, e)`` from ``source`` with a list expression ``raw`` of raw addresses."""
    tech = f"(?:{alternation(dims.TECHNICAL_SUFFIXES)})$"
    return f"""
raw_ AS (SELECT {key}, unnest({raw}) AS r, generate_subscripts({raw}, 1) AS i FROM {source}),
low_ AS (SELECT *, replace(replace(replace(replace(lower(trim(r)), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'), 'ß', 'ss') AS l FROM raw_),
fold_ AS (SELECT *, strip_accents(l) AS f FROM low_),
hit_ AS (SELECT *, regexp_extract(f, '{EMAIL}') AS m FROM fold_),
part_ AS (SELECT *, split_part(m, '@', 1) AS local, regexp_extract(m, '@(.*)$', 1) AS dom FROM hit_),
norm_ AS (SELECT *, {norm_domain('dom')} AS nd FROM part_),
cleaned AS (SELECT {key}, i, local || '@' || nd AS e FROM norm_
 WHERE NOT (contains(l, '@') AND regexp_matches(regexp_extract(l, '([^@]*)$', 1), '[^\\x00-\\x7F]')) AND m <> ''
   AND NOT (regexp_matches(f, '[^\\x00-\\x7F]') AND regexp_matches(f, '[^\\x00-\\x7F]{EMAIL}|{EMAIL}[^\\x00-\\x7F]'))
   AND NOT starts_with(local, '.') AND NOT ends_with(local, '.') AND NOT contains(local, '..') AND local NOT IN ({names(dims.SUSPICIOUS_LOCAL_PARTS)})
   AND NOT starts_with(dom, 'www.') AND NOT {platform('dom')} AND NOT {placeholder('dom')} AND NOT {platform('nd')} AND NOT {placeholder('nd')}
   AND regexp_matches(regexp_extract(nd, '\\.([^.]*)$', 1), '^[a-z]+$') AND (len(regexp_extract(nd, '\\.([^.]*)$', 1)) <= 3 OR regexp_extract(nd, '\\.([^.]*)$', 1) IN ({names(dims.LONG_TLDS)}))
   AND NOT regexp_matches(nd, '{tech}') AND NOT regexp_matches(dom, '{tech}'))"""


def case_map(c: str, mapping: dict, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"
