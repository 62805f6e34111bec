"""Licences that texts name: identifier tags and notice phrases by Aho-Corasick, and what their expressions allow.

One automaton holds every phrase as words between spaces. A text's words, joined by single spaces,
run through it once, whatever the number of phrases; each hit gives the number of its first word.

* Base phrases count at every place, overlapping or not.
* Of all licence names the leftmost-longest ones are operands. Names with nothing but ``and``, ``or`` or
  ``with`` and filling words between them form one expression.
* After a tag (``SPDX-License-Identifier``) the expression is read from the raw text, with parentheses.

A shunting-yard parser turns either kind into postfix order (``with`` binds before ``and``, that before
``or``), and evaluation gives the terms that remain for a user who may choose: the mildest side of an
``or``, the strictest of an ``and``, and one step milder than a copyleft licence ``with`` a linking exception.

A document is judged alone, in one pass without a shuffle; memory is bounded by the longest text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textops import ALNUM, sub_batches, words_of

#: fixed by the contract
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TERMS = ("permissive", "weak copyleft", "copyleft", "restricted", "unknown")
PERMISSIVE, WEAK, COPYLEFT, RESTRICTED, UNKNOWN = range(5)
#: families of identifiers, by how they begin, most particular first
FAMILIES = (
    ("cc-by-nc", RESTRICTED), ("cc-by-nd", RESTRICTED), ("proprietary", RESTRICTED), ("cc-by-sa", COPYLEFT), ("agpl", COPYLEFT), ("gpl", COPYLEFT), ("lgpl", WEAK), ("mpl", WEAK), ("epl", WEAK), ("cddl", WEAK),
    ("cc-by", PERMISSIVE), ("cc0", PERMISSIVE), ("mit", PERMISSIVE), ("apache", PERMISSIVE), ("bsd", PERMISSIVE), ("0bsd", PERMISSIVE), ("isc", PERMISSIVE), ("zlib", PERMISSIVE), ("bsl-1", PERMISSIVE), ("unlicense", PERMISSIVE),
    ("wtfpl", PERMISSIVE), ("python", PERMISSIVE), ("psf", PERMISSIVE), ("public-domain", PERMISSIVE))
TAGS = ("spdx license identifier", "license expression", "licence expression")
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of")
FILLERS = frozenset("the a an of license licenses licence licences version v either both terms under only your option at this software".split())
TAG_WEIGHT, NOTICE_WEIGHT, NAME_WEIGHT, GRANT_WEIGHT = 0.9, 0.7, 0.5, 0.3


def names() -> dict[str, tuple[str, float]]:
    """Phrases of licence names, with their label and what each is worth as evidence."""
    out = {p: (x, NAME_WEIGHT) for p, x in BASE.items()}

    def add(label, *phrases, weight=NOTICE_WEIGHT):
        out.update({p: (label, weight) for p in phrases if p not in BASE})

    for label, long, versions in (("gpl", "gnu general public license", ("2", "3")), ("lgpl", "gnu lesser general public license", ("2 1", "3")), ("agpl", "gnu affero general public license", ("3",)), ("mpl", "mozilla public license", ("1 1", "2 0")), ("epl", "eclipse public license", ("1 0", "2 0"))):
        gnu = "gpl" in label
        add(label, long, *(f"{g}{label}" for g in (("gnu ",) if gnu else ())), weight=NAME_WEIGHT)
        for v in versions:
            one = label + "-" + (v.replace(" ", ".") if " " in v else v + ".0")
            forms = [f"{n}{w}{x}" for n in (long, label, *([f"gnu {label}"] if gnu else [])) for w in (" version ", " v", "v", " ") for x in dict.fromkeys((v, v if " " in v else v + " 0")) if n != long or w != "v"]
            add(one, *forms)
            if gnu:
                add(one + "-or-later", *(f + s for f in forms for s in (" or later", " or any later version", " or at your option any later version")))
                add(one + "-or-later", f"{long} as published by the free software foundation either version {v} of the license or at your option any later version")
    add("apache-2.0", *(f"{n}{w}2 0" for n in ("apache license", "apache") for w in (" version ", " v", " ")))
    add("mit", "mit licence", "mit licensed", "the mit expat license", "permission is hereby granted free of charge to any person obtaining a copy")
    for kind in ("2", "3"):
        add(f"bsd-{kind}-clause", f"bsd {kind} clause", f"{kind} clause bsd")
    add("bsd", "bsd license", "bsd licence", weight=NAME_WEIGHT)
    add("bsd", "redistribution and use in source and binary forms with or without modification")
    commons = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    for suffix in ("", "nc", "nd", "sa", "nc nd", "nc sa"):
        short = " ".join(("cc by", *suffix.split()))
        long = " ".join(("creative commons attribution", *(commons[s] for s in suffix.split())))
        label = short.replace(" ", "-")
        add(label, short, long)
        for v in ("2 0", "2 5", "3 0", "4 0"):
            add(f"{label}-{v.replace(' ', '.')}", f"{short} {v}", f"{long} {v}")
    add("cc0-1.0", "cc0", "cc0 1 0", "creative commons zero")
    add("public-domain", "released into the public domain", "dedicated to the public domain")
    add("unlicense", "this is free and unencumbered software released into the public domain")
    add("isc", "isc license", "isc licence")
    add("zlib", "zlib license", "zlib licence")
    add("bsl-1.0", "boost software license", "boost software license version 1 0")
    add("proprietary", "all rights reserved", weight=GRANT_WEIGHT)
    return out


@lru_cache(maxsize=1)
def automaton():
    """Every phrase between spaces; the value holds its words' number and what it stands for."""
    known, out = names(), ahocorasick.Automaton()
    for p in {*known, *TAGS, *GRANTS}:
        label, weight = known.get(p, (None, GRANT_WEIGHT))
        out.add_word(f" {p} ", (p.count(" ") + 1, p, label, 0.0 if p in TAGS else weight))
    out.make_automaton()
    return out


_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_AFTER_TAG = re.compile(rb"[ \t]*[:=][ \t]*")


def level(identifier: str) -> int:
    """Terms of one identifier."""
    return next((t for start, t in FAMILIES if identifier.startswith(start)), UNKNOWN)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard; None where the tokens are no expression."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in _PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[int, list[str]]:
    """Terms of an expression in postfix order, and the identifiers of its licences."""
    stack: list[tuple[int, str]] = []
    licences = []
    for t in rpn:
        if t not in _PRECEDENCE:
            stack.append((level(t), t))
            licences.append(t)
            continue
        (b, right), (a, _) = stack.pop(), stack.pop()
        if t == "with":
            # an exception is no licence; the one for linking and its like soften copyleft by a step
            if right in licences:
                licences.remove(right)
            stack.append((WEAK if a == COPYLEFT and "exception" in right else a, ""))
        else:
            stack.append((min(a, b) if t == "or" else max(a, b), ""))
    return stack[0][0], licences


def tagged(raw: bytes, at: int) -> tuple[list[str], int]:
    """Tokens of the longest expression in ``raw`` from ``at`` (behind a tag) to the end of its line, and where it ends."""
    m = _AFTER_TAG.match(raw, at)
    tokens, depth, operand, whole, end = [], 0, True, 0, at
    at = m.end() if m else len(raw)
    while m := _TOKEN.match(raw, at):
        t = (m[1] or m[2]).decode().lower()
        is_word = t in _PRECEDENCE
        if operand != (t == "(" or not (is_word or t == ")")):
            break
        depth += (t == "(") - (t == ")")
        if depth < 0:
            break
        operand = t == "(" or is_word
        tokens.append(t)
        at = m.end()
        if not operand and not depth:
            whole, end = len(tokens), at
    return tokens[:whole], end


def spoken(hits: list[tuple[int, int, str]], gap) -> list[list[str]]:
    """Tokens of the expressions that licence names in running text form.

    ``hits`` are ``(first word, word behind, label)`` in order of their ends; ``gap(a, b)`` gives the words between.
    """
    names, out = [], []
    for a, b, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not names or a >= names[-1][1]:
            names.append((a, b, label))
    for i, (a, _, label) in enumerate(names):
        word = None
        # fillers around an operator are few
        if i and a - names[i - 1][1] <= 8:
            between = [w for w in gap(names[i - 1][1], a) if w not in FILLERS]
            word = {("and",): "and", ("or",): "or", ("and", "or"): "or", ("with",): "with"}.get(tuple(between))
        if word:
            out[-1] += [word, label]
        else:
            out.append([label])
    return out


_NOT_WORD = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")


def scan(raw: bytes) -> tuple:
    """``(words, base places, first, last, base labels, labels, score, expressions, terms)`` of one text."""
    # every byte that belongs to no word becomes a space
    line = _SPACES.sub(b" ", b" " + raw.translate(_NOT_WORD) + b" ").decode()
    n_words = line.count(" ") - 1
    places, base, labels, seen, hits, tags = [], set(), set(), {}, [], []
    at = behind = 0
    spans: dict[int, int] = {}
    for end, (size, phrase, label, weight) in automaton().iter(line):
        behind += line.count(" ", at, end)
        at, first = end, behind - size
        if phrase in BASE:
            places.append(first)
            base.add(BASE[phrase])
        if phrase in TAGS:
            tags.append(behind)
        else:
            seen[phrase] = weight
        if label:
            labels.add(label)
            hits.append((first, behind, label))
            spans[behind], spans[first] = end, end - len(phrase) - 1
    expressions = []
    if tags:
        words, inside = words_of([raw], ALNUM), [0]
        for b in tags:
            tokens, end = tagged(raw, int(words.ends[b - 1]))
            if tokens:
                expressions.append(tokens)
                seen["tag"] = TAG_WEIGHT
                inside += [b, int(words.starts.searchsorted(end))]
        # names in a tag's expression are read once
        hits = [h for h in hits if bisect_right(inside, h[0]) % 2]
    expressions += spoken(hits, lambda a, b: line[spans[a] : spans[b] + 1].split())
    said, terms = {}, []
    for tokens in expressions:
        key = " ".join(t.upper() if t in _PRECEDENCE else t for t in tokens)
        if key not in said:
            rpn = postfix(tokens)
            said[key], licences = evaluate(rpn)
            terms.append(said[key])
            labels |= {x for x in licences if level(x) != UNKNOWN}
    missing = 1.0
    for p in sorted(seen):
        missing *= 1 - seen[p]
    return (n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - missing, "; ".join(said), TERMS[max(terms)] if terms else None)


_OUT = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("terms", pa.string()))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What licences each whole text names.

    Returns one row per input row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` as the contract of ``op11_licence_scan`` has them, ``expressions`` (distinct, in order of tags,
    then of names; joined by ``; ``) and ``terms``, the strictest of what the expressions leave: all of a
    document's notices hold together. ``score`` is the chance that not all distinct phrases met are idle, each being worth
    what its kind says. Identifiers that no family knows are in ``expressions`` and make ``terms`` unknown.

    Null text is empty: no words, no labels, score 0, no terms. Repeated rows get equal results. Empty
    input gives no rows. Other columns are not read; ids pass through as they are.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at, texts in sub_batches(batch, "text"):
                got = list(zip(*map(scan, texts)))
                yield pa.RecordBatch.from_arrays([batch.column("id")[at], *(pa.array(x, t) for x, (_, t) in zip(got, _OUT))], ["id", *(n for n, _ in _OUT)])

    types = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {types[t]}" for n, t in _OUT)).withColumnRenamed("id", id_col)


def op11_licence_scan(spark, sf_dir):
    """``scan_licences`` over all ``documents``; its handling of nulls, ties and repeats holds."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
