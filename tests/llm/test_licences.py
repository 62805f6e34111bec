"""Licence scan against plain search; expressions against Python's own operators."""

import random
import re

import pytest

from helpers import EDGE, SF, edge, empty, lower
from sieveline.llm import licences as li
from sieveline.llm import on_workers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Base columns, and the labels and worth of all phrases, by trying each phrase at each word."""
    w = WORD.findall(lower(text))
    known = li.names()
    split = {p: tuple(p.split()) for p in (*known, *li.GRANTS)}
    where = {}
    for n in {len(s) for s in split.values()}:
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append(i)
    at = {p: where.get(s, []) for p, s in split.items()}
    places = [i for p in li.BASE for i in at[p]]
    base = {li.BASE[p] for p in li.BASE if at[p]}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), {known[p][0] for p in known if at[p]}, {p for p in at if at[p]}


def check(got, rows):
    want = sorted((str(i), *plain(t)[:5]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(plain(t))
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if "license" not in (r.expressions or "") and len(by[r.doc_id]) == 1:
            assert (r.score > 0) == bool(by[r.doc_id][0][6]) or "spdx" in str(r.expressions)


def test_documents(spark):
    on_workers(spark)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = li.op11_licence_scan(spark, SF).collect()
    check(got, rows)
    assert any(r.n_base for r in got) and any(not r.labels and r.score == 0 and r.terms is None for r in got)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows)):
        assert plain(t)[5] <= set(r.labels.split(",")) | {""}


def test_edge(spark):
    on_workers(spark)
    more = [(30, "MIT License mit license MIT\nLICENSE"), (31, "mit licenses, amit license, mitlicense"), (32, "CC BY-NC 4.0 cc-by"), (33, "ɢnu GNU General Public License"), (34, "été MIT License é"), (35, "mit license " * 20000)]
    got = li.scan_licences(edge(spark, [*EDGE, *more])).collect()
    check(got, [*EDGE, *more])
    by = {r.doc_id: r for r in got}
    assert by[32].labels == "cc-by,cc-by-nc,cc-by-nc-4.0" and by[32].terms == "restricted" and by[35].n_base == 20000
    assert li.scan_licences(empty(spark)).count() == 0


@pytest.mark.parametrize("text, expressions, terms", [
    ("# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */", "( mit OR gpl-2.0-only ) AND apache-2.0", "permissive"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 extra words", "gpl-2.0-or-later WITH classpath-exception-2.0", "weak copyleft"),
    ("SPDX-License-Identifier: MIT AND\nnext line", "mit", "permissive"),
    ("SPDX-License-Identifier: (MIT OR", "", None),
    ("SPDX-License-Identifier GPL-2.0", "gpl-2.0", "copyleft"),
    ("License-Expression: Foo-1.0 or MIT", "foo-1.0 OR mit", "permissive"),
    ("License-Expression: Foo-1.0 and MIT", "foo-1.0 AND mit", "unknown"),
    ("Dual licensed under the MIT License or the Apache License, Version 2.0.", "mit OR apache-2.0", "permissive"),
    ("under the GNU General Public License, version 3 and the MIT License", "gpl-3.0 AND mit", "copyleft"),
    ("MIT License, then much else. Apache License", "mit; apache", "permissive"),
    ("GNU General Public License version 2 or later", "gpl-2.0-or-later", "copyleft"),
])
def test_expressions(text, expressions, terms):
    got = li.scan(text.encode())
    assert (got[7], got[8]) == (expressions, terms)


def test_parser_against_plain_evaluation():
    """Random expressions: precedence and parentheses as a recursive descent evaluates them."""
    rng = random.Random(1)
    leaves = ["mit", "gpl-3.0", "mpl-2.0", "cc-by-nc-4.0", "other"]

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(leaves)]
        out = grow(depth - 1)
        for _ in range(rng.randrange(3)):
            out += [rng.choice(["and", "or"])] + grow(depth - 1)
        return ["(", *out, ")"] if rng.random() < 0.6 else out

    def descend(t):
        def atom():
            if t[0] == "(":
                t.pop(0)
                x = alternatives()
                t.pop(0)
                return x
            return li.level(t.pop(0))

        def both():
            x = atom()
            while t and t[0] == "and":
                t.pop(0)
                x = max(x, atom())
            return x

        def alternatives():
            x = both()
            while t and t[0] == "or":
                t.pop(0)
                x = min(x, both())
            return x

        return alternatives()

    for _ in range(500):
        t = grow(4)
        assert li.evaluate(li.postfix(t))[0] == descend(list(t))
    for wrong in (["("], [")"], ["and"], ["mit", "mit"], ["mit", "or"], ["(", "mit"], ["mit", ")"], []):
        assert li.postfix(wrong) is None
