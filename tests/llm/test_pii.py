"""Base spans against Python's regular expressions, and what the method adds."""

import hashlib
import math
import re

from helpers import EDGE, SF, edge, empty
from sieveline.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CASES = [
    "a@b.c_x@d.e f@@g.h i@j..k 1.2.3.4.5.6.7.8 01.002.3.4 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111-2 4111  1111 5500000000000004 1", "+1 (234) 555-1234 +33 1 23 45 67 89. +12 +1  2 é+4912345678 +1-",
    "x" * 3000 + "@" + "y" * 50, "1" * 6000, "12-" * 3000, "1.2.3.4@5.6 +1.2.3.4.5.6.7.8.9", " 😀 a@b.cc 😀 5.5.5.5", "+1(2)", "0000000000000000 000.0.0.0", "a.b@c-d.e.f-.g",
]


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def reference(t):
    spans, counts = [], []
    for kind, p in PATTERNS.items():
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if valid(kind, m.group())]
        spans += own
        counts.append(len(own))
    return spans, (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def check(rows, text_of):
    for r in rows:
        spans, want = reference(text_of(r))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, r.doc_id
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in r.spans.split(",") if s]
        assert order == sorted(order) and r.n_added == len(order) - len(spans)


def test_cases(spark):
    rows = list(enumerate(CASES))
    check(pii.find_pii(edge(spark, rows + rows[:1])).collect(), lambda r: CASES[r.doc_id])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.op3_pii(spark, SF).collect()
    assert len(got) == len(texts)
    check(got, lambda r: texts[r.doc_id])


def test_edge(spark):
    got = pii.find_pii(edge(spark)).collect()
    assert len(got) == len(EDGE) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_pii(empty(spark)).count() == 0


def test_added_spans(spark):
    rows = [(i, f"tel: (0{i % 9 + 1}) 12 34 5{i % 10} 7{i % 7} end, mail anna{i} [at] firm [dot] fr") for i in range(30)] + [(100, "1.5 million and 2024-01-01 or 12 34")]
    got = {r.doc_id: r for r in pii.find_pii(edge(spark, rows)).collect()}
    assert all("email:" in got[i].spans for i in range(30)) and got[100].spans == ""
    assert sum("phone:" in got[i].spans for i in range(30)) > 20


def test_em_finds_the_bad_labeller():
    import random

    random.seed(3)
    rows = {}
    for _ in range(4000):
        y = random.random() < 0.4
        v = tuple(int(y if random.random() < p else not y) for p in (0.95, 0.9, 0.5))
        rows[v] = rows.get(v, 0) + 1
    pats = sorted((p, float(n)) for p, n in rows.items())
    post = dict(zip([p for p, _ in pats], pii._em(pats)))
    assert post[1, 1, 0] > 0.9 and post[0, 0, 1] < 0.1 and abs(post[1, 1, 0] - post[1, 1, 1]) < 0.05


def candidates(t):
    """All proposals of one text: ``(kind, base, start, end, votes, features)``."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    many = lambda m: 9 <= len(digits(m)) <= 15
    rules = [("email", PATTERNS["email"], lambda m: True, True), ("ip", PATTERNS["ip"], lambda m: valid("ip", m), True), ("card", pii.CARD, lambda m: luhn(digits(m)), True), ("phone", PATTERNS["phone"], many, True),
             ("email", pii.SPELLED, lambda m: True, False), ("card", pii.CARD, lambda m: not luhn(digits(m)), False), ("phone", pii.NATIONAL, many, False)]
    for kind, p, ok, base in rules:
        ms = list(re.finditer(p, t))
        for i, m in enumerate(ms):
            b = m.group()
            if not ok(b):
                continue
            left = t[ms[i - 1].end() if i else 0 : m.start()][-pii.LEFT :]
            right = t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)][: pii.RIGHT]
            n = len(digits(b))
            has = lambda p, s: re.search(p, s) is not None
            form = 1 if base else (None if 9 <= n <= 11 else 0) if kind == "phone" else None
            check = int(luhn(digits(b))) if kind == "card" else 0 if kind == "phone" and not 9 <= n <= 15 else None
            near = 1 if has(rf"(?:^|[^a-z])(?:{pii.GAZETTEER[kind]})[^a-z0-9]{{0,6}}$", left.lower()) else None
            before = 0 if has(r"[A-Za-z0-9_=#\"/.]$", left) else 1 if left == "" or has(r"[\s:(,;|]$", left) else None
            after = 0 if has(r"^[A-Za-z0-9_=\"/]", right) else 1 if right == "" or has(r"^[\s),.;|!?]", right) else None
            variety = (0 if len(set(digits(b))) <= 3 else None) if kind in ("card", "phone") else (0 if has(r"^(0|127|255)\.|\.0\.0", b) else 1) if kind == "ip" else None
            shape = {"card": 1 if has(r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", b) else None, "phone": 1 if has(r"^\+|^\([0-9]+\)|^0[1-9]", b) else None, "email": 1 if has(r"\.[A-Za-z]{2,}$", b) else 0, "ip": None}[kind]
            word = re.search("([a-z]+)[^a-z]*$", left.lower())
            features = (min(len(b) // 4, 7), sum(1 << k for k, q in enumerate((r"\s", "-", r"\.", r"[()\[\]]")) if has(q, b)), int(hashlib.md5((word.group(1) if word else "").encode()).hexdigest()[:4], 16) % 16)
            yield kind, base, m.start(), m.end(), (form, check, near, before, after, variety, shape), features


def test_added_spans_are_brute_force(spark):
    """Every span of every text, from proposals, votes, features and the classifier worked out in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = [(10**6 + i, f"call (0{i % 9 + 1}) 12 34 5{i % 10} 7{i % 7} end 4111 1111 1111 111{i % 10}, x{i}a [at] firm [dot] fr ref 012 345 67{i % 5} 9") for i in range(40)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    found = {d: list(candidates(t or "")) for d, t in rows}
    seen: dict = {k: {} for k in pii.KINDS}
    for d, cs in found.items():
        for c in cs:
            seen[c[0]][c[4], c[5]] = seen[c[0]].get((c[4], c[5]), 0) + 1
    weights = {k: pii.train([(v, f, float(n)) for (v, f), n in x.items()]) for k, x in seen.items()}
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = 0
    for d, cs in found.items():
        base = [c for c in cs if c[1]]
        extra = [c for c in cs if not c[1] and 1 / (1 + math.exp(-sum(weights[c[0]][k] for k in pii._columns(c[4], c[5])))) >= 0.5]
        extra = [c for c in extra if not any(c[2] < b[3] and b[2] < c[3] for b in base)]
        added += len(extra)
        want = sorted({(pii.KINDS.index(c[0]), c[2], c[3]) for c in base + extra})
        assert got[d] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want), d
    assert added > 40
