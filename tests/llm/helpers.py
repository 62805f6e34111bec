"""Fixtures and brute-force references shared by the tests of the numbered operators."""

import collections
import hashlib
import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, spans string, kept string"

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30000))
EDGE = [
    (0, "the quick brown fox jumps over the lazy dog again and again today"), (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, "ONE two"),
    (7, LONG), (8, LONG), (9, "été 😀 naïve Straße été 😀"), (10, "a" * 5000), (11, "In. " * 400), (12, "the quick brown fox jumps over the lazy dog again and again Today"),
    (13, "x\x00y\x0bz \x85 w"), (14, "!!! ### $$$"), (None, "no id here"), (None, None), (15, "no id here"), (5, "one two"),
]


def edge(spark, rows=None):
    """The edge-case documents, with extra columns whose names clash with inner ones."""
    rows = EDGE if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", "fr", None][(i or 0) % 3], [None, "b", "a", "a"][(i or 0) % 4], len(t or ""), "s", "h", "sp", "k") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (s or ""))


def words(s):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(s))


def shingles(s):
    w = words(s)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs, percent):
    """Brute force: smallest id reachable through links of shingle sets."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    where = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = collections.Counter((a, b) for l in where.values() for k, b in enumerate(l) for a in l[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def repeats(docs, span=100):
    """Brute force of repeated strings: per document (bytes, removed, runs, sha256 of the rest)."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        off = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                off[i : i + span] = b"\x01" * span
            seen.add(w)
        kept = bytes(x for x, o in zip(b, off) if not o)
        runs = sum(1 for i, o in enumerate(off) if o and (i == 0 or not off[i - 1]))
        out[d] = (len(b), sum(off), runs, hashlib.sha256(kept).hexdigest())
    return out
