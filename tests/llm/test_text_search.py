"""Decontamination, near-duplicates and repeated strings against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from helpers import EDGE, SF, components, edge, empty, lower, repeats, shingles
from sieveline.llm import decontaminate, hashfilter, near_dedup, suffix_dedup, textops


def contamination(docs, items):
    word = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for item, t in items:
        w = word(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = word(t), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= own - {None}
        out.append((d if d is not None else -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run10(docs, bench):
    got = decontaminate.contamination(docs, bench).na.fill(-1, ["doc_id"])
    return sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_decontaminate_table(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert run10(docs, bench) == want and any(x[2] for x in want)


def test_decontaminate_short_items_and_edges(spark):
    items = [(1, "the quick BROWN fox jumps over the lazy dog again"), (2, "one, two"), (3, "naïve"), (4, None), (5, "..."), (6, "lazy dog again and again today x"), (7, "word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 zzz"), (12, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run10(edge(spark), bench) == contamination(EDGE, items)
    assert run10(edge(spark), bench.limit(0)) == contamination(EDGE, [])
    assert run10(empty(spark), bench) == []


def test_decontaminate_items_without_id_and_a_common_passage(spark):
    """One passage in every item and document; items without an id hit, but have no name."""
    rnd = random.Random(8)
    some = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    passage, lone = some(25), some(12)
    items = [(i % 40, some(5) + " " + passage + " " + some(8)) for i in range(60)] + [(None, lone), (None, None), (90, lone[: len(lone) // 2])]
    docs = [(i, f"{some(3)} {passage} {some(9)}") for i in range(50)] + [(50, lone), (51, f"x {lone} y"), (51, some(30)), (None, lone), (None, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run10(edge(spark, docs), bench) == contamination(docs, items)


def test_filter_of_hashes(spark, monkeypatch):
    """Every hash passes its own filter; a saturated one lets more windows through and changes nothing."""
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = hashfilter.hash_filter(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", len(h), 27)
    assert f.passes(h.view(np.uint64)).all() and f.passes(textops.mix64(h.view(np.uint64))).mean() < 0.05
    monkeypatch.setattr(decontaminate, "MAX_LOG_BITS", 6)
    items = [(1, "the quick BROWN fox jumps over the lazy dog again"), (2, "one, two")]
    assert run10(edge(spark), spark.createDataFrame(items, "item_id long, text string")) == contamination(EDGE, items)


def test_winnowing_guarantee():
    """Any shared span of 10 words shares a fingerprint, whatever stands around it."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    for _ in range(300):
        span = " ".join(rnd.choices(vocabulary, k=10))
        marks = []
        for _ in range(2):
            text = " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9))) + " " + span + " " + " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))
            marks.append(set(decontaminate._fingerprints([text.strip().encode()], ())[1][2].tolist()))
        assert marks[0] & marks[1]


def near(docs, **kw):
    return {r.doc_id if r.doc_id is not None else -1: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs, **kw).collect()}


def copies(n=60, seed=2):
    """Groups of near copies around the threshold, chains, and texts that share a passage only."""
    rnd = random.Random(seed)
    word = lambda: f"t{rnd.randint(0, 5000)}"
    passage = [word() for _ in range(30)]
    docs = []
    for g in range(n // 6):
        base = [word() for _ in range(rnd.randint(8, 120))] + (passage if g % 2 else [])
        for k in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = word()
            docs.append(" ".join(w))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("percent, leaf", [(85, 2048), (80, 4)])
def test_near_against_brute_force(spark, percent, leaf):
    docs = copies()
    want = components(docs, percent)
    got = near(edge(spark, docs), percent=percent, leaf=leaf)
    assert got == {d: (len(shingles(t)), want[d], want[d] == d) for d, t in docs}


def crowd(pairs, others, seed=3):
    """A large group of near copies of one text, and in it pairs that are linked to each other only: ``2 * i`` with ``2 * i + 1``."""
    rnd = random.Random(seed)
    fresh = iter(range(10**9))
    hub = [f"h{i}" for i in range(100)]

    def changed(w, places):
        w = list(w)
        for p in places:
            w[p] = f"n{next(fresh)}"
        return w

    docs = []
    for _ in range(pairs):
        x = changed(hub, rnd.sample(range(5, 95), 4))
        docs += [x, changed(x, [rnd.randrange(5, 95), 98])]
    docs += [changed(hub, [rnd.randrange(5, 95)]) for _ in range(others)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_near_pairs_apart_from_the_hub(spark, monkeypatch):
    """Where branching ends, a node far above ``leaf`` still links pairs that its hub does not."""
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", 1)
    pairs = 80
    docs = crowd(pairs, 60)
    sets = [shingles(t) for _, t in docs]
    linked = [i for i in range(pairs) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 85 * len(sets[2 * i] | sets[2 * i + 1])]
    got = near(edge(spark, docs), percent=85, trees=4, leaf=64)
    lost = [i for i in linked if got[2 * i][1] != got[2 * i + 1][1]]
    assert len(linked) > pairs // 2 and len(lost) <= 0.01 * len(linked), (len(lost), len(linked))


def test_near_dense_group_far_above_the_leaf(spark):
    """360 near copies, 16 of which fill a leaf: components against brute force, with the depth that the stated recall allows."""
    rnd = random.Random(21)
    fresh = iter(range(10**9))
    hub = [f"h{i}" for i in range(110)]

    def changed(w, n):
        w = list(w)
        for p in rnd.sample(range(5, 105), n):
            w[p] = f"n{next(fresh)}"
        return w

    docs = []
    for _ in range(90):
        x = changed(hub, rnd.choice([2, 3, 4]))
        docs += [x, changed(x, 1), changed(x, rnd.choice([1, 2])), changed(hub, rnd.choice([2, 5]))]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = components(docs, 85)
    got = near(edge(spark, docs), percent=85, leaf=16)
    lost = [d for d in want if got[d][1] != want[d]]
    print(f"{len(set(want.values()))} components of {len(docs)} documents, {len(lost)} documents in a wrong one")
    assert 50 < len(set(want.values())) < len(docs) and len(lost) <= 1


def test_near_edge(spark):
    got = near(edge(spark), percent=85)
    want = components([(d, t) for d, t in dict(EDGE).items() if d is not None], 85)
    for d, t in dict(EDGE).items():
        if d is not None:
            assert got[d] == (len(shingles(t)), want[d], want[d] == d), d
    rows = near_dedup.near_components(edge(spark), percent=85)
    assert rows.count() == len(EDGE) and rows.where("doc_id is null and component_id is null").count() == 2
    assert near_dedup.near_components(empty(spark)).count() == 0


def test_near_one_id_two_texts(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    got = near_dedup.near_components(edge(spark, [(1, a), (2, a), (2, b), (3, b)])).collect()
    assert {r.component_id for r in got} == {1}


def test_exact_links_blocks():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, 200)).astype(np.uint64) for _ in range(20)]
    got = near_dedup.exact_links(sets, 50)
    for i in range(20):
        for j in range(20):
            n = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (100 * n >= 50 * (len(sets[i]) + len(sets[j]) - n))


def test_loser_tree():
    rnd = random.Random(1)
    for _ in range(300):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(0, 7))]
        coded = []
        for r in runs:
            shared, rest = suffix_dedup._front_code(r)
            coded.append((shared, np.array([len(k) for k in r], np.uint16), rest))
        out = list(suffix_dedup.LoserTree(coded))
        keys = [o[0] for o in out]
        assert keys == sorted(k for r in runs for k in r)
        assert all(b[1] == len(os.path.commonprefix([a, b[0]])) for a, b in zip(keys, out[1:]))
        assert sorted((r, i) for _, _, r, i in out) == sorted((r, i) for r, x in enumerate(runs) for i in range(len(x)))


def run8(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}


def test_repeats_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = repeats(rows)
    assert run8(docs) == want and sum(x[1] for x in want.values()) > 0
    assert run8(docs.repartition(5)) == want


def test_repeats_crafted(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = [noise(n) for n in (99, 100, 101, 150, 400)]
    docs = [(i, noise(rnd.randint(0, 200)) + rnd.choice(shared) + noise(rnd.randint(0, 60)) + rnd.choice(shared)[: rnd.randint(50, 400)] + noise(3)) for i in range(80)]
    docs += [(100, "ab" * 300), (101, "é" * 120), (102, "é" * 120), (103, "z" * 99), (104, "z" * 99), (105, "z" * 100), (106, "q" * 100 + "z" * 100)]
    assert run8(edge(spark, docs)) == repeats(docs)


def test_many_variants_of_one_anchor(spark):
    """More variants of one stretch than the byte-wise path takes."""
    rnd = random.Random(4)
    core = "".join(rnd.choice("abcdefghij") for _ in range(90))
    docs = [(i, "".join(rnd.choice("xy") for _ in range(30)) + core + "".join(rnd.choice("xy") for _ in range(12))) for i in range(300)]
    assert run8(edge(spark, docs)) == repeats(docs)


@pytest.mark.parametrize("hot, strings, bits", [(3, 60_000, 27), (3, 100, 27), (0, 1000, 27), (3, 60_000, 6)])
def test_repeats_of_hot_anchors(spark, monkeypatch, hot, strings, bits):
    """Anchors taken apart into strings give the same spans."""
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = [noise(n) for n in (100, 130, 300)]
    docs = [(i, noise(rnd.randint(0, 150)) + rnd.choice(shared) + noise(rnd.randint(0, 60)) + rnd.choice(shared)) for i in range(60)]
    docs += [(100, "ab" * 300), (101, "é" * 120), (102, "é" * 120)]
    # a filter of 64 bits is at its bound: nearly every anchor passes
    monkeypatch.setattr(suffix_dedup, "HOT_LOG_BITS", bits)
    monkeypatch.setattr(suffix_dedup, "STRINGS", strings)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(edge(spark, docs), hot=hot).collect()}
    assert got == repeats(docs)


def test_repeats_of_one_passage_everywhere(spark):
    """Thousands of surroundings of one passage, far above ``hot``."""
    passage = " ".join(f"shared{i}" for i in range(12))
    docs = [(i, f"{hashlib.sha256(b'%d' % i).hexdigest()} {passage} {hashlib.md5(b'%d' % i).hexdigest()}") for i in range(6000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(edge(spark, docs), hot=200).collect()}
    assert got == repeats(docs)


def test_repeats_in_pieces(spark, monkeypatch):
    """Texts longer than a block are read in pieces."""
    rnd = random.Random(13)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    long = noise(3000)
    docs = [(1, long), (2, long[500:2500] + noise(700)), (3, noise(200) + long[:1999]), (4, ""), (5, "ab" * 900)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    rows = [(d, t.encode()) for d, t in docs]
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    whole = {w: sum(1 for _, t in rows for i in range(len(t) - 99) if t[i : i + 100] == w) for w in {t[i : i + 100] for _, t in rows for i in range(len(t) - 99)}}
    met: dict[bytes, int] = {}
    for _, texts, _ in suffix_dedup._blocks(batch):
        data, _, first, last, *_ = suffix_dedup._stretches(texts)
        for p, q in zip(first.tolist(), last.tolist()):
            for i in range(p, q + 1):
                w = data[i : i + 100].tobytes()
                met[w] = met.get(w, 0) + 1
    assert met == whole
    assert run8(edge(spark, docs)) == repeats(docs)


def test_repeats_one_id_other_texts(spark):
    """Rows with one id and different texts are documents of their own; repeated rows are one."""
    rnd = random.Random(14)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    a, u1, u2 = noise(300), noise(200), noise(300)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(edge(spark, [(1, a), (5, a + u1), (5, u2), (5, u2), (None, u1), (None, u1)])).collect()}
    assert got == {(1, 300): 0, (5, 500): 500, (5, 300): 0, (None, 200): 0}


def test_filter_saturates(spark, monkeypatch):
    """A filter far too small lets every stretch in and changes nothing."""
    monkeypatch.setattr(suffix_dedup, "MAX_LOG_BITS", 6)
    rows = [(d, t) for d, t in dict(EDGE).items() if d is not None]
    assert run8(edge(spark, rows)) == repeats(rows)


def test_repeats_edge(spark):
    rows = [(d, t) for d, t in dict(EDGE).items() if d is not None]
    got = run8(edge(spark, rows))
    assert got == repeats(rows)
    assert suffix_dedup.remove_repeats(edge(spark)).count() == len(EDGE) and suffix_dedup.remove_repeats(empty(spark)).count() == 0
