"""Language identification, language model, quality classifier: brute force and held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np

from helpers import EDGE, SF, edge, empty, words
from sieveline.llm import brown_lm, language_crf, quality, textops


def test_lm_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {d: [*words(t), None] for d, t in docs.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = collections.Counter(w for d, x in tokens.items() if not out[d] for w in x)
    n, v = sum(c.values()), len(c)
    base = ours = 0.0
    got = brown_lm.op6_brown_lm(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r.doc_id]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
        if r.held_out:
            base, ours = base + want, ours + r.score
    assert ours > base  # classes predict held-out text better than words alone


def test_lm_score_is_brute_force(spark):
    """Every text's score, token by token, with classes for members, for further words of the head, and for the rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, counts = brown_lm.fit(docs.where("doc_id % 7 <> 2"), members=40, head=400)
    cls = dict(zip(model.head.tolist(), model.head_class.tolist()))
    c = {r.h % 2**64: r.c for r in counts.collect()}
    assert len(set(model.head_class.tolist())) > 10 and (model.head_class < model.classes).all()
    got = {r.doc_id: r.score for r in brown_lm.score(docs, model, counts).collect()}
    for r in docs.collect():
        w = textops.words_of([(r.text or "").encode()])
        want, last = 0.0, model.classes
        for h, rare in zip([*w.hashes().tolist(), None], [*brown_lm._rare(w).tolist(), None]):
            k = model.classes if h is None else cls.get(h, model.classes + 1 + (rare or 0))
            n = model.ends if h is None else c.get(h, 0)
            want += model.log_next[last, k] + math.log10(n + 1) - model.log_size[k]
            last = k
        assert abs(got[r.doc_id] - want) < 1e-6 * abs(want)
    # sizes: every token and word is in one class
    assert abs((10 ** model.log_size - 1).sum() - (model.tokens + model.distinct)) < 1e-3


def test_every_word_is_exchanged(spark, monkeypatch):
    """A word of any rank has its best class; class bigrams and scores are those of all words' classes, texts cut into many batches."""
    monkeypatch.setattr(brown_lm, "MEMBERS", 20)
    monkeypatch.setattr(brown_lm, "HEAD", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        model, counts = brown_lm.fit(docs.where("doc_id % 7 <> 2"))
        table = {r.h % 2**64: r for r in counts.collect()}
        got = {r.doc_id: r for r in brown_lm.score(docs, model, counts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    texts = {r.doc_id: textops.words_of([(r.text or "").encode()]) for r in docs.collect()}
    tokens = {d: list(zip(w.hashes().tolist(), (model.classes + 1 + brown_lm._rare(w)).tolist())) for d, w in texts.items()}
    train = [x for d, x in tokens.items() if d % 7 != 2]
    c = collections.Counter(h for x in train for h, _ in x)
    head = dict(zip(model.head.tolist(), model.head_class.tolist()))
    assert len(head) == 50 and len(table) > 1000 and {h: r.c for h, r in table.items()} == {h: k for h, k in c.items() if h not in head}

    def bigrams(of):
        n = np.zeros((model.classes + 1 + brown_lm.RARE,) * 2)
        for x in train:
            nodes = [model.classes, *(of(h, rare) for h, rare in x), model.classes]
            np.add.at(n, (nodes[:-1], nodes[1:]), 1)
        return n

    n = bigrams(lambda h, rare: head.get(h, rare))
    before, after = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for x in train:
        nodes = [model.classes, *(head.get(h, rare) for h, rare in x), model.classes]
        for i, (h, _) in enumerate(x):
            before[h][nodes[i]] += 1
            after[h][nodes[i + 2]] += 1
    f = lambda x: x * math.log(x) if x else 0.0
    grown = lambda x, by: f(x + by) - f(x)
    rows, cols = n.sum(1), n.sum(0)
    for h, r in table.items():
        gain = []
        for k in range(model.classes):
            added = collections.Counter()
            for s, x in before[h].items():
                added[s, k] += x
            for s, x in after[h].items():
                added[k, s] += x
            gain.append(sum(grown(n[cell], x) for cell, x in added.items()) - grown(rows[k], c[h]) - grown(cols[k], c[h]))
        assert gain[r.cls] > max(gain) - 1e-6
    own = lambda h, rare: head[h] if h in head else table[h].cls if h in table else rare
    n = bigrams(own)
    assert n[model.classes + 1 :].sum() == n[:, model.classes + 1 :].sum() == 0
    assert np.allclose(model.log_next, np.log10((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * len(n))))
    assert abs((10**model.log_size - 1).sum() - (model.tokens + model.distinct)) < 1e-3
    for d, x in tokens.items():
        want, last = 0.0, model.classes
        for h, k in [*((h, own(h, rare)) for h, rare in x), (None, model.classes)]:
            want += model.log_next[last, k] + math.log10((model.ends if h is None else c[h]) + 1) - model.log_size[k]
            last = k
        assert abs(got[d].score - want) < 1e-6 * abs(want)
        assert (got[d].n_tokens, got[d].n_known) == (len(x) + 1, sum(c[h] > 0 for h, _ in x) + 1)


def test_batch_exchange_predicts_better(spark):
    """Classes by choice for words beyond the members beat fixed ones on held-out text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.where("doc_id % 7 <> 2"), docs.where("doc_id % 7 = 2")
    total = lambda sweeps: sum(r.score for r in brown_lm.score(rest, *brown_lm.fit(train, members=60, sweeps=sweeps)).collect())
    assert total(1) > total(0)


def test_lm_tail_join(spark, monkeypatch):
    """The same scores when nearly all words go through the join."""
    docs = edge(spark, [(i, t) for i, t in EDGE if i is not None and i < 13])
    a = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in brown_lm.score(docs, *brown_lm.fit(docs)).collect()}
    monkeypatch.setattr(brown_lm, "HEAD", 3)
    b = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in brown_lm.score(docs, *brown_lm.fit(docs)).collect()}
    assert a == b


def test_lm_edge(spark):
    model, counts = brown_lm.fit(edge(spark))
    got = brown_lm.score(edge(spark), model, counts).collect()
    assert len(got) == len(EDGE) and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    none = brown_lm.fit(empty(spark))
    assert brown_lm.score(empty(spark), *none).count() == 0
    assert all(r.n_known == 0 for r in brown_lm.score(edge(spark), *none).collect())


def test_exchange_raises_likelihood():
    rnd = np.random.default_rng(0)
    true = rnd.integers(0, 4, 60)
    move = np.array([[0, 9, 1, 0], [1, 0, 9, 0], [0, 1, 0, 9], [9, 0, 1, 0]]) + 0.05
    pairs = rnd.poisson(move[true][:, true] * 3).astype(float)
    pairs = np.pad(pairs, (0, 2))

    def likelihood(of):
        t = of.max() + 1
        n = np.zeros((t, t))
        np.add.at(n, (of[:, None], of[None, :]), pairs)
        return brown_lm._xlogx(n).sum() - brown_lm._xlogx(n.sum(0)).sum() - brown_lm._xlogx(n.sum(1)).sum()

    start = np.concatenate([np.arange(60) % 4, [4, 5]])
    of = brown_lm.exchange(pairs, 60, classes=4)
    assert likelihood(of) > likelihood(start)
    together = np.mean([[of[i] == of[j] for j in range(60) if true[i] == true[j]].count(True) / (true == true[i]).sum() for i in range(60)])
    assert together > 0.9


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(3)
    m = language_crf.Crf(["a", "b"], None, None, rnd.normal(size=(2, 2)), rnd.normal(size=2), None, None)
    e = rnd.normal(size=(9, 2))
    seg = np.full((2, language_crf.SEGMENT), -1)
    seg[0, :5], seg[1, :4] = range(5), range(5, 9)
    post = language_crf._forward_backward(m, e, seg)[0]
    for row, n in ((seg[0], 5), (seg[1], 4)):
        total = np.zeros((n, 2))
        for y in itertools.product(range(2), repeat=n):
            w = math.exp(m.start[y[0]] + sum(e[row[i], y[i]] for i in range(n)) + sum(m.moves[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                total[i, y[i]] += w
        assert np.allclose(post[row[:n]], total / total.sum(1, keepdims=True))


def naive_language(m, text):
    """Word by word and chain by chain: ``(label, score)`` of one text, over windows of 64 words with 8 more on both sides."""
    w, idx, tri = language_crf._features([text])
    table = {int(h): int(k) for h, k in zip(*m.lexicon)}
    n, size = len(w.starts), len(m.labels)
    if not n:
        return "und", 0.0
    h = w.hashes()
    e = [[sum(float(m.words[idx[f][i]][k]) for f in range(len(idx))) + sum(float(m.grams[tri[b]][k]) for b in range(w.starts[i], w.ends[i])) + float(m.places[table.get(int(h[i]), size)][k]) for k in range(size)] for i in range(n)]
    total = [0.0] * size
    for at in range(0, n, 64):
        a, b = max(0, at - 8), min(n, at + 72)
        fwd = [[m.start[k] + e[a][k] for k in range(size)]]
        for i in range(a + 1, b):
            fwd.append([e[i][k] + np.logaddexp.reduce([fwd[-1][j] + m.moves[j][k] for j in range(size)]) for k in range(size)])
        bwd = [[0.0] * size]
        for i in range(b - 1, a, -1):
            bwd.insert(0, [np.logaddexp.reduce([m.moves[k][j] + e[i][j] + bwd[0][j] for j in range(size)]) for k in range(size)])
        z = np.logaddexp.reduce(fwd[-1])
        for i in range(at, min(n, at + 64)):
            for k in range(size):
                total[k] += math.exp(fwd[i - a][k] + bwd[i - a][k] - z)
    best = max(range(size), key=lambda k: total[k])
    return m.labels[best], total[best] / n


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    m = language_crf.fit(language_crf.take_sample(docs, max_docs=60), rounds=4)
    text = {r.doc_id: (r.text or "").encode() for r in docs.limit(40).collect()}
    got = [r for r in language_crf.predict(docs, m).collect() if r.doc_id in text]
    assert len(got) == len(text)
    for r in got:
        lang, score = naive_language(m, text[r.doc_id])
        assert (r.lang_pred, round(r.score, 5)) == (lang, round(score, 5))


def test_switched_words(spark):
    """Words of code-switched texts that no training saw get their span's language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) between 200 and 3000")
    rows = [(r.text, r.lang) for r in docs.orderBy("doc_id").collect()]
    m = language_crf.fit([(t.encode(), lang) for t, lang in rows[:300]])
    assert all(m.moves[i, i] > m.moves[i, j] for i in range(len(m.labels)) for j in range(len(m.labels)) if i != j)
    right = n = 0
    rest = rows[300:600]
    for k in range(0, len(rest) - 1, 2):
        (a, la), (b, lb) = rest[k], rest[k + 1]
        if la == lb:
            continue
        first, second = " ".join(a.split()[:15]), " ".join(b.split()[:15])
        labelled = language_crf.label_words(first + " " + second, m)
        cut = len(language_crf.label_words(first, m))
        right += sum(x == (la if i < cut else lb) for i, (_, x, _) in enumerate(labelled))
        n += len(labelled)
    assert n > 1000 and right >= 0.93 * n, (right, n)


def test_language_held_out(spark):
    got = language_crf.op1_language_crf(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge(spark):
    sample = [(b"the and of to with this that", "en"), ("le la les des et où été".encode(), "fr")] * 20
    m = language_crf.fit(sample)
    got = language_crf.predict(edge(spark), m).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 14)) and by[0].lang_pred == "en"
    assert language_crf.predict(edge(spark, [(1, "😀 😀"), (2, "— …"), (3, "Ω")]), m).select("lang_pred").orderBy("doc_id").collect()[:2] == [("und",), ("und",)]
    none = language_crf.fit([])
    assert {r.lang_pred for r in language_crf.predict(edge(spark), none).collect()} == {"und"}
    assert language_crf.predict(empty(spark), m).count() == 0
    mixed = language_crf.label_words("the and of this les des et le la été", m)
    assert [l for _, l, _ in mixed[:3]] == ["en"] * 3 and [l for _, l, _ in mixed[-3:]] == ["fr"] * 3


def test_language_leaves_labels_alone(spark):
    """Predictions do not read lang, source or id."""
    m = language_crf.fit([(b"the and of", "en"), (b"le la les", "fr")])
    a = [r.lang_pred for r in language_crf.predict(edge(spark, [(1, "the of le"), (2, "la")]), m).orderBy("doc_id").collect()]
    b = [r.lang_pred for r in language_crf.predict(edge(spark, [(8, "the of le"), (9, "la")]), m).orderBy("doc_id").collect()]
    assert a == b


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    junk = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("kept").count()


def test_quality_signals_are_brute_force():
    """Signals of texts in one batch against a plain count in each text by itself."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("a bb ccc dddd eeeee ffffff…  ggg... \n \n- \n• \n* x".split(" ")) for _ in range(rnd.choice([0, 3, 40, 200]))) for _ in range(60)]
    texts += ["", " ", "\n\n\n", "a\na\na\na", "one line ...", "a…\nb…\nc\n\nd..."]
    got = quality._signals([t.encode() for t in texts])[0]
    bare = lambda w: (lambda m: m and m.group(0))(re.search(r"[a-z\x80-\U0010ffff].*[a-z\x80-\U0010ffff]|[a-z\x80-\U0010ffff]", w))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        h = [bare(x) or "" for x in w]
        g = [tuple(h[k : k + 5]) for k in range(len(h) - 4)]
        share = lambda n: n / max(1, len(w)) if len(w) >= 20 else 0.0
        assert abs(got["sequences"][i] - share(len(g) - len(set(g)))) < 1e-9
        assert abs(got["no_short"][i] - (1 - sum(len(x.encode()) <= 3 for x in w) / len(w) if len(w) >= 20 else 0)) < 1e-9
        assert abs(got["lengths"][i] - (abs(sum(len(x.encode()) for x in w) / len(w) - 5.5) if len(w) >= 20 else 0)) < 1e-9
        lines = [x for x in t.split("\n") if x]
        share = lambda n: n / len(lines) if len(lines) >= 4 else 0.0
        assert abs(got["lines"][i] - share(len(lines) - len(set(lines)))) < 1e-9, (t, got["lines"][i])
        assert abs(got["bullets"][i] - share(sum(x[0] in "-*•" for x in lines))) < 1e-9, repr(t)
        assert abs(got["ellipses"][i] - share(sum(x.endswith(("...", "…")) for x in lines))) < 1e-9, repr(t)


def test_quality_scores_alone_and_together(spark):
    """A document's score is that of the logistic model on its own features, whatever else is in the batch."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.score(docs, m).collect():
        signals, doc, h, shape = quality._signals([text[r.doc_id]])
        parts, hits, dense = quality._lexicon_hits(doc, h, 1, m.lexicon)
        _, bucket, value = quality._features(signals, doc, h, shape, parts, hits, dense, 1)
        want = [1 / (1 + math.exp(-max(-30, min(30, sum(v * float(m.weights[k][b]) for b, v in zip(bucket, value)))))) for k in quality.ASPECTS]
        assert abs(r.p_junk - want[0]) < 1e-6 and abs(r.p_toxic - want[1]) < 1e-6 and r.kept == (1 - max(want) >= 0.5)


def test_quality_edge(spark):
    m = quality.fit(edge(spark), spark.createDataFrame([(0, 1, 0), (11, 0, None), (99, None, 1)], "doc_id long, quality int, toxic int"))
    got = quality.score(edge(spark), m).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(empty(spark), None)
    assert quality.score(empty(spark), none).count() == 0


def test_em_estimates_labellers():
    rnd = np.random.default_rng(2)
    y = rnd.random(20000) < 0.2
    acc = [0.95, 0.9, 0.8, 0.5]
    votes = np.stack([np.where(rnd.random(20000) < p, ~y, y).astype(int) for p in acc], 1)
    p, n = np.unique(votes, axis=0, return_counts=True)
    post = quality.em(p, n.astype(float))
    by = {tuple(r): q for r, q in zip(p, post)}
    got = np.array([by[tuple(v)] for v in votes]) > 0.5
    assert (got == y).mean() > 0.96
