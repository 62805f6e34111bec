"""Language identification with a linear-chain conditional random field.

Words of a text are labelled in sequence. A word's score for a language sums learned weights of
its affixes, its letter trigrams (with word borders), the word itself (all hashed) and its place in
the lexicon: which language's training texts it is told by, if any. Learned transitions tie
neighbouring words, so short or ambiguous words follow their surroundings and code-switched text
is split where the evidence turns. Forward-backward gives each word's posterior; a text's language
is the one with the largest sum of posteriors.

Training texts have one label each, so they show no switch. A share of the training sequences is
therefore spliced from spans of texts in different languages, drawn from the same sample: there the
label of each word is that of its span, and transitions learn what a switch costs.

Chains run over segments of at most 64 words, so a batch is computed as one array program
whatever its texts' lengths. In prediction a segment reads ``PAD`` further words on both sides, whose
own posteriors come from their own segments: a cut costs no context. Training uses a bounded sample of
labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.brown_lm import held_out
from sieveline.llm.sampling import bounded_sample
from sieveline.llm.textops import Rolling, mix64, sub_batches, words_of

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
SEGMENT = 64
PAD = 8
#: spliced training sequences for each whole text, spans in each, and words in a span
SPLICED, SPANS, SPAN_WORDS = 0.5, 6, 12
BUCKETS = 1 << 18
TRIGRAMS = 1 << 16
UNKNOWN = "und"


@dataclass
class Crf:
    labels: list[str]
    words: np.ndarray
    grams: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]
    places: np.ndarray


def _features(texts: list[bytes]):
    """Words, six hashed features of each (affixes and the word), and the trigram bucket at each byte of each word."""
    w = words_of(texts, LETTER)
    s, e = w.starts, w.ends
    roll = Rolling(w.data)
    spans = [(s, e), (s, np.minimum(s + 2, e)), (s, np.minimum(s + 4, e)), (np.maximum(e - 2, s), e), (np.maximum(e - 3, s), e), (np.maximum(e - 4, s), e)]
    idx = np.stack([(mix64(roll.ranges(a, b) + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.int32) for i, (a, b) in enumerate(spans)])
    # the byte before and after a word counts as a border
    d = np.where(LETTER[w.data], w.data, 0).astype(np.uint64)
    pad = np.concatenate([[np.uint64(0)], d, [np.uint64(0)]])
    code = pad[:-2] * np.uint64(65536) + pad[1:-1] * np.uint64(256) + pad[2:]
    tri = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
    return w, idx, tri


def lexicon_of(sample: list[tuple[bytes, str]], labels: list[str], least: int = 3, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words that stand in ``least`` texts or more of one language, and in ``share`` or more of all their texts in it; and its number."""
    of = {x: i for i, x in enumerate(labels)}
    seen: list[np.ndarray] = []
    for i in range(0, len(sample), 64):
        w = words_of([t for t, _ in sample[i : i + 64]], LETTER)
        y = np.array([of[x] for _, x in sample[i : i + 64]])
        u = np.unique(np.stack([w.doc, w.hashes().view(np.int64)]), axis=1)
        seen.append(np.stack([u[1], y[u[0]]]))
    if not seen:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
    n = np.zeros((len(h), len(labels)), np.int64)
    np.add.at(n, (at, np.concatenate([x[1] for x in seen])), 1)
    best = n.argmax(1)
    top = n[np.arange(len(h)), best]
    keep = (top >= least) & (top >= share * n.sum(1))
    h, best = h[keep].view(np.uint64), best[keep]
    order = np.argsort(h)
    return h[order], best[order]


def _places(m: Crf, w) -> np.ndarray:
    """The lexicon each word is in: a language's number, or their count where it is in none."""
    table, of = m.lexicon
    h = w.hashes()
    if not len(table):
        return np.full(len(h), len(m.labels))
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, of[at], len(m.labels))


def _emissions(m: Crf, w, idx, tri) -> np.ndarray:
    out = m.words[idx[0]] + m.places[_places(m, w)]
    for i in range(1, len(idx)):
        out = out + m.words[idx[i]]
    if len(w.starts):
        # trigrams centred on the bytes of a word
        sums = np.zeros((len(tri) + 1, len(m.labels)))
        np.cumsum(m.grams[tri], axis=0, out=sums[1:])
        out = out + (sums[w.ends] - sums[w.starts])
    return out


def _segments(first: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word positions as rows of at most 64 consecutive words of one text and ``pad`` more on both sides, -1 beyond; and which are of the row's own 64."""
    n = np.diff(first)
    rows = -(-n // SEGMENT)
    text = np.repeat(np.arange(len(n)), rows)
    k = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = first[:-1][text] + k * SEGMENT
    far = np.minimum(begin + SEGMENT + pad, first[1:][text])
    at = np.maximum(begin - pad, first[:-1][text])[:, None] + np.arange(SEGMENT + 2 * pad)
    own = (at >= begin[:, None]) & (at < begin[:, None] + SEGMENT)
    return np.where(at < far[:, None], at, -1), own


def _forward_backward(m: Crf, emissions: np.ndarray, seg: np.ndarray, own: np.ndarray | None = None, expect: bool = False):
    """Posterior of each word (only those a row owns, if said), and if wanted the expected transitions and starts."""
    size = len(m.labels)
    post = np.zeros_like(emissions)
    moves, starts = np.zeros((size, size)), np.zeros(size)
    if not len(seg):
        return post, moves, starts
    length = (seg >= 0).sum(1)
    order = np.argsort(-length, kind="stable")
    seg, length = seg[order], length[order]
    own = np.ones(seg.shape, bool) if own is None else own[order]
    psi = np.exp(emissions - emissions.max(1, keepdims=True))
    t, s0 = np.exp(m.moves), np.exp(m.start)
    steps = int(length[0])
    live = [int((length > i).sum()) for i in range(steps)]
    alpha = []
    a = psi[seg[:, 0]] * s0
    a /= a.sum(1, keepdims=True)
    alpha.append(a)
    for i in range(1, steps):
        a = (alpha[-1][: live[i]] @ t) * psi[seg[: live[i], i]]
        a /= a.sum(1, keepdims=True)
        alpha.append(a)
    beta = np.ones((live[-1], size))
    for i in range(steps - 1, -1, -1):
        if len(beta) < live[i]:
            beta = np.concatenate([beta, np.ones((live[i] - len(beta), size))])
        p = alpha[i] * beta
        p /= p.sum(1, keepdims=True)
        mine = own[: live[i], i]
        post[seg[: live[i], i][mine]] = p[mine]
        if i:
            nxt = psi[seg[: live[i], i]] * beta
            if expect:
                q = alpha[i - 1][: live[i], :, None] * t * nxt[:, None, :]
                moves += (q / q.sum((1, 2), keepdims=True)).sum(0)
            beta = nxt @ t.T
            beta /= beta.sum(1, keepdims=True)
        elif expect:
            starts += p.sum(0)
    return post, moves, starts


def splice(sample: list[tuple[bytes, str]], share: float = SPLICED, seed: int = 11) -> list[tuple[bytes, list[tuple[int, str]]]]:
    """Every text of the sample, and ``share`` as many sequences of spans of texts in different languages.

    A sequence is its text and, span by span, where it ends and its label.
    """
    out = [(t, [(len(t), lang)]) for t, lang in sample]
    rnd = np.random.Generator(np.random.PCG64(seed))
    words = [t.split() for t, _ in sample]
    some = [i for i, w in enumerate(words) if w]
    if len({sample[i][1] for i in some}) < 2:
        return out
    for _ in range(int(share * len(sample))):
        parts, ends, size, last = [], [], 0, None
        for i in rnd.choice(some, SPANS).tolist():
            if sample[i][1] == last:
                continue
            last = sample[i][1]
            n = int(rnd.integers(1, SPAN_WORDS + 1))
            at = int(rnd.integers(0, max(1, len(words[i]) - n + 1)))
            span = b" ".join(words[i][at : at + n]) + b" "
            size += len(span)
            parts.append(span), ends.append((size, last))
        out.append((b"".join(parts), ends))
    return out


def fit(sample: list[tuple[bytes, str]], rounds: int = 12, rate: float = 0.3, l2: float = 1e-6) -> Crf:
    """Train by AdaGrad on the CRF's likelihood, on texts with one label each and on sequences spliced from them."""
    labels = sorted({lang for _, lang in sample})
    of = {x: i for i, x in enumerate(labels)}
    size = len(labels)
    m = Crf(labels, np.zeros((BUCKETS, size)), np.zeros((TRIGRAMS, size)), np.zeros((size, size)), np.zeros(size), lexicon_of(sample, labels), np.zeros((size + 1, size)))
    blocks, held, n = [], [], 0
    for x in splice(sample):
        held.append(x)
        n += len(x[0])
        if n > 1 << 19:
            blocks.append(held)
            held, n = [], 0
    if held:
        blocks.append(held)
    g2 = [np.full_like(x, 1e-4) for x in (m.words, m.grams, m.moves, m.start, m.places)]

    def step(i, x, g):
        g2[i] += g * g
        x += rate * (g - l2 * x) / np.sqrt(g2[i])

    for _ in range(rounds if size > 1 else 0):
        for block in blocks:
            w, idx, tri = _features([t for t, _ in block])
            if not len(w.starts):
                continue
            ends = np.array([at + e for at, (_, spans) in zip(w.offsets, block) for e, _ in spans])
            y = np.array([of[x] for _, spans in block for _, x in spans])[np.searchsorted(ends, w.starts, side="right")]
            seg, _ = _segments(w.first)
            post, moves, starts = _forward_backward(m, _emissions(m, w, idx, tri), seg, expect=True)
            delta = -post
            delta[np.arange(len(y)), y] += 1
            delta /= len(y) / 1000
            inside = np.repeat(np.arange(len(y)), w.ends - w.starts)
            byte = np.arange(len(inside)) + np.repeat(w.starts - (np.cumsum(w.ends - w.starts) - (w.ends - w.starts)), w.ends - w.starts)
            place = _places(m, w)
            step(0, m.words, np.stack([np.bincount(idx.ravel(), np.tile(delta[:, k], len(idx)), BUCKETS) for k in range(size)], 1))
            step(1, m.grams, np.stack([np.bincount(tri[byte], delta[inside, k], TRIGRAMS) for k in range(size)], 1))
            a, b = seg[:, :-1], seg[:, 1:]
            both = b >= 0
            seen = np.bincount(y[a[both]] * size + y[b[both]], minlength=size * size).reshape(size, size)
            step(2, m.moves, (seen - moves) / len(y) * 1000)
            step(3, m.start, (np.bincount(y[seg[:, 0]], minlength=size) - starts) / len(y) * 1000)
            step(4, m.places, np.stack([np.bincount(place, delta[:, k], size + 1) for k in range(size)], 1))
    return Crf(labels, m.words.astype(np.float32), m.grams.astype(np.float32), m.moves, m.start, m.lexicon, m.places)


def take_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2000, max_bytes: int = 6 << 20, max_text: int = 128 << 10) -> list[tuple[bytes, str]]:
    """Labelled texts for ``fit``: of the first ``max_docs`` by md5 of the id, those that fit into ``max_bytes`` in all, in that order.

    Rows without a label or text are not drawn, nor are texts above ``max_text`` bytes, so that no
    single text takes a large part of the sample. All three are bounds of the training sample alone.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.octet_length(text_col).alias("n"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    out, held = [], 0
    for r in bounded_sample(rows.where(F.col("n") <= max_text), F.col("k"), max_docs).toLocalIterator():
        if held + r["n"] <= max_bytes:
            held += r["n"]
            out.append((r["t"].encode(), r["l"]))
    return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, n_words, n_switches`` of each row.

    ``score`` is the mean posterior of the predicted language over the words, ``n_switches`` the
    number of neighbouring words whose best labels differ. Null text, text without a letter, and
    any text when nothing was learned, give ``und`` with score 0. Ties go to the first language.
    Each row is labelled by its own whole text: repeated rows, repeated ids and rows without an id
    need no care. Empty input gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for rows, texts in sub_batches(batch, "text"):
                w, idx, tri = _features(texts)
                n = np.diff(w.first)
                total = np.zeros((len(texts), max(len(m.labels), 1)))
                switches = np.zeros(len(texts), np.int64)
                if m.labels and len(w.starts):
                    post = _forward_backward(m, _emissions(m, w, idx, tri), *_segments(w.first, PAD))[0]
                    for k in range(len(m.labels)):
                        total[:, k] = np.bincount(w.doc, post[:, k], len(texts))
                    best = post.argmax(1)
                    turn = np.flatnonzero((best[1:] != best[:-1]) & (w.doc[1:] == w.doc[:-1]))
                    switches = np.bincount(w.doc[turn], minlength=len(texts))
                top = total.argmax(1)
                ok = (n > 0) & bool(m.labels)
                ascii_letter = np.array([any(65 <= c <= 90 or 97 <= c <= 122 for c in t[:64]) or t.isascii() and k > 0 for t, k in zip(texts, n)], bool)
                for i in np.flatnonzero(ok & ~ascii_letter):
                    ok[i] = _has_letter(texts[i])
                lang = [m.labels[k] if o else UNKNOWN for k, o in zip(top, ok)]
                share = np.where(ok, total[np.arange(len(texts)), top] / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc")[rows], pa.array(lang, pa.string()), pa.array(np.clip(share, 0, 1)), pa.array(n), pa.array(np.where(ok, switches, 0))], ["doc", "lang_pred", "score", "n_words", "n_switches"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, lang_pred string, score double, n_words long, n_switches long").withColumnRenamed("doc", id_col)


def label_words(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """The words of one text with their best label and its posterior, for inspecting code-switched text."""
    w, idx, tri = _features([text.encode()])
    post = _forward_backward(model, _emissions(model, w, idx, tri), *_segments(w.first, PAD))[0]
    return [(w.data[a:b].tobytes().decode(errors="replace"), model.labels[p.argmax()], float(p.max())) for a, b, p in zip(w.starts, w.ends, post)]


def op1_language_crf(spark, sf_dir):
    """Language of every whole text of ``documents``; fitted on a bounded sample of those not held out. Handling as in ``predict``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(take_sample(docs.where(~held_out("doc_id", 4, 2))))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
