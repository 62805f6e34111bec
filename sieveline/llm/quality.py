"""Quality classifier from weak labels.

Heuristic labellers vote on two aspects of a document, *junk* (repetition of words, word sequences
and lines; odd word lengths, too few short words; bullets and ellipses; symbols, shouting and other
marks) and *toxic* (a lexicon learned from labels, by strength, count and density). Votes overlap and
err; expectation-maximisation on the counts of vote patterns (a small table, counted over all
documents) estimates each labeller's vote probabilities in good and bad documents. The
posterior of a document's pattern is its soft label, and a hashed linear scorer per aspect is
trained on a bounded sample of such labels. The scorer, not the vote, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.sampling import bounded_sample
from sieveline.llm.textops import LOWER, Rolling, grams, mix64, sub_batches, words_of

BUCKETS = 1 << 16
ASPECTS = ("junk", "toxic")
TAIL = np.zeros(256, bool)
TAIL[list(b"#$%&*")] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|!<>{}[]\\^~=_@")] = True
BAD, GOOD, ABSTAIN = 0, 1, 2
#: labellers of junk: (signal, bad from, good up to); between the two they abstain
JUNK_RULES = (
    ("caps", 0.30, 0.08), ("tails", 0.20, 0.05), ("pipes", 0.08, 0.01), ("shouts", 0.15, 0.03),
    ("repeats", 0.20, 0.08), ("symbols", 0.025, 0.01), ("sameness", 0.60, 0.45),
    ("sequences", 0.97, 0.90), ("lines", 0.45, 0.15), ("lengths", 4.5, 2.5), ("no_short", 0.97, 0.85), ("bullets", 0.80, 0.40), ("ellipses", 0.30, 0.10),
)
#: fewer words, or lines, than these say nothing about shares of them
FEW_WORDS, FEW_LINES = 20, 4
#: bytes of a usual word with its punctuation; ``lengths`` is the distance of a text's mean from it
USUAL_LENGTH = 5.5
#: the toxic lexicon is dealt by strength into this many parts, each a labeller; others vote on counts and density
PARTS = 4


def _line_signals(data: np.ndarray, offsets: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Shares of each text's lines that repeat an earlier one, begin with a bullet, end in an ellipsis; 0 for texts of few lines."""
    begin = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data)) - 1
    # a text ends in the space that joins it to the next
    end = np.maximum(np.minimum(end, offsets[np.searchsorted(offsets, begin, side="right")] - 1), begin)
    full = end > begin
    begin, end = begin[full], end[full]
    text = np.searchsorted(offsets, begin, side="right") - 1
    key = mix64(Rolling(data).ranges(begin, end) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    count = np.bincount(text, minlength=n)
    share = lambda on: np.where(count >= FEW_LINES, np.bincount(text[on], minlength=n) / np.maximum(count, 1), 0.0)
    back = lambda k: data[np.maximum(end - k, begin)]
    first, last = data[begin], data[end - 1]
    bullet = (first == 45) | (first == 42) | ((first == 0xE2) & (data[np.minimum(begin + 1, end - 1)] == 0x80) & (data[np.minimum(begin + 2, end - 1)] == 0xA2))
    dots = ((last == 46) & (back(2) == 46) & (back(3) == 46)) | ((back(3) == 0xE2) & (back(2) == 0x80) & (last == 0xA6))
    return {"lines": share(again), "bullets": share(bullet), "ellipses": share(dots)}


def _signals(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Signals per text, and for every word its text, the hash of its trimmed lower-case form and its shape."""
    w = words_of(texts, lower=False)
    n = np.diff(w.first)
    doc = w.doc
    size = np.maximum(n, 1)
    count = lambda flags: np.bincount(doc[flags], minlength=len(n)) / size
    up = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    low = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
    ups, lows = up[w.ends] - up[w.starts], low[w.ends] - low[w.starts]
    caps = (ups >= 2) & (lows == 0)
    last = w.data[w.ends - 1] if len(doc) else np.zeros(0, np.uint8)
    before = w.data[np.maximum(w.ends - 2, 0)]
    shout = (last == 33) & (before == 33) & (w.ends - w.starts > 2)
    tail = TAIL[last]
    pipe = (last == 124) & (w.ends - w.starts == 1)
    lower = LOWER[w.data]
    # words without punctuation at either end, up to three bytes of it
    a, b = w.starts.copy(), w.ends.copy()
    letter = np.zeros(256, bool)
    letter[97:123] = letter[48:58] = letter[128:] = True
    for _ in range(3):
        a = np.where((a < b) & ~letter[lower[a]], a + 1, a)
        b = np.where((a < b) & ~letter[lower[b - 1]], b - 1, b)
    h = Rolling(lower).ranges(a, b)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    symbols = np.add.reduceat(np.concatenate([SYMBOL[w.data], [False]]).astype(np.int64), w.offsets[:-1]) if len(n) else np.zeros(0)
    key = mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(key, return_index=True)
    distinct = np.bincount(doc[once], minlength=len(n))
    # five words in a row that stood in this order before
    g = grams(h, 5)
    w_doc = doc[: len(g)]
    inside = w_doc == doc[4:] if len(g) else np.zeros(0, bool)
    g, w_doc = mix64(g[inside] + w_doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), w_doc[inside]
    again = np.ones(len(g), bool)
    again[np.unique(g, return_index=True)[1]] = False
    shape = caps * 1 + shout * 2 + tail * 4 + pipe * 8 + same * 16
    sentence = (last == 46) | (last == 44)
    shape = shape + sentence * 32
    signals = {
        "caps": count(caps), "tails": count(tail), "pipes": count(pipe), "shouts": count(shout), "repeats": count(same),
        "symbols": symbols / np.maximum(np.diff(w.offsets), 1),
        # long texts repeat common words anyway; judged against the growth of a natural vocabulary
        "sameness": np.where(n >= FEW_WORDS, 1 - distinct / np.maximum(np.minimum(size, 12 * np.sqrt(size)), 1), 0.0),
        "sequences": np.where(n >= FEW_WORDS, np.bincount(w_doc[again], minlength=len(n)) / size, 0.0),
        "lengths": np.where(n >= FEW_WORDS, np.abs(np.bincount(doc, w.ends - w.starts, len(n)) / size - USUAL_LENGTH), 0.0),
        "no_short": np.where(n >= FEW_WORDS, 1 - count(w.ends - w.starts <= 3), 0.0),
        **_line_signals(w.data, w.offsets, len(n)),
    }
    return signals, doc, h, shape


def _lexicon_hits(doc, h, n_docs: int, lexicon: tuple[np.ndarray, np.ndarray]):
    """Per text: which parts of the lexicon (word hashes, their parts) occur, how many distinct words, and per word of text."""
    lexicon, part = lexicon
    parts = np.zeros((n_docs, PARTS), bool)
    hits = np.zeros(n_docs, np.int64)
    if len(lexicon) and len(h):
        at = np.searchsorted(lexicon, h)
        found = lexicon[np.minimum(at, len(lexicon) - 1)] == h
        parts[doc[found], part[at[found]]] = True
        pair = np.unique(doc[found] * len(lexicon) + at[found])
        hits = np.bincount(pair // len(lexicon), minlength=n_docs)
    return parts, hits, hits / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def _votes(signals, parts, hits, dense) -> dict[str, np.ndarray]:
    """A column per labeller: BAD, GOOD or ABSTAIN."""
    junk = [np.where(signals[k] >= bad, BAD, np.where(signals[k] <= good, GOOD, ABSTAIN)) for k, bad, good in JUNK_RULES]
    # a word missing says nothing; how many there are, and how dense, speaks both ways
    toxic = [np.where(parts[:, i], BAD, ABSTAIN) for i in range(PARTS)]
    toxic += [np.where(hits >= k, BAD, GOOD) for k in (2, 4)]
    toxic.append(np.where(dense >= 0.006, BAD, np.where(dense < 0.002, GOOD, ABSTAIN)))
    return {"junk": np.stack(junk, 1), "toxic": np.stack(toxic, 1)}


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(bad) of each vote pattern: EM over labellers that vote independently given the class.

    ``patterns`` (P, K) holds votes 0, 1, 2 and ``counts`` how many documents show each. Starts
    from two bad votes, and keeps a labeller's bad votes at least as likely in bad documents
    as in good ones, so the classes cannot swap.
    """
    bad = np.array([0.02, 0.3, 0.95])[np.minimum((patterns == BAD).sum(1), 2)]
    for _ in range(rounds):
        prior = np.clip((counts * bad).sum() / counts.sum(), 1e-4, 0.5)
        logs = np.stack([np.full(len(patterns), np.log(1 - prior)), np.full(len(patterns), np.log(prior))])
        for k in range(patterns.shape[1]):
            table = np.stack([[(counts * q * (patterns[:, k] == v)).sum() + 0.5 for v in (BAD, GOOD, ABSTAIN)] for q in (1 - bad, bad)])
            table /= table.sum(1, keepdims=True)
            if table[1, BAD] < table[0, BAD]:
                table[:] = table.mean(0)
            logs += np.log(table[:, patterns[:, k]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - bad).max() < 1e-6:
            break
        bad = new
    return bad


def _features(signals, doc, h, shape, parts, hits, dense, n_docs: int):
    """Hashed features: ``(text, bucket, value)``. Words and shape pairs by share, lexicon hits and strong signals by presence."""
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    word = (mix64(h ^ np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    form = (mix64(shape.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(BUCKETS)).astype(np.int64)
    bits = [mix64(np.full(len(doc), (1 << 41) + i, np.uint64)) % np.uint64(BUCKETS) for i in range(6)]
    text, bucket, value = [doc, doc], [word, form], [2.0 / n[doc], 4.0 / n[doc]]
    for i, b in enumerate(bits):
        on = (shape >> i) & 1 == 1
        text.append(doc[on]), bucket.append(b[on].astype(np.int64)), value.append(8.0 / n[doc[on]])
    for k in range(1, 6):
        d = np.flatnonzero(hits >= k)
        text.append(d), bucket.append(np.full(len(d), k, np.int64)), value.append(np.full(len(d), 2.0))
    for k in range(PARTS):
        d = np.flatnonzero(parts[:, k])
        text.append(d), bucket.append(np.full(len(d), 8 + k, np.int64)), value.append(np.full(len(d), 1.0))
    for k, least in enumerate((0.001, 0.002, 0.004, 0.006, 0.01, 0.02)):
        d = np.flatnonzero(dense >= least)
        text.append(d), bucket.append(np.full(len(d), 16 + k, np.int64)), value.append(np.ones(len(d)))
    for k, (name, bad, _) in enumerate(JUNK_RULES):
        d = np.flatnonzero(signals[name] >= bad)
        text.append(d), bucket.append(np.full(len(d), 32 + k, np.int64)), value.append(np.full(len(d), 2.0))
    d = np.arange(n_docs)
    text.append(d), bucket.append(np.zeros(n_docs, np.int64)), value.append(np.ones(n_docs))
    return np.concatenate(text), np.concatenate(bucket), np.concatenate(value)


def _fit(text, bucket, value, target: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets, full-batch AdaGrad."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, value * w[bucket], len(target)), -30, 30)))
        g = np.bincount(bucket, value * (p - target)[text], BUCKETS) / len(target) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w.astype(np.float32)


@dataclass
class Scorer:
    """A fitted model: small and picklable."""

    lexicon: tuple[np.ndarray, np.ndarray]
    weights: dict[str, np.ndarray]

    def bad(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        signals, doc, h, shape = _signals(texts)
        parts, hits, dense = _lexicon_hits(doc, h, len(texts), self.lexicon)
        text, bucket, value = _features(signals, doc, h, shape, parts, hits, dense, len(texts))
        return {k: 1 / (1 + np.exp(-np.clip(np.bincount(text, value * w[bucket], len(texts)), -30, 30))) for k, w in self.weights.items()}


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 10000, size: int = 512, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that mark toxic documents, from at most ``sample`` labelled rows, at most ``size`` words.

    A word's occurrences after the same word count for the smallest document that has them, so
    neither copies of a toxic document nor a long one make its plain words look toxic. A word
    qualifies in 5 such toxic documents at 15 times the others' rate. Returns sorted hashes and
    their parts: the words in four shares from the strongest ratio down.
    """
    marks = bounded_sample(labels.where("toxic is not null").select(F.col("doc_id").alias("_doc"), "toxic"), F.col("_doc"), sample)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(marks, "_doc")

    def words(batches):
        for batch in batches:
            for at, texts in sub_batches(batch, "text"):
                _, doc, h, _ = _signals(texts)
                before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
                if len(h):
                    before[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
                u = np.unique(np.stack([doc, h.view(np.int64), before.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u[1]), pa.array(u[2]), batch.column("_doc")[at].take(pa.array(u[0])), batch.column("toxic")[at].take(pa.array(u[0])).cast(pa.int32())], ["h", "before", "doc", "toxic"])

    n = rows.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    bad, good = n[0] or 0, (n[1] or 0) - (n[0] or 0)
    is_bad = F.col("toxic") == 1
    pairs = rows.mapInArrow(words, "h long, before long, doc long, toxic int").groupBy("h", "before").agg(F.min(F.when(is_bad, F.col("doc"))).alias("b"), F.min(F.when(~is_bad, F.col("doc"))).alias("g"))
    counts = pairs.groupBy("h").agg(F.countDistinct("b").alias("b"), F.countDistinct("g").alias("g"))
    ratio = (F.col("b") / F.lit(max(bad, 1))) / ((F.col("g") + 0.5) / F.lit(max(good, 1)))
    top = counts.where((F.col("b") >= 5) & (ratio >= 15)).orderBy(ratio.desc(), "h").limit(size).select("h").collect()
    h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (np.arange(len(h)) * PARTS // max(len(h), 1))[order]


def fit(docs: DataFrame, labels: DataFrame | None, fit_rows: int = 6000, fit_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Votes over all documents, EM, then a scorer trained on at most ``fit_rows`` documents' posteriors.

    Of those, as many are used as their features (8 bytes for each distinct one) fit into ``fit_bytes``.
    """
    lexicon = learn_lexicon(docs, labels, id_col=id_col, text_col=text_col) if labels is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))

    def vote(batches):
        for batch in batches:
            for _, texts in sub_batches(batch, "text"):
                signals, doc, h, _ = _signals(texts)
                v = _votes(signals, *_lexicon_hits(doc, h, len(texts), lexicon))
                for aspect, votes in v.items():
                    u, c = np.unique(votes, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([aspect] * len(u)), pa.array(["".join(map(str, x)) for x in u]), pa.array(c)], ["aspect", "votes", "n"])

    # a labeller has 3 votes: at most 3^13 + 3^7 patterns, in practice some hundreds, whatever the corpus
    seen = rows.mapInArrow(vote, "aspect string, votes string, n long").groupBy("aspect", "votes").agg(F.sum("n").alias("n")).collect()
    posterior = {}
    for aspect in ASPECTS:
        own = sorted((r["votes"], r["n"]) for r in seen if r["aspect"] == aspect)
        if own:
            posterior[aspect] = dict(zip([v for v, _ in own], em(np.array([[int(c) for c in v] for v, _ in own]), np.array([n for _, n in own], float))))
    sample = bounded_sample(rows, F.col("_doc"), fit_rows)

    def gather(batches):
        for batch in batches:
            for _, texts in sub_batches(batch, "text"):
                signals, doc, h, shape = _signals(texts)
                parts, hits, dense = _lexicon_hits(doc, h, len(texts), lexicon)
                v = _votes(signals, parts, hits, dense)
                text, bucket, value = _features(signals, doc, h, shape, parts, hits, dense, len(texts))
                both = text * BUCKETS + bucket
                u, at = np.unique(both, return_inverse=True)
                value = np.bincount(at, value)
                cuts = np.searchsorted(u // BUCKETS, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(u[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     *[pa.array([posterior[k]["".join(map(str, x))] for x in v[k]], pa.float64()) for k in ASPECTS]],
                    ["bucket", "value", *ASPECTS],
                )

    got, held = [], 0
    for r in sample.mapInArrow(gather, "bucket binary, value binary, junk double, toxic double").toLocalIterator():
        held += 2 * len(r["bucket"])
        if held > fit_bytes:
            break
        got.append(r)
    if not got:
        return Scorer(lexicon, {k: np.zeros(BUCKETS, np.float32) for k in ASPECTS})
    bucket = [np.frombuffer(r["bucket"], np.int32) for r in got]
    text = np.repeat(np.arange(len(got)), [len(b) for b in bucket])
    bucket, value = np.concatenate(bucket), np.concatenate([np.frombuffer(r["value"], np.float32) for r in got])
    return Scorer(lexicon, {k: _fit(text, bucket, value, np.array([r[k] for r in got])) for k in ASPECTS})


def score(docs: DataFrame, model: Scorer, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, p_junk, p_toxic, score, kept`` of each row; score is 1 minus the larger of the two.

    Null and empty texts have no words: their score is that of an empty document, decided like
    any other. Ties, repeated rows and null ids need no care, each row is scored by itself and in
    whole, however long. Empty input gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, texts in sub_batches(batch, "text"):
                p = shared.value.bad(texts)
                s = 1 - np.maximum(p["junk"], p["toxic"])
                yield pa.RecordBatch.from_arrays([batch.column("doc")[rows], pa.array(p["junk"]), pa.array(p["toxic"]), pa.array(s), pa.array(s >= threshold)], ["doc", "p_junk", "p_toxic", "score", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, p_junk double, p_toxic double, score double, kept boolean").withColumnRenamed("doc", id_col)


def keep_good(docs: DataFrame, model: Scorer, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns as they were; one pass, no join back.

    Decides as ``score``; columns may have any names, and repeated rows are kept or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, texts in sub_batches(batch, text_col):
                p = shared.value.bad(texts)
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(1 - np.maximum(p["junk"], p["toxic"]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir):
    """``score`` of all ``documents`` by a model fitted on them and ``labels``; its handling of nulls, ties and repeats holds."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
