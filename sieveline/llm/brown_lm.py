"""Language-model scoring with Brown classes.

Words are counted over all training documents. The most frequent ones (``members``) are assigned to
classes by the exchange algorithm on their bigram counts (a bounded matrix, counted over the whole
corpus). All further words are then exchanged in batches: Spark adds up the classes that stand before
and after each of them, and each goes to the class that raises the likelihood of the class bigrams
most, all words of a batch against the same classes. First go the other words of the ``head``, whose
classes are broadcast, then every other training word, whose class is kept in a table with its count.
Only words never seen in training belong to a fixed class, by their last two bytes. Class bigrams
are those of the whole corpus under the final classes. A token scores P(class | class before) *
P(word | class), both smoothed.

Counting and scoring read each text once. Words of the table, the rest, leave their text as rows of
their hash and what stands beside them, and meet their class in a shuffle, in which no key is hot,
because the hot words are the head. Where two of the rest stand side by side, both classes are needed:
in counting by a join of such pairs alone, in scoring by place, once a text's rows are together again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textops import mix64, signed, sub_batches, words_of
from sieveline.session import written

#: classes of the exchange, and fixed ones of words without a class of their own
CLASSES = 40
RARE = 24
#: words exchanged one by one, and words whose classes are broadcast, at most (2 MB)
MEMBERS = 1000
HEAD = 1 << 16


def _rare(w) -> np.ndarray:
    """Class of a word outside the class vocabulary: by its last two bytes."""
    last = w.data[w.ends - 1].astype(np.uint64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64)
    return (mix64(last * np.uint64(256) + before) % np.uint64(RARE)).astype(np.int64)


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _count(batches):
    held, kinds, n = [], [], 0

    def flush():
        h, at, c = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.concatenate(kinds)[at].astype(np.int32)), pa.array(c)], ["h", "rare", "c"])

    for batch in batches:
        for _, texts in sub_batches(batch, "text"):
            w = words_of(texts)
            held.append(w.hashes()), kinds.append(_rare(w))
            n += len(held[-1])
            if n > 3_000_000:
                yield flush()
                held, kinds, n = [], [], 0
    if n:
        yield flush()


def _classes(texts, known: tuple[np.ndarray, np.ndarray], base: int):
    """Words, their hashes, their place in ``known`` (sorted hashes and their nodes), and the node of every token, ends included.

    Nodes are the ``base`` nodes of known words, then the boundary, then the rare classes.
    """
    w = words_of(texts)
    h = w.hashes()
    at = _find(known[0], h)
    node = np.where(at >= 0, known[1][at] if len(known[1]) else 0, base + 1 + _rare(w))
    return w, h, at, np.insert(node, w.first[1:], base)


def _bigrams(shared, base: int):
    def run(batches):
        size = base + 1 + RARE
        for batch in batches:
            total = np.zeros(0, np.int64)
            for _, texts in sub_batches(batch, "text"):
                node = _classes(texts, shared.value, base)[3]
                total = np.concatenate([total, np.concatenate([[base], node[:-1]]) * size + node])
                if len(total) > 3_000_000:
                    k, c = np.unique(total, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["k", "c"])
                    total = np.zeros(0, np.int64)
            k, c = np.unique(total, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["k", "c"])

    return run


def _matrix(rows: DataFrame, known: tuple[np.ndarray, np.ndarray], base: int) -> np.ndarray:
    """How often each node follows each, over all of ``rows``: (base + 1 + RARE)^2 sums at most reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    pairs = rows.mapInArrow(_bigrams(shared, base), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    size = base + 1 + RARE
    out = np.zeros(size * size)
    out[pairs.column("k").to_numpy()] = pairs.column("c").to_numpy()
    return out.reshape(size, size)


def _neighbours(shared, base: int):
    """Per word of the head that is no member: which classes stand before it (slots 0 to T - 1) and after it (T to 2 T - 1), and how often."""

    def run(batches):
        known, wanted = shared.value
        size = base + 1 + RARE
        held, n = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            word, first = np.unique(k // (2 * size), return_index=True)
            ends = pa.array(np.append(first, len(k)).astype(np.int32))
            slots, counts = pa.array((k % (2 * size)).astype(np.int16)), pa.array(c.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(word), pa.ListArray.from_arrays(ends, slots), pa.ListArray.from_arrays(ends, counts)], ["word", "slots", "counts"])

        for batch in batches:
            for _, texts in sub_batches(batch, "text"):
                w, h, _, node = _classes(texts, known, base)
                word = _find(wanted, h)
                # place of each word among the tokens, ends included
                at = np.arange(len(h)) + w.doc
                on = np.flatnonzero(word >= 0)
                before = np.concatenate([[base], node])[at[on]]
                held.append(word[on] * 2 * size + before), held.append(word[on] * 2 * size + size + node[at[on] + 1])
                n += 2 * len(on)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _whole(batches, rows: int):
    """Tables of some ``rows`` rows in which no run of the first column's values, ascending, is cut."""
    held, n, most = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n, most = table.slice(cut).to_batches(), n - cut, rows if cut else 2 * n
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(n: np.ndarray, classes: int, word: np.ndarray, slot: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per word (0, 1, ... in ``word``, ascending) the class that raises the likelihood of the class bigrams ``n`` most.

    ``slot`` (ascending in each word) is a class before the word, or ``len(n)`` and a class after it, that
    stands there ``c`` times. What stands beside the word stays in its class, and so do the word's own places there.
    """
    size, rows, cols = len(n), n.sum(1)[:classes], n.sum(0)[:classes]
    beside = np.concatenate([n[:, :classes], n[:classes].T])
    kind, of = np.unique(slot + 2 * size * c, return_inverse=True)
    now = beside[kind % (2 * size)]
    gains = _xlogx(now + (kind // (2 * size))[:, None]) - _xlogx(now)
    times, of_times = np.unique(np.bincount(word, np.where(slot >= size, c, 0)).astype(np.int64), return_inverse=True)
    times = times[:, None]
    losses = _xlogx(rows + times) - _xlogx(rows) + _xlogx(cols + times) - _xlogx(cols)
    # a class on both sides of the word: both raise the same cell
    entry = word * 2 * size + slot
    left = np.flatnonzero(slot < classes)
    right = np.minimum(np.searchsorted(entry, entry[left] + size), len(entry) - 1)
    left, right = (x[entry[right] == entry[left] + size] for x in (left, right))
    d = n[slot[left], slot[left]]
    more = _xlogx(d + c[left] + c[right]) - _xlogx(d + c[left]) - _xlogx(d + c[right]) + _xlogx(d)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(len(first), np.int64)
    # some 20,000 rows of gains at a time
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(word), 20_000)), len(first)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        end = first[b] if b < len(first) else len(word)
        gain = np.add.reduceat(gains[of[first[a] : end]], first[a:b] - first[a]) - losses[of_times[a:b]]
        p, q = np.searchsorted(word[left], (a, b))
        gain[word[left[p:q]] - a, slot[left[p:q]]] += more[p:q]
        out[a:b] = gain.argmax(1)
    return out


def _choose(shared, classes: int, size: int):
    """The class of each word of the head ``(word, slots, counts)``, its rows one after the other."""

    def run(batches):
        for table in _whole(batches, 2_000):
            words, nth = np.unique(table.column("word").to_numpy(), return_inverse=True)
            slots, counts = (table.column(x).combine_chunks() for x in ("slots", "counts"))
            entry = np.repeat(nth, slots.value_lengths().to_numpy()) * 2 * size + slots.flatten().to_numpy()
            k, at = np.unique(entry, return_inverse=True)
            c = np.bincount(at, counts.flatten().to_numpy()).astype(np.int64)
            best = _best(shared.value, classes, k // (2 * size), k % (2 * size), c)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best.astype(np.int32))], ["word", "cls"])

    return run


def _rest(shared, base: int):
    """Per token of a word that is not known: its hash, the nodes before and after it, and the hash of the next token, if that is not known either."""

    def run(batches):
        size = base + 1 + RARE
        for batch in batches:
            for _, texts in sub_batches(batch, "text"):
                w, h, at, node = _classes(texts, shared.value, base)
                on = np.flatnonzero(at < 0)
                place = on + w.doc[on]
                before, after = np.concatenate([[base], node])[place], node[place + 1]
                following = np.where(after > base, signed(np.append(h, np.uint64(0)))[on + 1], 0)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[on])), pa.array((before * size + after).astype(np.int32)), pa.array(following)], ["h", "beside", "following"])

    return run


#: rows of ``_place``: a word, its class and count; a word, the class of one of the rest before it and how often; a cell of the matrix and its count
WORD, PAIR, CELL = 0, 1, 2


def _place(shared, classes: int, size: int):
    """The class of each word of the rest, its tokens one after the other, and what that class adds to the class bigrams."""

    def run(batches):
        for table in _whole(batches, 100_000):
            h, beside, following = (table.column(x).to_numpy() for x in ("h", "beside", "following"))
            words, nth, times = np.unique(h, return_inverse=True, return_counts=True)
            before, after = beside // size, beside % size
            k, c = np.unique(np.concatenate([nth * 2 * size + before, nth * 2 * size + size + after]), return_counts=True)
            best = _best(shared.value, classes, k // (2 * size), k % (2 * size), c)
            own = best[nth]
            pair = after > classes
            # neighbours of the rest have new classes themselves: pairs of them are counted once, by the first
            cells, found = np.unique(np.concatenate([(before * size + own)[before <= classes], (own * size + after)[~pair]]), return_counts=True)
            kinds = np.repeat([WORD, PAIR, CELL], [len(words), pair.sum(), len(cells)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.astype(np.int32)), pa.array(np.concatenate([words, following[pair], cells])), pa.array(np.concatenate([best, own[pair], np.zeros(len(cells), np.int64)]).astype(np.int32)),
                 pa.array(np.concatenate([times, np.ones(pair.sum(), np.int64), found]))],
                ["kind", "h", "cls", "c"])

    return run


def _exchange_rest(rows: DataFrame, known: tuple[np.ndarray, np.ndarray], n: np.ndarray, classes: int) -> tuple[np.ndarray, DataFrame]:
    """The class bigrams once every word of ``rows`` that is not known has moved to its best class, and these words ``(h, c, cls)``.

    Of the rest only sums of class pairs reach the driver.
    """
    sc, size = rows.sparkSession.sparkContext, len(n)
    tokens = rows.mapInArrow(_rest(sc.broadcast(known), classes), "h long, beside int, following long").repartition("h").sortWithinPartitions("h")
    placed = written(tokens.mapInArrow(_place(sc.broadcast(n), classes, size), "kind int, h long, cls int, c long"))
    words = placed.where(F.col("kind") == WORD).select("h", "c", "cls")
    pairs = placed.where(F.col("kind") == PAIR).select("h", F.col("cls").alias("before"), "c").join(words.select("h", "cls"), "h")
    pairs = pairs.groupBy((F.col("before").cast("long") * size + F.col("cls")).alias("k"))
    cells = placed.where(F.col("kind") == CELL).groupBy(F.col("h").alias("k"))
    n = n.copy()
    n[classes + 1 :], n[:, classes + 1 :] = 0, 0
    for found in (pairs, cells):
        got = found.agg(F.sum("c").alias("c")).toArrow()
        n.reshape(-1)[got.column("k").to_numpy()] += got.column("c").to_numpy()
    return n, words


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, members: int, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """Class of each of the first ``members`` nodes of the bigram matrix; the other nodes keep a class each.

    Starts from frequency rank modulo ``classes`` and moves one word at a time to the class that
    raises the likelihood of the class bigrams most, until a round moves nothing.
    """
    others = len(pairs) - members
    of = np.concatenate([np.arange(members) % classes, classes + np.arange(others)])
    t = classes + others
    n = np.zeros((t, t))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    for _ in range(rounds):
        moved = 0
        for w in range(members):
            a = of[w]
            own = pairs[w, w]
            right = np.bincount(of, pairs[w], t)
            left = np.bincount(of, pairs[:, w], t)
            right[a] -= own
            left[a] -= own
            n[a, :] -= right
            n[:, a] -= left
            n[a, a] -= own
            rows, cols = n.sum(1)[:classes], n.sum(0)[:classes]
            b = np.arange(classes)
            gain = (_xlogx(n[:classes] + right) - _xlogx(n[:classes])).sum(1) + (_xlogx(n[:, :classes] + left[:, None]) - _xlogx(n[:, :classes])).sum(0)
            d = n[b, b]
            gain += _xlogx(d + right[b] + left[b] + own) - _xlogx(d) - (_xlogx(d + right[b]) - _xlogx(d)) - (_xlogx(d + left[b]) - _xlogx(d))
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            of[w] = best
            n[best, :] += right
            n[:, best] += left
            n[best, best] += own
        if not moved:
            break
    return of


@dataclass
class BrownModel:
    """What scoring broadcasts: bounded by ``head`` and the number of classes."""

    head: np.ndarray
    head_counts: np.ndarray
    head_class: np.ndarray
    log_next: np.ndarray
    log_size: np.ndarray
    classes: int
    tokens: int
    distinct: int
    ends: int


def fit(train: DataFrame, text_col: str = "text", classes: int = CLASSES, members: int | None = None, head: int | None = None, sweeps: int = 1) -> tuple[BrownModel, DataFrame]:
    """The model and the full table of word counts ``(h, rare, c)``, counted over all of ``train``.

    ``members`` words (default ``MEMBERS``) are exchanged one by one until nothing moves, the others
    of the ``HEAD`` most frequent words in ``sweeps`` batch exchanges, and every further word in one more;
    the table is then that of these further words and their classes ``(h, c, cls)``. ``MEMBERS`` and ``HEAD``
    bound what is broadcast and what the driver holds. A caller who gives ``head`` asks for a vocabulary of so
    many words: words beyond it keep their fixed classes, as all but the members do with ``sweeps=0``.
    """
    most, whole = members if members is not None else MEMBERS, head is None and sweeps > 0
    rows = train.select(F.col(text_col).alias("text"))
    spark = train.sparkSession
    counts = written(rows.mapInArrow(_count, "h long, rare int, c long").groupBy("h").agg(F.first("rare").alias("rare"), F.sum("c").alias("c")))
    ends = rows.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD if head is None else head).toArrow()
    h, c, rare_of = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("rare").to_numpy()
    m = min(most, len(h))
    own = np.argsort(h[:m])
    matrix = _matrix(rows, (h[:m][own], own), m)
    of = exchange(matrix, m, classes)
    t = classes + 1 + RARE
    n = np.zeros((t, t))
    np.add.at(n, (of[:, None], of[None, :]), matrix)
    # class of each word of the head, in order of frequency; further words begin in their fixed one
    cls = np.concatenate([of[:m], classes + 1 + rare_of[m:].astype(np.int64)])
    order = np.argsort(h)
    if len(h) > m:
        wanted = np.sort(h[m:])
        for _ in range(sweeps):
            shared = spark.sparkContext.broadcast(((h[order], cls[order]), wanted))
            per = rows.mapInArrow(_neighbours(shared, classes), "word long, slots array<short>, counts array<int>").repartition("word").sortWithinPartitions("word")
            chosen = per.mapInArrow(_choose(spark.sparkContext.broadcast(n), classes, t), "word long, cls int").toArrow()
            moved = np.searchsorted(h[order], wanted[chosen.column("word").to_numpy()])
            cls[order[moved]] = chosen.column("cls").to_numpy()
            n = _matrix(rows, (h[order], cls[order]), classes)
    further = counts.groupBy((F.col("rare") + classes + 1).alias("cls"))
    whole = whole and total[1] > len(h)
    if whole:
        n, counts = _exchange_rest(rows, (h[order], cls[order]), n, classes)
        further = counts.groupBy("cls")
    log_next = np.log10((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * t))
    # words and tokens of each class; one unit more for words never seen
    tokens, words = np.bincount(cls, c, t), np.bincount(cls, minlength=t).astype(float)
    tokens[classes], words[classes] = ends, 1 if ends else 0
    for k, s, r in further.agg(F.sum("c"), F.count("*")).collect():
        tokens[k] += s
        words[k] += r
    if not whole:
        # the head was counted in its rare classes as well
        tokens[classes + 1 :] -= np.bincount(rare_of, c, RARE)
        words[classes + 1 :] -= np.bincount(rare_of, minlength=RARE)
    model = BrownModel(h[order], c[order], cls[order], log_next, np.log10(tokens + words + 1), classes, int(total[0]) + ends, int(total[1]) + (1 if ends else 0), ends)
    return model, counts


def score(docs: DataFrame, model: BrownModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` of each row; both scores are log10 probabilities.

    ``perplexity`` follows as 10 ** (-score / n_tokens). Null text is empty: one end token. Rows
    repeating an id, or without one, are scored each by itself. With no training text every
    count is 0. Empty input gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = math.log10(model.tokens + model.distinct + 1)
    # beside a word that is not broadcast stands a node, or (``other``) another such word
    size = other = model.classes + 1 + RARE
    codes = (other + 1) ** 2 * RARE

    def run(batches):
        m = shared.value
        rid = TaskContext.get().partitionId() << 36
        known_end = m.ends > 0
        for batch in batches:
            for rows, texts in sub_batches(batch, "text"):
                w, h, at_head, cls = _classes(texts, (m.head, m.head_class), m.classes)
                n = np.diff(w.first) + 1
                doc = np.repeat(np.arange(len(texts)), n)
                start = np.cumsum(n) - n
                seen = at_head >= 0
                tail = np.flatnonzero(~seen)
                text = w.doc[tail]
                place = tail + text
                rare = cls[place] - m.classes - 1
                cls[place] = other
                before = np.concatenate([[m.classes], cls[:-1]])
                before[start] = m.classes
                sure, both = cls < other, (cls < other) & (before < other)
                fixed = np.bincount(doc[both], m.log_next[before[both], cls[both]], len(texts)) - np.bincount(doc[sure], m.log_size[cls[sure]], len(texts)) + math.log10(m.ends + 1)
                part = np.bincount(w.doc[seen], np.log10(m.head_counts[at_head[seen]] + 1.0), len(texts)) if len(m.head) else np.zeros(len(texts))
                known = np.bincount(w.doc[seen], minlength=len(texts)) + known_end
                # one row per token of such a word; the text's first, or a row of its own, carries the text's sums
                code = (before[place] * (other + 1) + cls[place + 1]) * RARE + rare
                none = np.setdiff1d(np.arange(len(texts)), text)
                ids = rid + np.arange(len(texts))
                rid += len(texts)
                first = np.concatenate([np.diff(text, prepend=-1) != 0, np.ones(len(none), bool)])
                at = np.concatenate([(place - start[text]) * codes + code, np.full(len(none), -1)])
                word = np.concatenate([signed(h[tail]), signed(mix64(ids[none].astype(np.uint64)))])
                text = np.concatenate([text, none])
                only = lambda x: np.where(first, x[text], 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc")[rows].take(pa.array(text, mask=~first)), pa.array(ids[text]), pa.array(at), pa.array(word), pa.array(only(n)), pa.array(only(known)), pa.array(only(part).astype(float)), pa.array(only(fixed).astype(float))],
                    ["doc", "rid", "at", "h", "n", "known", "part", "fixed"])

    def add(batches):
        m = shared.value
        held = None
        last = 0
        for batch in batches:
            if not len(batch):
                continue
            rid, at, c = (batch.column(x).to_numpy() for x in ("rid", "at", "c"))
            token = at >= 0
            code, k = at // size % codes, at % size
            before, after = code // RARE // (other + 1), code // RARE % (other + 1)
            # such a word before this one has the row before this one's
            k_before = np.where(before == other, np.append(last, k[:-1]), before)
            # the step to another such word is added with that word
            leaves = np.where(after == other, 0, m.log_next[k, np.minimum(after, other - 1)])
            moves = np.where(token, m.log_next[k_before, k] + leaves - m.log_size[k], 0)
            first = np.flatnonzero(np.diff(rid, prepend=rid[0] - 1))
            sums = [batch.column(x).to_numpy() for x in ("n", "known", "part", "fixed")]
            sums = [sums[0], sums[1] + (token & (c > 0)), sums[2] + np.where(token, np.log10(c + 1.0), 0), sums[3] + moves]
            sums = [np.add.reduceat(x, first) for x in sums]
            ids, docs_of = rid[first], batch.column("doc").take(pa.array(first)).to_pylist()
            last = k[-1]
            if held is not None and held[0] == ids[0]:
                docs_of[0] = held[1]
                for x, y in zip(sums, held[2]):
                    x[0] += y
            elif held is not None:
                yield out([held[1]], [np.array([y]) for y in held[2]])
            held = ids[-1], docs_of[-1], [x[-1] for x in sums]
            yield out(docs_of[:-1], [x[:-1] for x in sums])
        if held is not None:
            yield out([held[1]], [np.array([y]) for y in held[2]])

    def out(docs_of, sums):
        return pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), *map(pa.array, sums)], ["doc", "n_tokens", "n_known", "s", "fixed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, "doc long, rid long, at long, h long, n long, known long, part double, fixed double")
    # a class of its own where the table has one, else the fixed one
    cls = F.coalesce(*([F.col("cls")] if "cls" in counts.columns else []), F.col("at") % RARE + (model.classes + 1))
    at = F.when(F.col("at") < 0, -1).otherwise(F.col("at") * size + cls).alias("at")
    found = parts.join(counts.drop("rare"), "h", "left").select("rid", at, F.coalesce(F.col("c"), F.lit(0)).alias("c"), "doc", "n", "known", "part", "fixed")
    sums = found.repartition("rid").sortWithinPartitions("rid", "at").mapInArrow(add, "doc long, n_tokens long, n_known long, s double, fixed double")
    end = math.log10(model.ends + 1)
    return sums.select(F.col("doc").alias(id_col), "n_tokens", "n_known", (F.col("s") + F.lit(end) - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("s") + F.col("fixed")).alias("score"))


def held_out(id_col: str, of: int, rest: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == rest


def op6_brown_lm(spark, sf_dir):
    """Scores of all ``documents`` by a model of those not held out; handling as in ``score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = fit(docs.where(~held_out("doc_id", 7, 2)))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
