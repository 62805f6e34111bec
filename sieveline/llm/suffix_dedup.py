"""Removal of repeated 100-byte strings by a distributed merge sort of sparse suffixes.

Which bytes are repeated follows from the sorted suffixes: equal 100-byte strings are neighbours.
Sorting a suffix per byte is not needed. Every 100-byte string owns an anchor, the leftmost of the
32-byte grams in it with the smallest hash, which depends on its bytes alone; so equal strings have
equal anchors at equal offsets. Consecutive strings of a text that own the same anchor form one
*stretch*, and one suffix per stretch (from the anchor on, then its left context reversed) is sorted.

1. Anchor hashes are counted over all documents (one shuffle of 8-byte hashes, pre-aggregated).
   Hashes seen once cannot lie in a repeat. The others enter a filter that is broadcast, of
   16 bits for each of them and at most 2^``MAX_LOG_BITS`` bits in all: false positives only add suffixes to
   the sort, so beyond that size the exchange grows (at worst every stretch enters) and the result stays.
2. Map tasks sort the suffixes that remain into runs, drop copies inside a run but the first, and
   front-code the runs (length of the prefix shared with the suffix before, and the rest), cut at
   the borders of hash ranges. A suffix's sort key begins with its anchor's hash. Only suffixes of
   one anchor can have a string in common, so any order of the anchors does, and hash order needs
   no sampled splitters: ranges are even, and no anchor lies across a border.
3. Each range merges its runs with a loser tree that carries, for every loser, the length of the
   prefix shared with the winner, so known prefixes are never compared again. There are as many
   ranges as the counts call for at ``RANGE`` suffixes each.
4. In merged order equal suffixes are adjacent: all but the first are repeats as a whole.
   Different suffixes of one anchor may share some of their strings; those are compared one by
   one against the strings already met, in order of first occurrence.
5. Anchors seen more than ``hot`` times (a passage that a third of all documents share) would bring
   all their surroundings to one range. Their stretches are taken apart into single strings, each of
   which is a suffix with a hash of its own: equal ones meet, others spread over all ranges, and a
   run holds each once.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.hashfilter import hash_filter
from sieveline.llm.textops import Rolling, mix64, signed, sub_batches
from sieveline.session import written

SPAN = 100
GRAM = 32
#: a document without an id sorts first
NO_ID = -(2**63)
RUN = 40_000
RANGE = 50_000
STRINGS = 60_000
BLOCK = 1 << 18
#: bits of a position inside a block; the other bits of an anchor's rank are its gram's hash, whatever the block
PLACE = 20
MAX_LOG_BITS = 28
#: of the filter of hot anchors: 16 bits for each, up to 16 MB; beyond that more anchors are taken apart
HOT_LOG_BITS = 27
_ZSTD = pa.Codec("zstd", compression_level=3)


def _stretches(texts: list[bytes], span: int = SPAN, gram: int = GRAM):
    """``data``, and per stretch: text index, first and last window start, anchor (all in ``data``), anchor hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    none = np.zeros(0, np.int64)
    n = len(data) - span + 1
    if n <= 0:
        return data, none, none, none, none, np.zeros(0, np.uint64), ends - lens
    at = np.arange(len(data) - gram + 1)
    g = Rolling(data).ranges(at, at + gram)
    low = (g >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    width, want = 1, span - gram + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if want > width:
        low = np.minimum(low[: -(want - width)], low[want - width :])
    anchor = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)[:n]
    valid = np.arange(n) + span <= np.repeat(ends, lens)[:n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return data, none, none, none, none, np.zeros(0, np.uint64), ends - lens
    size = np.add.reduceat(valid.astype(np.int64), first)
    a = anchor[first]
    # a minimum is small; mixed again it spreads over filter and ranges
    return data, np.searchsorted(ends, first, side="right"), first, first + size - 1, a, mix64(g[a]), ends - lens


def _blocks(batch: pa.RecordBatch):
    """``(row numbers, texts, offsets)`` of at most ``BLOCK`` bytes; a longer text comes in overlapping pieces."""
    for rows, texts in sub_batches(batch, "text", BLOCK):
        if max(map(len, texts)) <= BLOCK:
            yield range(rows.start, rows.stop), texts, [0] * len(texts)
            continue
        for i, text in enumerate(texts, rows.start):
            # a window of SPAN bytes lies whole in the piece in which it starts
            for at in range(0, len(text) - SPAN + 1, BLOCK):
                yield [i], [text[at : at + BLOCK + SPAN - 1]], [at]


def _count(batches):
    held, n = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], ["h", "c"])

    for batch in batches:
        for _, texts, _ in _blocks(batch):
            held.append(_stretches(texts)[5])
            n += len(held[-1])
            if n > 1_000_000:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _front_code(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared-prefix lengths of sorted keys and the remaining bytes, joined."""
    shared, rest, last = np.zeros(len(keys), np.uint16), [], b""
    for i, k in enumerate(keys):
        s = _shared(last, k, 0)
        shared[i] = s
        rest.append(k[s:])
        last = k
    return shared, b"".join(rest)


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, given that ``at`` bytes are known to be shared."""
    end = min(len(a), len(b))
    step = 32
    while at < end:
        if a[at : at + step] == b[at : at + step]:
            at = min(at + step, end)
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
    return end


BLOCKS = ["part", "n", "size", "block"]


def _pack(part: int, n: int, *sections) -> pa.RecordBatch:
    """One compressed block; ``n`` is negative for copies already known."""
    raw = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in sections)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([len(raw)], pa.int32()), pa.array([_ZSTD.compress(raw, asbytes=True)])], BLOCKS)


def _unpack(raw: bytes, n: int, *types):
    """The typed sections of a block of ``n`` entries, and the bytes that remain."""
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return (*out, raw[at:])


def _joined(doc, dig, start, end):
    """Spans in order, overlapping ones of one document joined."""
    order = np.lexsort((start, dig, doc))
    doc, dig, start, end = doc[order], dig[order], start[order], end[order]
    if not len(doc):
        return doc, dig, start, end
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (dig[1:] == dig[:-1])])
    # ends grow with the document's number, so one running maximum serves all documents
    step = int(end.max()) + 1
    base = np.cumsum(~same) * step
    reach = np.maximum.accumulate(base + end)
    new = ~same
    new[1:] |= base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], dig[at], start[at], (reach - base)[np.concatenate([at[1:] - 1, [len(doc) - 1]])]


def _runs(shared, parts: int):
    """Front-coded sorted runs per hash range, and the copies found inside runs."""

    def run(batches):
        known, hot = shared.value
        held: list[tuple] = []
        copies = tuple(array("q") for _ in range(4))

        def copy(doc, dig, start, end):
            for a, x in zip(copies, (doc, dig, start, end)):
                a.append(x)

        def blocks(keep):
            """Sorted, distinct ``(key, doc, dig, p, q, anchor)`` as one run."""
            at = np.array([int.from_bytes(x[0][:8], "big") * parts >> 64 for x in keep], np.int64)
            cuts = np.searchsorted(at, np.unique(at))
            for a, b in zip(cuts, [*cuts[1:], len(keep)]):
                own = keep[a:b]
                prefix, rest = _front_code([x[0] for x in own])
                doc, dig, p, q, anchor = np.array([x[1:] for x in own], np.int64).T
                yield _pack(int(at[a]), len(own), prefix, np.array([len(x[0]) for x in own], np.uint16), doc, dig, p.astype(np.int32), (q - p).astype(np.uint16), (anchor - p).astype(np.uint16), rest)

        def strings(first: dict):
            return blocks(sorted((hashlib.blake2b(s, digest_size=8).digest() + s + bytes([SPAN]), *place, place[2], place[2]) for s, place in first.items()))

        def flush():
            held.sort()
            keep = []
            for x in held:
                # equal keys sort by place, so the first of them is the earliest here
                if keep and keep[-1][0] == x[0]:
                    if keep[-1][1:4] != x[1:4]:
                        copy(x[1], x[2], x[3], x[4] + SPAN)
                else:
                    keep.append(x)
            held.clear()
            if hot is not None and keep:
                often = hot.passes(np.array([int.from_bytes(x[0][:8], "big") for x in keep], np.uint64)).tolist()
                apart = [x for x, on in zip(keep, often) if on]
                keep = [x for x, on in zip(keep, often) if not on]
                first: dict[bytes, tuple] = {}
                for key, doc, dig, p, q, _ in apart:
                    body = _body(key)
                    for i in range(q - p + 1):
                        s, place = body[i : i + SPAN], (doc, dig, p + i)
                        old = first.setdefault(s, place)
                        if old != place:
                            if place < old:
                                first[s], place = place, old
                            copy(*place, place[2] + SPAN)
                    if len(first) > STRINGS:
                        yield from strings(first)
                        first = {}
                yield from strings(first)
            yield from blocks(keep)
            if copies[0]:
                spans = _joined(*(np.array(x, np.int64) for x in copies))
                yield _pack(int(spans[0][0] % parts), -len(spans[0]), *spans)
                for x in copies:
                    del x[:]

        for batch in batches:
            ids, digs = batch.column("doc").to_numpy(), batch.column("dig").to_numpy()
            for rows, texts, offsets in _blocks(batch):
                data, text, first, last, anchor, h, start = _stretches(texts)
                on = np.flatnonzero(known.passes(h))
                raw = data.tobytes()
                shift = start - np.array(offsets, np.int64)
                for i, k, a, p, q, f in zip(text[on].tolist(), h[on].tolist(), anchor[on].tolist(), first[on].tolist(), last[on].tolist(), shift[text[on]].tolist()):
                    right = raw[a : q + SPAN]
                    held.append((k.to_bytes(8, "big") + right + raw[p:a][::-1] + len(right).to_bytes(1, "big"), int(ids[rows[i]]), int(digs[rows[i]]), p - f, q - f, a - f))
                if len(held) >= RUN:
                    yield from flush()
        yield from flush()

    return run


class LoserTree:
    """Merges sorted, front-coded runs. Yields ``(key, bytes shared with the key before, run, index)``."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray, bytes]]):
        self.runs = [self._decode(*r) for r in runs]
        self.keys: list[bytes | None] = []
        self.known: list[int] = []
        self.index = [-1] * len(runs)
        for r in self.runs:
            k, _ = next(r, (None, 0))
            self.keys.append(k)
            self.known.append(0)

    @staticmethod
    def _decode(shared, lens, rest):
        at, last = 0, b""
        for s, n in zip(shared.tolist(), lens.tolist()):
            last = last[:s] + rest[at : at + n - s]
            at += n - s
            yield last, s

    def _beats(self, a: int, b: int) -> bool:
        """Does run ``a`` come first? The loser's known prefix becomes the one it shares with the winner."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return ka > kb
        s = _shared(x, y, ka)
        first = x[s : s + 1] < y[s : s + 1] or (len(x) == len(y) == s and a < b)
        self.known[b if first else a] = s
        return first

    def __iter__(self):
        n = len(self.runs)
        if not n:
            return
        losers = [-1] * n
        for r in range(n):
            w, node = r, (r + n) // 2
            while node > 0:
                other = losers[node]
                if other < 0:
                    losers[node] = w
                    w = -1
                    break
                if self._beats(other, w):
                    losers[node], w = w, other
                node //= 2
            if w >= 0:
                winner = w
        counts = [0] * n
        while self.keys[winner] is not None:
            yield self.keys[winner], self.known[winner], winner, counts[winner]
            counts[winner] += 1
            self.keys[winner], self.known[winner] = next(self.runs[winner], (None, 0))
            w, node = winner, (winner + n) // 2
            while node > 0:
                if self._beats(losers[node], w):
                    losers[node], w = w, losers[node]
                node //= 2
            winner = w


def _shared_strings(variants: list[tuple[bytes, tuple]], emit) -> None:
    """Strings that several variants of one anchor have in common: spans of all but the first occurrence.

    Equal strings have their anchor at the same offset, so one offset is compared at a time and
    only its strings are held; a variant remembers its repeats as a bit set.
    """
    variants.sort(key=lambda v: (v[1][0], v[1][1], v[1][4]))
    found = [0] * len(variants)
    rows = [(j, body, at - p, q - p) for j, (body, (_, _, p, q, at)) in enumerate(variants)]
    for offset in range(min(o - n for _, _, o, n in rows), max(o for _, _, o, _ in rows) + 1):
        seen: set[bytes] = set()
        for j, body, o, n in rows:
            i = o - offset
            if 0 <= i <= n:
                w = body[i : i + SPAN]
                if w in seen:
                    found[j] |= 1 << i
                else:
                    seen.add(w)
    for bits, (_, (doc, dig, p, _, _)) in zip(found, variants):
        i = 0
        while bits >> i:
            if bits >> i & 1:
                first = i
                while bits >> i & 1:
                    i += 1
                emit(doc, dig, p + first, p + i - 1 + SPAN)
            else:
                i += 1


def _body(key: bytes) -> bytes:
    """The stretch's bytes, from the sort key: anchor hash, right context, reversed left context, its length."""
    right = 8 + key[-1]
    return key[right:-1][::-1] + key[8:right]


def _merge(table: pa.Table) -> pa.Table:
    spans = tuple(array("q") for _ in range(4))
    runs, places = [], []

    def emit(*span):
        for a, x in zip(spans, span):
            a.append(x)

    for n, size, block in zip(*(table.column(c) for c in BLOCKS[1:])):
        n = n.as_py()
        raw = _ZSTD.decompress(block.as_buffer(), size.as_py(), asbytes=True)
        if n < 0:
            for a, x in zip(spans, _unpack(raw, -n, *[np.int64] * 4)):
                a.frombytes(x.tobytes())
        else:
            shared, lens, doc, dig, p, wide, at, rest = _unpack(raw, n, np.uint16, np.uint16, np.int64, np.int64, np.int32, np.uint16, np.uint16)
            runs.append((shared, lens, rest))
            places.append((doc, dig, p, wide, at))

    def close(group):
        if len(group) > 1:
            _shared_strings([(_body(k), p) for k, p in group], emit)

    group: list[list] = []
    for key, known, run, i in LoserTree(runs):
        doc, dig, p, wide, at = (int(x[i]) for x in places[run])
        place = (doc, dig, p, p + wide, p + at)
        if group and known == len(key) == len(group[-1][0]):
            old = group[-1][1]
            if place[:3] != old[:3]:
                first, second = (old, place) if old[:3] <= place[:3] else (place, old)
                emit(*second[:3], second[3] + SPAN)
                group[-1][1] = first
            continue
        if group and known < 8 + GRAM:
            close(group)
            group = []
        group.append([key, place])
    close(group)
    # fewer rows leave the task
    return pa.table(dict(zip(("doc", "dig", "start", "end"), _joined(*(np.array(x, np.int64) for x in spans)))))


def repeated_spans(rows: DataFrame, hot: int = 20_000) -> DataFrame:
    """Byte spans ``(doc, dig, start, end)`` covered by 100-byte strings that also start earlier; spans may overlap.

    ``rows`` has ``doc`` and ``dig`` (longs, not null), which together name a text, and ``text``.
    """
    spark = rows.sparkSession
    counts = rows.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    often = written(counts.where("c > 1"))
    n, total = often.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    many = often.where(F.col("c") > hot)
    n_hot = many.count()
    # an anchor that passes by chance is taken apart too, in all tasks alike: no result depends on it
    apart = hash_filter(many, "h", n_hot, HOT_LOG_BITS) if n_hot else None
    shared = spark.sparkContext.broadcast((hash_filter(often, "h", n, MAX_LOG_BITS), apart))
    parts = max(1, math.ceil(total / RANGE))
    runs = rows.mapInArrow(_runs(shared, parts), "part int, n int, size int, block binary")
    return runs.groupBy("part").applyInArrow(lambda t: _merge(t), "doc long, dig long, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000) -> DataFrame:
    """Each row's text without the bytes covered by a 100-byte string that also starts earlier.

    Returns one row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept``
    (the remaining bytes). Earlier is a smaller id, or the same text further left. Strings are
    judged on the input, not on what is left. Null text is empty; texts under 100 bytes never
    change. Rows without an id sort first. Rows that repeat both id and text are one document and
    do not remove each other's bytes; rows with one id and different texts (rows without an id
    too) are documents of their own, in order of a hash of the text. Empty input gives no rows;
    other columns are not read. ``hot`` is the count of an anchor above which its surroundings are
    compared string by string over all ranges (see the module); the result does not depend on it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("dig"), "text")
    spans = repeated_spans(rows.drop("id"), hot).groupBy("doc", "dig").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans.withColumnsRenamed({"doc": "of", "dig": "of_dig"}))

    def cut(batches):
        for batch in batches:
            for at, texts in sub_batches(batch, "text"):
                out = [[] for _ in range(5)]
                for text, own in zip(texts, batch.column("spans")[at].to_pylist()):
                    gone = runs = 0
                    kept = text
                    if own:
                        edge = np.zeros(len(text) + 1, np.int64)
                        for s in own:
                            edge[s["start"]] += 1
                            edge[s["end"]] -= 1
                        off = np.cumsum(edge[:-1]) > 0
                        gone = int(off.sum())
                        runs = int((off[1:] & ~off[:-1]).sum() + off[0]) if len(off) else 0
                        kept = np.frombuffer(text, np.uint8)[~off].tobytes()
                    for x, v in zip(out, (len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept)):
                        x.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id")[at], *[pa.array(x, t) for x, t in zip(out, types)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = rows.join(spans, (rows.doc == spans.of) & (rows.dig == spans.of_dig), "left").select("id", "text", "spans")
    return both.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op8_suffix_dedup(spark, sf_dir):
    """``remove_repeats`` over all ``documents``, without the remaining bytes themselves; its handling of nulls, ties and repeats holds."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
