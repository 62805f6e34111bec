"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-word hashes the smallest is a fingerprint, so any span of 10 shared
words holds a shared one (5 + 6 - 1 = 10). Documents and benchmark are fingerprinted alike. A
document's fingerprints pass a filter of the benchmark's ones that is broadcast; around each that
passes, every window of 10 words that holds it is joined, by 128 bits of its words' hashes, to the
benchmark's windows. That extends hits to the full extent of shared spans.

Items of fewer than 10 words are one window each; every gram of such a length is tried instead of
a winnowed set, so short spans are guaranteed as well.

Items enter as sets: a window names the set of items that hold it, and a document the combination
of its windows' sets. Each distinct combination is worked out once, so a passage that stands in every
item and in a third of all documents costs one row per document, not a pair with each item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.hashfilter import hash_filter
from sieveline.llm.textops import ALNUM, grams, mix64, signed, sub_batches, words_of
from sieveline.session import written

K, WINDOW = 5, 10
#: the filter holds 16 bits for each benchmark fingerprint, up to 16 MB; beyond that more windows reach the exact join
MAX_LOG_BITS = 27


def _winnow(g: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest of each ``w`` consecutive grams inside one text (rightmost on ties)."""
    if not len(g):
        return np.zeros(0, np.int64)
    pad = np.concatenate([g, np.full(w, np.uint64(2**64 - 1))])
    low = g.copy()
    for i in range(1, w):
        low = np.minimum(low, pad[i : i + len(g)])
    at = np.zeros(len(g), np.int64)
    for i in range(w):
        at[pad[i : i + len(g)] == low] = i
    # windows must lie inside one text: a window at word p needs p .. p + w + K - 2 in it
    start = np.arange(len(g))
    text = np.searchsorted(first, start, side="right") - 1
    ok = start + w + K - 1 <= first[text + 1]
    return np.unique((start + at)[ok])


def _fingerprints(texts: list[bytes], short: tuple[int, ...]):
    """Words of the texts, and ``(gram length, position, hash)`` of winnowed 5-grams and of all grams of the lengths in ``short``."""
    w = words_of(texts, ALNUM)
    h = w.hashes()
    g = grams(h, K)
    at = _winnow(g, w.first, WINDOW - K + 1)
    out = [(np.full(len(at), WINDOW), at, g[at])]
    for m in short:
        g = mix64(grams(h, m) + np.uint64(m))
        start = np.arange(len(g))
        ok = start + m <= w.first[np.searchsorted(w.first, start, side="right")] if len(g) else np.zeros(0, bool)
        out.append((np.full(ok.sum(), m), start[ok], g[ok]))
    return w, [np.concatenate(x) for x in zip(*out)]


def _windows(w, size: int, start: np.ndarray) -> list[np.ndarray]:
    """128 bits of each window of ``size`` words, from two families of word hashes."""
    out = []
    for which in (0, 1):
        h, total = w.hashes(which), np.zeros(len(start), np.uint64)
        for i in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[start + i]
        out.append(signed(mix64(total)))
    return out


_ITEM = ["item", "mark", "size", "h0", "h1"]


def _item_windows(batches):
    """A row for each window of an item, and one for each fingerprint (``mark``) that stands for some."""
    for batch in batches:
        for rows, texts in sub_batches(batch, "text"):
            w = words_of(texts, ALNUM)
            n = np.diff(w.first)
            short = tuple(sorted(set(n[(n > 0) & (n < WINDOW)].tolist())))
            w, (size, at, h) = _fingerprints(texts, short)
            text = np.searchsorted(w.first, at, side="right") - 1
            own = size == np.minimum(n[text], WINDOW)
            h = np.unique(h[own])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(signed(h)), *[pa.nulls(len(h), t) for t in (pa.int32(), pa.int64(), pa.int64())]], _ITEM)
            for m in (*short, WINDOW):
                start = np.arange(len(w.starts))
                text = np.searchsorted(w.first, start, side="right") - 1
                start = start[(start + m <= w.first[text + 1]) & (np.minimum(n[text], WINDOW) == m)]
                text = np.searchsorted(w.first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("item")[rows].take(pa.array(text)), pa.nulls(len(start), pa.int64()), pa.array(np.full(len(start), m, np.int32)), *map(pa.array, _windows(w, m, start))], _ITEM)


_SEEN = ["doc", "dig", "n_words", "size", "start", "h0", "h1"]


def _document_windows(shared, short):
    """A row for each document with its number of words, and one for each of its windows around a fingerprint that passes."""

    def run(batches):
        for batch in batches:
            for rows, texts in sub_batches(batch, "text"):
                w, (size, at, h) = _fingerprints(texts, short)
                n = np.diff(w.first)
                doc, dig = batch.column("doc")[rows], batch.column("dig")[rows]
                none = [pa.nulls(len(texts), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([doc, dig, pa.array(n), *none], _SEEN)
                on = shared.value.passes(h)
                size, at = size[on], at[on]
                for m in np.unique(size).tolist():
                    p = at[size == m]
                    text = np.searchsorted(w.first, p, side="right") - 1
                    if m == WINDOW:
                        start = (p[:, None] - np.arange(WINDOW - K + 1)).ravel()
                        text = np.repeat(text, WINDOW - K + 1)
                        ok = (start >= w.first[text]) & (start + WINDOW <= w.first[text + 1])
                        p = np.unique(start[ok])
                        text = np.searchsorted(w.first, p, side="right") - 1
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(take), dig.take(take), pa.nulls(len(p), pa.int64()), pa.array(np.full(len(p), m, np.int32)), pa.array((p - w.first[text]).astype(np.int32)), *map(pa.array, _windows(w, m, p))], _SEEN)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Words of each document that lie inside a benchmark window.

    Returns one row per input row: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``, and with
    ``digest`` the ``xxhash64`` of the text, which tells rows of one id apart.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. Null or wordless
    texts have no words and no hits; null or wordless items never occur. Items repeating an id
    count once by that id, each with its own windows. The windows of items without an id hit words
    like any others, but such items have no name and count in neither ``n_items`` nor the digest.
    Every row is searched in its own text, also rows that repeat an id or have none. With no items
    nothing is contaminated. Empty input gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("dig"), F.col(text_col).alias("text"))
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item"), "text").mapInArrow(_item_windows, "item long, mark long, size int, h0 long, h1 long"))
    marks = items.where("mark is not null").select("mark").distinct()
    # at most nine lengths below a window
    short = tuple(sorted(r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()))
    shared = spark.sparkContext.broadcast(hash_filter(marks, "mark", marks.count(), MAX_LOG_BITS))
    of = items.where("size is not null").groupBy("size", "h0", "h1").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.md5(F.to_json("items").cast("binary")))
    of = written(of)
    seen = written(d.mapInArrow(_document_windows(shared, short), "doc long, dig long, n_words long, size int, start int, h0 long, h1 long"))
    # repeated rows have the same windows: one of each counts
    hits = seen.where("size is not null").join(of.select("size", "h0", "h1", "set"), ["size", "h0", "h1"])
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    per = hits.groupBy("doc", "dig").agg(spans.alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    grown = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")))
    per = written(per.select(F.col("doc").alias("of_doc"), F.col("dig").alias("of_dig"), grown["n"].alias("n_hit"), "sets", F.md5(F.array_join("sets", ",").cast("binary")).alias("mix")))
    named = per.select("mix", "sets").dropDuplicates(["mix"]).select("mix", F.explode("sets").alias("set")).join(of.select("set", "items").dropDuplicates(["set"]), "set")
    named = named.select("mix", F.explode("items").alias("item")).groupBy("mix").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"))
    named = named.select("mix", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    per = per.join(named, "mix", "left").select("of_doc", "of_dig", "n_hit", "n_items", "items_sha256")
    base = seen.where("n_words is not null").select("doc", "dig", "n_words")
    out = base.join(per, base.doc.eqNullSafe(per.of_doc) & (base.dig == per.of_dig), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *([F.col("dig").alias("digest")] if digest else []))


def op10_decontaminate(spark, sf_dir):
    """``contamination`` of all ``documents`` by all ``benchmark`` items; its handling of nulls, ties and repeats holds."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
dw AS (SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT r, m, k, item_id FROM dw JOIN iw USING (m, win)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS pos FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
