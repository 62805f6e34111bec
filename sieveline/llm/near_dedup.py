"""Near-duplicate components by a chosen-path set similarity join over minwise tokens.

Documents are sets of 5-word shingles; equal sets collapse into one class first. Each class has
64 minwise tokens. In each of ``trees`` independent trees a node picks one token position (and
a second one with probability 1 / threshold - 1) and deals its documents to one child per token
value, so dissimilar documents part quickly while a pair at the threshold is expected to share
one child. Small nodes (at most ``leaf`` documents and ``weight`` shingles) are compared
exhaustively; only larger ones branch. A large node at the top of a tree is also cut into blocks
that each hold the node's hub, the document whose tokens are most common in it: in a large group
of near copies that is the text they come from, and every link to it is met.

Branching ends at the depth to which a pair at the threshold shares a node of some tree with
probability ``RECALL``, whatever the group's size. What is still large there is compared in full: of
the components known by then, the node's largest keeps its inner pairs unread (they change nothing),
and every other member meets every member, block against block.

Leaves give candidate links by agreement of 8 bits per token, set five standard deviations below the threshold.
Small components of candidates are then compared pair by pair on their full sets; larger
components are compared leaf by leaf, over all trees. Only links confirmed on full sets enter the
result. What reaches a task as one group is bounded by ``leaf`` and ``weight``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textops import grams, mix64, sub_batches, words_of
from sieveline.operators.components import connected_components
from sieveline.session import written

TOKENS = 64
SHINGLE = 5
#: no node is deeper; ``branching_ends`` is reached before at the thresholds in use
MAX_DEPTH = 40
#: least probability that a pair at the threshold shares a leaf or an end node of some tree
RECALL = 0.99999
#: so many ids of large components, of 8 bytes each, are broadcast; more are joined by shuffle
FEW = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(1 << 63, size=TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1 << 63, size=TOKENS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text; a text of fewer words is one shingle, none is empty."""
    w = words_of(texts)
    h = w.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(w.first, w.first[1:]):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(mix64(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, from its hashes in order."""
    with np.errstate(over="ignore"):
        order = np.arange(1, len(s) + 1, dtype=np.uint64)
        return int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)), int(mix64(s + order * np.uint64(0x14057B7EF767814F)).sum().view(np.int64))


def _signatures(batches):
    for batch in batches:
        for rows, texts in sub_batches(batch, "text"):
            sets = shingle_sets(texts)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), TOKENS), np.int16)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                for t in range(TOKENS):
                    sig[some, t] = (mix64(np.minimum.reduceat(flat * _MUL[t] + _ADD[t], at)) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            d = [_digest(s) for s in sets]
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, TOKENS), pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc")[rows], pa.array(sizes), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), tokens, pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["doc", "n", "d1", "d2", "sig", "marks"])


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index it is connected to."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(least: int):
    """Groups of a leaf whose members agree (by 8 bits each) in ``least`` tokens or more, directly or through others."""

    def run(batches):
        for batch in batches:
            paths, out = batch.column("path").to_pylist(), ([], [], [])
            for path, members in zip(paths, batch.column("members")):
                ids = members.values.field("rep").to_numpy()
                sig = np.frombuffer(b"".join(members.values.field("marks").to_pylist()), np.uint8).reshape(len(ids), TOKENS)
                order = np.argsort(ids)
                ids, sig = ids[order], sig[order]
                if len(ids) <= 64:
                    agree = (sig[:, None, :] == sig[None, :, :]).sum(2)
                else:
                    agree = np.zeros((len(ids), len(ids)), np.int16)
                    for t in range(TOKENS):
                        agree += sig[:, t][:, None] == sig[:, t][None, :]
                root = _roots(agree >= least)
                for r in np.flatnonzero(np.bincount(root, minlength=len(ids)) > 1):
                    own = np.flatnonzero(root == r)
                    gid = int(mix64(np.array([np.uint64(path & (2**64 - 1)) ^ np.uint64(int(r) + 1)]))[0].view(np.int64))
                    out[0].extend([gid] * len(own)), out[1].extend(ids[own].tolist()), out[2].extend([int(ids[r])] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["gid", "rep", "low"])

    return run


def _sets(batches):
    """A row for each group of a class with its set, where the text is the class's."""
    for batch in batches:
        for rows, texts in sub_batches(batch, "text"):
            out = ([], [], [])
            gids, d1, d2, rep = (batch.column(c)[rows].to_pylist() for c in ("gids", "d1", "d2", "rep"))
            for i, s in enumerate(shingle_sets(texts)):
                if _digest(s) == (d1[i], d2[i]):
                    body = s.tobytes()
                    for g in gids[i]:
                        out[0].append(g), out[1].append(rep[i]), out[2].append(body)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["gid", "rep", "body"])


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, from an incidence matrix in column blocks."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(inverse, kind="stable")
    col, row = inverse[order], row[order]
    # shingles of one set alone meet nothing
    shared = np.bincount(col)[col] > 1
    col, row = np.unique(col[shared], return_inverse=True)[1], row[shared]
    both = np.zeros((m, m), np.float32)
    width = max(1, (1 << 22) // m)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        block = np.zeros((m, width), np.float32)
        block[row[lo:hi], col[lo:hi] - a] = 1
        both += block @ block.T
    inter = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    return 100 * inter >= percent * union


def recall(percent: int, trees: int, depth: int) -> float:
    """Probability that a pair at the threshold shares a node of this depth in some tree, over the agreement of its tokens."""
    j = percent / 100
    extra = max(1, round((1 / j - 1) * 1000)) / 1000
    missed = 0.0
    for k in range(TOKENS + 1):
        a, stays = k / TOKENS, 1.0
        for _ in range(depth - 1):
            stays = (1 - extra) * a * stays + extra * (1 - (1 - a * stays) ** 2)
        missed += math.comb(TOKENS, k) * j**k * (1 - j) ** (TOKENS - k) * (1 - a * stays) ** trees
    return 1 - missed


def branching_ends(percent: int, trees: int) -> int:
    """The last depth with ``RECALL``; 1 where no depth has it."""
    depth = 1
    while depth < MAX_DEPTH and recall(percent, trees, depth + 1) >= RECALL:
        depth += 1
    return depth


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        order = np.argsort(ids)
        bodies = table.column("body").to_pylist()
        sets = [np.frombuffer(bodies[i], np.uint64) for i in order]
        ids = ids[order]
        links = exact_links(sets, percent)
        root = _roots(links)
        own = root != np.arange(len(ids))
        return pa.table({"src": pa.array(ids[own], pa.int64()), "dst": pa.array(ids[root[own]], pa.int64())})

    return run


def near_components(docs: DataFrame, percent: int = 80, trees: int = 16, leaf: int = 2048, weight: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= ``percent`` * union of shingle sets.

    Returns one row per input row: ``id_col, n_shingles, component_id`` (smallest id reachable)``,
    kept`` (the row is the one of that id).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts without words, null ones too,
    have empty sets and link with nothing. Rows that share an id are one node of the graph. A row
    without an id keeps a null component and links nothing. Empty input gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    s = written(rows.select("doc", "text").mapInArrow(_signatures, "doc long, n long, d1 long, d2 long, sig array<short>, marks binary"))
    classes = written(s.where("n > 0 and doc is not null").groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig"), F.first("marks").alias("marks")))

    # an id may stand for several classes; they are one node, but each class is dealt by itself
    j = percent / 100
    extra = max(1, round((1 / j - 1) * 1000))
    by_cls = classes.select(F.xxhash64("d1", "d2").alias("cls"), "n", "sig", "marks")
    frontier = by_cls.select("cls", "n", F.posexplode(F.slice("sig", 1, trees)).alias("tree", "v")).select("cls", "n", "tree", F.xxhash64("tree", "v").alias("path"))
    small = (F.col("size") <= leaf) & (F.col("weight") <= weight)
    blocks_of = F.ceil(F.greatest(F.col("size") * 2 / leaf, F.col("weight") * 2 / weight))
    leaves, depth, last, ends = [], 1, branching_ends(percent, trees), None
    while True:
        sizes = frontier.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
        sized = written(frontier.join(sizes, "path"))
        leaves.append(sized.where(small).select("cls", "path"))
        large = sized.where(~small)
        if not large.take(1):
            break
        if depth in (1, last):
            # blocks around the hub: at the top, and where branching ends
            common = sized.groupBy("cls").agg(F.sum("size").alias("common"))
            top = large.where("tree < 4") if depth < last else large
            block = F.pmod(F.xxhash64("cls"), blocks_of)
            hubs = top.join(common, "cls").groupBy("path").agg(F.max_by("cls", F.struct("common", "cls")).alias("cls"), F.max(blocks_of).alias("blocks"))
            hubs = hubs.select("cls", "path", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            cut = top.select("cls", "path", block.alias("block")).unionByName(hubs)
            leaves.append(cut.select("cls", F.xxhash64("path", "block").alias("path")).distinct())
        if depth == last:
            ends = large.select("cls", "n", "path")
            break
        # one token position per node, sometimes two; both follow from the node's path alone
        first = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(TOKENS))
        second = F.when(F.pmod(F.xxhash64("path", F.lit(-depth)), F.lit(1000)) < extra, F.pmod(first + 1 + F.pmod(F.hash("path"), F.lit(TOKENS - 1)), F.lit(TOKENS)))
        picks = F.array_compact(F.array(first, second))
        frontier = (
            large.select("cls", "n", "tree", "path").join(by_cls.select("cls", "sig"), "cls").withColumn("i", F.explode(picks))
            .select("cls", "n", "tree", F.xxhash64("path", "i", F.expr("element_at(sig, cast(i + 1 as int))")).alias("path"))
        )
        depth += 1

    def confirmed(members: DataFrame) -> DataFrame:
        # trees often end in leaves of the same documents: one of each is enough
        alike = members.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("b"))
        members = members.join(alike.groupBy("n", "a", "b").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")
        members = members.join(by_cls.select("cls", "marks"), "cls").select("path", F.struct(F.col("cls").alias("rep"), "marks").alias("m"))
        least = math.floor(TOKENS * j - 5 * math.sqrt(TOKENS * j * (1 - j)))
        groups = members.groupBy("path").agg(F.collect_list("m").alias("members")).mapInArrow(_candidates(least), "gid long, rep long, low long")
        groups = written(groups)
        coarse = connected_components(groups, "rep", "low")
        coarse = written(coarse)
        heavy = coarse.join(by_cls.select(F.col("cls").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
        # components above a leaf are few (nodes / leaf at most): rows need no exchange by component, in which a large one is one task
        large = written(heavy.where(~small).select("component"))
        large = F.broadcast(large) if large.count() <= FEW else large
        in_small = coarse.join(large, "component", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("gid"))
        in_large = groups.join(coarse.join(large, "component", "left_semi").select(F.col("node").alias("rep")), "rep", "left_semi").select("rep", "gid")
        # leaves of several trees often hold the same documents: one of each is enough
        same = in_large.groupBy("gid").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("b"))
        once = same.groupBy("n", "a", "b").agg(F.min("gid").alias("gid")).select("gid")
        wanted = in_small.unionByName(in_large.join(once, "gid", "left_semi")).groupBy("rep").agg(F.collect_set("gid").alias("gids"))
        wanted = wanted.join(classes.select(F.xxhash64("d1", "d2").alias("cls"), "d1", "d2", F.col("rep").alias("doc")), F.col("rep") == F.col("cls")).select("doc", "d1", "d2", "gids")
        sets = rows.join(wanted, "doc").select("text", "gids", "d1", "d2", F.col("doc").alias("rep")).mapInArrow(_sets, "gid long, rep long, body binary").dropDuplicates(["gid", "rep", "body"])
        return sets.groupBy("gid").applyInArrow(_confirm(percent), "src long, dst long")

    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    # classes under one id are the same node
    named = s.where("n > 0 and doc is not null")
    several = named.groupBy("doc").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc")
    own = named.join(several, "doc", "left_semi").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc <> rep")
    own = own.select(F.col("doc").alias("src"), F.col("rep").alias("dst"))
    links = confirmed(members).unionByName(own)
    if ends is not None:
        links = written(links)
        known = classes.join(connected_components(links), F.col("rep") == F.col("node"), "left").select(F.xxhash64("d1", "d2").alias("cls"), F.coalesce("component", "rep").alias("component"))
        ends = written(ends.join(known, "cls"))
        most = ends.groupBy("path", "component").agg(F.count("*").alias("size")).groupBy("path").agg(F.max_by("component", F.struct("size", "component")).alias("most"))
        other = ends.join(most, "path").where("component <> most").select("cls", "n", "path")
        blocks = lambda d, name: d.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).select("path", blocks_of.alias(name))
        # every block of the others meets every block of the node
        dealt = blocks(other, "n_other").join(blocks(ends, "n_all"), "path")
        pair = F.xxhash64("path", F.lit("other"), "a", "b").alias("path")
        of = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        left = other.join(dealt, "path").select("cls", "path", of("n_other").alias("a"), each("n_all").alias("b"))
        right = ends.join(dealt, "path").select("cls", "path", each("n_other").alias("a"), of("n_all").alias("b"))
        links = links.unionByName(confirmed(left.unionByName(right).select("cls", pair).distinct()))
    parts = connected_components(links)
    labels = classes.join(parts, classes.rep == parts.node, "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = s.join(labels, ["d1", "d2", "n"], "left").select("doc", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_near_dedup(spark, sf_dir):
    """``near_components`` of all ``documents`` at 85 %; its handling of nulls, ties and repeats holds."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


#: all pairs that share a shingle: for small tables
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n - shared)), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.id, g.b FROM r JOIN g ON r.reach = g.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id
"""
