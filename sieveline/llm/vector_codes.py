"""Compression of vectors to product codes, the codebooks learned by filtering Lloyd rounds.

Vectors become integers and are cut into equal parts, each with a codebook of its own. Every task
builds a kd-tree per part over blocks of its vectors, once: the points in tree order, and for each
node its bounding box and the sum of its points. The trees are written as one row a block, so no
round builds them again, and a lost executor costs only the blocks that it was reading.

A round walks all nodes of a level together. Of the entries that can still own a point of a node,
the nearest to the box's middle is found, and every entry that is farther than it from the whole
box is ruled out (at equal distance the lower index wins, as for single points). Where one entry is
left the whole subtree is its own, and the node's sum and count stand for its points. Only points
in leaves with several entries left are measured one by one.

Arithmetic is exact: products are of integers, in doubles where those hold them all, else in longs.
What a round sends on is a sum per entry and task, aggregated by Spark; codebooks have at most 256
entries and reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 32
#: components in a block of vectors
BLOCK = 1 << 19
#: labels up to which their sums are sent to every task; beyond, they are joined by a shuffle
LABELS = 100_000


def _cuts(n: int) -> list[np.ndarray]:
    """Borders of the nodes on each level: halves of halves, down to at most ``LEAF`` points."""
    out, level = [], 0
    while True:
        out.append(n * np.arange((1 << level) + 1) >> level)
        if n <= LEAF << level:
            return out
        level += 1


class Tree:
    """A kd-tree over one part of a block: points in tree order, boxes and sums of the nodes by level."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.cuts = _cuts(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        cuts, order = _cuts(len(points)), np.arange(len(points))
        low, high, sums = [], [], []
        for level, edge in enumerate(cuts):
            own = points[order]
            low.append(np.minimum.reduceat(own, edge[:-1]))
            high.append(np.maximum.reduceat(own, edge[:-1]))
            sums.append(np.add.reduceat(own, edge[:-1], dtype=np.int64))
            if level + 1 < len(cuts):
                node = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
                widest = (high[-1].astype(np.int64) - low[-1]).argmax(1)
                order = order[np.lexsort((own[np.arange(len(own)), widest[node]], node))]
        return cls(points[order], order.astype(np.uint32), np.concatenate(low), np.concatenate(high), np.concatenate(sums))

    def assign(self, book: np.ndarray):
        """``(entry of each point in tree order, sum of the points of each entry, their count)``."""
        k = len(book)
        square = (book * book).sum(1)
        owner = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros((k, book.shape[1]), np.int64), np.zeros(k, np.int64)
        nodes, may, first = np.zeros(1, np.int64), np.ones((1, k), bool), 0
        far = np.inf if book.dtype == np.float64 else np.iinfo(np.int64).max
        for level, edge in enumerate(self.cuts):
            low, high = (x[first + nodes].astype(book.dtype) for x in (self.low, self.high))
            # twice the middle and twice the half width keep everything whole
            score = square - (low + high) @ book.T
            best = np.where(may, score, far).argmin(1)
            margin = score - score[np.arange(len(nodes)), best][:, None]
            for z in np.unique(best):
                own = best == z
                margin[own] -= (high[own] - low[own]) @ np.abs(book - book[z]).T
            may &= (margin < 0) | ((margin == 0) & (np.arange(k) <= best[:, None]))
            done = may.sum(1) == 1
            if done.any():
                # the entry nearest to the middle is never ruled out
                won, own = nodes[done], best[done]
                np.add.at(sums, own, self.sums[first + won])
                np.add.at(counts, own, edge[won + 1] - edge[won])
                for node, entry in zip(won.tolist(), own.tolist()):
                    owner[edge[node] : edge[node + 1]] = entry
            nodes, may = nodes[~done], may[~done]
            if not len(nodes):
                break
            if level + 1 < len(self.cuts):
                first += len(edge) - 1
                nodes, may = (np.repeat(x, 2, 0) for x in (nodes, may))
                nodes = 2 * nodes + np.tile([0, 1], len(nodes) // 2)
            else:
                size = edge[nodes + 1] - edge[nodes]
                at = np.repeat(edge[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
                own = self.points[at]
                near = np.where(np.repeat(may, size, 0), square - 2 * (own.astype(book.dtype) @ book.T), far).argmin(1)
                owner[at] = near
                np.add.at(sums, near, own.astype(np.int64))
                np.add.at(counts, near, 1)
        return owner, sums, counts


def _integers(vectors: pa.Array, dim: int) -> np.ndarray:
    whole = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(SCALE))
    most = float(np.abs(whole).max(initial=0))
    # a squared distance, and every sum on the way to it, must fit a long
    if 16.0 * dim * most * most >= 2.0**63:
        raise ValueError("components too large: squared distances would not fit a long")
    return whole.astype(np.int16 if most < 2**15 else np.int32)


_TREE = ("points", "tree_order", "low", "high", "sums")


def _blocks(dim: int, most: int, parts: int):
    """One row for each ``most`` vectors of a task: their ids and labels, and the trees of all parts."""

    def row(rows: pa.Table):
        x = _integers(rows.column("vector").combine_chunks(), dim)
        trees = [Tree.build(np.ascontiguousarray(p)) for p in np.split(x, parts, 1)]
        kinds = [pa.array([b"".join(np.ascontiguousarray(getattr(t, "order" if c == "tree_order" else c)).tobytes() for t in trees)], pa.binary()) for c in _TREE]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([x.dtype.itemsize], pa.int32()), *kinds], ["id", "label", "width", *_TREE])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                rows = pa.Table.from_batches(held)
                yield row(rows.slice(0, most))
                held, n = rows.slice(most).to_batches(), n - most
        if n:
            yield row(pa.Table.from_batches(held))

    return run


def _trees(r: dict, dim: int, parts: int) -> list[Tree]:
    n, width = len(r["id"]), {2: np.int16, 4: np.int32}[r["width"]]
    nodes = sum(len(c) - 1 for c in _cuts(n))
    shapes = {"points": (parts, n, dim // parts), "tree_order": (parts, n), **{c: (parts, nodes, dim // parts) for c in ("low", "high", "sums")}}
    types = {"points": width, "tree_order": np.uint32, "low": width, "high": width, "sums": np.int64}
    whole = [np.frombuffer(r[c], types[c]).reshape(shapes[c]) for c in _TREE]
    return [Tree(*(x[p] for x in whole)) for p in range(parts)]


def _exact(books: list[np.ndarray], trees: list[Tree]) -> type:
    """Doubles where all products and sums are whole numbers below 2^53, else longs."""
    most = max([1, *(int(np.abs(x.astype(np.int64)).max()) for x in (*books, *(y for t in trees for y in (t.low[:1], t.high[:1]))))])
    return np.float64 if 16 * books[0].shape[1] * most * most < 2**53 else np.int64


def _sums(books: list[np.ndarray], dim: int):
    def run(batches):
        total = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                trees = _trees(batch.slice(i, 1).to_pylist()[0], dim, len(books))
                kind = _exact(books, trees)
                for (s, n), tree, book in zip(total, trees, books):
                    _, sums, counts = tree.assign(book.astype(kind))
                    s += sums
                    n += counts
        part = np.repeat(np.arange(len(books)), [len(b) for b in books])
        entry = np.concatenate([np.arange(len(b)) for b in books])
        sums, n = np.concatenate([s for s, _ in total]), np.concatenate([n for _, n in total])
        on = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[on].astype(t)) for x, t in ((part, np.int32), (entry, np.int32), (n, np.int64))] + [pa.array(list(sums[on]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return run


def _codes(books: list[np.ndarray], dim: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                trees = _trees(batch.slice(i, 1).to_pylist()[0], dim, len(books))
                kind, error, code = _exact(books, trees), 0, []
                for tree, book in zip(trees, books):
                    owner = np.empty(len(tree.points), np.int64)
                    own = tree.assign(book.astype(kind))[0]
                    owner[tree.order] = own
                    gap = np.empty(len(owner), np.int64)
                    gap[tree.order] = ((tree.points.astype(np.int64) - book[own]) ** 2).sum(1)
                    error = error + gap
                    code.append(owner)
                code = ["".join(f"{x:02x}" for x in c) for c in np.stack(code, 1).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(c)[i].values for c in ("id", "label")] + [pa.array(code), pa.array(error)], ["id", "label", "code", "error"])

    return run


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of ``parts`` hexadecimal pairs for each vector, and how far they are from it.

    Returns one row per kept row: ``id_col, code, error, label_error, codebooks_sha256``, as the contract
    of ``op12_vector_codes`` has them. A component x counts as floor(1024 x).

    Dropped are rows whose vector is null, empty or holds a null or non-finite component, and those
    whose length is not that of the kept row with the smallest id; so are all where that length cannot be
    cut into equal parts. Rows without an id come last in the order that the first codebooks are
    taken from; rows that share an id, in the order of their vectors. With fewer vectors than
    ``entries`` the codebooks have as many entries as there are vectors. Rows with a null label are one
    group. Components so large that a squared distance would not fit a long raise an error. Empty
    input gives no rows. Other columns are not read.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    v = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    v = v.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    out = f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"
    order = [F.asc_nulls_last("id"), "vector"]
    head = v.orderBy(*order).limit(1).collect()
    dim = len(head[0].vector) if head else 0
    if not dim or dim % parts:
        none = spark.createDataFrame([], out + ", label_error long, codebooks_sha256 string")
        return none.drop("label").withColumnRenamed("id", id_col)
    v = v.where(F.size("vector") == dim)
    first = [r.vector for r in v.orderBy(*order).limit(entries).select("vector").collect()]
    books = [b.astype(np.int64) for b in np.split(_integers(pa.array(first), dim), parts, 1)]
    blocks = written(v.mapInArrow(_blocks(dim, max(1, BLOCK // dim), parts), f"id array<{kinds[id_col]}>, label array<{kinds[label_col]}>, width int, " + ", ".join(f"{c} binary" for c in _TREE)))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books, dim), "part int, entry int, n long, s array<long>")
        got = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim // parts)]).collect()
        books = [b.copy() for b in books]
        for r in got:
            books[r.part][r.entry] = np.array(r[3:], np.int64) // r.n
    coded = written(blocks.mapInArrow(_codes(books, dim), out))
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if per.count() <= LABELS:
        per = F.broadcast(per)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    both = coded.join(per, coded.label.eqNullSafe(per.of))
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir):
    """``product_codes`` of all ``embeddings``: 4 parts, 256 entries, 4 rounds; its handling of nulls, ties and repeats holds."""
    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The plain form: every part against every entry in each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT x.r, x.p, c.j, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{i} c USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, j, list(f ORDER BY k) AS v FROM (SELECT p, j, k, floor(sum(e) / count(*))::BIGINT AS f FROM (SELECT x.p, a.j, unnest(x.v) AS e, unnest(range(len(x.v))) AS k FROM x JOIN a{i} a USING (r, p)) GROUP BY p, j, k) GROUP BY p, j),
c{i + 1} AS (SELECT p, j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, j))""")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p)),
c0 AS (SELECT p, r - 1 AS j, v FROM x WHERE r <= {entries}),{",".join(steps)},
e AS (SELECT r, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN e USING (r)
"""


SQL = sql()
