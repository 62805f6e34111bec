"""Sharding by extendible hashing.

Every document hashes to 60 bits. A directory node is a prefix of those bits; a node whose
documents exceed the byte limit splits on its next bit, and only such nodes do. The leaves
are the shards. Sizes are added up per cell (a prefix a few bits longer than the shards will
need) and the directory is worked out on that small table; only cells that are still too
large are counted again, a few bits deeper. No document moves before its shard is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import written

BITS = 60
#: bits worked out per pass beyond the depth the total size asks for
STEP = 6


def _prefix(h, depth):
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright({h}, {BITS} - {depth})")


def key_hash(doc_id) -> F.Column:
    """The first 60 bits of the md5 of the id as text, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(cells: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    """The leaves ``(depth, prefix, shard_bytes, shard_docs)`` over cells ``(h, b, n)``, and the least depth of them."""
    total = cells.agg(F.sum("b")).first()[0] or 0
    low, deep = 0, min(BITS, max(STEP, (total // max_bytes + 1).bit_length() + STEP))
    leaves, todo = None, cells
    while True:
        per = todo.groupBy(F.shiftright("h", BITS - deep).alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        nodes = written(
            per.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        )
        done = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") <= 1) | (F.col("depth") == BITS)
        ends = nodes.where(done)
        # an end is a leaf when its parent splits; the parent of the first level of a later pass always does
        up = nodes.where(~done).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaf = ends.join(up, (ends.depth == up.depth) & (F.shiftright(ends.prefix, 1) == up.parent), "left_semi")
        leaf = leaf.unionByName(ends.where(F.col("depth") == low)) if low == 0 else leaf
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        open_cells = nodes.where(~done & (F.col("depth") == deep)).select(F.col("prefix").alias("cell"))
        if deep == BITS or not open_cells.take(1):
            break
        todo = todo.join(open_cells, F.shiftright(todo.h, BITS - deep) == open_cells.cell, "left_semi")
        low, deep = deep, min(BITS, deep + STEP)
    leaves = written(leaves)
    return leaves, leaves.agg(F.min("depth")).first()[0] or 0


def sharded(docs: DataFrame, max_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", row: F.Column | None = None) -> DataFrame:
    """Each row of ``docs`` whole, as the struct ``row`` (or what ``row`` says), with its shard: ``row, n_bytes, shard, depth, shard_bytes, shard_docs, fits``.

    Only (hash, bytes) of each row are written and counted to work the directory out. The rows then
    meet it in one equi-join on the bits that all leaves have in common: an entry there lists the few
    leaves below it.
    """
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(id_col)).alias("h"))
    cells = written(rows.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
    leaves, least = _directory(cells, max_bytes)
    at = leaves.groupBy(F.expr(f"shiftright(prefix, depth - {least})").alias("at")).agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("leaves"))
    met = rows.join(at, F.shiftright(rows.h, BITS - least) == at["at"])
    own = F.filter("leaves", lambda x: F.call_function("shiftright", F.col("h"), F.lit(BITS) - x["depth"]) == x["prefix"])[0]
    out = met.select("row", "n_bytes", own.alias("leaf"))
    return out.select(
        "row", "n_bytes",
        F.expr("if(leaf.depth = 0, '', lpad(conv(cast(leaf.prefix as string), 10, 2), leaf.depth, '0'))").alias("shard"),
        F.col("leaf.depth").cast("int").alias("depth"), "leaf.shard_bytes", "leaf.shard_docs", (F.col("leaf.shard_bytes") <= max_bytes).alias("fits"))


def extendible_shards(docs: DataFrame, max_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign each row to a shard of at most ``max_bytes`` bytes of UTF-8 text.

    Returns one row per input row: ``id_col, n_bytes, shard`` (the bit prefix as text, empty for
    a directory of depth 0)``, depth, shard_bytes, shard_docs, fits``. A shard splits while it
    is over the limit and holds more than one document; a single document above the limit has a
    shard of its own with ``fits`` false. Rows that share an id share all bits, so they stay
    together; such a shard stops at depth 60 with ``fits`` false. Null text has 0 bytes, a null
    id hashes as the empty string. Other columns are not read. Empty input gives no rows.
    """
    out = sharded(docs, max_bytes, id_col, text_col, F.col(id_col))
    return out.select(F.col("row").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "fits")


def write_shards(docs: DataFrame, path: str, max_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "_shard") -> None:
    """Write ``docs`` as one folder per shard, ``<shard_col>=<bits>``; rows of a shard meet in the task that writes it.

    Columns stay as they are; ``shard_col`` must not be one of them.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the table has a column {shard_col}; choose another shard_col")
    out = sharded(docs, max_bytes, id_col, text_col).select("row.*", F.col("shard").alias(shard_col))
    out.repartition(shard_col).write.partitionBy(shard_col).parquet(path)


def op4_extendible_sharding(spark, sf_dir):
    """``extendible_shards`` of all ``documents``; its handling of nulls, ties and repeats holds."""
    return extendible_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(source: str = "documents", max_bytes: int = 1 << 20) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {source}),
p AS (SELECT d.*, g.depth, h >> (60 - g.depth) AS prefix FROM d, (SELECT unnest(range(0, 61))::INTEGER AS depth) g),
n AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
e AS (SELECT * FROM n WHERE shard_bytes <= {max_bytes} OR shard_docs <= 1 OR depth = 60),
l AS (SELECT p.*, e.shard_bytes, e.shard_docs, row_number() OVER (PARTITION BY p.h, p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN e USING (depth, prefix))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, depth,
       shard_bytes, shard_docs, shard_bytes <= {max_bytes} AS fits
FROM l WHERE k = 1
"""


SQL = sql()
