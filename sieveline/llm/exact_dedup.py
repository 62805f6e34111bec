"""Exact de-duplication: group by a 128-bit content hash, compare bytes inside each group.

Plan at scale: one shuffle of texts, pre-aggregated in the map tasks, so a text copied a
billion times arrives once per map task. Rows then find their group by hash alone, in a join
of ~100-byte rows that adaptive execution may split when one hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None) -> DataFrame:
    """Label every row with the group of rows that have the same text.

    Parameters: ``keep`` is ``max`` or ``min``, the end of the id order that stays;
    ``normalise`` an optional Column -> Column function applied first (default: no change).

    Returns one row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Rows with a null id take part and are kept only if their whole
    group has null ids. Rows repeating both id and text are one document: all of them are kept
    or none. Empty input gives no rows; other columns of the input are not read.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("t"))
    rows = rows.select("id", "t", F.md5("t").alias("h"), F.sha2("t", 256).alias("s"))
    end = F.max if keep == "max" else F.min
    # grouping by the text itself is the byte comparison; the 128-bit hash only names the group
    same = rows.groupBy("h", "t").agg(end("id").alias("keep_id"), F.count("*").alias("group_size"))
    # texts that collide in the 128-bit hash are groups of their own, told apart by the second digest
    groups = same.select("h", F.sha2("t", 256).alias("s"), "keep_id", "group_size")
    return rows.select("id", "h", "s").join(groups, ["h", "s"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256")
    )


def op2_exact_dedup(spark, sf_dir):
    """``exact_groups`` over all ``documents``: whole texts, no change first, the largest id stays; its handling of nulls, ties and repeats holds."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
