"""A training-corpus pipeline of five of the numbered operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept; what it
returns is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, mixing, near_dedup, on_workers, quality, sharding
from sieveline.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects as junk or toxic go.

    Each row is judged by its own whole text: null and empty texts as a document without words (they
    stay), repeated rows alike, rows without an id like others. All columns pass through as they are,
    whatever their names. An empty table stays empty.
    """
    on_workers(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _comparable(field) -> Column:
    """A column by which rows can be ordered: a map by its sorted entries, what has maps inside by its JSON."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if "map<" not in kind.simpleString():
        return c
    flat = kind.typeName() == "map" and "map<" not in kind.keyType.simpleString() + kind.valueType.simpleString()
    return F.array_sort(F.map_entries(c)) if flat else F.to_json(F.struct(c))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (similarity 0.8) the smallest id stays; of rows that repeat id and text, one.

    Of such repeated rows the smallest by the other columns, in their order, stays (maps count as their
    sorted entries). Rows with one id and different texts are one document: they stay or go together.
    Rows without an id, and texts without words, null ones too, are linked with nothing and stay. All
    columns pass through. An empty table stays empty.
    """
    on_workers(spark)
    kept = near_dedup.near_components(docs)
    fate = written(kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.bool_or(~F.col("kept")).alias("gone"), (F.count("*") > 1).alias("many")).where("gone or many"))
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    rows = rows.join(fate.where("gone").select("of"), rows["doc_id"] == F.col("of"), "left_anti")
    many = fate.where("many and not gone").select("of")
    single = rows.join(many, rows["doc_id"] == F.col("of"), "left_anti").select("row.*")
    again = rows.join(many, rows["doc_id"] == F.col("of"), "left_semi").select("row.*")
    # null sorts first
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    rank = F.struct(F.lit(0), *[_comparable(f) for f in others])
    one = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(F.lit(0), *[F.col(f"`{f.name}`") for f in others]), rank).alias("r"))
    one = one.select(*[F.col(c) if c in ("doc_id", "text") else F.col("r")[c].alias(c) for c in docs.columns])
    return single.unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of 10 words (or a whole shorter item) with a benchmark item go.

    Rows that share an id go together if one of them is hit. A row without an id is judged by itself;
    texts without words, null ones too, stay. All columns pass through, repeated rows too. No items or
    an empty table change nothing.
    """
    on_workers(spark)
    hit = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), digest=True).where("contaminated").select(F.col("doc_id").alias("of"), "digest")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("dig"), F.struct("*").alias("row"))
    named = rows.where("id is not null").join(hit.select("of").distinct(), rows["id"] == F.col("of"), "left_anti")
    nameless = rows.where("id is null").join(hit.where("of is null").select("digest").distinct(), rows["dig"] == F.col("digest"), "left_anti")
    return named.select("row.*").unionByName(nameless.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it, in training order: files in order, and rows in them.

    Documents without words, null and empty texts too, leave; a document at the target's border stays
    whole. Rows that share an id are taken as often as the most taken of them, likewise rows without an
    id. A null source is a source of its own. All columns pass through, whatever their names. An empty
    table stays empty.
    """
    return mixing.training_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row whole with its shard, of at most 1 MiB of text where one document allows it, in training order inside its shard.

    Returns ``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits, place`` and ``row``, the document with all
    its columns. ``place`` is the row's training position, the file and row that the stage before wrote
    it to (null for tables that are not read from files). Copies of a document, and rows that share an id,
    share a shard; null text has 0 bytes. An empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        placed = docs.select(row, F.concat_ws(":", "_metadata.file_name", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")).alias("place"))
    except AnalysisException:
        placed = docs.select(row, F.lit(None).cast("string").alias("place"))
    out = sharding.sharded(placed.select("row", "place", "row.doc_id", "row.text"), row=F.struct("row", "doc_id", "place"))
    out = out.select("row.doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "fits", "row.place", F.col("row.row").alias("row"))
    return out.repartition("shard").sortWithinPartitions("shard", "place")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: the first two stages and the third are no SQL; tests/llm hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
