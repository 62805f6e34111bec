"""The pipeline's stages on planted documents, and end to end."""

import random

import pytest

import corpus_pipeline
from helpers import EDGE, SF, components
from sieveline.llm import sharding


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = "the of and to in is that for with as on by this from at it was are be or".split()
    prose = lambda n: " ".join(rnd.choice(vocabulary) + (rnd.choice("abcdefgh") * (rnd.random() < 0.5)) for _ in range(n)) + "."
    item = prose(40)
    rows = [(i, prose(80), "en", f"s{i % 5}", 0) for i in range(200)]
    rows += [(1000, rows[3][1] + " extra", "en", "s1", 0), (1001, prose(20) + item + prose(20), "en", "s2", 0), (1002, "BUY!! NOW!! CHEAP!! " * 60, "en", "s3", 0)]
    rows += [(3, rows[3][1], "en", "s3", 0), (None, prose(50), "en", None, 0)]
    s = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, s).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, gone = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == columns
        gone.append(before - {r.doc_id for r in docs.collect()})
    assert 1002 in gone[0] and gone[1] == {1000} and gone[2] == {1001}
    assert len(gone[0]) <= 8
    assert spark.read.parquet(f"{tmp_path}/stage1").where("doc_id = 3").count() == 1
    assert spark.read.parquet(f"{tmp_path}/stage2").where("doc_id is null").count() == 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count()


def odd(spark, path, rows):
    """A table with clashing columns under ``path``, read again, and the other tables the stages want."""
    s = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, at string, shard string, of long, gone boolean, kept string, __x map<string,string>, __place string, place string, nested map<string,map<string,int>>"
    full = [(i, t, "en", ["a", None, "b"][k % 3], 0, "r", "i", "z", "s", 1, True, "k", {"a": "b"}, "p", "q", {"a": {"b": 1}}) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, s).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "nothing that any text holds in ten words or more than that"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark, tmp_path / "a", EDGE)
    got = stage(spark, docs, str(tmp_path / "a"))
    if name == "sharding":
        assert got.count() == len(EDGE) and got.select("row.*").columns == docs.columns and got.where("place is null").count() == 0
    else:
        assert got.columns == docs.columns
        texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect())
        before = sorted((i if i is not None else -1, t or "") for i, t in EDGE)
        if name in ("quality", "decontamination"):
            assert set(texts) <= set(before) and len(texts) >= len(before) - 8
            assert name == "quality" or texts == before
        if name == "near_dedup":
            want = components([(d, t) for d, t in EDGE if d is not None], 80)
            assert {i for i, _ in texts if i >= 0} == {d for d in want if want[d] == d} and sum(i < 0 for i, _ in texts) == 2
    none = odd(spark, tmp_path / "b", [])
    assert stage(spark, none, str(tmp_path / "b")).count() == 0


def test_repeated_rows_are_chosen(spark, tmp_path):
    """Of rows that repeat id and text, the smallest by the other columns stays; rows without an id all do."""
    rows = [(1, "a b c d e f", "fr", "z", 1), (1, "a b c d e f", "en", "y", 1), (1, "other words of this id here", "en", "x", 1), (None, "q", "en", "x", 1), (None, "q", "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows[1:]))


def test_repeated_rows_with_maps(spark):
    """A map counts as its sorted entries; of 26 repeated rows the smallest stays, however they lie."""
    kind = "doc_id long, text string, m map<string,string>, lang string"
    rows = [(1, "one two three four five six", {"k": "v", c: c}, "en") for c in "zyxwvutsrqponmlkjihgfedcba"]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, kind).repartition(parts)
        got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
        assert [r.m for r in got] == [{"a": "a", "k": "v"}]


def test_decontamination_without_ids(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    docs = odd(spark, tmp_path, [(None, "a clean text of no id"), (None, "x " + item), (1, item), (1, "clean but of the same id"), (2, "clean")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["a clean text of no id", "clean"]


def test_shards_keep_training_order(spark, tmp_path):
    """Inside a shard rows stand as the mix ordered them, copies apart by their place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mixing_stage(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.sharding_stage(spark, mixed, SF)
    rows = got.collect()
    assert len(rows) == mixed.count() == len({r.place for r in rows}) and all(r.row.text is not None for r in rows)
    order = {}
    for r in rows:
        assert order.get(r.shard, "") < r.place
        order[r.shard] = r.place


def test_shards_of_a_table_without_files(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.place, r.row.text) for r in corpus_pipeline.sharding_stage(spark, docs, "").orderBy("doc_id").collect()] == [(1, None, "a"), (2, None, None)]


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "shard"} <= set(out.columns)


def test_queries_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in q} and "pipeline" in q
    sql = __spark_entry__.oracle_sql()
    assert sharding.SQL in sql.values() and set(sql) <= set(q) and all(isinstance(x, str) for x in sql.values())
