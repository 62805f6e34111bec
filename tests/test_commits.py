"""Saves of tables: unchanged, broken, overtaken and pinned."""

import pytest
from pyspark.sql import functions as F

from sieveline.sources.commits import Change, Overtaken, Tables


def rows(spark, n=200, bump=()):
    return spark.range(n).select("id", F.when(F.col("id").isin(*bump, -1), "new").otherwise("old").alias("v"), F.array("id").alias("l"))


def got(df):
    return sorted((r.id, r.v) for r in df.collect())


def files(tmp_path):
    return sorted(str(p) for p in tmp_path.rglob("*.parquet"))


def test_only_changed_buckets_are_written(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    first = t.commit({"a": Change(rows(spark), ["id"], 8)})
    assert len(first["a"]) == 8 and got(t.read("a")) == got(rows(spark))
    before = files(tmp_path)
    assert t.commit({"a": Change(rows(spark).orderBy(F.desc("id")), ["id"], 8)}) == {"a": []}
    assert files(tmp_path) == before and t.state().version == 1
    assert len(t.commit({"a": Change(rows(spark, bump=(3,)), ["id"], 8)})["a"]) == 1
    assert got(t.read("a")) == got(rows(spark, bump=(3,))) and t.state().version == 2
    # a reader that holds a manifest sees what was there
    assert got(t.read("a", t.state(1))) == got(rows(spark))
    t.commit({"a": Change(rows(spark, 0), ["id"], 8)})
    assert got(t.read("a")) == [] and t.read("b") is None


def test_buckets_are_replaced_alone(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    t.commit({"a": Change(rows(spark), ["id"], 4)})
    part = t.read("a", only=[2])
    n = part.count()
    assert 0 < n < 200
    t.commit({"a": Change(part.withColumn("v", F.lit("x")), ["id"], 4, only=[2])})
    assert sum(v == "x" for _, v in got(t.read("a"))) == n and t.read("a").count() == 200


def test_broken_save_leaves_the_old_table(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    t.commit({"a": Change(rows(spark), ["id"]), "b": Change(rows(spark), ["id"])})
    bad = rows(spark, bump=(1, 2)).withColumn("v", F.when(F.col("id") == 199, F.raise_error(F.lit("disk full"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="disk full"):
        t.commit({"a": Change(rows(spark, bump=(5,)), ["id"]), "b": Change(bad, ["id"])})
    assert t.state().version == 1 and got(t.read("a")) == got(t.read("b")) == got(rows(spark))


def test_second_writer_is_told(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    t.commit({"a": Change(rows(spark), ["id"])})
    seen = t.state()
    t.commit({"a": Change(rows(spark, bump=(1,)), ["id"])}, seen)
    with pytest.raises(Overtaken):
        t.commit({"a": Change(rows(spark, bump=(2,)), ["id"])}, seen)
    assert got(t.read("a")) == got(rows(spark, bump=(1,))) and t.state().version == 2
