"""Entities taken in batch by batch against resolution and merge of all rows at once."""

import random

from pyspark.sql import functions as F

from sieveline.operators import entities
from sieveline.operators.incremental import EntityStore, finished, fold, row_states

SCHEMA = "id long, keys array<string>, name string, city string, score long, score_label string, subscribers long, monetized boolean, status string, next_follow_up_at string, emails array<string>, tags array<string>"


def make(n, seed, hot=0):
    rng = random.Random(seed)
    pick = rng.choice
    out = []
    for i in rng.sample(range(1000), n):
        keys = [f"k{rng.randrange(2 * n)}" for _ in range(pick([0, 1, 1, 2, 3]))] + (["hot"] if rng.random() < hot else [])
        out.append((i, keys, pick(["", None, f"n{i}"]), pick(["", f"c{i}"]), pick([None, i % 7]), f"l{i}", pick([None, i]), pick([None, True, False]), pick(["new", "won", "contacted", "unsubscribed", "replied"]), pick([None, f"2024-{i:04d}"]), pick([None, [f"A{i % 9}@x.fr", "", f"b{i % 5}@x.fr"], []]), pick([None, ["t", f"g{i % 3}"]])))
    return out


def flat(df):
    return sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in df.collect())


def at_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.col("id"))
    parts = entities.resolve(df, "id", "keys").withColumnRenamed("id", "i")
    return entities.merge(df.join(parts, F.col("id") == F.col("i")).drop("i", "keys"))


def test_batches_equal_all_rows_at_once(spark, tmp_path):
    """One key is held by a quarter of the rows; the second batch is one row."""
    rows = make(160, 2, 0.25)
    store = EntityStore(spark, f"file://{tmp_path}/s", 4)
    cuts = [0, 60, 61, 160]
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        got = store.upsert(spark.createDataFrame(rows[a:b], SCHEMA).withColumn("seq", F.col("id")), f"b{a}")
        assert got["created"] + got["merged"] == b - a
        total = got["total"]
        # what a batch reads of the stored entities is what it touches
        assert got["entities_read"] <= got["keys_read"]
    want, have = at_once(spark, rows), store.entities()
    assert sorted(have.columns) == sorted(want.columns)
    assert flat(have) == flat(want) and total == want.count()
    assert store.upsert(spark.createDataFrame(rows[:5], SCHEMA).withColumn("seq", F.col("id")), "b0") == {}


def test_small_batch_touches_little(spark, tmp_path):
    rows = [(i, [f"k{i}"], f"n{i}", "", None, None, None, None, "new", None, None, None) for i in range(300)]
    store = EntityStore(spark, f"file://{tmp_path}/s", 16)
    store.upsert(spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.col("id")), "all")
    bridge = [(1000, ["k7", "k9"], "x", "town", 3, "l", None, None, "won", None, None, None)]
    got = store.upsert(spark.createDataFrame(bridge, SCHEMA).withColumn("seq", F.col("id")), "bridge")
    assert (got["created"], got["merged"], got["total"]) == (0, 1, 299)
    assert got["keys_read"] == 2 and got["entities_read"] == 2 and got["buckets_written"] <= 3
    r = store.entities().where("component = 7").first()
    assert (r.n_rows, r.name, r.city, r.status, r.score_label) == (3, "n7", "town", "won", "l")


def test_fold_is_merge(spark):
    rows = make(120, 9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.col("id")).drop("keys").withColumn("component", F.col("id") % 10)
    halves = fold(row_states(df.where("id % 3 = 0"), F.col("component"))).unionByName(fold(row_states(df.where("id % 3 <> 0"), F.col("component"))))
    assert flat(finished(fold(halves))) == flat(entities.merge(df.drop("id")))
