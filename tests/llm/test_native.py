"""Operators that SQL can express against it over the small tables; edge cases of exact de-duplication, sharding and mixing."""

import hashlib

import duckdb
import pytest

from helpers import EDGE, SF, edge, empty
from sieveline.llm import decontaminate, exact_dedup, mixing, near_dedup, sharding
from test_catalogue import compare


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("query, sql", [(exact_dedup.op2_exact_dedup, exact_dedup.SQL), (sharding.op4_extendible_sharding, sharding.SQL), (mixing.op5_source_mixing, mixing.SQL), (near_dedup.op9_near_dedup, near_dedup.SQL), (decontaminate.op10_decontaminate, decontaminate.SQL)])
def test_sql(spark, con, query, sql):
    compare(query(spark, SF), con, sql)


@pytest.mark.parametrize("limit", [100_000, 20_000])
def test_small_shards_sql(spark, con, limit):
    compare(sharding.extendible_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit), con, sharding.sql(max_bytes=limit))


def test_exact_edge(spark):
    got = exact_dedup.exact_groups(edge(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].text_sha256 == by[2].text_sha256 == hashlib.sha256(b"").hexdigest() and by[1].group_size == 3
    assert (by[4].keep_id, by[4].kept, by[4].group_size) == (5, False, 3) and by[5].kept
    assert by[8].kept and not by[7].kept and by[6].group_size == 1
    assert [r.keep_id for r in got if r.doc_id is None and r.group_size == 2] == [15]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_shard_edge(spark):
    got = sharding.extendible_shards(edge(spark), 1000).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert r.fits == (r.shard_bytes <= 1000) and len(r.shard) == r.depth
        assert r.fits or r.shard_docs == 1 or r.depth == 60
    # prefixes of leaves never contain one another
    leaves = {r.shard for r in got}
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)
    assert sharding.extendible_shards(empty(spark)).count() == 0


def test_shards_written(spark, tmp_path):
    docs = edge(spark, [(i, "t" * 50) for i in range(60)])
    sharding.write_shards(docs, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 60 and back.groupBy("_shard").count().agg({"count": "max"}).first()[0] <= 20


def test_mix_edge(spark):
    got = mixing.mix(edge(spark)).collect()
    assert len(got) == len(EDGE)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.first_position is None) == (r.copies == 0)
        s = per.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        assert r.target <= 2 * r.source_size
    for (size, target), (taken, _) in per.items():
        assert abs(taken - target) <= 1
    assert abs(sum(t for _, t in per) - 1.5 * sum(s for s, _ in per)) < 1e-6
    assert sorted(map(tuple, mixing.mix(edge(spark).repartition(7)).select("doc_id", "taken").na.fill(-1).collect())) == sorted((r.doc_id if r.doc_id is not None else -1, r.taken) for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(edge(spark, [(1, None), (2, "")])).select("taken").distinct().collect()[0][0] == 0


def test_water_filling(spark):
    """Against the rounds of the definition: cap, reshare, repeat."""
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 0, None: 70}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * sizes[k]]
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            free.discard(k)
    assert all(abs(got[k] - target[k]) < 1e-9 for k in sizes)


def test_positions_follow_schedule(spark):
    """Positions invert the integral of the schedule."""
    for knots in mixing.SCHEDULES.values():
        us = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(u,) for u in us], "u double")
        from pyspark.sql import functions as F

        ts = [r[0] for r in df.orderBy("u").select(mixing.position(F.col("u"), knots)).collect()]
        area = lambda t: sum((min(t, b) - a) * (wa + (wa + (wb - wa) * (min(t, b) - a) / (b - a))) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
        assert all(abs(area(t) / area(1.0) - u) < 1e-9 for u, t in zip(us, ts)) and ts == sorted(ts)


def test_training_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_main_paths_are_native(spark):
    from sieveline.llm import pii

    for q in (exact_dedup.op2_exact_dedup, sharding.op4_extendible_sharding, mixing.op5_source_mixing, pii.op3_pii):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
