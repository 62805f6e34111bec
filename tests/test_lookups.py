"""Lookups against plain Python: suffixes, phrases, radius, versions; windows of hot groups."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.functions import contact, dims, score
from sieveline.operators import lookups, selection
from sieveline.plans.lookup_queries import QUERIES


def test_suffix_list_says_what_the_alternation_says(spark):
    hosts = [d for x in dims.PLATFORM_DOMAINS[:40] for d in (x, "a." + x, "www." + x, "not" + x, x + ".fr", "A." + x.upper())] + ["", ".", "..", "firm.fr", "a..b", None]
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(hosts)] * 2, "host string, listed_before int")
    known = spark.createDataFrame([(d,) for d in dims.PLATFORM_DOMAINS] + [(None,), ("",)], "domain string")
    for small in (10**6, 0):
        got = lookups.on_list(rows, "host", known, small=small).select("*", contact.is_platform(F.col("host")).alias("want")).collect()
        assert len(got) == 2 * len(hosts)
        assert all((r.listed is not None) == r.want for r in got if r.host), [r for r in got if r.host and (r.listed is not None) != r.want]
    exact = lookups.on_list(rows, "host", spark.createDataFrame([("firm.fr",), ("b.c",)], "domain string"), exact=True).where("listed is not null").collect()
    assert {r.host for r in exact} == {"firm.fr"}


def test_phrases_leftmost_longest(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for i in range(40)] + [(None, "a b a b"), (1, "c d e"), (50, None), (51, "")]
    phrases = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))) for i in range(25)] + [(99, ""), (98, None)]
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != "")
    best = {}
    for i, p in phrases:
        if p:
            best[tuple(p.split())] = min(i, best.get(tuple(p.split()), 10**9))
    want = []
    for i, t in texts:
        w, at = (t or "").split(), 0
        while at < len(w):
            n = max((n for n in range(1, 6) if tuple(w[at : at + n]) in best and at + n <= len(w)), default=0)
            if n:
                want.append((str(i), at, n, best[tuple(w[at : at + n])]))
            at += n or 1
    for small in (10**6, 0):
        got = lookups.match_phrases(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "phrase_id long, p string"), "id", words("text"), words("p"), small=small).collect()
        assert sorted((str(r.id), r.pos, r.n, r.phrase_id) for r in got) == sorted(want)
    none = spark.createDataFrame([], "phrase_id long, p string")
    assert lookups.match_phrases(spark.createDataFrame(texts, "id long, text string"), none, "id", words("text"), words("p")).count() == 0


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("lat, lng, spread, radius", [(48.1, -1.7, 0.2, 2000.0), (0.0, 179.99, 0.05, 1500.0), (-89.99, 0.0, 0.02, 900.0), (70.0, 10.0, 3.0, 90000.0)])
def test_radius(spark, lat, lng, spread, radius):
    rng = random.Random(1)
    wrap = lambda x: (x + 180) % 360 - 180
    make = lambda n: [(i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), wrap(lng + rng.uniform(-spread, spread) * (100 if abs(lat) > 89 else 1))) for i in range(n)]
    a, b = make(60), make(90)
    kind = "id long, lat double, lng double"
    bad = [(900, None, 1.0), (901, 95.0, 1.0), (902, 1.0, 200.0)]
    got = lookups.within(spark.createDataFrame(a + bad, kind), spark.createDataFrame(b + bad, kind), radius).collect()
    want = {(i, j) for i, *p in a for j, *q in b if metres(p, q) <= radius}
    assert sorted((r.left_id, r.right_id) for r in got) == sorted(want) and want


@pytest.mark.parametrize("radius", [0.0, 1.0, 2_000_000.0, 12_000_000.0, 25_000_000.0])
def test_radius_round_the_earth(spark, radius):
    """Points from pole to pole, on the date line and on each other."""
    rng = random.Random(7)
    a = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(70)] + [(100, 90.0, 0.0), (101, -90.0, 77.0), (102, 0.0, 180.0), (103, 10.0, -180.0), (104, float("nan"), 0.0), (105, 89.999995, -90.0)]
    b = [(i, *p) for i, *p in a[::2]] + [(200, 90.0, 123.0), (201, 0.0, -180.0), (202, 0.000005, 179.999995), (203, 10.0, 180.0), (204, 1.0, float("nan"))]
    kind = "id long, lat double, lng double"
    df = lookups.within(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), radius)
    got = df.collect()
    pairs = {(i, j): metres(p, q) for i, *p in a for j, *q in b if not any(math.isnan(x) for x in (*p, *q))}
    # as far from the radius as two ways of rounding may lie apart
    sure, may = ({k for k, m in pairs.items() if m <= radius + d} for d in (-1e-3, 1e-3))
    if radius == 0:
        sure = {k for k, m in pairs.items() if m == 0}
    assert len(got) == len({(r.left_id, r.right_id) for r in got}) and sure <= {(r.left_id, r.right_id) for r in got} <= may and len(sure) >= 30
    assert all(abs(r.metres - pairs[r.left_id, r.right_id]) < 1e-3 for r in got)


def test_radius_sends_no_side_to_every_task(spark):
    """However small the files look, the copies that one side is dealt out in do not go to one machine's memory."""
    plan = QUERIES["radius_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spiral_number_is_the_grid_order(spark):
    grid = score.spiral(spark, 1, 121)
    assert grid.select("cell", lookups.spiral_number(F.col("dx"), F.col("dy")).alias("n")).where("cell <> n").count() == 0


@pytest.mark.parametrize("split", [1, 4])
def test_newest_within(spark, split):
    rng = random.Random(split)
    zero = dt.datetime(2024, 1, 1)
    t = lambda h: zero + dt.timedelta(minutes=h)
    versions = [(rng.choice(["hot", "hot", "b", None]), t(rng.randrange(40000)), i) for i in range(300)] + [("b", None, 1), ("b", t(50), 7), ("b", t(50), 9)]
    requests = [(i, rng.choice(["hot", "b", "c", None]), t(rng.randrange(45000)) if rng.random() < 0.95 else None) for i in range(300)] + [(900, "b", t(50)), (901, "b", t(50 + 1440)), (902, "b", t(50 + 1441))]
    got = lookups.newest_within(spark.createDataFrame(requests, "id long, key string, ts timestamp"), spark.createDataFrame(versions, "key string, ts timestamp, version long"), "key", "ts", 86400, split=split).collect()
    assert len(got) == len(requests)
    for r in got:
        own = [(b, v) for k, b, v in versions if k is not None and k == r.key and b is not None and r.ts is not None and r.ts - dt.timedelta(days=1) <= b <= r.ts]
        assert (r.version_ts, r.version) == max(own, default=(None, None)), r


def test_hot_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    zero = dt.datetime(2024, 1, 1)
    rows = [(i, None if rng.random() < 0.02 else "hot" if rng.random() < 0.9 else f"u{i % 5}", zero + dt.timedelta(minutes=rng.randrange(20000)), rng.randrange(-5, 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, u string, ts timestamp, v long").repartition(5)
    got = {r.id: r for r in selection.running_total(selection.rolling_count(df, ["u"], hours=24), ["u"], [F.col("ts"), F.col("id")], F.col("v")).collect()}
    assert len(got) == len(rows)
    for i, u, ts, _ in rows:
        own = [r for r in rows if r[1] == u]
        assert got[i].n_window == sum(ts - dt.timedelta(hours=24) <= r[2] <= ts for r in own)
        assert got[i].total == sum(r[3] for r in own if (r[2], r[0]) <= (ts, i))
    cap = selection.capped(df, ["u"], [F.col("ts"), F.col("id")], F.lit(7), hot=True).collect()
    plain = selection.capped(df, ["u"], [F.col("ts"), F.col("id")], F.lit(7)).collect()
    assert sorted((r.id, r.slot) for r in cap) == sorted((r.id, r.slot) for r in plain)


def test_hot_days_are_counted_in_one_sweep(spark):
    """Two events a second of one account, for 41 hours: no event counts its whole window anew."""
    e = spark.range(300_000).select("id", F.lit("hot").alias("u"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 500_000).alias("ts"))
    began = time.time()
    assert selection.rolling_count(e, ["u"]).where(F.col("n_window") != F.least(F.col("id") + 1, F.lit(172_801))).count() == 0
    assert time.time() - began < 30


def test_counters_are_taken_in_the_one_pass(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.when(F.col("id") < 90, F.col("id")))
    tagged, seen = selection.observed(df, {"known": F.col("x").isNotNull(), "even": F.col("x") % 2 == 0})
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "CollectMetrics" in plan
    tagged.write.parquet(f"file://{tmp_path}/t")
    assert seen.get == {"n": 100, "n_accepted": 45, "n_known": 10, "n_even": 45}


def test_prefixes_are_found_in_one_written_table(spark):
    rows = [("a", w) for w in ("abc", "abcd", "abcde", "xyz", "xy", "xyzz", "q")] + [(None, "abc"), (None, "abcd"), ("b", "abcd"), ("b", None)]
    got = selection.without_longer(spark.createDataFrame(rows, "g string, w string"), ["g"], "w", 3).collect()
    assert sorted((str(r.g), str(r.w)) for r in got) == sorted([("a", "abc"), ("a", "xyz"), ("a", "xy"), ("a", "q"), ("None", "abc"), ("b", "abcd"), ("b", "None")])
