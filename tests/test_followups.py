"""Follow-up timers: order, restart, late and repeated events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import events as stream
from sieveline.streaming import followups as fu

SCHEMA = "entity_id long, kind string, ts timestamp"
ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, fu.ROCKS)
    yield
    spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def at(hours):
    return ZERO + dt.timedelta(hours=hours)


def rows(df):
    return sorted(tuple(r) for r in df.select("entity_id", "last_sent", "due", "n_sent").collect())


def expected(events, days, until):
    """Plain walk over each entity's events in order."""
    out, wait = [], dt.timedelta(days=days)
    for entity in {e for e, _, t in events if e is not None and t is not None}:
        own = sorted((t, k == fu.SENT) for e, k, t in events if e == entity and t is not None and (k == fu.SENT or k in fu.STOP))
        last, n = None, 0
        for t, sent in [*own, (until, False)]:
            if last is not None and last + wait < t:
                out.append((entity, last, last + wait, n))
                break
            if not sent:
                break
            last, n = t, n + 1
    return sorted((e, a.astimezone().replace(tzinfo=None), b.astimezone().replace(tzinfo=None), n) for e, a, b, n in out)


def test_restart_goes_on_and_emits_once(spark, rocks, tmp_path):
    """Two runs with one checkpoint: batches out of order inside a day, an answer across the restart."""
    rng = random.Random(4)
    events = [(rng.randrange(40), rng.choice([fu.SENT] * 6 + ["opened", "reply_detected", "bounced"]), at(rng.randrange(24 * 30))) for _ in range(260)]
    events += [(None, fu.SENT, at(5)), (3, None, at(6)), (4, fu.SENT, None), (100, fu.SENT, at(10)), (100, "reply_detected", at(24 * 5 + 10)), (101, fu.SENT, at(10)), (101, fu.SENT, at(24 * 5 + 10)), (102, fu.SENT, at(24 * 14)), (102, "won", at(24 * 17))]
    events.sort(key=lambda e: e[2] or ZERO)
    half = next(i for i, e in enumerate(events) if (e[2] or ZERO) >= at(24 * 15))
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    frame = lambda r, n: spark.createDataFrame(r, SCHEMA).coalesce(n)
    shuffled = events[:half]
    # out of order by less than a day
    shuffled.sort(key=lambda e: (e[2] or ZERO) + dt.timedelta(hours=rng.randrange(20)))
    for part in range(0, half, 40):
        frame(shuffled[part : part + 40], 1).write.mode("append").parquet(source)

    def run():
        e = stream.read_events(spark, source, files_per_trigger=2)
        return rows(stream.land(fu.followups(e), path))

    first = run()
    assert first and run() == first
    frame(events[half:], 1).write.mode("append").parquet(source)
    got = run()
    until = max(t for _, k, t in events if t and (k == fu.SENT or k in fu.STOP)) - dt.timedelta(days=1)
    want = expected(events, 5, until)
    assert got == want and len({r[0] for r in got}) == len(got) and set(first) < set(got)
    table = spark.createDataFrame(events, SCHEMA)
    assert rows(fu.followups_of_all(table, F.lit(until))) == want
    assert not any(r[0] in (100, 102) for r in got) and [r[3] for r in got if r[0] == 101] == [2]


def test_forgotten_entities_start_anew(spark, rocks, tmp_path):
    """The state of a closed entity goes so long after its end."""
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/out"

    def run(events):
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        return rows(stream.land(fu.followups(stream.read_events(spark, source), forget_days=10), path))

    assert run([(1, fu.SENT, at(0)), (2, "won", at(24 * 8))])[0][0] == 1
    assert len(run([(1, fu.SENT, at(24 * 9)), (2, "won", at(24 * 30))])) == 1
    assert len(run([(1, fu.SENT, at(24 * 31)), (2, "won", at(24 * 50))])) == 2
