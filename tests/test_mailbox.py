"""Landed mail: pushed bounds, and a stream that loses and repeats nothing across restarts."""

import pytest
from pyspark.sql import functions as F

from sieveline.sources import mailbox
from sieveline.streaming import events as stream


def mails(spark, low, high, folders=("inbox", "sent/été 1")):
    r = spark.range(low, high).withColumnRenamed("id", "uid")
    names = F.array(*[F.lit(f) for f in folders])
    return r.select(F.element_at(names, (F.col("uid") % len(folders) + 1).cast("int")).alias("folder"), "uid", F.timestamp_seconds(F.col("uid")).alias("ts"), F.lit("a@b.fr").alias("from_addr"), F.concat(F.lit("m"), "uid").alias("message_id"), F.lit(None).cast("string").alias("in_reply_to"))


def got(df):
    return sorted((r.folder, r.uid, r.message_id) for r in df.collect())


@pytest.fixture()
def path(spark, tmp_path):
    p = f"file://{tmp_path}/mail"
    mailbox.land_pages(mails(spark, 1, 500), p, 50)
    return p


@pytest.mark.parametrize("where, pages", [("uid > 430", 4), ("folder = 'inbox' and uid > 430 and uid <= 449", 1), ("folder in ('inbox', 'none') and uid >= 450", 1), ("uid = 77", 2), ("message_id = 'm5'", 20), ("uid > 9999", 0)])
def test_bounds_reach_the_source(spark, path, where, pages):
    df = mailbox.read_mail(spark, path, 50).where(where)
    assert got(df) == got(mails(spark, 1, 500).where(where))
    assert df.rdd.getNumPartitions() == max(1, pages)


def test_pushed_filters_leave_no_filter_in_the_plan(spark, path):
    plan = lambda where: mailbox.read_mail(spark, path, 50).where(where)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan("folder = 'inbox' and uid > 430").replace("RuntimeFilters", "")
    assert "Filter" in plan("message_id = 'm5'").replace("RuntimeFilters", "")


def test_stream_goes_on_after_a_restart(spark, path, tmp_path):
    out = f"file://{tmp_path}/out"
    run = lambda: got(stream.land(mailbox.stream_mail(spark, path, 50), out))
    assert run() == got(mails(spark, 1, 500))
    assert run() == got(mails(spark, 1, 500))
    # the last page goes on, a folder appears, another stays as it is
    mailbox.land_pages(mails(spark, 500, 640, ("inbox", "new")), path, 50)
    want = got(mails(spark, 1, 500).unionByName(mails(spark, 500, 640, ("inbox", "new"))))
    assert run() == want and run() == want


def test_nothing_landed(spark, tmp_path):
    assert mailbox.read_mail(spark, f"file://{tmp_path}/none").count() == 0
