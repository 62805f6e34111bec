"""A session's own settings stay."""

import subprocess
import sys

CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark import SparkConf
from sieveline.session import build_session
{before}
s = build_session()
print("GOT", s.sparkContext.master, s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.sql.session.timeZone"), s.conf.get("spark.sql.adaptive.enabled"))
"""


def run(before, *args):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": " ".join([*args, "pyspark-shell"])}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, before=before)], capture_output=True, text=True, env=env, timeout=120).stdout
    return [x for x in out.splitlines() if x.startswith("GOT")][0].split()[1:]


def test_a_running_session_stays_as_it_is():
    before = "SparkSession.builder.master('local[1]').config('spark.sql.shuffle.partitions', 77).config('spark.sql.session.timeZone', 'Asia/Tokyo').getOrCreate()"
    assert run(before)[:3] == ["local[1]", "77", "Asia/Tokyo"]


def test_the_submitter_wins():
    args = ("--master", "local[3]", "--conf", "spark.sql.shuffle.partitions=33")
    assert run("", *args) == ["local[3]", "33", "UTC", "true"]
    assert run("")[0].startswith("local[") and run("")[1:] == ["8", "UTC", "true"]
