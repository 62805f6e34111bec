"""Session settings and table loading shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


#: what the engine relies on, and what suits one machine
NEEDED = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}


def build_session(app: str = "sieveline", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """The running session, or a new one, with the settings the engine relies on: UTC, AQE and Arrow.

    Only names that are unset are filled in: what the submitter or a running session has set stays, the
    master too. Without a master the session is local, with ``cpus`` threads and ``shuffle_partitions``.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        # a running session has been given every setting it will have
        return running
    given = _submitted()
    wanted = dict(NEEDED)
    if "spark.master" not in given:
        wanted |= LOCAL | {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(shuffle_partitions)}
    builder = SparkSession.builder.appName(app)
    for k, v in wanted.items():
        if k not in given:
            builder = builder.config(k, v)
    return builder.getOrCreate()


def _submitted() -> dict[str, str]:
    """What ``spark-submit`` has set: read from its JVM where that runs already, else from the arguments it will get."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()
        return dict(SparkConf().getAll())
    args, out = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", "")), {}
    for name, value in zip(args, args[1:]):
        if name == "--master":
            out["spark.master"] = value
        elif name == "--driver-memory":
            out["spark.driver.memory"] = value
        elif name in ("--conf", "-c"):
            out.update([value.split("=", 1)])
    return out


def on_workers(spark: SparkSession) -> None:
    """Put the folder this package was loaded from on the Python workers' path, for sources and state machines in Python.

    Local sessions need it when the program was started elsewhere; it holds for the session's later workers.
    On a cluster install the package or ship it with ``--py-files``; a folder that is not there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test star schema; the path may live in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only where it is unset on a local master (tests on one machine) a temporary folder is made; on a
    cluster a folder of one machine would lose what others wrote, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Write to a fresh Parquet folder beside the checkpoints and read it back: cuts lineage, compressed."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
