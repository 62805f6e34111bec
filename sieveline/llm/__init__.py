"""Operators for large training-text pipelines; nothing else in the library imports this package."""

import os

BATCH_ROWS = 2000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(spark) -> None:
    """Put the folder this package was loaded from on the Python workers' path.

    Local sessions need it when the program was started elsewhere. On a cluster install the
    package or ship it with ``--py-files``; a folder that is not there does no harm.

    Arrow batches are cut to ``BATCH_ROWS`` rows, as texts are long: a batch of the default size
    would hold several copies of some 30 MB in each task.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
