"""Tables whose saves are whole or not at all: buckets of Parquet files, and manifests that name them.

A save compares the digest of each bucket's rows with the one in the manifest and writes the buckets that
changed, into a folder of their own. Then the next manifest is put in place, by a rename that fails
where another writer was first. What a broken save leaves behind is in no manifest, so nobody reads it.
A reader holds a manifest, and with it one state of all tables, whatever is saved meanwhile. Columns come
back nullable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class Overtaken(RuntimeError):
    """Another writer has put the next manifest in place."""


@dataclass
class Change:
    """New rows of a table: all of it, or with ``only`` the whole content of those buckets."""

    rows: DataFrame
    by: list[str]
    buckets: int = 16
    only: list[int] | None = None


@dataclass
class State:
    """One manifest: a number, the tables' schemas and buckets, and the labels of what was applied."""

    version: int = 0
    tables: dict = field(default_factory=dict)
    applied: list = field(default_factory=list)


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


class Tables:
    """Named tables under one folder, saved together. ``path`` may lie in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def state(self, version: int | None = None) -> State:
        """The newest manifest, or that of ``version``; an empty one where nothing was saved yet."""
        found = self._manifests()
        if not found and version is None:
            return State()
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version or found[-1]:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def read(self, name: str, state: State | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table's rows as of ``state``, of the buckets ``only`` where given; None if it was never saved."""
        table = (state or self.state()).tables.get(name)
        if table is None:
            return None
        schema = table["schema"]
        wanted = [b["path"] for k, b in table["buckets"].items() if only is None or int(k) in only]
        # at most as many paths as there are buckets
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in wanted]) if wanted else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], state: State | None = None, label: str | None = None) -> dict[str, list[int]]:
        """Save ``changes`` on top of ``state``; the buckets written, by table. Nothing changed: nothing is written.

        Digests tell sets of rows apart, whatever their order: count, sum and exclusive or of two 64-bit
        row hashes. Map columns have no hash and raise. ``label`` is remembered as applied.
        """
        state = state or self.state()
        tables, written = dict(state.tables), {}
        for name, c in changes.items():
            rows = c.rows.withColumn(BUCKET, bucket_of(c.by, c.buckets))
            schema = ", ".join(f"`{n}` {t}" for n, t in c.rows.dtypes)
            cols = [F.col(f"`{x}`") for x in c.rows.columns]
            digest = F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(2), *cols)))
            now = {str(r[0]): r[1] for r in rows.groupBy(BUCKET).agg(digest).collect()}
            before = tables.get(name, {"buckets": {}, "schema": schema})
            if before.get("n", c.buckets) != c.buckets or before["schema"] != schema:
                if c.only is not None:
                    raise ValueError(f"{name}: single buckets can only be saved with the schema and number of buckets that the table has")
                before = {"buckets": {}, "schema": schema}
            kept = {k: b for k, b in before["buckets"].items() if c.only is not None and int(k) not in c.only}
            same = {k: b for k, b in before["buckets"].items() if now.get(k) == b["digest"]}
            changed = sorted(int(k) for k in now if k not in same)
            if changed:
                folder = f"data/{name}-{uuid.uuid4().hex}"
                # large buckets are split over tasks, small ones share one
                rows.where(F.col(BUCKET).isin(changed)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
                same |= {str(k): {"path": f"{folder}/{BUCKET}={k}", "digest": now[str(k)]} for k in changed}
            buckets = kept | {k: b for k, b in same.items() if k in now}
            written[name] = changed
            tables[name] = {"schema": schema, "n": c.buckets, "buckets": buckets}
        if tables != state.tables or (label is not None and label not in state.applied):
            self._put(State(state.version + 1, tables, state.applied + ([label] if label is not None else [])))
        return written

    def _put(self, state: State) -> None:
        jvm = self.spark._jvm
        draft = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state.__dict__).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"{self.path}/manifests/{state.version:09d}.json"), none)
        except Exception as e:
            if isinstance(e, PySparkException) or "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            raise Overtaken(f"version {state.version} of {self.path} was saved by another writer") from e
