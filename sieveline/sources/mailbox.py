"""Landed mail as a data source of its own: batch scans by folder and uid, and a stream whose offsets are the last uids.

Messages land in pages: ``path/folder=<name>/page=<uid div rows a page>/*.parquet``. A page is a range of uids, so
a scan that asks for uids above a bound (keyset paging) opens only the pages that can hold them, and
pages are the units that tasks read. Uids rise within a folder; a page may get further files while it fills.

The stream's offset is ``{folder: last uid}``. A batch reads the uids behind its start up to its end, so
what the checkpoint holds decides: no uid is read twice or left out across a restart, and folders
that appear later begin at their first uid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "landed_mail"
PAGE = 1000
SCHEMA = "folder string, uid long, ts timestamp, from_addr string, message_id string, in_reply_to string"
_OPEN = 1 << 62


@dataclass
class Page(InputPartition):
    """The uids above ``low`` up to ``high`` in one page of a folder."""

    path: str
    folder: str
    low: int
    high: int


def land_pages(rows: DataFrame, path: str, page: int = PAGE) -> None:
    """Append messages (columns of ``SCHEMA``) as pages; those without a folder or uid are left out. A large folder spreads over tasks by its pages."""
    rows, at = rows.where("folder is not null and uid is not null"), F.floor(F.col("uid") / page)
    rows.withColumn("page", at).repartition("folder", "page").sortWithinPartitions("uid").write.mode("append").partitionBy("folder", "page").parquet(path)


class _Pages:
    def __init__(self, path: str):
        self.fs, self.root = pfs.FileSystem.from_uri(path)

    def folders(self) -> dict[str, dict[int, str]]:
        """Pages of each folder by number. Names only: no file is opened."""
        out: dict[str, dict[int, str]] = {}
        for d in self._dirs(self.root, "folder="):
            out[unquote(d.base_name.removeprefix("folder="))] = {int(p.base_name.removeprefix("page=")): p.path for p in self._dirs(d.path, "page=")}
        return out

    def _dirs(self, path: str, start: str):
        found = self.fs.get_file_info(pfs.FileSelector(path, allow_not_found=True))
        return [i for i in found if i.type == pfs.FileType.Directory and i.base_name.startswith(start)]

    def files(self, page: str) -> list[str]:
        return sorted(i.path for i in self.fs.get_file_info(pfs.FileSelector(page)) if i.base_name.endswith(".parquet") and i.base_name[0] not in "_.")

    def last_uid(self, page: str) -> int:
        """The largest uid of a page, from its files' footers."""
        last = 0
        for f in self.files(page):
            meta = pq.read_metadata(f, filesystem=self.fs)
            at = meta.schema.names.index("uid")
            last = max([last, *(meta.row_group(g).column(at).statistics.max for g in range(meta.num_row_groups))])
        return last


def _read(root: str, part: Page, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pages = _Pages(root)
    data = pds.dataset(pages.files(part.path), filesystem=pages.fs, format="parquet")
    for batch in data.to_batches(filter=(pc.field("uid") > part.low) & (pc.field("uid") <= part.high)):
        if batch.num_rows:
            columns = {"folder": pa.array([part.folder] * batch.num_rows, pa.string()), **{n: batch.column(n) for n in batch.schema.names if n != "folder"}}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class MailReader(DataSourceReader):
    """Pages that the pushed bounds on folder and uid leave; the bounds hold row by row too."""

    def __init__(self, path: str, page: int, schema):
        self.path, self.page, self.schema = path, page, _arrow(schema)
        self.low, self.high, self.only = -_OPEN, _OPEN, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("folder",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            elif column == ("uid",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value - isinstance(f, GreaterThanOrEqual))
            elif column == ("uid",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif column == ("uid",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value - 1), min(self.high, f.value)
            elif not (isinstance(f, IsNotNull) and column in (("folder",), ("uid",))):
                yield f

    def partitions(self) -> list[Page]:
        return [
            Page(path, folder, self.low, self.high)
            for folder, pages in sorted(_Pages(self.path).folders().items()) if self.only is None or folder in self.only
            for n, path in sorted(pages.items()) if (n + 1) * self.page - 1 > self.low and n * self.page <= self.high
        ] or [Page("", "", 0, 0)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _read(self.path, partition, self.schema)


class MailStreamReader(DataSourceStreamReader):
    """Offsets are ``{folder: last uid}``; the newest page of each folder tells how far it goes."""

    def __init__(self, path: str, page: int, schema):
        self.path, self.page, self.schema = path, page, _arrow(schema)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = _Pages(self.path)
        return {folder: pages.last_uid(own[max(own)]) for folder, own in sorted(pages.folders().items()) if own}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        folders = _Pages(self.path).folders()
        return [
            Page(path, folder, start.get(folder, -_OPEN), high)
            for folder, high in end.items() if high > start.get(folder, -_OPEN)
            for n, path in sorted(folders.get(folder, {}).items()) if (n + 1) * self.page - 1 > start.get(folder, -_OPEN) and n * self.page <= high
        ]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        """Nothing: the query's checkpoint is the memory of what was read."""


class LandedMail(DataSource):
    """Options: ``path`` (of a store that pyarrow can open: local, HDFS, S3, GCS) and ``page``, the uids of a page."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(self.options["path"], int(self.options.get("page", PAGE)), schema)

    def streamReader(self, schema) -> MailStreamReader:
        return MailStreamReader(self.options["path"], int(self.options.get("page", PAGE)), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(LandedMail)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_mail(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).option("page", page).load()


def stream_mail(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("path", path).option("page", page).load()
