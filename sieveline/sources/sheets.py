"""Spreadsheets: the first sheet of each workbook as text rows. A workbook is one task's work, as its parts are zipped together."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group(0):
        n = 26 * n + ord(c) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the first sheet, by the workbook's own list."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(_REL))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _cell(c, shared: list[str]) -> str:
    v, kind = c.find("m:v", _NS), c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)).strip()
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)].strip()
    if kind == "n":
        try:
            x = float(v.text)
            return str(int(x)) if x.is_integer() else str(x)
        except ValueError:
            return v.text.strip()
    return {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text.strip()


def _rows(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        with book.open(_first_sheet(book)) as part:
            # row by row: a sheet is never held as a whole
            for _, e in ElementTree.iterparse(part):
                if e.tag.endswith("}row"):
                    yield {_column(c.get("r")): _cell(c, shared) for c in e.iterfind("m:c", _NS)}
                    e.clear()


def _cells(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            head, held = None, []
            for n, row in enumerate(_rows(content)):
                if head is None:
                    head = {i: h for i, h in row.items() if h}
                    continue
                d = [(h, row.get(i, "")) for i, h in head.items()]
                if any(v for _, v in d):
                    held.append((n, d))
                if len(held) == 1000:
                    yield _batch(path, held)
                    held = []
            if held:
                yield _batch(path, held)


def _batch(path: str, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.map_(pa.string(), pa.string()))], ["path", "row", "cells"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, cells)`` of the first sheet of each workbook under ``path``: a map from header to text.

    The first row holds the headers; columns without one, and rows without a value, go. Whole
    numbers lose their decimals. A workbook is read by one task, row by row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_cells, "path string, row long, cells map<string,string>")


def as_table(cells: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Cells as columns, one for each header (all that occur, by letter, if not given)."""
    if headers is None:
        headers = sorted(r[0] for r in cells.select(F.explode(F.map_keys("cells"))).distinct().collect())
    return cells.select(*[F.try_element_at("cells", F.lit(h)).alias(h) for h in headers])
