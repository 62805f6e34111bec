"""Search cursors as a small table: keyed by source, valid for one set of criteria, advanced after a run has been consumed.

A cursor is ``(source, criteria_hash, place)``, ``place`` a struct of longs. Criteria are
configuration, so their hash is worked out where the job is put together; the states are rows, and all
cursors advance in one pass.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def criteria_hash(criteria: dict) -> str:
    """12 hex digits of the criteria that are set, whatever their order."""
    kept = {k: v for k, v in criteria.items() if v not in (None, "", [], {})}
    return hashlib.sha1(json.dumps(kept, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def shuffle_seed(criteria: dict) -> int:
    """The seed of a shuffled listing: the same for the same criteria."""
    return int(hashlib.sha1(str(criteria).encode()).hexdigest()[:8], 16)


def load(cursors: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` is ``(source, criteria_hash)``: each with its saved place, null where there is none or the criteria have changed."""
    saved = cursors.select("source", F.col("criteria_hash").alias("__hash"), "place")
    out = wanted.join(saved, "source", "left")
    return out.select("source", "criteria_hash", F.when(F.col("__hash") == F.col("criteria_hash"), F.col("place")).alias("place"))


def save(cursors: DataFrame, done: DataFrame) -> DataFrame:
    """All cursors after a run: those in ``done`` take the place of the ones of the same source."""
    return cursors.join(done.select("source"), "source", "left_anti").unionByName(done.select(cursors.columns))


def reset(cursors: DataFrame, sources: list[str]) -> DataFrame:
    return cursors.where(~F.col("source").isin(*sources))


def next_page(place: Column, exhausted: Column, reached: Column, n_regions: Column, n_codes: Column) -> Column:
    """A walk over pages of (code, region): the next page, or page 1 of the next region, or of the next code after the last region; round and round."""
    code, region, page = (F.coalesce(place[f], F.lit(d)) for f, d in (("code", 0), ("region", 0), ("page", 1)))
    turn = (region + 1) % n_regions
    return F.when(exhausted, F.struct(F.when(turn == 0, (code + 1) % n_codes).otherwise(code).cast("long").alias("code"), turn.cast("long").alias("region"), F.lit(1).cast("long").alias("page"))).otherwise(
        F.struct(code.cast("long").alias("code"), region.cast("long").alias("region"), F.coalesce(reached, page + 1).cast("long").alias("page")))


def next_offset(offset: Column, taken: Column, total: Column) -> Column:
    """A walk over a listing: on by what was taken, back to the start at its end."""
    on = F.coalesce(offset, F.lit(0)) + taken
    return F.when(on >= total, 0).otherwise(on).cast("long")


def next_cell(cell: Column, cells: int = 49) -> Column:
    """A walk over a grid: one cell on, whatever the last one gave; round and round."""
    return ((F.coalesce(cell, F.lit(0)) % cells + 1) % cells).cast("long")
