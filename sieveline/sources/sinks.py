"""Outputs: entity export, events with open extras, upsert by rewrite, the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT = ("name", "legal_name", "siren", "email", "phone", "website", "address", "city", "postal_code", "country", "industry", "status", "score", "subscribers", "tags", "sources")


def export_rows(entities: DataFrame) -> DataFrame:
    """The flat export: first e-mail and phone, joined tags and distinct sorted source names, no nulls."""
    one = lambda c: F.try_element_at(F.col(c), F.lit(1))
    have = set(entities.columns)
    cols = {
        "email": one("emails") if "emails" in have else F.lit(None), "phone": one("phones") if "phones" in have else F.lit(None),
        "tags": F.array_join("tags", ",") if "tags" in have else F.lit(None), "sources": F.array_join(F.array_sort(F.array_distinct("sources")), ",") if "sources" in have else F.lit(None),
    }
    return entities.select(*[F.coalesce((cols[c] if c in cols else F.col(c) if c in have else F.lit(None)).cast("string"), F.lit("")).alias(c) for c in EXPORT])


BOM = "\ufeff"


def write_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    """CSV files with a header whose first name follows a byte order mark, so that spreadsheets read them as UTF-8."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.option("header", True).option("sep", sep).csv(path)


#: event fields with a column of their own; all others live in ``extra``
EVENT_FIELDS = ("kind", "ts", "subject", "body", "template_key", "provider", "model", "message_id")


def event_row(payload: Column) -> list[Column]:
    """Columns of an event from a string map: known fields, and the rest as ``extra``."""
    known = [F.try_element_at(payload, F.lit(k)).alias(k) for k in EVENT_FIELDS]
    return [*known, F.map_filter(payload, lambda k, _: ~k.isin(*EVENT_FIELDS)).alias("extra")]


def flatten_event(fields: Column, extra: Column) -> Column:
    """One map of both; a known field is never overridden."""
    return F.map_concat(F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(fields), k)), fields)


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Current rows with incoming ones put over them: new keys added, non-null values replaced."""
    b = incoming.select(*[F.col(c).alias(f"_{c}") for c in incoming.columns])
    j = current.join(b, F.col(key) == F.col(f"_{key}"), "full")
    take = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in incoming.columns else F.col(c)
    return j.select(*[take(c).alias(c) for c in current.columns])


def upsert_counts(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``(created, merged, total)`` of an upsert, from keys alone."""
    new = incoming.select(key, F.lit(1).alias("new")).distinct()
    both = new.join(current.select(key, F.lit(1).alias("old")).distinct(), key, "full")
    return both.agg(F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("merged"), F.count("*").alias("total"))
