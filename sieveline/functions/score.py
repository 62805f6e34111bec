"""Scores and geometry."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sieveline.functions.text import fold, tokens


def relevance(name: Column, handle: Column, description: Column, platform: Column, subscribers: Column, language: Column, country: Column,
              has_urls: Column, has_emails: Column, query: str, boost: str = "", words: tuple[Column, Column, Column] | None = None) -> Column:
    """Relevance of a profile to a query, 0 to 100, not rounded.

    ``words`` are the tokens of name, handle and description where the caller has them as columns:
    they are read several times here, and a column is computed once.
    """
    terms = sorted({t for t in _terms(query)})
    if not terms:
        return F.lit(0.0)
    q, n = F.array(*[F.lit(t) for t in terms]), float(len(terms))
    own = words or (tokens(name), tokens(handle), tokens(description))
    inside = lambda c: F.lower(fold(F.coalesce(c, F.lit("")))).rlike("|".join(terms))
    k, h, d = (F.size(F.array_intersect(q, w)) for w in own)
    s = F.when(k == len(terms), 35.0).when(k > 0, 20.0 * k / n).when(inside(name), 12.0).otherwise(0.0)
    s = s + F.when(h > 0, 15.0 * h / n).when(inside(handle), 6.0).otherwise(0.0)
    s = s + F.when(d > 0, 25.0 * d / n).when(inside(description), 5.0).otherwise(0.0)
    p = F.lower(F.coalesce(platform, F.lit("")))
    s = s + F.when(p.isin("youtube", "twitch", "apple_podcasts"), 5.0).when(p.isin("bluesky", "mastodon", "kick", "dailymotion", "github"), 3.0).otherwise(0.0)
    s = s + F.when(subscribers > 0, F.least(F.lit(15.0), 2.0 * F.log10(F.greatest(F.lit(1.0), subscribers.cast("double"))))).otherwise(0.0)
    if boost:
        same = F.substring(F.lower(F.coalesce(language, F.lit(""))), 1, 2) == boost
        s = s + F.when(same, 5.0).when(F.lit(boost == "fr") & (F.upper(F.coalesce(country, F.lit(""))) == "FR"), 5.0).otherwise(0.0)
    size = F.length(F.coalesce(description, F.lit("")))
    s = s + F.when(size > 200, 5.0).when(size > 50, 2.0).otherwise(0.0) + F.when(has_urls, 3.0).otherwise(0.0) + F.when(has_emails, 5.0).otherwise(0.0) - F.when(size == 0, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))


def _terms(query: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).lower()
    return [t for t in re.findall(r"\w+", plain) if len(t) > 1]


def relevance_label(score: Column) -> Column:
    return F.when(score >= 65, "très pertinent").when(score >= 45, "pertinent").when(score >= 25, "moyen").otherwise("faible")


def shift(lat: Column, lng: Column, north_m: Column, east_m: Column) -> Column:
    """``struct(lat, lng)`` of a point moved by metres; longitude degrees shrink with the cosine of latitude."""
    return F.struct((lat + north_m / 111320.0).alias("lat"), (lng + east_m / (111320.0 * F.greatest(F.lit(0.01), F.cos(F.radians(lat))))).alias("lng"))


def spiral(spark, step_m: int, cells: int = 49):
    """Rows ``(cell, dx, dy)`` of a square spiral around the origin, ring by ring."""
    rings = 1
    while (2 * rings + 1) ** 2 < cells:
        rings += 1
    side = 2 * rings + 1
    grid = spark.range(side * side).select((F.col("id") % side - rings).alias("x"), (F.floor(F.col("id") / side) - rings).alias("y"))
    ring = F.greatest(F.abs("x"), F.abs("y"))
    edge = F.abs("y") == ring
    # rows of a ring first by x, top before bottom; then its sides by y, right before left
    order = F.struct(ring, F.when(edge, 0).otherwise(1), F.when(edge, F.col("x")).otherwise(F.col("y")), F.when(edge, -F.signum("y")).otherwise(-F.signum("x")))
    ranked = grid.select("x", "y", order.alias("o")).orderBy("o").limit(cells)
    return ranked.select((F.row_number().over(Window.orderBy("o")) - 1).alias("cell"), (F.col("x") * step_m).alias("dx"), (F.col("y") * step_m).alias("dy"))
