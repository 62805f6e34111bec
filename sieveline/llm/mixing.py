"""Mixing sources to target weights along a time-varying curriculum.

1. Source sizes are added up (one small row per source); targets come from water-filling.
2. Each source has a weight schedule over training time t in [0, 1], a list of knots joined
   by straight lines. Integrated and scaled to the target it is the source's cumulative token
   demand D(t).
3. Inside a source, documents stand in hash order. Their running token count comes from
   two-level prefix sums: per (source, hash cell) sums, then inside a cell, so a source with
   a third of all rows is spread over thousands of small windows.
4. A copy of a document whose middle is token u of the source has the position t = D^-1(u),
   in closed form per schedule segment. Range-sorting by position gives the training order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: knots (t, relative weight) by weight class: heavy sources fade out, light ones fade in
SCHEDULES = {0: [(0.0, 1.25), (1.0, 0.75)], 1: [(0.0, 1.0), (1.0, 1.0)], 2: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def order_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of the md5 of ``seed:id``, the order of documents inside a source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Targets by water-filling over ``(source, source_size)``: adds ``cls`` (weight class), ``weight, target``.

    Sources rank by code point, null last, and take ``weights`` in turn. Targets share
    ``share`` x all sizes by weight; one that would pass ``limit`` x its source's size stops
    there and the rest share the excess again. With caps ordered by cap / weight the level at
    which this settles is found from running sums, no iteration: sources are capped as long as
    their ratio is not above the level of those that remain. One row per source is all it reads.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    cls = (F.row_number().over(one) - 1) % len(weights)
    s = sizes.select("source", "source_size", cls.alias("cls"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("cls") + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * limit)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_over"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    s = s.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left_over") * F.col("weight"))
    open_ = F.when(~F.col("capped"), F.struct("left_weight", "left_over"))
    # the level is that of the first source that isn't capped; its remaining weight is the largest
    s = s.withColumn("level", F.max(open_).over(whole))
    share_of = F.col("weight") * F.col("level.left_over") / F.col("level.left_weight")
    return s.select("source", "source_size", "cls", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share_of).alias("target"))


def position(u: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which a fraction ``u`` of a source's demand is reached: inverts the schedule's integral."""
    parts = [(a, b, wa, wb) for (a, wa), (b, wb) in zip(knots, knots[1:])]
    areas = [(b - a) * (wa + wb) / 2 for a, b, wa, wb in parts]
    total, done, out = math.fsum(areas), 0.0, F.lit(1.0)
    steps = []
    for (a, b, wa, wb), area in zip(parts, areas):
        steps.append((done + area, a, b, wa, (wb - wa) / (b - a), done))
        done += area
    for upto, a, b, wa, slope, start in reversed(steps):
        need = u * F.lit(total) - F.lit(start)
        x = need / F.lit(wa) if slope == 0 else (F.sqrt(F.greatest(F.lit(wa * wa) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(wa)) / F.lit(slope)
        t = F.least(F.greatest(F.lit(a) + x, F.lit(a)), F.lit(b))
        out = t if upto == done else F.when(u * F.lit(total) <= F.lit(upto), t).otherwise(out)
    return out


def _passes(docs: DataFrame, weights, share, limit, schedules, cells, seed, id_col, text_col, source_col) -> DataFrame:
    """The mix with its working columns: ``full`` passes, ``part`` of the last one, ``u`` the demand at the first copy."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("k", order_hash(F.col("id"), seed)).withColumn("cell", F.shiftright("k", 60 - int(math.log2(cells))))
    by_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sizes = by_cell.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, limit)
    # the cells of one source are at most `cells` rows, whatever the source's size
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select("source", "cell", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts.source.eqNullSafe(targets.source)).drop(targets.source)
    inside = Window.partitionBy("source", "cell").orderBy("k", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r = rows.join(starts, rows.source.eqNullSafe(starts.source) & (rows.cell == starts.cell)).select(
        "id", "size", "source_size", "target", "cls", (F.col("start") + F.col("own")).alias("at"), F.round("target").cast("long").alias("goal"))
    r = r.withColumn("full", F.expr("if(source_size > 0, goal div source_size, 0)"))
    r = r.withColumn("part", F.expr("greatest(0, least(size, goal - full * source_size - at))"))
    r = r.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + (F.col("part") > 0).cast("long")).otherwise(0).cast("int"))
    return r.withColumn("u", F.expr("(at + cast(if(full > 0, size, part) as double) / 2) / nullif(goal, 0)"))


def _when(u: Column, schedules) -> Column:
    out = None
    for c, knots in (schedules or SCHEDULES).items():
        p = position(u, knots)
        out = F.when(F.col("cls") == c, p) if out is None else out.when(F.col("cls") == c, p)
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2, schedules=None, cells: int = 4096, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes, and when.

    Returns one row per input row: ``id_col, size, source_size, target, taken, copies,
    first_position``. Whole passes over a source come first; in the last pass documents in hash
    order are taken until the target is met, the one at the boundary in part, so a source's
    ``taken`` is its target rounded. ``copies`` counts the passes that take any of it,
    ``first_position`` is the training time of the first copy (null if none).

    Sizes count matches of ``[^\\x20\\x09-\\x0D]+``; null text has 0. A null source is a source
    of its own, last. Documents without words are never taken. Rows that share an id and a
    text stand in one fixed order up to their own exchange. Empty input gives no rows.
    """
    r = _passes(docs, weights, share, limit, schedules, cells, seed, id_col, text_col, source_col)
    return r.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("full") + F.col("part")).alias("taken"),
                    "copies", F.when(F.col("copies") > 0, _when(F.col("u"), schedules)).alias("first_position"))


def training_order(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2, schedules=None, cells: int = 4096, seed: int = 42,
                   id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` once per copy the mix takes, range-sorted by training position.

    Columns are those of ``docs``, whatever their names. Documents stay whole: one that the target cuts counts as a
    copy. Rows that share an id are taken as often as the most taken of them, rows without an
    id likewise. Documents without words, null and empty texts too, leave. Empty input gives no rows.
    """
    r = _passes(docs, weights, share, limit, schedules, cells, seed, id_col, text_col, source_col).where("copies > 0")
    lap = (F.col("lap") * F.col("source_size")) / F.col("goal")
    r = r.withColumn("lap", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    r = r.select(F.col("id").alias("of"), "lap", _when(F.least(F.col("u") + lap, F.lit(1.0)), schedules).alias("at"))
    r = r.groupBy("of", "lap").agg(F.min("at").alias("at"))
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    out = rows.join(r, rows.id.eqNullSafe(r["of"]))
    return out.repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("row.*")


def op5_source_mixing(spark, sf_dir):
    """The mix, range-sorted by training position; documents that are not taken come last."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    key = F.coalesce("first_position", F.lit(2.0))
    return out.repartitionByRange(key, "doc_id").sortWithinPartitions(key, "doc_id")


def _position_sql(u: str, knots) -> str:
    parts = [(a, b, wa, wb) for (a, wa), (b, wb) in zip(knots, knots[1:])]
    areas = [(b - a) * (wa + wb) / 2 for a, b, wa, wb in parts]
    total, done, cases = math.fsum(areas), 0.0, []
    for i, ((a, b, wa, wb), area) in enumerate(zip(parts, areas)):
        need, slope = f"({u} * {total}::DOUBLE - {done}::DOUBLE)", (wb - wa) / (b - a)
        x = f"{need} / {wa}::DOUBLE" if slope == 0 else f"(sqrt(greatest({wa * wa}::DOUBLE + {2 * slope}::DOUBLE * {need}, 0.0::DOUBLE)) - {wa}::DOUBLE) / {slope}::DOUBLE"
        t = f"least(greatest({a}::DOUBLE + {x}, {a}::DOUBLE), {b}::DOUBLE)"
        done += area
        cases.append(f"WHEN {u} * {total}::DOUBLE <= {done}::DOUBLE THEN {t}" if i < len(parts) - 1 else f"ELSE {t}")
    return f"CASE {' '.join(cases)} END" if len(cases) > 1 else cases[0][5:]


def sql(source: str = "documents", seed: int = 42, extra: str = "") -> str:
    when = " ".join(f"WHEN {c} THEN {_position_sql('u', k)}" for c, k in SCHEDULES.items())
    return f"""
WITH d AS (SELECT doc_id, source{extra}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM {source}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
c AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS cls FROM s),
w AS (SELECT *, CASE cls WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 2 * source_size AS cap FROM c),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE AS left_over,
             (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT AS left_weight FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * left_weight <= left_over * weight AS capped FROM f),
l AS (SELECT max_by(left_over, left_weight) AS lo, max(left_weight) AS lw FROM g WHERE NOT capped),
t AS (SELECT source, source_size, cls, CASE WHEN capped THEN cap::DOUBLE ELSE weight * lo / lw END AS target FROM g LEFT JOIN l ON true),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run0 FROM d),
j AS (SELECT a.*, t.source_size, t.target, t.cls, round(t.target)::BIGINT AS goal,
             CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS passes
      FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, goal - passes * source_size - run0)) AS part FROM j),
q AS (SELECT *, CASE WHEN size > 0 THEN passes + (part > 0)::BIGINT ELSE 0 END::INTEGER AS copies,
             (run0 + CASE WHEN passes > 0 THEN size ELSE part END::DOUBLE / 2) / nullif(goal, 0) AS u FROM p)
SELECT doc_id{extra}, size, source_size, target, size * passes + part AS taken, copies,
       CASE WHEN copies > 0 THEN CASE cls {when} END END AS first_position
FROM q
"""


SQL = sql()
