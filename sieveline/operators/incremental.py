"""Entities kept up to date batch by batch: what arrives meets what is stored by key, and only what it touches changes.

The store has three tables, saved together: ``keys`` (match key -> the component it was first seen
in), ``moved`` (a component that was merged away -> the one it went to) and ``entities`` (the merged state of
each component). A batch looks up its keys, follows moved components, and links its rows and the components found in
a graph of their own: its connected components are the new ones. States fold: that of a component is
the fold of its rows', so components that a row bridges are folded without their rows.

The result after any batches is that of ``entities.resolve`` and ``entities.merge`` over all rows at once.

At scale: of ``keys`` and ``moved`` only the batch's buckets are read, by equi-joins; of ``entities``
those of the touched components, which are written again. So with buckets in proportion to the store, a
batch costs in proportion to itself and to the buckets it touches. A hot key costs one edge per row of
the batch, and its component one state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.classify import status_rank
from sieveline.functions.contact import norm_email, norm_phone, norm_url
from sieveline.operators.components import connected_components
from sieveline.operators.entities import SCALARS
from sieveline.session import written
from sieveline.sources.commits import Change, Tables, bucket_of

LISTS = {"emails": norm_email, "phones": norm_phone, "other_urls": norm_url, "tags": lambda v: v}
MAXIMA = ("subscribers", "last_contact_at")
FLAGS = ("monetized", "has_legal_mentions")


def row_states(rows: DataFrame, by: Column, seq: str = "seq") -> DataFrame:
    """Each row as the state of a component of one row, under the name ``component``."""
    have, s = set(rows.columns), F.col(seq).cast("long")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    cols = [F.when(some(c), F.struct(s.alias("seq"), F.col(c).alias("v"))).alias(c) for c in SCALARS if c in have]
    if "score" in have:
        cols.append(F.struct(F.col("score"), (-s).alias("s"), F.col("score_label").alias("l")).alias("score"))
    cols += [F.col(c) for c in (*MAXIMA, *FLAGS) if c in have]
    if "next_follow_up_at" in have:
        cols.append(F.when(F.col("next_follow_up_at").isNotNull(), F.struct(s.alias("seq"), F.col("next_follow_up_at").alias("v"))).alias("next_follow_up_at"))
    if "status" in have:
        cols.append(F.struct(status_rank(F.col("status")).alias("rank"), (-s).alias("s"), F.col("status").alias("v")).alias("status"))
    for c, norm in LISTS.items():
        if c in have:
            item = F.transform(F.col(c), lambda v, i: F.struct(norm(v).alias("k"), s.alias("seq"), i.cast("int").alias("pos"), v.alias("v")))  # noqa: B023
            cols.append(F.filter(F.coalesce(item, F.array()), lambda x: F.coalesce(x["k"], F.lit("")) != "").alias(c))
    return rows.select(by.alias("component"), F.lit(1).cast("long").alias("n_rows"), *cols)


def fold(states: DataFrame) -> DataFrame:
    """The states of each ``component`` as one; folding is associative, and the order of states makes no difference."""
    have = [c for c in states.columns if c not in ("component", "n_rows")]
    one = {**{c: F.min for c in SCALARS}, "score": F.max, "status": F.max, "next_follow_up_at": F.max, **dict.fromkeys(MAXIMA, F.max), **dict.fromkeys(FLAGS, F.bool_or)}
    out = states.groupBy("component").agg(F.sum("n_rows").alias("n_rows"), *[one[c](c).alias(c) for c in have if c not in LISTS])
    lists = [c for c in have if c in LISTS]
    if lists:
        # one row per item of any list: the first by row and place of equal ones stays
        items = states.select("component", F.explode(F.concat(*[F.transform(c, lambda x: F.struct(F.lit(c).alias("list"), x.alias("x"))) for c in lists])).alias("i"))  # noqa: B023
        first = items.groupBy("component", "i.list", F.col("i.x.k").alias("k")).agg(F.min(F.struct("i.x.seq", "i.x.pos", "i.x.v")).alias("m"))
        again = F.struct(F.col("k"), F.col("m.seq").alias("seq"), F.col("m.pos").alias("pos"), F.col("m.v").alias("v"))
        per = first.groupBy("component").agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == c, again))).alias(c) for c in lists]).withColumnRenamed("component", "of")
        empty = F.array().cast(dict(states.dtypes)[lists[0]])
        out = out.join(per, F.col("component") == F.col("of"), "left").select("component", "n_rows", *[F.coalesce(c, empty).alias(c) if c in lists else F.col(c) for c in have])
    return out.select(states.columns)


def finished(states: DataFrame) -> DataFrame:
    """States as the rows that ``entities.merge`` gives: lists in order of row and place, null where empty."""
    cols = []
    for c in states.columns:
        if c in SCALARS or c in ("next_follow_up_at", "status"):
            cols.append(F.col(f"{c}.v").alias(c))
        elif c == "score":
            cols += [F.col("score.score").alias("score"), F.col("score.l").alias("score_label")]
        elif c in LISTS:
            ordered = F.array_sort(F.transform(c, lambda x: F.struct(x["seq"], x["pos"], x["v"])))
            cols.append(F.when(F.size(c) > 0, F.transform(ordered, lambda x: x["v"])).alias(c))
        else:
            cols.append(F.col(c))
    return states.select(*cols)


class EntityStore:
    """The store at ``path``. ``buckets`` is fixed at its first batch; choose it for the size it will have."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.tables = Tables(spark, path)

    def _touched(self, rows: DataFrame, col: str) -> list[int]:
        """Numbers of the buckets that the values of ``col`` fall in: at most as many as there are."""
        return [r[0] for r in rows.select(bucket_of([col], self.buckets)).distinct().collect()]

    def _roots(self, state, found: DataFrame) -> DataFrame:
        """``(component, root, hops)`` of stored components, along the moves since; one join for each move in a row."""
        at = found.select("component", F.col("component").alias("root"), F.lit(0).alias("hops"))
        if "moved" not in state.tables:
            return at
        while True:
            moved = self.tables.read("moved", state, self._touched(at.where("hops >= 0"), "root")).select(F.col("component").alias("__from"), "to")
            step = written(at.join(moved, F.col("root") == F.col("__from"), "left").select("component", F.coalesce("to", "root").alias("root"), (F.col("hops") + F.when(F.col("to").isNull(), 0).otherwise(1)).alias("hops"), F.col("to").isNotNull().alias("on")))
            at = step.drop("on")
            if step.where("on").isEmpty():
                return at

    def upsert(self, rows: DataFrame, label: str, id_col: str = "id", keys_col: str = "keys", seq: str = "seq") -> dict[str, int]:
        """Take in a batch of rows with ids that are new; ``(created, merged, total)`` of its rows, and what it read and wrote.

        ``created`` counts the batch's components that hold nothing stored, ``merged`` the rest of its rows,
        ``total`` all entities after it. A batch whose ``label`` was applied before changes nothing and
        gives an empty result, so a job that ends without knowing whether it saved may run it again. Rows
        without keys are entities of their own; null ids raise. All batches have the same columns.
        """
        state = self.tables.state()
        if label in state.applied:
            return {}
        b = written(rows.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit("a row without id")).cast("long"))))
        keyed = b.select(F.col(id_col).alias("id"), F.explode(keys_col).alias("key")).distinct()
        names = keyed.select("key").distinct()
        known = self.tables.read("keys", state, self._touched(names, "key"))
        known = written((known if known is not None else names.select("key", F.lit(None).cast("long").alias("component")).limit(0)).join(names, "key", "left_semi"))
        roots = written(self._roots(state, known.select("component").distinct()))
        stored = known.join(roots, "component").select("key", "root")
        nodes = keyed.unionByName(stored.select(F.col("root").alias("id"), "key"))
        low = nodes.groupBy("key").agg(F.min("id").alias("low"))
        edges = nodes.join(low, "key").where("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst"))
        parts = written(connected_components(edges))
        all_ids = b.select(F.col(id_col).alias("node")).union(roots.select("root")).distinct()
        parts = written(all_ids.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        old = roots.select(F.col("root").alias("node")).distinct().join(parts, "node")
        old = written(old)

        fresh = row_states(b.join(parts, F.col(id_col) == F.col("node")), F.col("component"), seq)
        buckets = sorted({*self._touched(old, "node"), *self._touched(parts, "component")})
        near = self.tables.read("entities", state, buckets)
        if near is None:
            new, read = fold(fresh), 0
        else:
            touched = written(near.join(old.select(F.col("node").alias("component"), F.col("component").alias("__new")), "component"))
            read = touched.count()
            new = fold(fresh.unionByName(touched.withColumn("component", F.col("__new")).drop("__new")))
            new = near.join(old.select(F.col("node").alias("component")), "component", "left_anti").unionByName(new)
        new = written(new)
        changes = {"entities": Change(new, ["component"], self.buckets, buckets if near is not None else None)}
        add = keyed.join(known, "key", "left_anti").join(parts, F.col("id") == F.col("node")).groupBy("key").agg(F.min("component").alias("component"))
        changes |= self._added("keys", add, "key", state)
        # components that lost their name, and shorter ways for those that took several moves
        gone = old.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("to"))
        far = roots.where("hops > 1").select("component", F.col("root").alias("node")).join(parts.withColumnRenamed("component", "to"), "node").select("component", "to")
        changes |= self._added("moved", gone.unionByName(far), "component", state)
        made = parts.join(old.select("component").distinct(), "component", "left_anti").select("component").distinct().count()
        wrote = self.tables.commit(changes, state, label)
        total = self.tables.read("entities").count()
        return {"created": made, "merged": b.count() - made, "total": total, "keys_read": known.count(), "entities_read": read, "buckets_written": sum(map(len, wrote.values()))}

    def _added(self, name: str, rows: DataFrame, by: str, state) -> dict[str, Change]:
        """``rows`` put into the buckets they fall in, over rows of the same name there."""
        rows = written(rows)
        buckets = self._touched(rows, by)
        before = self.tables.read(name, state, buckets)
        if before is None:
            return {name: Change(rows, [by], self.buckets)}
        return {name: Change(before.join(rows, by, "left_anti").unionByName(rows), [by], self.buckets, buckets)} if buckets else {}

    def entities(self) -> DataFrame:
        """The merged entities, one row per component."""
        return finished(self.tables.read("entities"))
