"""Who is due: eligibility, follow-ups, quotas, assignment and routing. Every order is explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sieveline.functions import dims
from sieveline.functions.contact import is_social
from sieveline.session import written


def anti_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones; null keys stay."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def has_email(emails: str = "emails") -> Column:
    """Is one of the addresses not blank?"""
    return F.exists(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.trim(e) != "")


def is_group_account(name: Column, handle: Column, url: Column) -> Column:
    """Does the account stand for a community (``r/...``) and not for a person?"""
    patterns = ((name, dims.GROUP_NAME), (handle, dims.GROUP_HANDLE), (url, dims.GROUP_URL))
    return reduce(lambda a, b: a | b, [F.coalesce(c.rlike(p), F.lit(False)) for c, p in patterns])


def eligible(entities: DataFrame, sent: DataFrame, drafts: DataFrame | None = None, id_col: str = "entity_id", only_verified: bool = False, limit: int | None = None) -> DataFrame:
    """Entities with an e-mail, a fresh status, nothing sent and no draft waiting.

    ``entities`` has ``emails`` and ``status``, and ``tags`` for ``only_verified``; ``sent`` and
    ``drafts`` need ``id_col`` only. ``limit`` takes the smallest ids.
    """
    out = entities.where(has_email() & F.col("status").isin("new", "qualified"))
    if only_verified:
        out = out.where(F.array_contains("tags", "site_verified"))
    out = anti_known(out, sent, id_col)
    out = anti_known(out, drafts, id_col) if drafts is not None else out
    return out.orderBy(id_col).limit(limit) if limit is not None else out


def eligible_creators(entities: DataFrame, sent: DataFrame, drafts: DataFrame | None = None, id_col: str = "entity_id", limit: int | None = None) -> DataFrame:
    """As ``eligible``, without group accounts; ``entities`` has ``name, handle, platform_url`` too."""
    own = entities.where(~is_group_account(F.col("name"), F.col("handle"), F.col("platform_url")))
    return eligible(own, sent, drafts, id_col, limit=limit)


def observed(rows: DataFrame, rules: dict[str, Column], name: str = "run") -> tuple[DataFrame, Observation]:
    """``rows`` with ``rejected_for``, and counts that Spark takes while they pass: ``n``, ``n_accepted`` and ``n_<rule>``.

    A row is rejected for the first rule in order that does not hold for it (null counts as not); null means
    accepted. The counts are there (``observation.get``) once the frame has been written, in that one pass:
    neither rows nor counts are read twice.
    """
    reason = reduce(lambda a, x: F.when(~F.coalesce(x[1], F.lit(False)), x[0]).otherwise(a), reversed(rules.items()), F.lit(None).cast("string"))
    seen = Observation(name)
    counts = [F.count("*").alias("n"), F.count_if(F.col("rejected_for").isNull()).alias("n_accepted"), *[F.count_if(F.coalesce(F.col("rejected_for") == k, F.lit(False))).alias(f"n_{k}") for k in rules]]
    return rows.withColumn("rejected_for", reason).observe(seen, *counts), seen


def accepted_rejected(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows with an e-mail, rows without, and the counts ``n, n_accepted, n_no_email`` of the one pass that wrote both under ``path``."""
    tagged, seen = observed(rows, {"no_email": has_email()})
    tagged.withColumn("__accepted", F.col("rejected_for").isNull()).drop("rejected_for").write.partitionBy("__accepted").parquet(path)
    back = rows.sparkSession.read.schema(", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("__accepted", "boolean")])).parquet(path)
    return back.where("__accepted").drop("__accepted"), back.where("not __accepted").drop("__accepted"), seen.get


def followup_due(events: DataFrame, as_of: Column, days: int = 5, id_col: str = "entity_id", suffix: str = "_relance_j5") -> DataFrame:
    """Entities whose last send lies strictly more than ``days`` back and that had no follow-up yet.

    ``events`` has ``kind, ts, template_key``; only ``email_sent`` counts. One pre-aggregated shuffle.
    """
    sent = events.where("kind = 'email_sent'").groupBy(id_col).agg(F.max("ts").alias("last_sent"), F.bool_or(F.coalesce(F.col("template_key").endswith(suffix), F.lit(False))).alias("followed"))
    return sent.where(~F.col("followed") & (F.col("last_sent") < as_of - F.make_dt_interval(F.lit(days)))).select(id_col, "last_sent")


def rolling_count(events: DataFrame, by: list[str], ts: str = "ts", hours: int = 24) -> DataFrame:
    """Adds ``n_window``: events of the group in the ``hours`` up to and including each event.

    Time is cut into buckets of ``hours``; a window holds one bucket of a group and the times at which the
    events of the bucket before it leave (its halo). So a group of any size is spread over its time, a task holds what two
    buckets hold, and one running sum of comings and goings serves all its rows: no frame is counted
    anew for each event. Rows without a time count those without one.
    """
    wide = hours * 3600 * 1_000_000
    r = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__bucket", F.floor(F.col("__us") / wide))
    halo = r.where("__us is not null").select(*by, (F.col("__us") + wide + 1).alias("__us"), (F.col("__bucket") + 1).alias("__bucket"), F.lit(-1).alias("__step"))
    both = r.withColumn("__step", F.lit(1)).unionByName(halo, allowMissingColumns=True)
    bucket = Window.partitionBy(*by, "__bucket")
    moved = F.sum("__step").over(bucket.orderBy("__us").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # all of the halo is there when the bucket begins
    return both.withColumn("n_window", moved + F.count_if(F.col("__step") < 0).over(bucket)).where("__step > 0").drop("__us", "__bucket", "__step")


def running_total(rows: DataFrame, by: list[str], order: list[Column], amount: Column, name: str = "total") -> DataFrame:
    """Adds the sum of ``amount`` in the group up to each row in ``order``, whatever a group's size.

    Two levels of prefix sums: rows are range-sorted by group and order and written, so a large group lies
    over several parts; each part sums its own stretch, and adds what the group's parts before it sum to,
    a table with a row for each part and group in it. ``order`` must be total for equal results in every run.
    """
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(by)}
    dealt = rows.withColumn("__amount", amount).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sums = dealt.groupBy(*[v.alias(k) for k, v in keys.items()], F.col("__part").alias("__p")).agg(F.sum("__amount").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.withColumn("__before", earlier).where("__before is not null").drop("__sum")
    own = F.sum("__amount").over(Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.col("__part") == F.col("__p"))
    out = dealt.withColumn("__own", own).join(before, same, "left")
    return out.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__amount", "__at", "__part", "__own", "__before", "__p", *keys)


def daily_counts(events: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return events.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: Column, hot: bool = False) -> DataFrame:
    """The first ``cap`` rows of each group; ``cap`` may be a column, constant within a group.

    ``hot`` numbers the rows by ``running_total``, for groups that no task should hold; ``order`` must then be total.
    """
    if hot:
        return running_total(rows, by, order, F.lit(1).cast("long"), "slot").where(F.col("slot") <= cap)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= cap)


def running_quota(rows: DataFrame, by: list[str], order: list[Column], amount: Column, quota: Column, hot: bool = False) -> DataFrame:
    """Rows of each group while the running sum of ``amount`` stays within ``quota``; ``hot`` as for ``capped``."""
    if hot:
        return running_total(rows, by, order, amount, "used").where(F.col("used") <= quota)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(amount).over(w)).where(F.col("used") <= quota)


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the global row number, from 0, without one task sorting everything.

    Rows are range-partitioned by ``order`` and numbered inside their partition by Spark's own
    running id, then written once: both the rows and the partitions' offsets (a row for each
    partition, so the broadcast is bounded by their number) are read from that table. ``order``
    must be total for the numbers to be the same in every run.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    r = written(r).withColumn("__part", F.shiftright("__at", 33))
    sizes = r.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__part").alias("__of"), F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return r.join(F.broadcast(before), r["__part"] == before["__of"]).withColumn(name, F.col("__off") + F.expr("__at & 8589934591L")).drop("__at", "__part", "__of", "__off")


def stable_bucket(key: Column, buckets: Column | int) -> Column:
    """The bucket of a key by the first 8 hex digits of its md5: the same everywhere and always."""
    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), n)


def seeded_page(rows: DataFrame, id_col: str, seed: int, offset: int, size: int) -> DataFrame:
    """A page of a shuffled listing that wraps around at the end; the order follows from id and seed.

    Places come from ``numbered``, so a page deep in the listing costs no task more than one partition.
    """
    key = F.md5(F.concat_ws("|", F.col(id_col), F.lit(seed)).cast("binary"))
    placed = numbered(rows, [key, F.col(id_col)], "__place")
    total = F.lit(placed.count())
    return placed.where(F.pmod(F.col("__place") - F.lit(offset), total) < size).drop("__place")


def without_longer(rows: DataFrame, by: list[str], col: str, least: int = 1) -> DataFrame:
    """Distinct rows ``(*by, col)`` whose ``col`` has no proper prefix, of ``least`` letters or more, among its group's.

    The distinct rows are written once. Each string looks up its prefixes by equi-join, only at lengths that
    some string of the group has, in one pass: a string and the prefixes of others that equal it meet under
    one key, and whoever brought the prefix goes. No group is gathered anywhere.
    """
    own = written(rows.select(*by, col).distinct())
    n = F.length(col)
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(by)}
    lengths = own.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.array_sort(F.collect_set(n)).alias("__ns"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.lit(True))
    probe = own.join(lengths, same).select(*by, F.col(col).alias("__whole"), F.explode(F.filter("__ns", lambda k: (k >= least) & (k < n))).alias("__n"))
    probe = probe.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.left("__whole", F.col("__n")).alias("__p"), "__whole")
    longer = probe.join(own, same & (F.col(col) == F.col("__p")), "left_semi").select(*keys, "__whole").distinct()
    return own.join(longer, same & (F.col(col) == F.col("__whole")), "left_anti")


def send_order(guessed: Column, tags: Column, seq: Column, redo: str = "redo") -> list[Column]:
    """Confirmed addresses first, then those to be redone, then by sequence."""
    return [guessed.cast("int"), F.when(F.array_contains(tags, redo), 0).otherwise(1), seq]


def route(messages: DataFrame, senders: DataFrame) -> DataFrame:
    """The sender of each message: ``(entity_id, template_from, state, account_id)``.

    ``messages`` has ``entity_id, template_from``; ``senders`` has ``account_id, from_email,
    remaining``. No required address gives state ``none``; no sender with that address or domain
    ``missing``; none with quota left ``cap`` and the first of them; else ``ok`` and one of those with
    quota, by the entity's stable bucket over their number. Equi-joins only: a domain's accounts are
    counted and numbered, and each message looks up its one number.
    """
    domain = lambda c: F.lower(F.substring_index(c, "@", -1))
    m = messages.select("entity_id", "template_from", domain(F.col("template_from")).alias("d"))
    s = senders.select("account_id", domain(F.col("from_email")).alias("d"), "remaining")
    has = F.col("remaining") > 0
    per = s.groupBy("d").agg(F.count_if(has).alias("free"), F.min("account_id").alias("first"))
    free = s.where(has).select("d", "account_id", (F.row_number().over(Window.partitionBy("d").orderBy("account_id")) - 1).cast("long").alias("i"))
    out = m.join(per, "d", "left").withColumn("i", F.when(F.col("free") > 0, stable_bucket(F.col("entity_id"), F.col("free"))))
    out = out.join(free, ["d", "i"], "left")
    state = F.when(F.coalesce(F.trim("template_from"), F.lit("")) == "", "none").when(F.col("free").isNull(), "missing").when(F.col("free") == 0, "cap").otherwise("ok")
    return out.select("entity_id", "template_from", state.alias("state"), F.when(state == "cap", F.col("first")).when(state == "ok", F.col("account_id")).alias("account_id"))


def enrichment_candidates(entities: DataFrame, most: int | None = None) -> DataFrame:
    """Entities without an e-mail that have a site of their own, or a name and a city; in id order if capped."""
    none = ~F.exists(F.coalesce("emails", F.array().cast("array<string>")), lambda e: F.trim(e) != "")
    url = F.exists(F.coalesce("other_urls", F.array().cast("array<string>")), lambda u: ~is_social(u)) | (F.coalesce("website", F.lit("")) != "")
    named = (F.coalesce("name", F.lit("")) != "") & (F.coalesce("city", F.lit("")) != "")
    out = entities.where(none & (url | named))
    return out.orderBy("entity_id").limit(most) if most else out
