"""Queries of what is kept between runs: entities by batches, timers, scans that go on, tables saved as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sieveline.operators.incremental import EntityStore
from sieveline.session import checkpoint_dir, load, on_workers
from sieveline.sources import mailbox
from sieveline.streaming import events as stream
from sieveline.streaming import followups


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def incremental_merge(spark, sf_dir):
    """Customers as records that arrive in three batches, later ones bridging earlier ones: the entities after the last."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    keys = F.array(F.concat_ws(":", F.lit("a"), F.floor(k / 8).cast("string")), F.when(k % 7 == 0, F.concat_ws(":", F.lit("b"), F.floor(k / 14).cast("string"))))
    rows = c.select(
        k.alias("id"), k.alias("seq"), F.array_compact(keys).alias("keys"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("name"), F.floor("c_acctbal").alias("score"), F.col("c_mktsegment").alias("score_label"), F.col("c_nationkey").alias("subscribers"),
        F.when(F.col("c_acctbal") > 5000, "won").when(F.col("c_acctbal") < -900, "unsubscribed").otherwise("new").alias("status"), F.array(F.lower("c_mktsegment")).alias("tags"))
    store = EntityStore(spark, _folder(spark), 4)
    for batch in range(3):
        store.upsert(rows.where(k.isNotNull() & (k % 3 == batch)), f"batch {batch}")
    e = store.entities()
    return e.select("component", "n_rows", "name", "score", "score_label", "subscribers", "status", F.array_join("tags", ",").alias("tags"))


INCREMENTAL_MERGE = """
WITH RECURSIVE k AS (SELECT c_custkey AS id, 'a:' || (c_custkey // 8) AS key FROM customer UNION ALL SELECT c_custkey, 'b:' || (c_custkey // 14) FROM customer WHERE c_custkey % 7 = 0),
m AS (SELECT key, min(id) AS low FROM k GROUP BY key), e AS (SELECT id AS x, low AS y FROM k JOIN m USING (key) UNION SELECT low, id FROM k JOIN m USING (key)),
r(id, reach) AS (SELECT DISTINCT id, id FROM k UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x),
p AS (SELECT id, min(reach) AS component FROM r GROUP BY id),
t AS (SELECT component, id AS seq, CASE WHEN c_acctbal > 0 THEN c_name END AS name, floor(c_acctbal)::BIGINT AS score, c_mktsegment AS l, c_nationkey AS n, lower(c_mktsegment) AS tag,
  CASE WHEN c_acctbal > 5000 THEN 4 WHEN c_acctbal < -900 THEN 101 ELSE 0 END AS rk FROM customer JOIN p ON id = c_custkey),
g AS (SELECT component, count(*) AS n_rows, arg_min(name, seq) FILTER (name IS NOT NULL) AS name, max(score) AS score, max(n) AS subscribers, max(rk) AS rk FROM t GROUP BY component),
b AS (SELECT component, l AS score_label FROM t QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, seq) = 1),
a AS (SELECT component, string_agg(tag, ',' ORDER BY seq) AS tags FROM (SELECT component, tag, min(seq) AS seq FROM t GROUP BY ALL) GROUP BY component)
SELECT component, n_rows, name, score, score_label, subscribers, CASE rk WHEN 4 THEN 'won' WHEN 101 THEN 'unsubscribed' ELSE 'new' END AS status, tags
FROM g JOIN b USING (component) JOIN a USING (component)
"""


def _mail_kind():
    """Events as sends and ends: some clicks are sends, some purchases replies."""
    return F.when((F.col("event_type") == "click") & (F.col("value") > 50), "email_sent").when((F.col("event_type") == "purchase") & (F.col("value") > 120), "reply_detected")


def followup_timers(spark, sf_dir):
    """Users whose last send found no answer for five days, from a stream with event-time timers over the landed events."""
    on_workers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", followups.ROCKS)
    e = stream.read_events(spark, f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("entity_id"), _mail_kind().alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    due = stream.land(followups.followups(e))
    return due.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_sent", "due")})


FOLLOWUP_TIMERS = """
WITH e AS (SELECT user_id AS entity_id, ts, CASE WHEN event_type = 'click' AND value > 50 THEN 's' WHEN event_type = 'purchase' AND value > 120 THEN 'r' END AS k FROM events),
s AS (SELECT entity_id, ts, lead(ts) OVER w AS next, row_number() OVER w AS n_sent FROM e WHERE k = 's' WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
d AS (SELECT entity_id, ts AS last_sent, ts + INTERVAL 5 DAY AS due, n_sent FROM s WHERE next IS NULL OR next > ts + INTERVAL 5 DAY QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts) = 1),
r AS (SELECT entity_id, min(ts) AS stop FROM e WHERE k = 'r' GROUP BY entity_id)
SELECT entity_id, last_sent, due, n_sent FROM d LEFT JOIN r USING (entity_id)
WHERE (stop IS NULL OR stop > due) AND due < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM e WHERE k IS NOT NULL)
"""

def _landed_mail(spark, sf_dir, path, late: bool):
    """Events as messages in the folder of their type, landed as pages: those before the middle of January, or the later ones."""
    e = load(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) if late else (F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    mail = e.select(F.col("event_type").alias("folder"), (F.col("event_id") + 1).alias("uid"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.fr")).alias("from_addr"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.get_json_object("props", "$.k").alias("in_reply_to"))
    mailbox.land_pages(mail, path, 2000)


_MAIL = "SELECT event_type AS folder, event_id + 1 AS uid, 'u' || user_id || '@mail.fr' AS from_addr, 'm' || event_id AS message_id, json_extract_string(props, '$.k') AS in_reply_to FROM events"


def mail_stream(spark, sf_dir):
    """All messages by a stream whose offsets are the folders' last uids: it stops, more pages land, and it goes on."""
    on_workers(spark)
    path, out = _folder(spark), _folder(spark)
    for late in (False, True):
        _landed_mail(spark, sf_dir, path, late)
        mail = stream.land(mailbox.stream_mail(spark, path, 2000).drop("ts"), out)
    return mail


def mail_keyset(spark, sf_dir):
    """The messages of two folders above a uid: the bounds choose the pages that are opened."""
    on_workers(spark)
    path = _folder(spark)
    for late in (False, True):
        _landed_mail(spark, sf_dir, path, late)
    return mailbox.read_mail(spark, path, 2000).where("folder in ('click', 'purchase') and uid > 700").drop("ts")


MAIL_KEYSET = f"SELECT * FROM ({_MAIL}) WHERE folder IN ('click', 'purchase') AND uid > 700"

_PAIRS = ((incremental_merge, INCREMENTAL_MERGE), (followup_timers, FOLLOWUP_TIMERS), (mail_stream, _MAIL), (mail_keyset, MAIL_KEYSET))
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
