"""The status of an entity as a state machine in a stream, with a timer for the follow-up.

Events wait in the key's state until the watermark has passed them and are then applied in order of time,
so what a batch brings out of order makes no difference. A send sets the timer; a reply or an end before
it runs out stops it for good; a further send moves it. When it runs out the entity is due, once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SENT, STOP = "email_sent", ("reply_detected", "unsubscribed", "bounced", "won", "lost", "followup_sent")
DUE = "entity_id long, last_sent_us long, due_us long, n_sent long"


class FollowUp(StatefulProcessor):
    """Per entity: events that wait for the watermark, and ``(last send, number of sends, closed, time to be forgotten)``."""

    def __init__(self, wait_us: int, forget_us: int | None):
        self.wait, self.forget = wait_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, kind string")
        self.machine = handle.getValueState("machine", "last_us long, n_sent long, closed boolean, forget_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        machine = self.machine.get()
        if not (machine and machine[2]):
            for r in rows:
                self.waiting.appendValue((r.us, r.kind))
                # a timer stands for all events of its millisecond
                self.handle.registerTimer(r.us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, n, closed, forget = self.machine.get() or (None, 0, False, None)
        if closed:
            if forget is not None and forget < now:
                self.machine.clear()
            return
        ready, later = [], []
        for us, kind in self.waiting.get():
            (ready if us < now else later).append((us, kind))
        due = None
        # at one time, an end comes before a send
        for us, kind in sorted(ready, key=lambda e: (e[0], e[1] == SENT)):
            if last is not None and last + self.wait < us:
                due = last + self.wait
            elif kind != SENT:
                closed = True
            if due is not None or closed:
                break
            last, n = us, n + 1
        if due is None and not closed and last is not None:
            if last + self.wait < now:
                due = last + self.wait
            else:
                self.handle.registerTimer((last + self.wait) // 1000 + 1)
        closed = closed or due is not None
        if closed or not later:
            self.waiting.clear()
        elif ready:
            self.waiting.put(later)
        if closed and self.forget is not None:
            forget = now + self.forget
            self.handle.registerTimer(forget // 1000 + 1)
        self.machine.update((last, n, closed, forget))
        if due is not None:
            yield Row(entity_id=key[0], last_sent_us=last, due_us=due, n_sent=n)

    def close(self) -> None:
        pass


def followups(events: DataFrame, days: int = 5, late: str = "1 day", forget_days: int | None = None) -> DataFrame:
    """``(entity_id, last_sent, due, n_sent)`` of entities whose last send got no answer for ``days``; each at most once.

    ``events`` is a stream with ``entity_id`` (a number), ``kind`` and ``ts``; ``email_sent`` sets the timer, the
    kinds in ``STOP`` end the entity's course, others do nothing. Rows without an entity, a kind or a time
    are left out. ``late`` is how far events may come out of order. ``forget_days`` drops the state of an
    entity so long after its course has ended (in event time; a time to live by the clock cannot stand beside
    event-time timers): a later send starts a new course. The session must use the RocksDB state store (``ROCKS``).

    Time advances with sends and ends alone. Only they reach the state; events of a closed entity leave nothing there.
    """
    e = events.where(F.col("kind").isin(SENT, *STOP) & F.col("entity_id").isNotNull() & F.col("ts").isNotNull())
    e = e.select(F.col("entity_id").cast("long").alias("entity_id"), "kind", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    machine = FollowUp(days * 86_400_000_000, None if forget_days is None else forget_days * 86_400_000_000)
    out = e.groupBy("entity_id").transformWithState(machine, DUE, "Append", "EventTime")
    return out.select("entity_id", F.timestamp_micros("last_sent_us").alias("last_sent"), F.timestamp_micros("due_us").alias("due"), "n_sent")


def followups_of_all(events: DataFrame, until: Column, days: int = 5) -> DataFrame:
    """The same from a table of all events at once: who is due by ``until``. Each entity's sends pass one window."""
    e = events.where(F.col("kind").isin(SENT, *STOP) & F.col("entity_id").isNotNull() & F.col("ts").isNotNull()).select("entity_id", "kind", "ts")
    wait = F.make_dt_interval(F.lit(days))
    stop = e.where(F.col("kind") != SENT).groupBy("entity_id").agg(F.min("ts").alias("stop")).withColumnRenamed("entity_id", "of")
    w = Window.partitionBy("entity_id").orderBy("ts")
    sent = e.where(F.col("kind") == SENT).select("entity_id", "ts", F.lead("ts").over(w).alias("next"), F.row_number().over(w).cast("long").alias("n_sent"))
    silent = sent.where(F.col("next").isNull() | (F.col("next") > F.col("ts") + wait)).groupBy("entity_id").agg(F.min(F.struct("ts", "n_sent")).alias("s"))
    due = silent.select("entity_id", F.col("s.ts").alias("last_sent"), (F.col("s.ts") + wait).alias("due"), F.col("s.n_sent").alias("n_sent"))
    due = due.join(stop, F.col("entity_id") == F.col("of"), "left").where((F.col("stop").isNull() | (F.col("stop") > F.col("due"))) & (F.col("due") < until))
    return due.drop("of", "stop")
