"""Repair of conversations along the tight arcs of a layered graph.

A layer stands between two turns, a node in it for each state of the role pattern ``(s?(ua)+)?``: start,
after the system turn, after a user, after an assistant. Arcs are edits: a row is kept, given the other
role or deleted, or an empty turn is inserted and the layer stays. Forward least costs from the start
and backward least costs from the accepting ends tell which arcs are *tight*, that is on some cheapest
path. The set of nodes that the cheapest paths with the least letters so far can be in is moved along
tight arcs, at each step by the least letter that any of its nodes has: so the letters are the
ASCII-least ones among all cheapest edits.

Costs are kept relative to the least one of their layer. Then they take few values, and each step of the
three passes is looked up after its first time.

Plan at scale: rows are range-sorted by conversation and turn, so a long conversation lies over several
tasks. Conversations inside a task are repaired there. Those at a task's ends, and what is longer than a
block, leave as rows: each block's effect is a 4 x 4 matrix of least costs, products of matrices give
its costs on both sides, and a map from sets of nodes to sets of nodes gives the set it begins with.
Only these blocks' summaries of one conversation meet in one task (some 200 bytes for 4,096 rows).
The digest of the repaired text is sequential by nature: a long conversation's rows run through one task
as a stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import written

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: the node after an inserted or re-roled turn
NEXT = (USER, USER, ASSISTANT, USER)
#: the node after a kept turn, by its role's initial and the node before
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIALS = "sua"
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 60
FRESH = (0, NEVER, NEVER, NEVER)
CLOSED = (0, NEVER, NEVER, 0)
BLOCK = 4096
#: a row's code: its role's initial (3: another), 4 if it is cut off, 8 if it must go
TRUNCATED, FORCED = 4, 8
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _arcs(node: int, code: int) -> list[tuple[str, int, int]]:
    """Letter, next node and cost of each edit of a row."""
    out = [("D", node, DELETE)]
    if not code & FORCED:
        more = CUT_OFF if code & TRUNCATED else 0
        if node in KEPT[code & 3]:
            out.append(("K", KEPT[code & 3][node], more))
        out.append(("R", NEXT[node], REROLE + more))
    return out


def _least(costs) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return (tuple(c - low if c < NEVER else NEVER for c in costs), low) if low < NEVER else (tuple(costs), 0)


def _inserted(costs, back: bool) -> list[int]:
    """Costs with any number of inserts at this layer."""
    costs = list(costs)
    for _ in range(3):
        for a, b in enumerate(NEXT):
            a, b = (b, a) if back else (a, b)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return costs


@lru_cache(maxsize=1 << 16)
def _forward(costs: tuple, code: int) -> tuple[tuple, int]:
    out = [NEVER] * 4
    for node, c in enumerate(costs):
        if c < NEVER:
            for _, to, add in _arcs(node, code):
                out[to] = min(out[to], c + add)
    return _least(_inserted(out, False))


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, code: int) -> tuple[tuple, int]:
    out = [min([NEVER, *(costs[to] + add for _, to, add in _arcs(node, code))]) for node in range(4)]
    return _least(_inserted(out, True))


@lru_cache(maxsize=1 << 18)
def _choose(at: frozenset, before: tuple, here: tuple, after: tuple, slack: int, slack_after: int, code: int) -> tuple[str, frozenset]:
    """The least letters up to and with this row's own, and the nodes that they can lead to."""
    said = ""
    while True:
        found: dict[str, set[int]] = {}
        for node in at:
            if before[node] + INSERT + here[NEXT[node]] == slack:
                found.setdefault("I", set()).add(NEXT[node])
            for letter, to, cost in _arcs(node, code):
                if before[node] + cost + after[to] == slack_after:
                    found.setdefault(letter, set()).add(to)
        if not found:
            return said, frozenset()
        letter = min(found)
        said, at = said + letter, frozenset(found[letter])
        if letter != "I":
            return said, at


class Layers:
    """Least costs on both sides of every layer of a run of rows."""

    def __init__(self, codes: bytes, first: tuple = FRESH, last: tuple = CLOSED):
        self.codes = codes
        f, shift = _least(_inserted(first, False))
        self.before = [(f, shift)]
        for c in codes:
            f, add = _forward(f, c)
            shift += add
            self.before.append((f, shift))
        b, shift = _least(_inserted(last, True))
        self.after = [(b, shift)]
        for c in reversed(codes):
            b, add = _backward(b, c)
            shift += add
            self.after.append((b, shift))
        self.after.reverse()
        (f, x), (b, y) = self.before[0], self.after[0]
        self.cost = min(p + q for p, q in zip(f, b)) + x + y

    def letters(self, at: frozenset) -> tuple[list[str], frozenset]:
        """Letters of each row, inserts before it included, beginning with the nodes ``at``; and the nodes at the end."""
        out = []
        for i, code in enumerate(self.codes):
            (f, x), (b, y), (b2, y2) = self.before[i], self.after[i], self.after[i + 1]
            said, at = _choose(at, f, b, b2, self.cost - x - y, self.cost - x - y2, code)
            out.append(said)
        return out, at

    def tail(self, at: frozenset) -> str:
        """Inserts after the last row of a conversation."""
        (f, x), (b, y) = self.before[-1], self.after[-1]
        said = ""
        while at and not any(n in ENDS and f[n] + x == self.cost for n in at):
            at = frozenset(NEXT[n] for n in at if f[n] + INSERT + b[NEXT[n]] == self.cost - x - y)
            said += "I"
        return said


@lru_cache(maxsize=1 << 14)
def _whole(codes: bytes) -> tuple[int, tuple[str, ...]]:
    """Cost and letters of a conversation; the last entry are the inserts at its end."""
    layers = Layers(codes)
    said, at = layers.letters(frozenset([START]))
    return layers.cost, (*said, layers.tail(at))


class Digest:
    """SHA-256 of the repaired turns, fed row by row."""

    def __init__(self):
        self.hash, self.node, self.some = hashlib.sha256(), START, False

    def _turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some = True

    def feed(self, letters: str, role: str = "", text: str = "") -> None:
        for x in letters:
            if x == "K":
                self.node = KEPT[_initial(role)][self.node]
                self._turn(role, text)
            elif x != "D":
                self.node = NEXT[self.node]
                self._turn("user" if self.node == USER else "assistant", text if x == "R" else "")


def _initial(role: str) -> int:
    i = INITIALS.find(role[:1]) if role else -1
    return i if i >= 0 else 3


def _repaired(rows: list[tuple]) -> tuple:
    """Everything about one whole conversation of ``(turn, role, text)`` rows in order."""
    seen, codes, blank, duplicate, truncated = set(), bytearray(), 0, 0, 0
    for _, role, text in rows:
        bare, code = text.strip(SPACE), _initial(role)
        if not bare:
            blank, code = blank + 1, code | FORCED
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, code | FORCED
        elif bare[-1] not in ".!?":
            truncated, code = truncated + 1, code | TRUNCATED
        seen.add((role, text))
        codes.append(code)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1], b[1][:1]) not in LEGAL for a, b in zip(rows, rows[1:]))
    cost, letters = _whole(bytes(codes))
    digest = Digest()
    for said, (_, role, text) in zip(letters, rows):
        digest.feed(said, role, text)
    digest.feed(letters[-1])
    return gaps, blank, duplicate, truncated, illegal, cost, "".join(letters), digest.hash.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [c.split()[0] for c in RESULT.split(", ")]
_ROW = ("turn", "role", "text", "gone")
#: a row's place is its task's number and, in these many bits, its number in the task
PLACES = 40


def _in_tasks(schema: pa.Schema, block: int):
    """Results of the conversations inside a task; the rows of those that may go on outside it or are longer than ``block`` rows."""

    def run(batches):
        place = TaskContext.get().partitionId() << PLACES
        # the first conversation may have begun in the task before
        held, conv, open_end, begun, out = [], None, True, False, []

        def leave():
            nonlocal place
            out.extend({"conv": conv, "pos": place + i, **dict(zip(_ROW, r))} for i, r in enumerate(held))
            place += len(held)
            held.clear()

        def sent():
            rows = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return rows

        for batch in batches:
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("conv", *_ROW))):
                if begun and c != conv:
                    if open_end:
                        leave()
                    else:
                        out.append({"conv": conv, **dict(zip(_RESULT, _repaired([r[:3] for r in held if not r[3]])))})
                        held.clear()
                    open_end = False
                begun, conv = True, c
                held.append(row)
                if len(held) >= block:
                    open_end = True
                    leave()
                if len(out) >= 1000:
                    yield sent()
            if out:
                yield sent()
        if begun:
            leave()
            yield sent()

    return run


def _matrix(codes: bytes) -> list[int]:
    """Least cost from each node before a block to each one behind it."""
    out = []
    for node in range(4):
        f, shift = _least(_inserted([0 if n == node else NEVER for n in range(4)], False))
        for c in codes:
            f, add = _forward(f, c)
            shift += add
        out += [x + shift if x < NEVER else NEVER for x in f]
    return out


def _summary(r: dict) -> dict:
    codes, initials = bytes(x["code"] for x in r["rows"]), [x["initial"] for x in r["rows"]]
    illegal = sum(p not in LEGAL for p in zip(initials, initials[1:]))
    return {"codes": codes, "matrix": _matrix(codes), "pairs": illegal, "left": initials[0], "right": initials[-1]}


def _sides(rows: list[dict]) -> list[dict]:
    """Costs on both sides of each block of a conversation, its whole cost and its illegal pairs."""
    first, firsts = FRESH, []
    for r in rows:
        firsts.append(first)
        first = tuple(min(NEVER, *(first[a] + r["matrix"][4 * a + b] for a in range(4))) for b in range(4))
    last, lasts = CLOSED, []
    for r in reversed(rows):
        lasts.append(last)
        last = tuple(min(NEVER, *(r["matrix"][4 * a + b] + last[b] for b in range(4))) for a in range(4))
    illegal = sum(r["pairs"] for r in rows) + sum((a["right"], b["left"]) not in LEGAL for a, b in zip(rows, rows[1:]))
    return [{"id": r["id"], "first": list(f), "last": list(x), "cost": last[START], "illegal": illegal, "end": r is rows[-1]} for r, f, x in zip(rows, firsts, reversed(lasts))]


def _layers(r: dict) -> Layers:
    return Layers(r["codes"], tuple(r["first"]), tuple(r["last"]))


def _moves(r: dict) -> dict:
    """The nodes behind a block for each set of nodes before it, as bits."""
    layers = _layers(r)
    return {"moves": [sum(1 << n for n in layers.letters(_nodes(m))[1]) for m in range(16)]}


def _nodes(bits: int) -> frozenset:
    return frozenset(n for n in range(4) if bits >> n & 1)


def _sets(rows: list[dict]) -> list[dict]:
    """The nodes that each block begins with."""
    at, out = 1 << START, []
    for r in rows:
        out.append({"id": r["id"], "at": at})
        at = r["moves"][at]
    return out


def _spoken(r: dict) -> dict:
    """Letters of a block's rows, with the inserts at the conversation's end as one more entry."""
    layers = _layers(r)
    said, at = layers.letters(_nodes(r["at"]))
    return {"letters": [*said, layers.tail(at)] if r["end"] else said}


def _each(df: DataFrame, fn, **new: str) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each row."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            rows = [fn(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[n] for r in rows], kinds[t]) for n, t in new.items())], [*batch.schema.names, *new])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"{n} {t}" for n, t in new.items())]))


def _by_conversation(df: DataFrame, fn, schema: str) -> DataFrame:
    """What ``fn`` makes of the ordered block summaries of each conversation."""
    return df.groupBy("conv").applyInArrow(lambda t: pa.Table.from_pylist(fn(sorted(t.to_pylist(), key=lambda r: r["id"]))), schema)


def _digests(schema: pa.Schema):
    """Audit and digest of conversations whose rows come in order, as a stream."""

    def run(batches):
        conv, begun, digest, audit = None, False, Digest(), []

        def result():
            return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hash.hexdigest()}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if begun and r["conv"] != conv:
                    yield result()
                    digest, audit = Digest(), []
                begun, conv = True, r["conv"]
                for letters in (r["letters"], r["tail"] or ""):
                    digest.feed(letters, r["role"], r["text"])
                    audit.append(letters)
        if begun:
            yield result()

    return run


def _long_ones(edges: DataFrame, kind: str, block: int) -> DataFrame:
    """Results of the conversations whose rows lie over several tasks or blocks."""
    live = edges.where("not gone").withColumn("d", F.sha2("text", 256))
    first = live.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("d").alias("e")).agg(F.min("pos").alias("seen"))
    live = live.join(first, live.conv.eqNullSafe(first.c) & (live.role == first.r) & (live.d == first.e))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("seen") != F.col("pos"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = number + F.when(fault.isin("blank", "duplicate"), FORCED).when(fault == "truncated", TRUNCATED).otherwise(0)
    live = written(live.select("conv", "pos", "turn", "role", "text", fault.alias("fault"), code.alias("code"), initial.alias("initial"), F.floor(F.col("pos") / block).alias("blk")))

    stats = live.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), *[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")])
    blocks = live.groupBy("conv", "blk").agg(F.min("pos").alias("id"), F.array_sort(F.collect_list(F.struct("pos", "code", "initial"))).alias("rows"))
    places = F.transform("rows", lambda x: x["pos"]).alias("places")
    blocks = written(_each(blocks.drop("blk"), _summary, codes="binary", matrix="array<long>", pairs="long", left="string", right="string").select("conv", "id", places, "codes", "matrix", "pairs", "left", "right"))
    sides = written(_by_conversation(blocks.select("conv", "id", "matrix", "pairs", "left", "right"), _sides, "id long, first array<long>, last array<long>, cost long, illegal long, end boolean"))
    blocks = blocks.select("conv", "id", "places", "codes").join(sides, "id")
    sets = _by_conversation(_each(blocks.select("conv", "id", "codes", "first", "last"), _moves, moves="array<long>").select("conv", "id", "moves"), _sets, "id long, at long")
    said = _each(blocks.join(sets, "id"), _spoken, letters="array<string>")
    said = written(said.select("conv", "cost", "illegal", "end", "places", F.slice("letters", F.lit(1), F.size("places")).alias("letters"), F.when(F.col("end"), F.element_at("letters", -1)).alias("tail")))
    letters = said.select(F.explode(F.arrays_zip("places", "letters")).alias("x"), F.array_max("places").alias("high"), "tail")
    letters = letters.select(F.col("x.places").alias("pos"), F.col("x.letters").alias("letters"), F.when(F.col("x.places") == F.col("high"), F.col("tail")).alias("tail"))
    texts = live.select("conv", "pos", "role", "text").join(letters, "pos")
    result = f"conv {kind}, audit string, repaired_sha256 string"
    ordered = texts.repartition("conv").sortWithinPartitions("conv", "pos")
    arrow = pa.schema([("conv", _arrow(edges, "conv")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    spoken = ordered.mapInArrow(_digests(arrow), result)
    whole = said.where("end").select(F.col("conv").alias("c1"), "cost", "illegal")
    names = edges.select("conv").distinct()
    out = names.join(stats.withColumnRenamed("conv", "c0"), F.col("conv").eqNullSafe(F.col("c0")), "left").join(whole, F.col("conv").eqNullSafe(F.col("c1")), "left")
    out = out.join(spoken.withColumnRenamed("conv", "c2"), F.col("conv").eqNullSafe(F.col("c2")), "left")
    zero, none = F.lit(0).cast("long"), {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return out.select("conv", *[F.coalesce(c, none.get(c, zero)).alias(c) for c in _RESULT])


def _arrow(df: DataFrame, col: str) -> pa.DataType:
    return df.select(col).limit(0).toArrow().schema.field(0).type


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """Faults of each conversation and its cheapest repair.

    Returns one row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` as the contract of ``op13_conversation_repair`` has them. ``gone`` names a boolean
    column of rows that only say that the conversation exists.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text.
    Null role or text count as one space. Rows without a conversation id are one conversation, with a
    null id. A turn that is no whole number raises. Repeated rows are duplicates. Only ``block`` rows of
    a conversation are held at a time; the results do not depend on it. Other columns are not read.
    Empty input gives no rows.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[conv]
    one = F.lit(" ")
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), one).alias("role"), F.coalesce(text, one).alias("text"), (F.coalesce(gone, F.lit(False)) if gone else F.lit(False)).alias("gone"))
    keys = ["conv", F.asc_nulls_first("turn"), "role", F.sha2("text", 256)]
    # the last key deals equal rows out over tasks; which of them comes first makes no difference
    dealt = r.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    form = f"conv {kind}, pos long, turn long, role string, text string, gone boolean, {RESULT}"
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([("conv", _arrow(r, "conv")), *((n, kinds[t]) for n, t in (c.split() for c in form.split(", ")[1:]))])
    found = written(dealt.mapInArrow(_in_tasks(schema, block), form))
    inside = found.where("pos is null").select("conv", *_RESULT)
    edges = found.where("pos is not null").select("conv", "pos", *_ROW)
    return inside.unionByName(_long_ones(edges, kind, block)).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults that the contract of ``op13_conversation_repair`` deals out by crc32; dropped rows stay as ``gone``."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.when(fault == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def op13_conversation_repair(spark, sf_dir):
    """``repair`` of all ``conversations``, each damaged first as ``damaged`` does; its handling of nulls, ties and repeats holds.

    A conversation of which every row was dropped has zeros, an empty audit and the digest of nothing.
    """
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")
