"""Conversation repair against a brute force over all edits."""

import hashlib
import random
import zlib

import pytest

from helpers import SF
from sieveline.llm import conversation_repair as cr
from sieveline.llm import on_workers

SPACE = " \t\n\x0b\x0c\r"
PATTERN = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def expected(rows):
    """``rows`` (turn, role, text) of one conversation after damage; plain search over the least (cost, letters) of every suffix."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    best = {}
    for i in range(len(rows), -1, -1):
        for left in (0, 1, 2):  # inserts that may still be made here
            for at in ("", "s", "u", "a"):
                some = []
                if i == len(rows) and at in ("", "a"):
                    some.append((0, "", ()))
                if left:
                    for role in "ua":
                        if (at, role) in PATTERN:
                            c, s, o = best[i, left - 1, role]
                            some.append((c + 5, "I" + s, ({"u": "user", "a": "assistant"}[role] + ":", *o)))
                if i < len(rows):
                    _, role, text = rows[i]
                    c, s, o = best[i + 1, 2, at]
                    some.append((c + 2, "D" + s, o))
                    if fault[i] in ("", "truncated"):
                        more = 5 if fault[i] else 0
                        if (at, role[:1]) in PATTERN:
                            c, s, o = best[i + 1, 2, PATTERN[at, role[:1]]]
                            some.append((c + more, "K" + s, (role + ":" + text, *o)))
                        for new in ("user", "assistant"):
                            if (at, new[0]) in PATTERN:
                                c, s, o = best[i + 1, 2, new[0]]
                                some.append((c + more + 1, "R" + s, (new + ":" + text, *o)))
                best[i, left, at] = min(some, default=(10**9, "", ()))
    cost, audit, out = best[0, 2, ""]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    """Plain form of the contract's damage; gives every conversation, also those without rows left."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(key.encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else text)
            own += [row] * (2 if k == 3 else 1)
    return out


def check(got, want):
    by = {r.conv_id: tuple(r[c] for c in cr._RESULT) for r in got}
    assert len(got) == len(by) == len(want)
    for conv, rows in want.items():
        assert by[conv] == expected(rows), conv


def test_query(spark):
    on_workers(spark)
    want = damage([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])
    check(cr.op13_conversation_repair(spark, SF).collect(), want)


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "admin", "sudo"])
            text = rng.choice(["", " \n", "Yes.", "No", "Why?", "what", f"t{turn}.", f"x{turn}", "a. ", "é!"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3, 0]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, pos string, conv string, letters string, gone2 boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "l", True) for r in rows], SCHEMA)


@pytest.mark.parametrize("block, parts", [(4096, "1"), (2, "5"), (3, "16"), (1, "3")])
def test_random(spark, block, parts):
    """The results do not depend on the blocks or on how the rows lie over tasks."""
    on_workers(spark)
    rows = random_rows(120, 5)
    rows += [(None, 0, "user", "null id."), (None, 1, None, None), (None, None, "assistant", None), (500, 1, "user", "long " * 30000 + "."), (500, 2, "assistant", "ok.")]
    rows += [(501, i % 7, ["user", "assistant"][i % 2], f"t{i}.") for i in range(60)] + [(502, 1, "user", "same.")] * 40
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append((r[1], r[2] or " ", r[3] if r[3] is not None else " "))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(cr.repair(frame(spark, rows), block=block).collect(), want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_edges(spark):
    on_workers(spark)
    assert cr.repair(frame(spark, [])).count() == 0
    gone = spark.createDataFrame([("a", 0, "user", "x.", True), ("b", 0, "user", "x.", True), ("b", 1, "user", "y.", None)], "conv_id string, turn int, role string, text string, gone boolean")
    got = {r.conv_id: r for r in cr.repair(gone, gone="gone").collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got["a"])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got["b"].audit == "D" and got["b"].repaired_sha256 == nothing and got["b"].cost == 2


def test_ties_take_the_least_letters():
    """One user turn that is whole: deleting it (2) is cheaper than an inserted answer (5)."""
    assert cr._whole(bytes([1]))[1] == ("D", "")
    for seed in range(300):
        rng = random.Random(seed)
        rows = [(i, rng.choice(["system", "user", "assistant", "x"]), rng.choice([f"t{i}.", f"t{i}", "", "same."])) for i in range(rng.randrange(9))]
        assert cr._repaired(rows) == expected(rows)
