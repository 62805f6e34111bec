"""Product codes against SQL, and filtering Lloyd against plain rounds."""

import hashlib

import duckdb
import numpy as np
import pytest

from helpers import SF
from sieveline.llm import on_workers
from sieveline.llm import vector_codes as vc
from test_catalogue import compare

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, error string, of int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, "i", "c", "e", 7) for i, v, x in rows], SCHEMA)


def expected(rows, entries=256, rounds=4):
    """Plain rounds over all parts and entries: ``{id: (code, error, label_error)}`` and the digest."""
    kept = [(i, v, x) for i, v, x in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 1024).astype(np.int64)
    parts = np.split(x, 4, 1)
    books = [p[:entries].copy() for p in parts]

    def near(p, b):
        d = ((p[:, None, :] - b[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p, b in zip(parts, books):
            own, _ = near(p, b)
            for j in range(len(b)):
                if (own == j).any():
                    b[j] = p[own == j].sum(0) // (own == j).sum()
    both = [near(p, b) for p, b in zip(parts, books)]
    codes = ["".join(f"{o[i]:02x}" for o, _ in both) for i in range(len(kept))]
    errors = [int(sum(d[i] for _, d in both)) for i in range(len(kept))]
    per = {}
    for (_, _, label), e in zip(kept, errors):
        per[label] = per.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted((str(r[0]), c, e, per[r[2]], digest) for r, c, e in zip(kept, codes, errors))


def check(spark, rows, **options):
    got = vc.product_codes(frame(spark, rows).repartition(3), **options).collect()
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == expected(rows, **options)


def test_sql(spark):
    on_workers(spark)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    compare(vc.op12_vector_codes(spark, SF), con, vc.SQL)


@pytest.mark.parametrize("kind", ["clusters", "equal", "grid"])
def test_plain_rounds(spark, monkeypatch, kind):
    """Ties, many equal vectors, tight clusters; blocks of a few vectors."""
    on_workers(spark)
    rng = np.random.default_rng(3)
    n = 900
    if kind == "clusters":
        x = rng.normal(size=(20, 8))[rng.integers(20, size=n)] + 0.01 * rng.normal(size=(n, 8))
    elif kind == "equal":
        x = rng.integers(0, 2, size=(n, 8)) / 1024
    else:
        x = rng.integers(-3, 4, size=(n, 8)) / 1024.0
    monkeypatch.setattr(vc, "BLOCK", 8 * 300)
    rows = [(i, [float(np.float32(c)) for c in v], [None, 1, 2, 2][i % 4]) for i, v in enumerate(x)]
    rows += [(None, rows[5][1], 1), (3, rows[9][1], None), (3, rows[9][1], None), (None, None, 1), (-5, None, 1), (2000, [0.0] * 7 + [float("nan")], 1), (2001, [0.0] * 7 + [None], 1), (2002, [float("inf")] * 8, 1), (2003, [], 1), (2004, [1.0] * 4, 1)]
    check(spark, rows, entries=64)


def test_edges(spark):
    on_workers(spark)
    assert vc.product_codes(frame(spark, [])).count() == 0
    assert vc.product_codes(frame(spark, [(1, None, 1), (2, [1.0, 2.0], 1)])).count() == 0
    check(spark, [(7, [1.0, -2.0, 3.5, 4.0], None)])
    # beyond doubles: longs
    check(spark, [(i, [float(np.float32(30000 * np.sin(i * k + 1))) for k in range(1, 9)], 1) for i in range(40)], entries=8)
    with pytest.raises(Exception, match="too large"):
        vc.product_codes(frame(spark, [(1, [1e30] * 4, 1)])).collect()


def test_filtering_rules_entries_out():
    """Tight clusters are assigned as whole subtrees, from cached sums: their points are not looked at."""
    rng = np.random.default_rng(0)
    x = (rng.permutation(np.repeat(np.arange(8), 512))[:, None] * 1000 + rng.integers(0, 3, size=(4096, 4))).astype(np.int32)
    tree = vc.Tree.build(x)
    where = tree.points[:, 0] // 1000
    tree.points = np.full_like(x, -1)
    owner, sums, counts = tree.assign((np.arange(8)[:, None] * 1000 + np.ones((1, 4))).astype(np.float64))
    assert (owner == where).all() and (counts == 512).all() and (sums.sum(0) == x.sum(0)).all()
