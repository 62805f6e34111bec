import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieveline.operators import entities, matching, selection
from sieveline.operators.components import connected_components
from sieveline.sources import files, sinks
from sieveline.streaming import events as stream


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert set(got[i] for i in range(61)) == {0} and set(got[k] for k in range(100, 140)) == {100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_resolve_is_order_free(spark):
    rows = [(1, ["a"]), (2, ["b"]), (3, ["a", "b"]), (4, []), (5, ["c"])]
    for r in (rows, rows[::-1]):
        got = dict(entities.resolve(spark.createDataFrame(r, "id long, keys array<string>"), "id", "keys").collect())
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_match_keys_and_find(spark):
    df = spark.createDataFrame([(["A@b.fr", "bad"], ["0612345678"], "123", "https://www.x.fr/", [("s", "9")])], "e array<string>, p array<string>, s string, w string, src array<struct<name:string,source_id:string>>")
    keys = df.select(entities.match_keys(*[F.col(c) for c in ("e", "p", "s", "w", "src")])).first()[0]
    assert keys == ["email:a@b.fr", "phone:+33612345678", "siren:123", "web:x.fr", "src:s:9"]
    new = spark.createDataFrame([(1, ["k1", "k2"]), (2, ["zz"])], "id long, keys array<string>")
    old = spark.createDataFrame([(10, ["k2"]), (11, ["k1"])], "id long, keys array<string>")
    assert dict(entities.find_first(new, old).collect()) == {1: 11, 2: None}


def test_merge_rules(spark):
    s = "component int, seq int, name string, emails array<string>, status string, score int, score_label string, subscribers long, monetized boolean, last_contact_at string, next_follow_up_at string"
    rows = [(1, 1, "", ["A@b.fr"], "qualified", 3, "x", None, False, None, "2026-01-01"), (1, 2, "X", ["a@b.fr", "c@d.fr"], "contacted", 3, "y", 5, True, "2026-07-06", "2026-02-02"), (1, 3, "Y", [], "unsubscribed", 2, "z", 4, None, "2026-07-01", None)]
    r = entities.merge(spark.createDataFrame(rows, s)).first()
    assert (r.name, r.status, r.score, r.score_label, r.subscribers, r.monetized, r.last_contact_at, r.next_follow_up_at) == ("X", "unsubscribed", 3, "x", 5, True, "2026-07-06", "2026-02-02")
    assert r.emails == ["A@b.fr", "c@d.fr"]


def test_selection_of_creators(spark, tmp_path):
    s = "entity_id int, name string, handle string, platform_url string, emails array<string>, status string, tags array<string>"
    mail, tags = ["a@b.fr"], ["site_verified"]
    rows = [(1, "Ann", None, None, mail, "new", tags), (2, " R/python", None, None, mail, "new", tags), (3, "x", "/r/x", None, mail, "new", None), (4, "x", None, "https://Reddit.com/r/x", mail, "new", []),
            (5, "x", None, "https://reddit.com/user/x?from=reddit.com/r/y", mail, "new", None), (6, "x", None, None, [" "], "new", tags), (7, None, None, None, None, "new", tags), (8, "Bob", "b", "u", mail, "qualified", tags)]
    e, none = spark.createDataFrame(rows, s), spark.createDataFrame([], "entity_id int")
    ids = lambda d: sorted(r.entity_id for r in d.collect())
    assert ids(selection.eligible_creators(e, none)) == [1, 5, 8] and ids(selection.eligible_creators(e, none, limit=2)) == [1, 5]
    assert ids(selection.eligible(e, none, only_verified=True)) == [1, 2, 8] and ids(selection.eligible(e, none, only_verified=True, limit=1)) == [1]
    yes, no, n = selection.accepted_rejected(e, f"file://{tmp_path}/split")
    assert ids(yes) == [1, 2, 3, 4, 5, 8] and ids(no) == [6, 7] and n == {"n": 8, "n_accepted": 6, "n_no_email": 2} and yes.columns == e.columns


def test_selection(spark):
    e = spark.createDataFrame([(1, ["a@b.fr"], "new"), (2, [" "], "new"), (3, ["c@d.fr"], "won"), (4, ["e@f.fr"], "qualified"), (5, ["g@h.fr"], "new")], "entity_id int, emails array<string>, status string")
    sent, drafts = spark.createDataFrame([(4,)], "entity_id int"), spark.createDataFrame([(5,)], "entity_id int")
    assert [r.entity_id for r in selection.eligible(e, sent, drafts).collect()] == [1]
    t = lambda d: dt.datetime(2026, 1, d)
    ev = spark.createDataFrame([(1, "email_sent", t(1), "a"), (2, "email_sent", t(1), "a"), (2, "email_sent", t(2), "x_relance_j5"), (3, "email_sent", t(9), "a"), (4, "other", t(1), "a")], "entity_id int, kind string, ts timestamp, template_key string")
    assert [r.entity_id for r in selection.followup_due(ev, F.lit(t(10))).collect()] == [1]


def test_numbered_and_pages(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("id"))
    got = sorted((r["rank"], r["id"]) for r in selection.numbered(df, [F.col("id")]).collect())
    assert got == [(i, i) for i in range(100)]
    small = spark.range(10)
    pages = [r.id for o in range(0, 10, 5) for r in selection.seeded_page(small, "id", 3, o, 5).collect()]
    assert sorted(pages) == list(range(10))
    assert len(selection.seeded_page(small, "id", 3, 8, 5).collect()) == 5
    assert selection.seeded_page(spark.range(0), "id", 3, 8, 5).count() == 0


def test_route_states(spark):
    m = spark.createDataFrame([(1, ""), (2, "a@x.fr"), (3, "a@y.fr"), (4, "a@z.fr")], "entity_id int, template_from string")
    s = spark.createDataFrame([("p", "b@X.fr", 0), ("q", "c@x.fr", 0), ("r", "d@y.fr", 2)], "account_id string, from_email string, remaining int")
    assert {r.entity_id: (r.state, r.account_id) for r in selection.route(m, s).collect()} == {1: ("none", None), 2: ("cap", "p"), 3: ("ok", "r"), 4: ("missing", None)}


def test_verdict(spark):
    rows = [("", "", [], [], [], "low"), ("123456789", "", ["123456789"], [], [], "high"), ("123456789", "", [], ["12345678900011"], [], "high"), ("123456789", "", ["999999999"], [], [], "reject"), ("", "35000", [], [], ["35000"], "ok"), ("", "35000", [], [], ["35111"], "low"), ("", "35000", [], [], ["75001"], "reject")]
    df = spark.createDataFrame(rows, "s string, p string, i array<string>, j array<string>, c array<string>, want string")
    none = F.array().cast("array<string>")
    got = df.select("want", matching.verdict(F.col("s"), F.col("p"), F.lit("X"), F.lit(""), none, F.col("i"), F.col("j"), F.col("c")).alias("v")).collect()
    assert all(r.want == r.v for r in got)


def test_import_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("﻿Nom;E-mail;Tél\nA;Jo@Firm.fr, info@firm.fr;06 12 34 56 78\n;;\n", encoding="utf-8")
    df = files.read_table(spark, str(p))
    assert files.suggest_mapping(df.columns) == {"name": "Nom", "emails": "E-mail", "phones": "Tél"}
    r = files.import_mapped(df, files.suggest_mapping(df.columns)).collect()
    assert len(r) == 1 or [x.name for x in r if x.name] == ["A"]
    row = next(x for x in r if x.name == "A")
    assert row.emails == ["jo@firm.fr", "info@firm.fr"] and row.phones == ["+33612345678"]
    out = str(tmp_path / "out")
    sinks.write_csv(sinks.export_rows(spark.createDataFrame([row])), out)
    back = spark.read.option("header", True).option("sep", ";").csv(out).first()
    assert (back.name, back.email, back.phone) == ("A", "jo@firm.fr", "+33612345678")
    with pytest.raises(ValueError):
        files.read_table(spark, "x.bin")


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, n string, v int")
    b = spark.createDataFrame([(2, None, 7), (3, "z", 8)], "k int, n string, v int")
    assert sorted(tuple(r) for r in sinks.upsert(a, b, "k").collect()) == [(1, "x", 5), (2, "y", 7), (3, "z", 8)]
    assert tuple(sinks.upsert_counts(a, b, "k").first()) == (1, 1, 3)


def test_articles(spark, tmp_path):
    art = "<PubmedArticle><MedlineCitation><Article><ArticleTitle>{t}</ArticleTitle><AuthorList><Author><LastName>{n}</LastName><ForeName>J</ForeName><AffiliationInfo><Affiliation>Uni. {e}.</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text("<Set>" + art.format(t="B", n="X", e="jo@uni.fr") + art.format(t="A", n="Y", e="Jo@uni.fr") + art.format(t="C", n="Z", e="none") + "</Set>")
    got = files.articles(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.email, r.title, r.author) for r in got] == [("jo@uni.fr", "A", "J Y")]


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    cols = ["event_id", "ts", "user_id", "event_type", "value"]
    batch = spark.read.parquet(src).select(*cols).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.unionByName(batch.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.read_events(spark, str(tmp_path / "in"), files_per_trigger=10)
    assert stream.land(stream.dedupe(live, late="60 days")).count() == batch.count()
    last = batch.agg(F.max("ts")).first()[0]
    w = stream.land(stream.windowed(stream.read_events(spark, str(tmp_path / "in")), ["event_type"], late="2 days"))
    want = stream.windowed(batch.unionByName(batch.limit(50)), ["event_type"]).where(F.col("end") <= F.lit(last) - F.expr("interval 2 days"))
    assert sorted((r.event_type, r.start, r.n) for r in w.collect()) == sorted((r.event_type, r.start, r.n) for r in want.collect())


def test_status_machine(spark, tmp_path):
    """Over several batches, and again with more files and the same state."""
    first = [(1, "new"), (1, "contacted"), (1, "qualified"), (2, "won"), (2, "unsubscribed"), (2, "contacted"), (3, "odd"), (None, "new"), (4, None)]
    spark.createDataFrame(first, "entity_id long, status string").repartition(4).write.parquet(str(tmp_path / "in"))
    out = stream.latest(stream.status_machine(stream.read_events(spark, str(tmp_path / "in"), files_per_trigger=1)), "entity_id")
    assert {r.entity_id: r.status for r in out.collect()} == {1: "contacted", 2: "unsubscribed", 3: "odd", None: "new", 4: None}


def test_numbered_is_a_permutation_of_a_large_table(spark):
    """More rows than one sample of range bounds settles, with a payload that pruning could drop."""
    n = 1_200_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = selection.numbered(rows, [F.col("k")])
    assert got.where("rank <> k").count() == 0 and got.select("rank").distinct().count() == n
    assert got.columns == ["k", "payload", "rank"] and selection.numbered(rows.limit(0), [F.col("k")]).count() == 0


def test_seeded_page_wraps(spark):
    rows = spark.range(20).withColumnRenamed("id", "k")
    page = lambda o, n: {r.k for r in selection.seeded_page(rows, "k", 7, o, n).collect()}
    assert len(page(17, 6)) == 6 and page(17, 6) == page(17, 3) | page(0, 3) and page(3, 50) == set(range(20))
    assert page(25, 4) == page(5, 4)


def test_without_longer(spark):
    rows = [("a", "con"), ("a", "contact"), ("a", "cont"), ("b", "contact"), (None, "x" * 3000), (None, "xxx"), ("a", "xxxx"), ("a", None)]
    got = selection.without_longer(spark.createDataFrame(rows, "source string, w string").where("w is not null"), ["source"], "w", 3)
    assert {tuple(r) for r in got.collect()} == {("a", "con"), ("b", "contact"), (None, "xxx"), ("a", "xxxx")}


def test_commercial_words_that_overlap(spark):
    from sieveline.functions import classify, dims

    text = "Ma boutique : code promo code, merch store et partenariats ; best seller-site webx, e-book pre-order"
    got = spark.createDataFrame([(text,), (None,), ("shopping boutiques",)], "t string").select(classify.commercial_signals(F.col("t")).alias("c")).collect()
    low = text.lower()
    import re

    want = ["word:" + k for k in dict.fromkeys(dims.COMMERCIAL_WORDS) if re.search(rf"(?<!\w){re.escape(k)}(?!\w)", low)]
    assert got[0].c.reasons == want[:6] and len(want) > 6 and not got[1].c.monetized and not got[2].c.monetized
