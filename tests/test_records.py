"""Records, templates, sites, sheets and cursors on small cases."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from sieveline.operators import records, sites, templates
from sieveline.sources import files, sheets, sinks
from sieveline.streaming import cursors


def workbook(rows, extra=()):
    """A minimal workbook: rows of (reference, kind, value)."""
    cell = lambda r, t, v: f'<c r="{r}" t="{t}"><is><t>{v}</t></is></c>' if t == "inlineStr" else f'<c r="{r}" t="{t}"><v>{v}</v></c>' if v is not None else f'<c r="{r}"/>'
    body = "".join(f'<row r="{i}">' + "".join(cell(*c) for c in row) + "</row>" for i, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="2" r:id="rId7"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Nom</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>")
        z.writestr("xl/worksheets/first.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    rows = [[("A1", "s", "0"), ("C1", "inlineStr", " E-mail "), ("AA1", "inlineStr", "n")], [("A2", "s", "1"), ("B2", "inlineStr", "no header"), ("C2", "inlineStr", "a@firm.fr"), ("AA2", "n", "12.0")], [("A3", "n", None)], [("AA4", "n", "1.5"), ("A4", "b", "1")]]
    (tmp_path / "x.xlsx").write_bytes(workbook(rows))
    (tmp_path / "empty.xlsx").write_bytes(workbook([]))
    got = files.read_table(spark, f"{tmp_path}/x.xlsx")
    assert got.columns == ["E-mail", "Nom", "n"] and sorted(tuple(r) for r in got.collect()) == [("", "True", "1.5"), ("a@firm.fr", "Anna", "12")]
    assert sheets.read_workbooks(spark, f"{tmp_path}/*.xlsx").count() == 2


def test_csv_has_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("é", "2")], "name string, b string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/out")
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith("﻿name;b\n".encode())
    assert files.read_table(spark, str(part)).columns == ["name", "b"]


def entry(e, s=""):
    return (e, s, "", "", "", "")


def test_add_emails(spark):
    kind = records.META
    rows = [(["a@x.fr"], [entry("a@x.fr")], [entry(" A@x.fr ", "web"), entry("b@x.fr"), entry("b@x.fr", "bio"), entry("bad"), entry("")]), (None, None, None), (["k@x.fr"], [], [entry("K@x.fr", "web")]), (["a@x.fr"], [entry("a@x.fr", "bio")], [entry("a@x.fr", "web")])]
    df = spark.createDataFrame(rows, f"emails array<string>, meta {kind}, found {kind}")
    got = [r.r for r in df.select(records.add_emails(F.col("emails"), F.col("meta"), F.col("found")).alias("r")).collect()]
    assert [g.emails for g in got] == [["a@x.fr", "b@x.fr"], [], ["k@x.fr"], ["a@x.fr"]]
    assert [[(m.email.strip().lower(), m.source) for m in g.meta] for g in got] == [[("a@x.fr", "web"), ("b@x.fr", "bio")], [], [("k@x.fr", "web")], [("a@x.fr", "bio")]]


def test_long_lists_of_addresses(spark):
    """The work of a record does not grow with the cube of its lists: 3,000 addresses found, a third of them known, each found twice."""
    found = [entry(f"M{i % 3000}@x.fr", "web" if i >= 3000 else "") for i in range(6000)]
    known = [entry(f"m{i}@x.fr", "file" if i % 2 else "") for i in range(0, 3000, 3)]
    df = spark.createDataFrame([([k[0] for k in known], known, found)], f"emails array<string>, meta {records.META}, found {records.META}")
    began = time.time()
    got = df.select(records.add_emails(F.col("emails"), F.col("meta"), F.col("found")).alias("r"), records.email_origin(F.col("found"), F.lit(" m7@X.fr")).alias("o"), F.size(records.gained(F.col("found.email"), F.col("emails"))).alias("n")).first()
    assert time.time() - began < 30
    assert got.r.emails == [k[0] for k in known] + [f"M{i}@x.fr" for i in range(3000) if i % 3]
    assert [(m.email, m.source) for m in got.r.meta] == [(k[0], "file") if k[1] else (k[0].upper().replace("X.FR", "x.fr"), "web") for k in known] + [(f"M{i}@x.fr", "web") for i in range(3000) if i % 3]
    assert (got.o.email, got.o.source, got.n) == ("M7@x.fr", "", 4000)


def test_json_records(spark):
    texts = ['{"name": "A", "emails_meta": [{"email": "a", "source": "WEB"}, {"source": "x"}], "score": 3.7, "subscribers": "9", "zzz": 1}', "[]", "bad", None, "{}"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(records.from_json_record(F.col("t")).alias("e")).collect()]
    assert (got[0].name, got[0].status, got[0].score, got[0].emails, [m.source for m in got[0].emails_meta]) == ("A", "new", 3, [], ["web"])
    assert got[1] is None and got[2] is None and got[3] is None and got[4].name == ""


def test_rows_and_back(spark):
    e = spark.createDataFrame([("A", ["a@x.fr"], "2024-01-02T03:04:05"), (None, None, "?")], "name string, emails array<string>, last_contact_at string")
    rows = records.to_rows(e)
    assert [r.match_keys for r in rows.collect()] == [["email:a@x.fr"], []] and rows.schema["last_contact_at"].dataType.typeName() == "timestamp"
    assert [(r.name, r.last_contact_at, r.monetized) for r in records.from_rows(rows).collect()] == [("A", "2024-01-02T03:04:05", False), ("", "", False)]


HTML = """<a href="/contact/">x</a> <a class=b href='/Contact#top'>again</a><a href="b/team">y</a> <a href="https://other.fr/p">o</a><a href="//cdn.fr/z">c</a><a href="https://other.fr/p#f">o</a>
<a href="https://www.instagram.com/me">i</a><a href="mailto:Jo@shop.fr?x">m</a><a href="page">Qui <b>est</b> l'équipe</a><a href="https://shop.fr/none">n</a> 06 12 34 56 78 zoe@far.fr"""


def test_links(spark):
    df = spark.createDataFrame([(HTML, "https://shop.fr/dir/index.html?q=1"), (None, "x"), ("", "https://shop.fr")], "html string, url string")
    got = df.select(sites.outbound_links(F.col("html"), F.col("url")).alias("o"), sites.priority_links(F.col("html"), F.col("url")).alias("p")).collect()
    assert got[0].o == ["https://other.fr/p", "https://cdn.fr/z"]
    assert got[0].p == ["https://shop.fr/contact/", "https://shop.fr/dir/page"]
    assert got[2].o == [] and got[2].p == []


def test_hubs(spark):
    hub = '<a href="https://a.fr">a</a><a href="https://b.fr">b</a><a href="https://c.fr">c</a> me@hub.fr'
    pages = spark.createDataFrame([("https://b.fr", "b1@b.fr 35000 Rennes"), ("https://c.fr", "c1@c.fr siret : 123 456 789 00012"), ("https://z.fr", "z@z.fr")], "url string, html string")
    hubs = spark.createDataFrame([("https://linktr.ee/x", hub), ("https://linktr.ee/y", "")], "url string, html string")
    got = {r.hub: r for r in sites.hub_contacts(hubs, pages).collect()}
    assert got["https://linktr.ee/x"].emails == ["b1@b.fr", "c1@c.fr", "me@hub.fr"] and got["https://linktr.ee/x"].primary_url == "https://b.fr" and got["https://linktr.ee/x"].has_legal
    assert got["https://linktr.ee/y"].emails == [] and got["https://linktr.ee/y"].primary_url is None
    assert sites.hub_contacts(hubs, pages, most_outbound=1).where("hub like '%x'").first().emails == ["me@hub.fr"]


def test_search_results(one):
    html = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Ffirm.fr%2F&amp;rut=1">x</a><a href="https://b.fr" rel="n" class="k result__a">b</a><a href="https://no.fr">n</a><a class="result__a" href="https://b.fr">b</a>'
    assert one(sites.search_results, [html, "", None]) == [["https://firm.fr/", "https://b.fr"], [], None]


def test_templates(spark):
    one = spark.range(1)
    row = one.select(templates.needs_identity(F.lit("x"), F.lit("pour {nom}"), F.lit(None).cast("string")).alias("a"), templates.chosen_model(F.lit("p"), {"p": "big"}, {"q": "small"}).alias("m"),
                     templates.unsubscribe_headers(F.lit(None).cast("map<string,string>"), F.lit("a@x.fr")).alias("h"), templates.unsubscribe_headers(F.create_map(F.lit("List-Unsubscribe"), F.lit("own")), F.lit("a@x.fr")).alias("k"),
                     templates.offer_block(F.lit(" "), F.lit("cat"), "must {offer}", "choose {offer}").alias("o"), templates.stacked_prompt(F.lit(" "), F.array().cast("array<struct<id:string,name:string,content:string>>")).alias("s")).first()
    assert row.a and row.m == "big" and row.h == {"List-Unsubscribe": "<mailto:a@x.fr?subject=unsubscribe>"} and row.k == {"List-Unsubscribe": "own"} and row.o == "choose cat" and row.s is None
    own = templates.overlay(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"), spark.createDataFrame([("b", 9)], "key string, v int"))
    assert {tuple(r) for r in own.collect()} == {("a", 1), ("b", 9)}
    items = templates.valid_library(spark.createDataFrame([("i", "n", "c"), ("j", None, "c")], "id string, name string, content string"))
    got = templates.find_item(items, spark.createDataFrame([("i",), ("x",)], "id string")).collect()
    assert {(r.id, r.name) for r in got} == {("i", "n"), ("x", None)}


def test_criteria(spark):
    a = {"q": "x", "n": None, "z": [], "k": 1}
    assert cursors.criteria_hash(a) == cursors.criteria_hash({"k": 1, "q": "x"}) != cursors.criteria_hash({"q": "x"}) and len(cursors.criteria_hash(a)) == 12
    assert cursors.shuffle_seed(a) == cursors.shuffle_seed(dict(a)) < 2**32
    t = spark.createDataFrame([("s", "h", 1)], "source string, criteria_hash string, place long")
    assert cursors.reset(t, ["s"]).count() == 0 and cursors.load(t, spark.createDataFrame([("s", "other")], "source string, criteria_hash string")).first().place is None


def test_hosted_elsewhere_and_own_site(spark):
    from sieveline.operators import completion

    cases = [("", True), (None, True), ("https://amzn.to/x", True), ("amzn.to", True), ("http://[bad", False), ("firm.fr/a", False), ("https://shop.firm.fr", False)]
    df = spark.createDataFrame(cases, "u string, want boolean")
    assert all(r.got == r.want for r in df.select("want", completion.hosted_elsewhere(F.col("u")).alias("got")).collect())
    urls = spark.createDataFrame([([None, "", "https://instagram.com/a", "https://amzn.to/x", "https://firm.fr", "https://b.fr"],), (None,), ([],)], "u array<string>")
    assert [r[0] for r in urls.select(completion.first_own_site(F.col("u"))).collect()] == ["https://firm.fr", None, None]


def test_a_record_is_repaired_once(spark):
    from sieveline.operators import completion

    s = "name string, description string, industry string, tags array<string>, verdict string, engine_down boolean, proposed_name string, proposed_industry string"
    rows = [("Bakery Paul | bread and cakes since 1950", "", "x", None, "draft", None, None, None), ("Paul", "bread", "x", ["a"], "draft", False, "Paul bread", "Bakery"), ("Paul", "", "x", None, "draft", True, "Paul", None), ("Paul", "", "x", None, None, None, "Paul", None)]
    once = completion.repaired(spark.createDataFrame(rows, s))
    got = once.collect()
    assert (got[0].name, got[0].description, got[0].repaired_fields, got[0].tags) == ("Bakery Paul", "bread and cakes since 1950", ["description", "name"], [completion.REPAIRED])
    assert (got[1].name, got[1].industry, got[1].tags) == ("Paul bread", "Bakery", ["a", completion.REPAIRED])
    assert got[2].repaired_fields is None and got[3].repaired_fields is None and got[3].tags is None
    assert completion.repaired(once.drop("repaired_fields")).where("repaired_fields is not null").count() == 0
