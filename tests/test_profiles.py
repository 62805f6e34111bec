import json

from pyspark.sql import functions as F

from sieveline.sources import profiles


def landed(spark, tmp_path, rows, schema):
    p = tmp_path / "in.json"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(p))


def test_profiles(spark, tmp_path):
    s = "platform string, id string, name string, handle string, description string, subscribers long, language string, country string, url string"
    raw = landed(spark, tmp_path, [{"platform": "kick", "id": "9", "name": "A", "description": "ma boutique https://a.fr jo@firm.fr 06 12 34 56 78"}, {"platform": "kick", "id": "", "name": "B"}, {"platform": "kick", "id": "7", "description": None}], s)
    got = profiles.from_profiles(raw).orderBy("sources").collect()
    assert len(got) == 2
    r = next(x for x in got if x.name == "A")
    assert r.emails == ["jo@firm.fr"] and r.phones == ["+33612345678"] and r.monetized and r.other_urls == ["https://a.fr"] and r.emails_meta[0].source == "profile_kick"
    assert profiles.from_profiles(raw, include_commercial=False).count() == 1


def test_registry(spark, tmp_path):
    s = "siren string, nom_complet string, nom_raison_sociale string, siege struct<numero_voie:string,type_voie:string,libelle_voie:string,code_postal:string,libelle_commune:string>, activite_principale string, section_activite_principale string"
    siege = {"numero_voie": "12", "type_voie": "RUE", "libelle_voie": "DU BOIS", "code_postal": "35000", "libelle_commune": "RENNES"}
    raw = landed(spark, tmp_path, [{"siren": "1", "nom_complet": "A", "siege": siege, "activite_principale": "47.76Z", "section_activite_principale": "G"}, {"siren": "2", "nom_raison_sociale": "B", "activite_principale": "99.99Z"}, {"siren": "", "nom_complet": "C"}, {"siren": "4"}], s)
    labels = spark.createDataFrame([("47.76Z", "Fleuriste")], "k string, v string")
    got = {r.siren: r for r in profiles.from_registry(raw, labels).collect()}
    assert set(got) == {"1", "2"} and got["1"].address == "12 RUE DU BOIS" and got["1"].industry == "Fleuriste" and got["2"].industry == "99.99Z"
    assert got["1"].description == "Fleuriste · SIREN 1 · RENNES"
    assert {r.siren: r.industry for r in profiles.from_registry(raw).collect()}["1"].startswith("Commerce")


def test_places(spark, tmp_path):
    s = "id string, displayName struct<text:string>, formattedAddress string, shortFormattedAddress string, internationalPhoneNumber string, nationalPhoneNumber string, websiteUri string, primaryType string, types array<string>, businessStatus string, rating double, userRatingCount int"
    raw = landed(spark, tmp_path, [{"id": "p", "displayName": {"text": "Café"}, "formattedAddress": "12 rue X, 35000 Rennes, France", "nationalPhoneNumber": "02", "types": ["cafe", "bar", "x"], "rating": 4.5, "userRatingCount": 3}, {"id": "q", "displayName": {"text": "Z"}, "businessStatus": "CLOSED_TEMPORARILY"}, {"id": "r"}], s)
    r = profiles.from_places(raw).collect()
    assert len(r) == 1 and (r[0].city, r[0].postal_code, r[0].phones, r[0].industry, r[0].description) == ("Rennes", "35000", ["02"], "cafe", "cafe / bar · ⭐ 4.5 (3 avis)")


def test_points(spark):
    s = "type string, id long, tags map<string,string>"
    rows = [("node", 1, {"name": "A", "contact:email": "X@a.fr; y@a.fr", "email": "x@a.fr", "website": "a.fr", "shop": "bakery", "addr:street": "R", "addr:housenumber": "3"}), ("node", 1, {"name": "A", "email": "x@a.fr"}), ("way", 2, {"name": "B"}), ("way", 3, {"email": "z@a.fr"})]
    got = profiles.from_points(spark.createDataFrame(rows[:1] + rows[2:], s)).collect()
    assert len(got) == 1 and got[0].emails == ["x@a.fr", "y@a.fr"] and got[0].website == "https://a.fr" and got[0].description == "shop=bakery\n3 R" and got[0].country == "FR"
    assert profiles.from_points(spark.createDataFrame(rows, s), require_email=False).count() == 2


def test_pages_and_feeds(spark, one):
    html = r'x "/redirect?event=a&q=https%3A%2F%2Fshop.fr%2F#t" "/redirect?a=1&q=https%3A%2F%2Fyoutube.com%2Fy" Business:\nbusiness@firm.com business@firm.comnyc'
    r = one(profiles.about_page, [html, ""])
    assert r[0].links == ["https://shop.fr"] and r[0].emails == ["business@firm.com"] and r[1].emails == []
    feed = "<rss><channel><link>https://p.fr</link><language>fr</language><itunes:owner><itunes:email> Jo@P.fr </itunes:email></itunes:owner><item><link>https://no.fr</link></item></channel></rss>"
    f = profiles.feed_head(spark.createDataFrame([(1, feed), (2, "<rss>me@x.fr"), (3, "<rss>")], "id int, body string"), "id", "body").orderBy("id").collect()
    assert [tuple(x) for x in f] == [(1, "jo@p.fr", "https://p.fr", "fr"), (2, "me@x.fr", None, None), (3, None, None, None)]
    assert one(profiles.bio_text, ["<p>a<br/>b &amp; c</p>"]) == ["a\nb & c"]
    assert one(profiles.infer_country, ["Univ. Lyon", "MIT, USA", "x", None]) == ["FR", "US", "", ""]
    assert one(profiles.legacy_status, ["À contacter", "refus", "?", None]) == ["qualified", "refused", "new", "new"]
    df = spark.createDataFrame([([("Email", "<a>x@y.fr</a>"), ("", "z"), ("n", "")],)], "f array<struct<name:string,value:string>>")
    assert df.select(profiles.join_fields(F.col("f"))).first()[0] == "Email: x@y.fr\nz"


def test_search_and_enrich(spark):
    s = "entity_id int, industry string, subscribers long, country string, language string, emails array<string>, status string, monetized boolean, description string"
    df = spark.createDataFrame([(1, "Kick", 5, "FR", "fr", ["a@b.fr"], "new", True, "d"), (2, "kick", None, "fr", "fr", [], "won", False, ""), (3, "kick", 50, "de", "de", [], None, False, None)], s)
    ids = lambda **k: sorted(r.entity_id for r in profiles.search_shared(df, **k).collect())
    assert ids() == [1, 3] and ids(only_uncontacted=False) == [1, 2, 3] and ids(platform="KICK", min_subscribers=10) == [3] and ids(country="fr", only_with_email=True, monetized_only=True) == [1]
    more = spark.createDataFrame([(1, "bio"), (3, "b2"), (3, "b1")], "entity_id int, description string")
    assert {r.entity_id: r.description for r in profiles.enrich(df, more, "entity_id").collect()} == {1: "d\nbio", 2: "", 3: "b1"}
