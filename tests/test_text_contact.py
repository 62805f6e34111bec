import duckdb
from pyspark.sql import functions as F

from sieveline.functions import classify, contact, dims, text
from sieveline.plans.text_queries import ORACLES, QUERIES

#: examples whose results must match; fixed values
NAMES = [
    ("à la mesure du bois", "À la Mesure du Bois"), ("plomberie albert nicolas", "Plomberie Albert Nicolas"), ("l'instant immobilier", "L'Instant Immobilier"), ("chemins d'aencrage", "Chemins d'Aencrage"),
    ("dilya's cake", "Dilya's Cake"), ("le fournil de paul", "Le Fournil de Paul"), ("dupont et fils", "Dupont et Fils"), ("gms33 gironde moto services", "Gms33 Gironde Moto Services"), ("école du web", "École du Web"),
    ("marie-claire dupont", "Marie-Claire Dupont"), ("saint-jean-de-luz", "Saint-Jean-de-Luz"), ("l'atelier de maud", "L'Atelier de Maud"),
]
SAME = ["l'Atelier de Maud", "iD Verde", "eBay", "SARL MOUGIN", "SNCF", "yan daubisse electricité electricien toulon var 83 depot", "artisan peintre en batiment renovation facade et decoration interieure", "", "   ", "1234", None]


def test_display_name(one):
    assert one(text.display_name, [a for a, _ in NAMES]) == [b for _, b in NAMES]
    assert one(text.display_name, SAME) == SAME


#: fixed values
REJECTED = ["online@www.aaa.com", "only@savagex.com", "only@www.gobble.com", "contact@example.com", "contact@yourcompany.com", "x@domaine.commercedetail", "lebazarapetales@gmail.comwebmaster", "contact@sessile.fr", "sales@godaddy.com", "contact@amzn.to", "contact@wa.me", ".a@firm.fr", "a..b@firm.fr", "x@é.fr", "nothing", "", None]


def test_clean_email(one):
    assert one(contact.clean_email, REJECTED) == [None] * len(REJECTED)
    assert one(contact.clean_email, [f"{p}@vraieboite.fr" for p in dims.SUSPICIOUS_LOCAL_PARTS]) == [None] * len(dims.SUSPICIOUS_LOCAL_PARTS)
    good = [("Contact@Firm.Studio", "contact@firm.studio"), ("contact@links.isao.io", "contact@isao.io"), ("info@bruxellesformation.brussels",) * 2, ("jardin@boutique.bretagne",) * 2, ("hello@studio.agency",) * 2, ("write to jo@firm.com now", "jo@firm.com"), ("andré.dupont@firm.fr", "andre.dupont@firm.fr"), ("sœur@firm.fr", "soeur@firm.fr")]
    assert one(contact.clean_email, [a for a, _ in good]) == [b for _, b in good]


def test_guess_email(one):
    assert one(contact.guess_email, ["https://amzn.to/4kyQyQz", "https://bit.ly/abc", "https://promessedefleurs.com", "nodot", None]) == [None, None, "contact@promessedefleurs.com", None, None]


def test_lists(spark):
    df = spark.createDataFrame([(["info@a.fr", "marie@a.fr", "Contact@a.fr", "marie@a.fr", "x@aaa.com"],)], "e array<string>")
    assert df.select(contact.clean_list(F.col("e"))).first()[0] == ["marie@a.fr", "contact@a.fr", "info@a.fr"]
    assert spark.range(1).select(contact.collapse_prefixes(F.array(F.lit("a@b.co"), F.lit("a@b.com"), F.lit("z")))).first()[0] == ["a@b.co", "z"]


def test_phone_url_address(one):
    assert one(contact.norm_phone, ["06 12 34 56 78", "0033612345678", "+33 6 12 34 56 78", "12-34", "", None]) == ["+33612345678"] * 3 + ["", "", ""]
    assert one(contact.norm_url, [" HTTPS://www.Firm.fr/a/?q=1#x ", "firm.fr//", "www.firm.fr", None]) == ["firm.fr/a", "firm.fr", "www.firm.fr", ""]
    assert one(contact.host, ["https://www.wow.fr/x", "wow.fr?y", ""]) == ["wow.fr", "wow.fr", ""]
    got = one(contact.split_address, ["65 Rue de Paris, 35000 Rennes, France", "1 r, 35510 Chapelle (La)", "x 72000 Mans (Le", "9, 75001 PARIS CEDEX 01", "rien", None])
    assert [(r.postal_code, r.city) for r in got] == [("35000", "Rennes"), ("35510", "La Chapelle"), ("72000", "Le Mans"), ("75001", "PARIS"), ("", ""), ("", "")]


def test_text_extraction(one):
    assert one(contact.text_emails, ["jo@firm.fr or ann (at) shop (dot) fr and bad@example.com", None]) == [["ann@shop.fr", "jo@firm.fr"], None]
    assert one(contact.text_phones, ["06 12 34 56 78 or 0612345678 or +44 20 7946 0958"]) == [["+33612345678", "+442079460958"]]


def by_sql(name, spark, tmp_path, texts):
    """Rows of a query over documents, and those of its SQL."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, f"s{i % 2}") for i, t in enumerate(texts)])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    res = con.execute(ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in res.fetchall())


#: addresses that touch letters which are not ASCII
TOUCHING = ["otas enrrgata dotación osl", "ciónjataes dotabo", "éab@firm.fr", "ab@firm.fré", "x.éc@firm.com", "jo at shop dot fré", "e\u0301d@firm.fr", "体f@firm.fr体", "g_@firm.fr_"]


def test_addresses_end_at_ascii_borders_by_source(spark, tmp_path):
    got, want = by_sql("clean_email_list", spark, tmp_path, TOUCHING)
    assert got == want and len(got) >= 7


#: letters that are others in another case, and blanks
ODD = ["foo aroba\u017fe bar dot com", "x\u212ay at bar dot com", "a at b dot \u017fk", "jo\x0bat\x0bfirm dot fr", "f\u017foo at bar dot com", "jo\u017f@firm.fr", "a.b at cd dot com.foo at bar dot fr", "jo\tat\r\nfirm\fdot fr", "PO\u0130NT at firm.fr", "ann at f\u0131rm poınt fr"]


def test_odd_letters_of_addresses_by_document(spark, tmp_path):
    got, want = by_sql("extract_emails", spark, tmp_path, TOUCHING + ODD)
    assert got == want and len(got) >= 10


def test_guessed(spark):
    df = spark.createDataFrame([(0, "contact@boite.fr", "web"), (1, "nina@boite.fr", "web"), (2, "nina@boite.fr", "guess"), (3, None, None)], "i int, e string, s string")
    assert [r[0] for r in df.orderBy("i").select(contact.is_guessed(F.col("e"), F.col("s"))).collect()] == [True, False, True, True]


def test_classifiers(one):
    assert one(classify.trade_category, ["Plombier", "Avocat", "Fleuriste", "Ostéopathe", "Architecte d’intérieur", "Architecte", "inconnu", None]) == ["artisan", "cabinet", "commerce", "commerce", "commerce", "cabinet", "", ""]
    assert one(classify.offer_segment, ["Courtier en travaux", "Courtier", "Expert-comptable", "Diagnostic immobilier", "Agence immobilière"]) == ["", "courtier", "comptable", "", "immo"]
    assert one(classify.activity_code, ["4776z", " 43.21A ", "47.76Z", "x"]) == ["47.76Z", "43.21A", "47.76Z", "X"]
    assert one(classify.section_label, ["g", None, "Z"])[0].startswith("Commerce")
    r = one(classify.commercial_signals, ["voir https://amzn.to/x et https://instagram.com/a, ma boutique", "rien", None])
    assert r[0].monetized and r[0].reasons[0].startswith("link:") and "word:ma boutique" in r[0].reasons
    assert not r[1].monetized and not r[2].monetized


def test_send_window(spark):
    df = spark.createDataFrame([("2024-07-01 07:00:00",), ("2024-07-01 21:30:00",)], "s string").select(F.col("s").cast("timestamp").alias("t"))
    got = df.orderBy("t").select(classify.send_window(F.col("t"), 9, 18), classify.send_window(F.col("t"), 22, 6), classify.send_window(F.col("t"), 5, 5)).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False)]


def test_messages(one):
    assert one(text.unfilled_placeholder, ["a {name} b", "{{x}}", "{ no }", None]) == ["{name}", "{{x}}", "", ""]
    assert one(text.looks_like_refusal, ["Impossible de rédiger ce mail", "Bonjour", None]) == [True, False, False]
    assert one(text.edit_type, ["Transition allégée", "ton", "", "zzz"]) == ["fluidité", "ton", "", "autre"]
    r = one(text.parse_review, ['```json\n{"score": 12, "comment": "x"}\n```', 'bla {"score": 3, "verdict": "OK"} bla', "no json", None])
    assert [(x.score, x.verdict) for x in r] == [(10, "ok"), (3, "ok"), (0, "draft"), (0, "draft")]
    assert one(text.message_name, ["SARL MOUGIN (garage)", "le fournil", "iD Verde"]) == ["Sarl Mougin", "Le Fournil", "iD Verde"]
    assert one(text.first_name, ["SARL dupont", "Le Café", ""]) == ["Dupont", "Café", ""]
    r = one(text.split_answer, ["OBJET : Bonjour\n\nLe corps"])[0]
    assert (r.subject, r.body) == ("Bonjour", "Le corps")
    r = one(text.split_polluted, ["FABBI PEINTURE: Artisan peintre en bâtiment", "Dupont"])
    assert r[0].name == "FABBI PEINTURE" and r[1] is None
    assert one(text.html_text, ["<p>a&amp;b</p><script>x</script> <b>c</b>"]) == ["a&b c"]


def test_language(one):
    assert one(text.query_language, ["the video with", "la vidéo pour", "été", "", None]) == ["en", "fr", "fr", "", ""]
