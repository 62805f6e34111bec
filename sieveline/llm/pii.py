"""Personal data spans by weak supervision, on DataFrame functions only.

Each kind has a strict pattern, whose valid matches are the base spans, and wider patterns that
propose further candidates (spelled-out e-mail addresses, card-like numbers that fail the check
digit, phone numbers without a plus sign). Labellers vote on every candidate: pattern form,
check digits, a gazetteer of words that announce such data, and what stands before and after.
Expectation-maximisation on the counts of vote patterns estimates how reliable each labeller is
for the kind; the posteriors train a logistic span classifier on the votes and on features that no
labeller reads: length, separators, and the hashed word before the span. So a form of number that
stands in personal contexts is accepted where its votes alone say little. Candidates the classifier
accepts are added; base spans always stay.

Whole texts stay in the tasks that read them; what is exchanged are candidates with a few characters around.
The counts behind EM and the classifier are a group-by over votes and features with a fixed number
of values, so what reaches the driver does not grow with the corpus beyond that.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import written

KINDS = ("email", "ip", "card", "phone")
#: starts only at the left end of a run (or where the last match ended), so long runs cost one pass
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: a maximal chain of digits with single separators, if it has 13 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]{1,63}){1,6}"
NATIONAL = r"(?<![0-9+.])(?<![0-9+][ .()-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])(?![ .-][0-9])"
GAZETTEER = {
    "email": "e-?mail|mail|contact|write|courriel|correo|kontakt", "ip": "ip|host|server|address|addr|node|client",
    "card": "card|visa|mastercard|amex|payment|carte|karte|tarjeta|iban|account", "phone": "phone|tel|telephone|call|mobile|cell|fax|appeler|telefon|llame",
}
LEFT, RIGHT = 32, 4


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(body: Column) -> Column:
    """Does the check digit of the digits of ``body`` hold? Every second digit from the right is doubled."""
    digit = F.transform(F.split(F.reverse(_digits(body)), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(digit, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _digit_count() -> Column:
    return F.length(_digits(F.col("body")))


def _rules() -> list[tuple[str, str, Column, Column, bool]]:
    """Kind, pattern, what a text must have to be searched, what a match must fulfil, and whether it is a base span."""
    text, body = F.col("text"), F.col("body")
    in_range = F.forall(F.split("body", r"\."), lambda p: p.rlike("^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    many = _digit_count().between(9, 15)
    return [
        ("email", EMAIL, text.contains("@"), F.lit(True), True),
        ("ip", IP, text.rlike(r"[0-9]\.[0-9]"), in_range, True),
        # one search serves both kinds of card: those that pass the check digit, and the others
        ("card", CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), F.lit(True), True),
        ("phone", PHONE, text.rlike(r"\+[0-9]"), many, True),
        ("email", SPELLED, text.rlike(r"(?i)[\[(]at[\])]"), F.lit(True), False),
        ("phone", NATIONAL, text.rlike(r"[0-9][ .)-]"), many, False),
    ]


def _proposals(rows: DataFrame) -> DataFrame:
    """Matches of all patterns with code-point offsets, of rows ``(doc, key, text)``; once each for rows that repeat doc and key.

    Every text is searched in the task that read it, and leaves as the pieces between its matches: their
    lengths and the few characters at their ends. Whole texts are never exchanged.
    """
    none = F.array().cast("array<struct<rule:int,i:int,gap:string,body:string>>")

    def pieces(number, pattern, maybe):
        # pieces between matches and matches alternate
        both = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("body"))
        return F.when(maybe, F.transform(both, lambda x, i: F.struct(F.lit(number).alias("rule"), i.cast("int").alias("i"), x["gap"].alias("gap"), x["body"].alias("body")))).otherwise(none)

    found = [pieces(n, r[1], r[2]) for n, r in enumerate(_rules())]
    p = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc", "key", F.explode(F.concat(*found)).alias("p"))
    # a first piece without a match is a text without any
    p = p.where("p.i > 0 or p.body is not null")
    p = p.select("uid", "doc", "key", "p.rule", "p.i", "p.body", F.length("p.gap").alias("gap"), F.right("p.gap", F.lit(LEFT)).alias("left"), F.left("p.gap", F.lit(RIGHT)).alias("head"))
    order = Window.partitionBy("uid", "rule").orderBy("i")
    start = F.sum("gap").over(order) + F.coalesce(F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumns({"start": start, "right": F.coalesce(F.lead("head").over(order), F.lit(""))}).where("body is not null")
    by_rule = lambda v: reduce(lambda a, x: a.when(F.col("rule") == x[0], v(x[1])), enumerate(_rules()), F.when(F.lit(False), v(_rules()[0])))
    kind = by_rule(lambda r: F.lit(r[0]))
    base = by_rule(lambda r: luhn(F.col("body")) if r[0] == "card" else F.lit(r[4]))
    p = p.where(by_rule(lambda r: r[3])).select("doc", "key", kind.alias("kind"), "start", (F.col("start") + F.length("body")).alias("end"), "body", "left", "right", base.alias("base"))
    return p.dropDuplicates(["doc", "key", "kind", "start", "base"])


def _votes(c: DataFrame) -> tuple[DataFrame, list[str]]:
    """Votes 1 (personal), 0 (not) or null (abstain) of the labellers, as columns."""
    body, left, right, kind = F.col("body"), F.col("left"), F.col("right"), F.col("kind")
    n = F.length(_digits(body))
    low = F.lower(left)
    near = reduce(lambda a, k: a.when(kind == k, low.rlike(rf"(?:^|[^a-z])(?:{GAZETTEER[k]})[^a-z0-9]{{0,6}}$")), KINDS, F.when(F.lit(False), F.lit(False)))
    digits = F.array_distinct(F.split(_digits(body), ""))
    votes = {
        "form": F.when(F.col("base"), 1).when(kind == "phone", F.when(n.between(9, 11), F.lit(None)).otherwise(0)).otherwise(F.lit(None)),
        "check": F.when(kind == "card", F.when(luhn(body), 1).otherwise(0)).when((kind == "phone") & ~n.between(9, 15), 0),
        "gazetteer": F.when(near, 1),
        "before": F.when(left.rlike(r"[A-Za-z0-9_=#\"/.]$"), 0).when((left == "") | left.rlike(r"[\s:(,;|]$"), 1),
        "after": F.when(right.rlike(r"^[A-Za-z0-9_=\"/]"), 0).when((right == "") | right.rlike(r"^[\s),.;|!?]"), 1),
        "variety": F.when(kind.isin("card", "phone"), F.when(F.size(digits) <= 3, 0).otherwise(F.lit(None))).when(kind == "ip", F.when(body.rlike(r"^(0|127|255)\.|\.0\.0"), 0).otherwise(1)),
        "shape": F.when(kind == "card", F.when(body.rlike(r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 1)).when(kind == "phone", F.when(body.rlike(r"^\+|^\([0-9]+\)|^0[1-9]"), 1)).when(kind == "email", F.when(body.rlike(r"\.[A-Za-z]{2,}$"), 1).otherwise(0)),
    }
    return c.withColumns({f"v_{k}": v.cast("int") for k, v in votes.items()}), [f"v_{k}" for k in votes]


#: values of each feature of the span classifier
LENGTHS, SEPARATORS, CONTEXTS = 8, 16, 16
FEATURES = {"f_length": LENGTHS, "f_separators": SEPARATORS, "f_context": CONTEXTS}


def _shape(c: DataFrame) -> DataFrame:
    """Features of a candidate, each a small number: length in steps of 4, which separators it has, and a hash of the word before it."""
    body = F.col("body")
    marks = reduce(lambda a, b: a + b, [F.when(body.rlike(p), 1 << i).otherwise(0) for i, p in enumerate((r"\s", "-", r"\.", r"[()\[\]]"))])
    word = F.regexp_extract(F.lower("left"), "([a-z]+)[^a-z]*$", 1)
    hashed = F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int")
    return c.withColumns({"f_length": F.least(F.floor(F.length(body) / 4), F.lit(LENGTHS - 1)).cast("int"), "f_separators": marks.cast("int"), "f_context": F.pmod(hashed, F.lit(CONTEXTS)).cast("int")})


def _em(patterns: list[tuple[tuple, float]], rounds: int = 60) -> list[float]:
    """Posterior of each pattern; votes 0, 1, None are taken as independent given the class."""
    post = [min(0.95, max(0.05, 0.5 + 0.25 * (sum(v == 1 for v in p) - 1.5 * sum(v == 0 for v in p)))) for p, _ in patterns]
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, sum(q * n for q, (_, n) in zip(post, patterns)) / total))
        score = [math.log(prior) - math.log(1 - prior)] * len(patterns)
        for k in range(len(patterns[0][0])):
            table = {}
            for v in (0, 1, None):
                for good in (True, False):
                    mass = sum(n * (q if good else 1 - q) for q, (p, n) in zip(post, patterns) if p[k] == v)
                    table[v, good] = mass + 0.5
            whole = {g: sum(table[v, g] for v in (0, 1, None)) for g in (True, False)}
            # a labeller may be useless, not perverse
            for v in (0, 1):
                ratio = math.log(table[v, True] / whole[True]) - math.log(table[v, False] / whole[False])
                ratio = max(ratio, 0.0) if v == 1 else min(ratio, 0.0)
                score = [s + ratio if p[k] == v else s for s, (p, _) in zip(score, patterns)]
        new = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        post = new
        if done:
            break
    return post


def _columns(votes: tuple, features: tuple) -> list[int]:
    """The columns of the classifier that are 1 for a candidate: a constant, each vote that is cast, each feature's value."""
    out, at = [0], 1
    for v in votes:
        if v is not None:
            out.append(at + v)
        at += 2
    for f, n in zip(features, FEATURES.values()):
        out.append(at + f)
        at += n
    return out


def _logistic(rows: list[tuple[list[int], float, float]], size: int, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model on (columns that are 1, target, count) rows, gradient descent with AdaGrad."""
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _, _ in rows])
    col = np.concatenate([c for c, _, _ in rows])
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    n = n / n.sum()
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)), -30, 30)))
        g = np.bincount(col, (n * (p - y))[row], size) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def train(seen: list[tuple[tuple, tuple, float]]) -> np.ndarray | None:
    """Weights for one kind from ``(votes, features, count)``: EM on the votes, then the classifier on its posteriors."""
    if not seen:
        return None
    total: dict[tuple, float] = {}
    for v, _, n in seen:
        total[v] = total.get(v, 0.0) + n
    patterns = sorted(total.items(), key=str)
    post = dict(zip([p for p, _ in patterns], _em(patterns)))
    return _logistic([(_columns(v, f), post[v], n) for v, f, n in sorted(seen, key=str)], 1 + 2 * len(seen[0][0]) + sum(FEATURES.values()))


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each whole text.

    Returns one row per input row: ``id_col, n_email, n_ip, n_card, n_phone`` (base spans)``,
    base_sha256, spans, n_added``. A span is ``kind:start:end`` in code points, end exclusive;
    spans are listed by kind (email, ip, card, phone), then start, joined by commas. An added
    span never overlaps a base span or an earlier added one of its kind.

    Null text is empty. Rows that repeat id and text get equal results; rows with one id and
    different texts, or without an id, are told apart by a hash of the text. No candidate
    anywhere means no model and no added span. Empty input gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    cands, votes = _votes(_shape(_proposals(rows)))
    # candidates without their texts are a small table, read twice
    cands = written(cands.drop("left", "right", "body"))
    seen = cands.groupBy("kind", *votes, *FEATURES).agg(F.count("*").alias("n")).collect()
    accept = F.lit(0.0)
    for kind in KINDS:
        w = train([(tuple(r[v] for v in votes), tuple(r[f] for f in FEATURES), float(r["n"])) for r in seen if r["kind"] == kind])
        if w is None:
            continue
        z, at = F.lit(float(w[0])), 1
        for v in votes:
            z = z + F.when(F.col(v) == 0, float(w[at])).when(F.col(v) == 1, float(w[at + 1])).otherwise(0.0)
            at += 2
        for f, n in FEATURES.items():
            z = z + F.element_at(F.array(*[F.lit(float(x)) for x in w[at : at + n]]), F.col(f) + 1)
            at += n
        accept = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(accept)
    rank = reduce(lambda a, k: a.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    per = cands.where(F.col("base") | (accept >= threshold)).groupBy("doc", "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("b"), F.array_sort(F.collect_list(F.when(~F.col("base"), span))).alias("a"))
    free = F.filter("a", lambda x: ~F.exists("b", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    per = per.withColumn("a", free).withColumn("all", F.array_sort(F.concat("b", "a")))
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("b", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    per = per.select(F.col("doc").alias("of"), F.col("key").alias("k"), *[count(k) for k in KINDS], F.sha2(join("b"), 256).alias("base_sha256"), join("all").alias("spans"), F.size("a").cast("long").alias("n_added"))
    out = rows.select("doc", "key").join(per, F.col("doc").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc").alias(id_col), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", zero).alias("n_added"))


def op3_pii(spark, sf_dir):
    """``find_pii`` over all ``documents``; its handling of nulls, ties and repeats holds."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
