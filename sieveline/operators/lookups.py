"""Lookups in tables of any size: domains by suffix, phrases in texts, points within a radius, versions as of a time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import written

#: rows up to which the table looked up in is sent to every task; beyond, rows are dealt out by key
SMALL = 200_000


def _near(table: DataFrame, small: int) -> DataFrame:
    """A lookup table, sent to every task where its counted rows are few."""
    return F.broadcast(table) if table.limit(small + 1).count() <= small else table


def suffixes(host: Column) -> Column:
    """A host and what stands behind each of its dots, longest first: ``a.b.c, b.c, c``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\.+", ""), r"^www\.", "")
    labels = F.split(bare, r"\.")
    return F.when(F.coalesce(bare, F.lit("")) != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def on_list(rows: DataFrame, host: str, domains: DataFrame, domain: str = "domain", exact: bool = False, small: int = SMALL) -> DataFrame:
    """``rows`` with ``listed``: the longest listed domain that the host is or lies under, else null.

    ``exact`` takes only the host itself. Case and a leading ``www.`` make no difference. Null and empty
    hosts lie under nothing. Distinct hosts look their suffixes up by equi-join, so a list of any size
    serves, and a host that many rows share is looked up once.
    """
    hosts = rows.select(F.col(host).alias("__h")).where("__h is not null").distinct()
    own = suffixes(F.col("__h"))
    probe = hosts.select("__h", F.posexplode(F.slice(own, 1, 1) if exact else own).alias("__i", "__s"))
    known = domains.select(F.get(suffixes(F.col(domain)), F.lit(0)).alias("__s")).where("__s is not null").distinct()
    best = probe.join(_near(known, small), "__s").groupBy("__h").agg(F.min_by("__s", "__i").alias("listed"))
    return rows.join(_near(written(best), small), F.col(host) == F.col("__h"), "left").drop("__h")


def match_phrases(texts: DataFrame, phrases: DataFrame, id_col: str, tokens: Column, phrase_tokens: Column, phrase_id: str = "phrase_id", small: int = SMALL) -> DataFrame:
    """Places of dictionary phrases in texts, leftmost-longest without overlap: ``(id_col, pos, n, phrase_id)``.

    ``tokens`` and ``phrase_tokens`` are arrays of words; ``pos`` counts words from 0. Phrases with the
    same words are one, by the smallest id; phrases without words are in no text. Rows that share an id
    are searched as texts of their own and give their places together, null ids too.

    The dictionary is grouped by first word: a text's word finds the lengths worth trying there, and only those
    n-grams meet the phrases, by equi-join. Chains of overlapping places are resolved each by itself.
    """
    p = phrases.select(F.col(phrase_id).alias("__p"), phrase_tokens.alias("__t")).where(F.size("__t") > 0)
    p = written(p.groupBy(F.array_join("__t", " ").alias("gram")).agg(F.min("__p").alias("__p"), F.first("__t").alias("__t")))
    firsts = p.groupBy(F.col("__t")[0].alias("word")).agg(F.array_sort(F.collect_set(F.size("__t"))).alias("lengths"))
    most = p.agg(F.max(F.size("__t"))).first()[0] or 0
    t = texts.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), tokens.alias("w"))
    at = t.select("uid", "id", F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.slice(F.col("w"), i + 1, most).alias("ahead")))).alias("pos", "x")).select("uid", "id", "pos", "x.word", "x.ahead")
    tried = at.join(_near(firsts, small), "word").select("uid", "id", "pos", F.explode(F.filter("lengths", lambda n: n <= F.size("ahead"))).alias("n"), "ahead")
    grams = tried.select("uid", "id", "pos", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("gram"))
    hits = grams.join(_near(p.select("gram", "__p"), small), "gram").select("uid", "id", "pos", "n", "__p")
    # one exchange by text serves all that follows: the longest at each place, chains, and their resolution
    order = Window.partitionBy("uid").orderBy("pos", F.desc("n"))
    hits = hits.withColumn("last", F.lag("pos").over(order)).where("last is null or last <> pos").drop("last")
    before = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("reach", F.max(F.col("pos") + F.col("n")).over(before))
    chain = F.sum(F.when(F.coalesce(F.col("reach") <= F.col("pos"), F.lit(True)), 1).otherwise(0)).over(Window.partitionBy("uid").orderBy("pos"))
    hits = hits.withColumn("chain", chain)
    per = hits.groupBy("uid", "id", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "__p"))).alias("xs"))
    # a chain is as long as phrases overlap; each place is taken where the one taken last ends before it
    start = F.struct(F.lit(0).alias("end"), F.array().cast(dict(per.dtypes)["xs"]).alias("out"))
    step = lambda a, x: F.when(x["pos"] >= a["end"], F.struct((x["pos"] + x["n"]).alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    taken = per.select("id", F.explode(F.aggregate("xs", start, step)["out"]).alias("x"))
    return taken.select(F.col("id").alias(id_col), "x.pos", "x.n", F.col("x.__p").alias(phrase_id))


METRES = 111_320.0
EARTH = 6_371_000.0


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points on the sphere (haversine)."""
    return _arc(lat2 - lat1, lng2 - lng1, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))


def _half(d: Column) -> Column:
    return F.pow(F.sin(F.radians(d) / 2), F.lit(2))


def _arc(lat: Column, lng: Column, cos1: Column, cos2: Column) -> Column:
    """Metres between points by the differences of their degrees and the cosines of their latitudes."""
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), _half(lat) + cos1 * cos2 * _half(lng))))


def within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs ``(left_id, right_id, metres)`` of points at most ``metres`` apart; both sides have ``id, lat, lng``.

    Bands of latitude half as high as the radius are cut into cells about as wide, a whole number of them
    round the earth. A right point lies in one cell; a left point looks into the cells that its circle touches, some
    22 unless it is near a pole, in a sort-merge equi-join: a task holds one cell's right points, in memory or spilled,
    and adaptive execution can split a hot cell. Rows with a null or impossible coordinate pair with nothing.

    The chord between points on the unit sphere, three products, decides; only where it is so near the
    radius that rounding matters does the exact distance. That is worked out once for each pair that is returned.
    """
    # degrees of latitude, with more than rounding can take away
    reach = min(180.0, math.degrees(metres / EARTH) * (1 + 1e-9) + 1e-9)
    high = max(reach / 2, 1e-7)
    valid = "lat between -90 and 90 and lng between -180 and 180"
    farthest = lambda b: F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(b * high), F.abs((b + 1) * high)))))
    cells = lambda b: F.greatest(F.lit(1), F.floor(360 / (high / F.greatest(F.lit(1e-6), farthest(b)))))
    cell = lambda lng, n: F.floor((lng + 180) / (360 / n))
    band = lambda lat: F.floor(lat / high)
    key = F.col("band") * F.lit(2**32) + F.col("cell")
    phi, lam = F.radians("lat"), F.radians("lng")
    point = lambda i: [F.col("lat").alias(f"lat{i}"), F.col("lng").alias(f"lng{i}"), F.cos(phi).alias(f"cos{i}"), (F.cos(phi) * F.cos(lam)).alias(f"x{i}"), (F.cos(phi) * F.sin(lam)).alias(f"y{i}"), F.sin(phi).alias(f"z{i}")]
    r = right.where(valid).withColumn("band", band(F.col("lat"))).withColumn("n", cells(F.col("band"))).withColumn("cell", F.pmod(cell(F.col("lng"), F.col("n")), F.col("n")))
    r = r.select(F.col("id").alias("right_id"), *point(2), key.alias("key"))
    l = left.where(valid).withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(-90.0), F.col("lat") - reach)), band(F.least(F.lit(90.0), F.col("lat") + reach)))))
    # what the band's distance leaves of the radius, as degrees of longitude
    near = F.greatest(F.lit(0.0), F.col("band") * high - F.col("lat") - 1e-9, F.col("lat") - (F.col("band") + 1) * high - 1e-9)
    left_over = F.greatest(F.lit(0.0), _half(F.lit(reach)) - _half(near)) / F.greatest(F.lit(1e-30), F.cos(phi) * farthest(F.col("band")))
    l = l.withColumns({"n": cells(F.col("band")), "wide": F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), left_over)))) * (1 + 1e-9) + 1e-9})
    l = l.withColumns({"first": cell(F.col("lng") - F.col("wide"), F.col("n")), "last": cell(F.col("lng") + F.col("wide"), F.col("n"))})
    l = l.withColumn("cell", F.explode(F.when(F.col("last") - F.col("first") + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.sequence("first", "last"))))
    l = l.withColumn("cell", F.pmod("cell", "n")).select(F.col("id").alias("left_id"), *point(1), key.alias("key"))
    chord = reduce(lambda a, b: a + b, [(F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"])
    limit = 2 * math.sin(min(metres / EARTH, math.pi) / 2)
    surely, may = max(0.0, limit * (1 - 1e-9) - 1e-12) ** 2, (limit * (1 + 1e-9) + 1e-12) ** 2
    arc = _arc(F.col("lat2") - F.col("lat1"), F.col("lng2") - F.col("lng1"), F.col("cos1"), F.col("cos2"))
    pairs = l.join(r.hint("merge"), "key").where((chord <= may) & ((chord < surely) | (arc <= metres)))
    return pairs.select("left_id", "right_id", arc.alias("metres"))


def spiral_number(x: Column, y: Column) -> Column:
    """The number of cell ``(x, y)`` on the square spiral of ``score.spiral``, in closed form: no grid is made.

    A ring's rows come first, by x and top before bottom, then its sides, by y and right before left.
    """
    r = F.greatest(F.abs(x), F.abs(y))
    rows = 2 * (x + r) + F.when(y < 0, 1).otherwise(0)
    sides = 2 * (2 * r + 1) + 2 * (y + r - 1) + F.when(x < 0, 1).otherwise(0)
    inside = F.pow(2 * r - 1, F.lit(2)).cast("long")
    return F.when(r == 0, F.lit(0).cast("long")).otherwise(inside + F.when(F.abs(y) == r, rows).otherwise(sides)).cast("long")


def spiral_cell(lat: Column, lng: Column, lat0: float, lng0: float, step_m: float) -> Column:
    """The spiral cell that a point falls in, of cells ``step_m`` wide around a centre."""
    north = (lat - lat0) * METRES
    east = (lng - lng0) * METRES * F.greatest(F.lit(0.01), F.cos(F.radians(F.lit(lat0))))
    at = lambda m: F.floor(m / step_m + 0.5)
    return spiral_number(at(east), at(north))


def newest_within(requests: DataFrame, versions: DataFrame, key: str, ts: str, age_seconds: int, version: str = "version", split: int = 4) -> DataFrame:
    """``requests`` with ``version, version_ts``: the newest version of its key not after it and at most ``age_seconds`` older, else nulls.

    Of versions with one key and time the largest counts. Null keys and times have no version.

    Time is cut into ``split`` buckets an age. A request looks into its own bucket; of each earlier
    bucket that may matter only the newest version is carried on. So a hot key is spread over its time,
    and a window holds one bucket of one key.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    wide, age = max(1, age_seconds * 1_000_000 // split), age_seconds * 1_000_000
    v = versions.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("__k"), us.alias("__us"), F.col(version).alias("__v"), F.col(ts).alias("__ts"), F.floor(us / wide).alias("__b"))
    v = v.groupBy("__k", "__b", "__us").agg(F.max(F.struct("__v", "__ts")).alias("__x"))
    last = v.groupBy("__k", "__b").agg(F.max_by("__x", "__us").alias("__x"), F.max("__us").alias("__us"))
    carried = last.select("__k", F.explode(F.sequence(F.col("__b") + 1, F.col("__b") + age // wide + 1)).alias("__b"), "__us", "__x")
    both = v.select("__k", "__b", "__us", "__x").unionByName(carried)
    r = requests.select(F.col(key).alias("__k"), us.alias("__us"), F.floor(us / wide).alias("__b"), F.struct("*").alias("__row"))
    w = Window.partitionBy("__k", "__b").orderBy("__us", "__q").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumns({"__q": F.lit(0), "__row": F.lit(None).cast(dict(r.dtypes)["__row"])}).unionByName(r.withColumns({"__q": F.lit(1), "__x": F.lit(None).cast(dict(v.dtypes)["__x"])}), allowMissingColumns=True)
    seen = F.last(F.when(F.col("__q") == 0, F.struct(F.col("__us").alias("at"), F.col("__x").alias("x"))), ignorenulls=True).over(w)
    out = met.withColumn("__seen", seen).where("__q = 1")
    ok = (F.col("__us") - F.col("__seen.at") <= age) & F.col("__k").isNotNull()
    return out.select("__row.*", F.when(ok, F.col("__seen.x.__v")).alias("version"), F.when(ok, F.col("__seen.x.__ts")).alias("version_ts"))
