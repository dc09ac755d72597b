"""Lookups that join: typed rates, key ladders, fuzzy keys, sector ranges, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import fuzzy, scalar


def last_rate(rates: DataFrame, keys: list[str], rate: str, seq: str) -> DataFrame:
    """One rate for each key: the last loaded wins."""
    return rates.where(scalar.positive(F.col(rate)).isNotNull()).groupBy(*keys).agg(F.max_by(F.col(rate), F.col(seq)).alias(rate))


def typed_rates(rates: DataFrame, keys: list[str], kind: str, rate: str, seq: str) -> DataFrame:
    """keys..., kind, rate, default_rate: the largest rate of each kind, and the key's default: the last Residential one, else the first loaded."""
    ok = rates.where(scalar.positive(F.col(rate)).isNotNull())
    k = ok.groupBy(*keys, kind).agg(F.max(rate).alias(rate))
    res = F.when(F.col(kind) == "Residential", F.col(seq))
    d = ok.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(F.col(kind) == "Residential", F.col(rate)), res), F.min_by(rate, seq)).alias("default_rate"))
    return k.join(d, keys)


def unwrapped_rate(typed: Column, residential: Column, default: Column, *more: Column) -> Column:
    """The first rate that is there and not zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in (typed, residential, default, *more)])


def expanded_sectors(df: DataFrame, column: str, most: int | None = None, span: int = 200) -> DataFrame:
    """A row for each sector named in ranges and lists: '99 TO 110', '33,34,37A', '16-17', '23-23A', '17 (P)'. Text without a sector gives no row.

    Adds ``sector`` ('Sector 37A'); numbers above ``most``, if given, are dropped, and so are ranges that run
    backwards; one of more than ``span`` numbers is no range, and gives its two ends.
    """
    t = F.regexp_replace(F.regexp_replace(F.upper(F.col(column)), r"\([^)]*\)", " "), r"\bSEC(?:TOR)?S?\b\.?", " ")
    parts = F.filter(F.split(F.regexp_replace(t, r"\s+(?:TO|&|AND)\s+|\s*-\s*", "-"), r"[,/;]|\s{1,}"), lambda p: p.rlike(r"^\d{1,3}[A-Z]?(-\d{1,3}[A-Z]?)?$"))

    def one(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"-(\d+)", 1).try_cast("int")
        plain = p.rlike(r"^\d+-\d+$")
        numbers = F.transform(F.sequence(lo, F.greatest(lo, F.coalesce(hi, lo))), lambda n: n.cast("string"))
        return F.when(plain & (hi > lo) & (hi - lo <= F.lit(span)), numbers).when(plain & (hi < lo), F.array().cast("array<string>")).otherwise(F.split(p, "-"))

    names = F.array_distinct(F.filter(F.flatten(F.transform(parts, one)), lambda s: F.regexp_extract(s, r"^(\d+)", 1).try_cast("int").between(1, most if most is not None else 2**31 - 1)))
    return df.withColumn("sector", F.explode(F.transform(names, lambda s: F.concat(F.lit("Sector "), s))))


def key_ladder(locality: Column) -> Column:
    """array<struct(level, key)> of the keys under which a locality may be found, best first: itself, its comma parts, without a sector at its end, its bare sector, without the sector."""
    k = scalar.locality_form(locality)
    level = lambda n, c: F.when(c.isNotNull() & (c != ""), F.struct(F.lit(n).alias("level"), c.alias("key")))
    comma = F.transform(F.split(k, r"\s*,\s*"), lambda p, i: F.struct((F.lit(10) + i).alias("level"), F.trim(p).alias("key")))
    sector = F.nullif(F.regexp_extract(k, r"(sector \d+[a-z]?)", 1), F.lit(""))
    out = F.array(level(0, k), level(30, F.trim(F.regexp_replace(k, r"[,\s]*sector \d+[a-z]?$", ""))), level(40, sector), level(50, F.trim(F.regexp_replace(k, r"sector \d+[a-z]?", ""))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(out, F.filter(comma, lambda x: x["key"] != "")), lambda x: x.isNotNull())))


def ladder_lookup(pairs: DataFrame, rates: DataFrame, *, fuzzy_from: float | None = 82.0) -> DataFrame:
    """city, locality, rate, level of each distinct pair: the rate found under its best key; level 100 is a fuzzy match, NULL none.

    ``rates``: city, locality, rate. Each distinct pair explodes into its keys, which are equi-joined, so no level rescans the rates. Pairs
    that no key finds, bare sectors apart, are compared by ``token_sort_ratio`` with all localities of their city: each distinct pair once,
    behind ``near_pairs``' bounds, which lose none. The best from ``fuzzy_from`` on wins, the first by name among equals.
    """
    p = pairs.select("city", "locality").where("city is not null and locality is not null").distinct()
    r = rates.select(scalar.collapsed(F.col("city")).alias("rc"), scalar.locality_form(F.col("locality")).alias("rk"), "rate").where("rate > 0").groupBy("rc", "rk").agg(F.max("rate").alias("rate"))
    keys = p.withColumn("k", F.explode(key_ladder(F.col("locality")))).select("city", "locality", "k.level", "k.key")
    hit = keys.join(r, (scalar.collapsed(F.col("city")) == F.col("rc")) & (F.col("key") == F.col("rk"))).groupBy("city", "locality").agg(F.min_by("rate", F.struct("level", "key")).alias("rate"), F.min("level").alias("level"))
    out = p.join(hit, ["city", "locality"], "left")
    if fuzzy_from is None:
        return out
    form = scalar.locality_form(F.col("locality"))
    left = out.where("rate is null").select("city", "locality", form.alias("f")).where(~F.col("f").rlike(r"^sector \d+[a-z]?$"))
    mine = left.where("f <> ''").select(scalar.collapsed(F.col("city")).alias("fc"), "f").distinct().withColumn("p", fuzzy.sorted_tokens(F.col("f")))
    theirs = r.withColumn("q", fuzzy.sorted_tokens(F.col("rk")))
    near = fuzzy.near_pairs(mine, theirs, "p", "q", fuzzy_from / 100, (F.col("fc") == F.col("rc")))
    near = near.withColumn("score", fuzzy.indel_ratio_of_pairs("p", "q")).where(F.col("score") >= fuzzy_from)
    best = near.groupBy("fc", "f").agg(F.max_by("rate", F.struct(F.col("score"), F.transform(F.split("rk", ""), lambda ch: -F.ascii(ch)))).alias("fuzzy_rate"))
    best = left.join(best, (scalar.collapsed(F.col("city")) == F.col("fc")) & (left.f == best.f)).select("city", "locality", "fuzzy_rate")
    return out.join(best, ["city", "locality"], "left").select("city", "locality", F.coalesce("rate", "fuzzy_rate").alias("rate"), F.coalesce("level", F.when(F.col("fuzzy_rate").isNotNull(), 100)).alias("level"))


def nearest_names(names: DataFrame, choices: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """name, choice, score: for each distinct name the choice with the best matching-blocks ratio from ``cutoff`` on, the last by name among equals.

    Every choice counts: the matching blocks hold no more characters than the two have in common, so ``near_pairs`` loses none. The ratio
    is taken from the choice to the name, as ``difflib.get_close_matches`` does.
    """
    a = names.select(F.col(names.columns[0]).alias("name")).where("name is not null").distinct()
    b = choices.select(F.col(choices.columns[0]).alias("choice")).where("choice is not null").distinct()
    scored = fuzzy.near_pairs(a, b, "name", "choice", cutoff).withColumn("score", fuzzy.matching_blocks_ratio("choice", "name")).where(F.col("score") >= cutoff)
    return scored.groupBy("name").agg(F.max(F.struct("score", "choice")).alias("m")).select("name", "m.choice", "m.score")


def resolved_locality(requests: DataFrame, localities: DataFrame, least_overlap: float = 0.3) -> DataFrame:
    """city, wanted, locality, tier: 0 exact, 1 one name inside the other (closest length), 2 most common words; rows without any are left out.

    ``requests``: city, wanted. ``localities``: city, locality.
    """
    wanted = requests.select(F.col("city").alias("scope"), F.col("wanted").alias("q")).distinct()
    x = _scored(wanted, localities.select(F.col("city").alias("scope"), "locality").distinct()).select(F.col("scope").alias("city"), F.col("q").alias("wanted"), "locality")
    a, b = scalar.collapsed(F.col("wanted")), scalar.collapsed(F.col("locality"))
    overlap = fuzzy.token_overlap(a, b)
    tier = F.when(a == b, 0).when(F.contains(b, a) | F.contains(a, b), 1).when(overlap > least_overlap, 2)
    tie = F.when(tier == 1, F.abs(F.length(a) - F.length(b)).cast("double")).otherwise(-overlap)
    return x.withColumn("tier", tier).where("tier is not null").groupBy("city", "wanted").agg(F.min_by(F.struct("locality", "tier"), F.struct("tier", tie, "locality")).alias("m")).select("city", "wanted", "m.locality", "m.tier")


def gazetteer_hit(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id, locality: the longest gazetteer name of its city that stands in a text as whole words. ``texts``: id, city, text.

    Runs of words of the text, up to the length of the longest name, are equi-joined to the names, so a text is not compared with every name.
    Runs a job.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    t = texts.select("id", "city", words.alias("w"))
    g = gazetteer.select("city", "locality", F.trim(F.regexp_replace(F.lower("locality"), r"[^\p{L}\p{N}]+", " ")).alias("run")).distinct()
    longest = g.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 1
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))).otherwise(F.array().cast("array<string>"))))
    t = t.select("id", "city", F.explode(F.array_distinct(runs)).alias("run"))
    return t.join(g, ["city", "run"]).groupBy("id").agg(F.max_by("locality", F.struct(F.length("run"), "locality")).alias("locality"))


def override_report(missing: DataFrame, overrides: DataFrame) -> DataFrame:
    """city, locality, rate, listings, status: known overrides kept, new missing pairs added, each with the listings it concerns."""
    m = missing.groupBy("city", "locality").agg(F.count("*").alias("listings"))
    x = m.join(overrides.select("city", "locality", "rate"), ["city", "locality"], "full_outer")
    status = F.when(F.col("rate").isNotNull(), "override").otherwise("missing")
    return x.select("city", "locality", "rate", F.coalesce("listings", F.lit(0)).cast("long").alias("listings"), status.alias("status"))


# ---------------------------------------------------------------- rates of every shape, as one table


def rate_table(rates: DataFrame) -> DataFrame:
    """city, locality, kind, rate, default_rate of rates in load order (``readers.with_order``): the largest of each kind; the default is the last Residential one, else the first loaded. Rates without a kind are Residential."""
    from plinth.operators.keys import rate_city, rate_class

    x = rates.select(rate_city(F.col("city")).alias("city"), scalar.locality_form(F.col("locality")).alias("locality"), F.coalesce(rate_class(F.col("property_type")), F.lit("Residential")).alias("kind"), "rate", "seq")
    return typed_rates(x, ["city", "locality"], "kind", "rate", "seq")


def rate_entries(table: DataFrame) -> DataFrame:
    """city, locality, rates, default_rate: each place's rates as a map by kind."""
    return table.groupBy("city", "locality").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "rate")))).alias("rates"), F.first("default_rate").alias("default_rate"))  # one entry for each of a handful of kinds


def resolved_rate(rates: Column, default: Column, kind: Column | None = None) -> Column:
    """A place's rate for a kind, else its Residential one, its default, its Commercial one, else any."""
    own = [rates[kind]] if kind is not None else []
    return F.coalesce(*own, rates["Residential"], default, rates["Commercial"], F.get(F.map_values(rates), F.lit(0)))


def merged_cities(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """city, locality, rates, default_rate for each distinct city of ``requests``: the rates of the cities it is looked up under; the first city's rate of a kind wins.

    ``entries``: as ``rate_entries`` gives them.
    """
    from plinth.operators.keys import rate_cities

    want = requests.select("city").distinct().select("city", F.posexplode(rate_cities(F.col("city"))).alias("rank", "key"))
    x = want.join(entries.withColumnRenamed("city", "key"), "key").select("city", "locality", "rank", "default_rate", F.explode("rates").alias("kind", "rate"))
    k = x.groupBy("city", "locality", "kind").agg(F.min_by("rate", "rank").alias("rate"), F.min_by("default_rate", "rank").alias("d"), F.min("rank").alias("rank"))
    return k.groupBy("city", "locality").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "rate")))).alias("rates"), F.min_by("d", "rank").alias("default_rate"))


_SECTOR = r"\bsec(?:tor)?[.\-\s]*(\d{1,3}[a-z]?)\b"
# Words that do not tell one locality from another.
_COMMON_WORDS = ["sector", "sec", "block", "phase", "extension", "extn", "ext"]


def composite_score(q: Column, c: Column, ratio: Column) -> Column:
    """The likeness of a wanted and a known locality: 1000 for equals, else ``ratio`` (the best of three similarities) with what common words, sectors and beginnings add or take."""
    words = lambda x: F.filter(F.array_distinct(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " ")), lambda w: (w != "") & ~w.isin(*_COMMON_WORDS))
    common, own = F.size(F.array_intersect(words(q), words(c))), F.size(words(q))
    shared = F.when(own > 0, common / own * 28.0 + F.when(common == own, 10.0).otherwise(0.0)).otherwise(0.0)
    a, b = F.nullif(F.regexp_extract(q, _SECTOR, 1), F.lit("")), F.nullif(F.regexp_extract(c, _SECTOR, 1), F.lit(""))
    sector = F.when(a.isNull(), 0.0).when(b.isNull(), -10.0).when(a == b, 35.0).otherwise(-25.0)
    begins = F.when(F.startswith(c, q), 12.0).when(F.contains(c, q), 6.0).otherwise(0.0)
    return F.when(q == c, 1000.0).otherwise(ratio + shared + sector + begins)


def slug_score(q: Column, c: Column, ratio: Column) -> Column:
    """The likeness of two locality slugs: 100 for equals, else ``ratio`` (matching blocks, 0 to 1) in percent, 12 for one inside the other, 8 for a beginning, up to 20 for common words."""
    words = lambda x: F.array_distinct(F.split(x, "_"))
    shared = F.size(F.array_intersect(words(q), words(c))) / F.size(words(q)) * 20.0
    return F.when(q == c, 100.0).otherwise(ratio * 100.0 + F.when(F.contains(c, q), 12.0).otherwise(0.0) + F.when(F.startswith(c, q), 8.0).otherwise(0.0) + shared)


def _scored(wanted: DataFrame, known: DataFrame, salts: int = 16) -> DataFrame:
    """Distinct wanted names (scope, q) against all names (scope, c) of their scope, in blocks: the stated query set, each distinct pair once."""
    x = wanted.withColumn("__s", F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int"))
    y = known.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.join(y, ["scope", "__s"]).drop("__s")


def composite_lookup(requests: DataFrame, entries: DataFrame, *, least: float = 72.0, kind: Column | None = None) -> DataFrame:
    """city, locality, found, score, rate of each distinct request: the place of its city with the same name, else the one of the best composite score of ``least`` or more; requests without any are left out.

    ``requests``: city, locality. ``entries``: as ``merged_cities`` gives them for those cities. Equal names are joined first; only the distinct
    names that are left meet the names of their city. Ties go to the first by name.
    """
    r = requests.where("city is not null").select("city", "locality", scalar.collapsed(F.col("locality")).alias("q")).where("q is not null and q <> ''").distinct()
    e = entries.select(F.col("city").alias("scope"), F.col("locality").alias("c"), resolved_rate(F.col("rates"), F.col("default_rate"), kind).alias("rate"))
    same = r.join(e, (r.city == e.scope) & (r.q == e.c)).select("city", "q", "c", F.lit(1000.0).alias("score"), "rate")
    rest = r.select(F.col("city").alias("scope"), "q").distinct().join(same.select(F.col("city").alias("scope"), "q"), ["scope", "q"], "left_anti")
    pair = _scored(rest, e)
    pair = pair.withColumn("score", composite_score(F.col("q"), F.col("c"), fuzzy.best_of_three("q", "c"))).where(F.col("score") >= least)
    best = pair.groupBy("scope", "q").agg(F.min_by(F.struct("c", "score", "rate"), F.struct((-F.col("score")).alias("s"), "c")).alias("m")).select(F.col("scope").alias("city"), "q", "m.*")
    hit = same.unionByName(best)
    return r.join(hit, ["city", "q"]).select("city", "locality", F.col("c").alias("found"), "score", "rate")


def trend_locality(requests: DataFrame, series: DataFrame, *, least: float = 70.0) -> DataFrame:
    """city, locality, found, score: the series of the request's city with the same slug, else the best ``slug_score`` of ``least`` or more; a city without any series is compared with all.

    ``requests``, ``series``: city, locality. Ties go to the first slug.
    """
    from plinth.operators.keys import forecast_city

    r = requests.select("city", "locality").distinct().withColumns({"ck": forecast_city(F.col("city")), "q": scalar.slug(F.col("locality"))}).where("q <> ''")
    s = series.select(forecast_city(F.col("city")).alias("scope"), scalar.slug(F.col("locality")).alias("c"), F.col("locality").alias("found")).where("c <> ''").groupBy("scope", "c").agg(F.min("found").alias("found"))
    cities = s.select("scope").distinct().withColumn("__has", F.lit(True))
    r = r.join(cities, r.ck == cities.scope, "left").withColumn("own", F.coalesce("__has", F.lit(False))).drop("scope", "__has").withColumn("scope", F.when(F.col("own"), F.col("ck")).otherwise(F.lit("*")))
    every = s.unionByName(s.withColumn("scope", F.lit("*"))).groupBy("scope", "c").agg(F.min("found").alias("found"))
    same = r.join(every, (r.scope == every.scope) & (r.q == every.c)).select(r.scope, "q", "c", "found", F.lit(100.0).alias("score"))
    rest = r.select("scope", "q").distinct().join(same.select("scope", "q"), ["scope", "q"], "left_anti")
    pair = _scored(rest, every)
    pair = pair.withColumn("score", slug_score(F.col("q"), F.col("c"), fuzzy.matching_blocks_ratio("q", "c"))).where(F.col("score") >= least)
    best = pair.groupBy("scope", "q").agg(F.min_by(F.struct("c", "found", "score"), F.struct((-F.col("score")).alias("s"), "c")).alias("m")).select("scope", "q", "m.*")
    return r.join(same.unionByName(best), ["scope", "q"]).select("city", "locality", "found", "score")


def suggestions(queries: DataFrame, localities: DataFrame, *, least: float = 40.0, k: int = 8) -> DataFrame:
    """city, q, locality, score, place: for each typed text the ``k`` localities of its city with the best composite score of ``least`` or more, ties by name."""
    from pyspark.sql import Window as W

    q = queries.select(F.col("city").alias("scope"), scalar.collapsed(F.col("q")).alias("q")).where("q <> ''").distinct()
    c = localities.select(F.col("city").alias("scope"), scalar.collapsed(F.col("locality")).alias("c")).distinct()
    x = _scored(q, c).withColumn("score", composite_score(F.col("q"), F.col("c"), fuzzy.best_of_three("q", "c"))).where(F.col("score") >= least)
    x = x.withColumn("place", F.row_number().over(W.partitionBy("scope", "q").orderBy(F.desc("score"), "c"))).where(F.col("place") <= k)
    return x.select(F.col("scope").alias("city"), "q", F.col("c").alias("locality"), "score", "place")


def place_of_text(listings: DataFrame, gazetteer: DataFrame, *, least: float = 80.0) -> DataFrame:
    """id, place, score: the place of each listing, with its sector appended where the name has none.

    ``listings``: id, city, locality, address, description. A present locality stays. Else the longest name of the city's gazetteer that
    stands in the description or the address (score 200 and its length; the description wins ties); texts without one are cut at commas,
    and a part that is like a name (``token_sort_ratio`` of ``least`` or more) gives it; else the sector alone. Rows without any are left out.
    """
    sector = lambda c: F.nullif(F.concat(F.lit("Sector "), F.upper(F.regexp_extract(c, r"(?i)\bsec(?:tor)?[\s.\-]*(\d{1,3}[a-z]?)\b", 1))), F.lit("Sector "))
    own = F.nullif(F.trim("locality"), F.lit(""))
    x = listings.select("id", "city", own.alias("own"), F.coalesce(sector(F.col("address")), sector(F.col("description"))).alias("sector"), "address", "description")
    g = gazetteer.select("city", "locality").distinct()
    need = x.where("own is null")
    whole = lambda c: gazetteer_hit(need.select("id", "city", F.col(c).alias("text")), g).select("id", "locality", (200 + F.length("locality")).cast("double").alias("score"))
    hits = whole("description").withColumn("from", F.lit(0)).unionByName(whole("address").withColumn("from", F.lit(1)))
    exact = hits.groupBy("id").agg(F.min_by(F.struct("locality", "score"), F.struct((-F.col("score")).alias("s"), "from", "locality")).alias("m")).select("id", "m.*")
    parts = need.join(exact, "id", "left_anti").select("id", "city", F.explode(F.split(F.lower(F.concat_ws(",", "description", "address")), r"[,;.\n|]")).alias("p"))
    parts = parts.select("id", "city", F.trim(F.regexp_replace("p", r"[^\p{L}\p{N}]+", " ")).alias("p")).where("length(p) between 4 and 60")  # a name is no longer
    mine = parts.select(F.col("city").alias("fc"), "p").distinct().withColumn("a", fuzzy.sorted_tokens(F.col("p")))
    theirs = g.select(F.col("city").alias("rc"), "locality", fuzzy.sorted_tokens(F.col("locality")).alias("b"))
    near = fuzzy.near_pairs(mine, theirs, "a", "b", least / 100, F.col("fc") == F.col("rc")).withColumn("score", fuzzy.indel_ratio_of_pairs("a", "b")).where(F.col("score") >= least)
    best = near.groupBy("fc", "p").agg(F.min_by(F.struct("locality", "score"), F.struct((-F.col("score")).alias("s"), "locality")).alias("m")).select(F.col("fc").alias("city"), "p", "m.*")
    like = parts.join(best, ["city", "p"]).groupBy("id").agg(F.min_by(F.struct("locality", "score"), F.struct((-F.col("score")).alias("s"), "locality")).alias("m")).select("id", "m.*")
    found = x.join(exact.unionByName(like), "id", "left").withColumn("name", F.coalesce("own", "locality"))
    place = F.when(F.col("name").isNull(), F.col("sector")).when(F.lower("name").contains("sector") | F.col("sector").isNull(), F.col("name")).otherwise(F.concat_ws(", ", "name", "sector"))
    return found.select("id", place.alias("place"), F.coalesce("score", F.when(F.col("own").isNotNull(), 1000.0)).alias("score")).where("place is not null")


def rates_for_listings(listings: DataFrame, table: DataFrame, donors_km: float | None = 5.0, *, typed: bool = True, drop_unresolved: bool = True) -> DataFrame:
    """id, rate, source: a rate for each listing by its place, else by the nearest listing that has one.

    ``listings``: id, city, locality, kind, lat, lon. ``table``: as ``rate_table`` gives it. ``typed`` asks for the listing's kind, else the
    place's default counts. ``donors_km`` bounds the nearest donor (of the same city, else of any); None sets no bound. Unresolved listings
    are dropped or kept with NULL. Each distinct place and kind is looked up once. Runs jobs.
    """
    from plinth.operators.nearest import nearest_any, tiered_fill
    from plinth.session import written

    e = rate_entries(table)
    rate = resolved_rate(F.col("rates"), F.col("default_rate"), F.col("kind") if typed else None)
    places = listings.select("city", "locality", "kind").distinct()
    keys = places.withColumn("k", F.explode(key_ladder(F.col("locality")))).select("city", "locality", "kind", "k.level", "k.key")
    hit = keys.join(e, (scalar.collapsed(keys.city) == e.city) & (keys.key == e.locality)).select(keys.city.alias("c"), keys.locality.alias("l"), keys.kind.alias("k"), "level", rate.alias("rate")).groupBy("c", "l", "k").agg(F.min_by("rate", "level").alias("value"))
    x = listings.join(hit, (F.col("city") == F.col("c")) & (F.col("locality") == F.col("l")) & F.col("kind").eqNullSafe(F.col("k")), "left").select("id", scalar.collapsed(F.col("city")).alias("city"), "lat", "lon", "value")
    x = written(x, "rates")  # read by each search for donors
    fill = tiered_fill(x, [["city"], []], donors_km) if donors_km is not None else nearest_any(x)
    out = x.join(fill.select("id", F.col("value").alias("near")), "id", "left").select("id", F.coalesce("value", "near").alias("rate"), F.when(F.col("value").isNotNull(), "place").when(F.col("near").isNotNull(), "nearest").alias("source"))
    return out.where("rate is not null") if drop_unresolved else out
