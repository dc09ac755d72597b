"""Free-typed places mapped to a reference list by token repair and soft TF-IDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.index import edit_join
from plinth.llm.places import place_tokens, plain_words
from plinth.session import bounded_broadcast, written


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(s: pd.Series) -> pd.Series:
    return s.map(lambda x: list(place_tokens(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda x: list(plain_words(x)))


def token_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``<column>_tokens`` for each column. Apply it to distinct values: it calls Python once a row."""
    return df.withColumns({f"{c}_tokens": _tokens(F.col(c)) for c in columns})


def _numbered(c: Column) -> Column:
    return c.rlike(r"\d")


def match_places(pairs: DataFrame, reference: DataFrame, *, threshold: float = 0.75) -> DataFrame:
    """city, locality, locality_id, score: the reference entry that each distinct (city, locality) means, -1 if none.

    ``reference``: locality_id, city, locality. Each distinct typed token, and each two neighbouring tokens
    together, is joined to the reference vocabulary by edit distance (``edit_join``); the vocabulary holds each
    entry's words, its words written together, and the cities, so a name typed without spaces is repaired as well.
    Entries that share a repaired name word are ranked by soft TF-IDF: the sum over the entry's words of idf times the
    best similarity of a typed token, over the idf of the entry's words. Tokens with numbers (sector 77a, phase 2) must
    agree exactly on both sides. The city, as repaired from either field, must be the entry's; without a readable city
    the best entry of any city counts, if it is alone.

    A score under ``threshold`` or a tie between entries gives -1. Null, blank and ``nan`` localities are left out.
    Repeated pairs give one row. Empty input gives an empty result; an empty reference gives -1 throughout. Runs jobs.
    """
    empty = F.array().cast("array<string>")
    typed = pairs.select("city", "locality").where(F.col("locality").isNotNull() & ~F.lower(F.trim("locality")).isin("", "nan")).distinct()
    typed = token_columns(typed.withColumns({"pair": F.xxhash64("city", "locality"), "plain_words": F.concat(_plain("city"), _plain("locality"))}), "city", "locality")
    typed = written(typed, "typed")
    ref = written(token_columns(reference.select("locality_id", "city", "locality"), "city", "locality").select("locality_id", F.array_join("city_tokens", "").alias("ref_city"), "locality_tokens"), "reference")
    total = ref.count()

    # the vocabulary: words, an entry's words without their spaces, and cities
    plain = F.filter("locality_tokens", lambda t: ~_numbered(t))
    kinds = F.concat(
        F.transform(plain, lambda t: F.struct(t.alias("entry"), F.array(t).alias("parts"), F.lit(False).alias("is_city"))),
        F.array(F.struct(F.array_join(plain, "").alias("entry"), plain.alias("parts"), F.lit(False).alias("is_city")), F.struct(F.col("ref_city").alias("entry"), F.array("ref_city").alias("parts"), F.lit(True).alias("is_city"))),
    )
    vocabulary = written(ref.select(F.inline(kinds)).where("entry <> ''").groupBy("entry").agg(F.max_by("parts", F.struct(~F.col("is_city"), F.size("parts"))).alias("parts"), F.max("is_city").alias("is_city")), "vocabulary")
    weight = ref.select(F.explode(F.array_distinct("locality_tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    entries = ref.select("locality_id", "ref_city", F.posexplode("locality_tokens").alias("at", "token")).join(weight, "token").withColumn("idf", F.log(F.lit(float(max(total, 1))) / F.col("df") + 1.0))
    entries = entries.groupBy("locality_id", "ref_city").agg(F.array_sort(F.collect_list(F.struct("at", "token", "idf", "df"))).alias("words"))
    # words that many entries share, such as kinds and phases, rank entries but propose only those that have no other
    telling = F.transform(F.filter("words", lambda w: (w["df"] <= max(3.0, total / 40)) & ~w["token"].startswith("phase ")), lambda w: w["token"])
    rarest = F.array(F.array_min(F.transform("words", lambda w: F.struct(w["df"].alias("df"), w["token"].alias("token"))))["token"])  # an entry of nothing but such words
    proposed = written(entries.withColumn("lead", F.explode(F.array_distinct(F.when(F.size(telling) > 0, telling).otherwise(rarest)))), "entries")

    both = lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.get(F.col(c), i - 1), F.get(F.col(c), i)))).otherwise(empty)
    where = lambda words, field: F.transform(words, lambda t: F.struct(t.alias("word"), F.lit(field).alias("field")))
    slots = F.concat(where(F.col("city_tokens"), 0), where(both("city_tokens"), 0), where(F.col("locality_tokens"), 1), where(both("locality_tokens"), 1), where(F.col("plain_words"), 1))
    slot = typed.select("pair", F.explode(F.array_distinct(slots)).alias("s")).select("pair", "s.word", "s.field")
    words = slot.where(~_numbered(F.col("word"))).select("word").distinct()
    close = edit_join(words, vocabulary.select("entry")).join(vocabulary, "entry").select("word", "entry", "parts", "is_city", "distance", (1 - F.col("distance") / F.greatest(F.length("word"), F.length("entry"))).alias("sim"))
    close = written(close.groupBy("word").agg(F.collect_list(F.struct("entry", "parts", "is_city", "distance", "sim")).alias("fixes")), "repaired")
    whole = F.col("word").rlike("^(sector|phase) [0-9]+[a-z]?$")  # two neighbours written together are no such word
    one = F.when(whole, F.array(F.struct(F.col("word").alias("token"), F.lit(1.0).alias("sim")))).otherwise(
        F.flatten(F.transform(F.filter("fixes", lambda x: ~x["is_city"]), lambda x: F.transform(x["parts"], lambda p: F.struct(p.alias("token"), x["sim"].alias("sim"))))))
    city = F.transform(F.filter("fixes", lambda x: x["is_city"]), lambda x: F.struct(F.col("field").alias("field"), x["distance"].alias("d"), x["entry"].alias("entry")))
    have = slot.join(close, "word", "left").groupBy("pair").agg(F.flatten(F.collect_list(one)).alias("sims"), F.array_min(F.flatten(F.collect_list(city)))["entry"].alias("own_city"))
    have = written(have, "have")

    lead = have.select("pair", "own_city", "sims", F.explode(F.array_distinct(F.transform("sims", lambda x: x["token"]))).alias("lead"))
    candidate = lead.join(proposed, "lead").where(F.col("own_city").isNull() | (F.col("own_city") == F.col("ref_city")))
    best_sim = lambda t: F.coalesce(F.array_max(F.transform(F.filter("sims", lambda x: x["token"] == t), lambda x: x["sim"])), F.lit(0.0))
    got = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["idf"] * best_sim(w["token"]))
    full = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["idf"])
    typed_numbers = F.array_distinct(F.transform(F.filter("sims", lambda x: x["token"].rlike("^(sector|phase) ")), lambda x: x["token"]))
    own_numbers = F.array_distinct(F.transform(F.filter("words", lambda w: _numbered(w["token"])), lambda w: w["token"]))
    agree = F.size(F.array_except(typed_numbers, own_numbers)) + F.size(F.array_except(own_numbers, typed_numbers)) == 0
    ranked = candidate.where(agree).groupBy("pair", F.col("locality_id").alias("id")).agg(F.max(got / full).alias("score"))
    best = ranked.groupBy("pair").agg(F.max(F.struct("score", "id")).alias("top"), F.collect_list("score").alias("all"))
    alone = F.size(F.filter("all", lambda s: s > F.col("top.score") - 0.02)) == 1
    best = best.where((F.col("top.score") >= threshold) & alone).select("pair", F.col("top.id").alias("hit"), F.col("top.score").alias("score"))
    return typed.join(best, "pair", "left").select("city", "locality", F.coalesce("hit", F.lit(-1)).cast("long").alias("locality_id"), "score")


def canonical_localities(listings: DataFrame, gazetteer: DataFrame, **options) -> DataFrame:
    """listing_id, locality_id of each row whose (city, locality) is not literally a gazetteer entry; -1 where none is meant.

    Rows whose locality is null, blank or ``nan`` are left out. Matching runs on distinct typed pairs and is joined
    back, so repeated rows cost nothing more and each keeps its row.
    """
    typed = listings.select("listing_id", "city", "locality").where(F.col("locality").isNotNull() & ~F.lower(F.trim("locality")).isin("", "nan"))
    literal = gazetteer.select("city", "locality").distinct()
    rest = typed.join(bounded_broadcast(literal, 200_000), ["city", "locality"], "left_anti")
    hits = match_places(rest, gazetteer, **options).select(F.col("city").alias("__c"), F.col("locality").alias("__l"), "locality_id")
    return rest.join(hits, rest.city.eqNullSafe(F.col("__c")) & (rest.locality == F.col("__l")), "left").select("listing_id", F.coalesce("locality_id", F.lit(-1)).cast("long").alias("locality_id"))
