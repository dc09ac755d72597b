"""Forecast series of localities and properties: growth from a date, horizons, profiles and property summaries.

A series is a table of keys, ``date`` and ``value``; every operator works on all keys at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions.scalar import clamp, positive


def growth_from(series: DataFrame, keys: list[str], as_of: Column, date: str = "date", value: str = "value") -> DataFrame:
    """keys..., base_date, base_value, target_date, target_value, yoy_pct: growth over the year from the first date at or after ``as_of``.

    The target is the first date at least a year after the base; where no date is late enough, the last one stands in for either. Medians
    are taken where a date has several values. A base that is not positive gives no row.
    """
    s = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(date).cast("date").alias("d")).agg(F.median(value).alias("v"))
    at = lambda lo, name: (F.coalesce(F.min_by(F.struct("d", "v"), F.when(F.col("d") >= lo, F.col("d"))), F.max_by(F.struct("d", "v"), F.col("d")))).alias(name)
    base = s.groupBy(*keys).agg(at(as_of.cast("date"), "b"))
    x = s.join(base, keys)
    out = x.groupBy(*keys, "b").agg(at(F.add_months(F.col("b.d"), 12), "t")).where("b.v > 0")
    return out.select(*keys, F.col("b.d").alias("base_date"), F.col("b.v").alias("base_value"), F.col("t.d").alias("target_date"), F.col("t.v").alias("target_value"), ((F.col("t.v") / F.col("b.v") - 1) * 100).alias("yoy_pct"))


def numbered(series: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """``series`` with ``quarter``, the place of each row in its series from 1, and ``quarters``, how many it has."""
    w = W.partitionBy(*keys)
    return series.withColumns({"quarter": F.row_number().over(w.orderBy(date)), "quarters": F.count("*").over(w)})


def quarter_growth(series: DataFrame, keys: list[str], years: int = 5, value: str = "value") -> DataFrame:
    """keys..., year_no, anchor, target, yoy_pct for each year whose quarters exist: from quarter 4(n-1), in the first year from the first one, to 4n.

    ``series``: as ``numbered`` gives it. A quarter serves at most two years, so each row fans out to two at most, and a year is one small group.
    """
    q = F.col("quarter")
    ends = F.when((q % 4 == 0) & (q >= 4), F.struct((q / 4).cast("int").alias("year_no"), F.lit(False).alias("anchor")))
    starts = F.when(q == 1, F.struct(F.lit(1).alias("year_no"), F.lit(True).alias("anchor"))).when(q % 4 == 0, F.struct((q / 4 + 1).cast("int").alias("year_no"), F.lit(True).alias("anchor")))
    x = series.select(*keys, F.col(value).alias("v"), F.explode(F.filter(F.array(ends, starts), lambda s: s.isNotNull())).alias("s")).where(F.col("s.year_no") <= years)
    x = x.groupBy(*keys, F.col("s.year_no").alias("year_no")).agg(F.max(F.when(F.col("s.anchor"), F.col("v"))).alias("anchor"), F.max(F.when(~F.col("s.anchor"), F.col("v"))).alias("target"))
    return x.where("anchor is not null and target is not null").withColumn("yoy_pct", F.when(F.col("anchor") != 0, (F.col("target") - F.col("anchor")) / F.col("anchor") * 100))


def at_horizon(series: DataFrame, keys: list[str], years: int, value: str = "value") -> DataFrame:
    """keys..., quarter, value at the quarter a holding time of ``years`` ends in, the first at least and the series' last at most."""
    return series.where(F.col("quarter") == F.least(F.greatest(F.lit(1), F.lit(4 * years)), F.col("quarters"))).select(*keys, "quarter", F.col(value).alias("value"))


# Rental yield in percent before the premium over the rate is taken into account, by kind; others have the last one.
BASE_YIELD = {"builder-floor": 3.2, "apartment": 2.8, "plot": 1.5}
OTHER_YIELD = 3.0


def locality_profile(master: DataFrame, keys: list[str], kind: str | None = None) -> DataFrame:
    """keys..., median_ppsf, listings, median_rate, affordability, rental_yield of each locality.

    ``master``: keys, price_per_sqft, circle_rate. Affordability is 50 where price equals rate, 100 at half of it; the yield falls by half a
    point for each rate that the price lies above it, two at most, and rises by as much below. Without a rate the base yield stands.
    """
    x = master.groupBy(*keys).agg(F.median(positive(F.col("price_per_sqft"))).alias("median_ppsf"), F.count("*").alias("listings"), F.median(positive(F.col("circle_rate"))).alias("median_rate"))
    base = F.lit(BASE_YIELD.get(kind or "", OTHER_YIELD))
    premium = clamp(F.col("median_ppsf") / F.col("median_rate") - 1.0, -1.0, 2.0)
    return x.withColumns({
        "affordability": clamp(F.col("median_rate") / F.col("median_ppsf") * 50.0, 0.0, 100.0),
        "rental_yield": F.when(F.col("median_ppsf") > 0, F.coalesce(base - 0.5 * premium, base)),
    })


def price_trend(history: DataFrame, forecast: DataFrame, keys: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """keys..., date, value, type: observed values and the forecast's medians as one series."""
    part = lambda df, name: df.groupBy(*keys, F.col(date).cast("date").alias("date")).agg(F.median(value).alias("value")).withColumn("type", F.lit(name))
    return part(history, "historical").unionByName(part(forecast, "forecast"))


def competitors(master: DataFrame, scope: list[str], key: str, value: str, k: int = 5) -> DataFrame:
    """scope..., key, rival, median, gap, place: the ``k`` localities of the same scope with the nearest median, ties by name.

    Medians are sorted within their scope and each looks only ``k`` places up and down, so no locality is compared with all others.
    """
    from plinth.functions.scalar import positive as pos

    m = master.groupBy(*scope, key).agg(F.median(pos(F.col(value))).alias("median")).where("median is not null")
    w = W.partitionBy(*scope).orderBy("median", key)
    near = F.concat(F.collect_list(F.struct(F.col(key).alias("rival"), F.col("median").alias("m"))).over(w.rowsBetween(-k, -1)), F.collect_list(F.struct(F.col(key).alias("rival"), F.col("median").alias("m"))).over(w.rowsBetween(1, k)))
    x = m.withColumn("near", near)
    ordered = F.slice(F.array_sort(F.transform("near", lambda r: F.struct(F.abs(r["m"] - F.col("median")).alias("gap"), r["rival"].alias("rival"), r["m"].alias("m")))), 1, k)
    return x.select(*scope, key, F.posexplode(ordered).alias("at", "r")).select(*scope, key, "r.rival", F.col("r.m").alias("median"), "r.gap", (F.col("at") + 1).alias("place"))


def property_summary(master: DataFrame) -> DataFrame:
    """property_id, city, locality, listed_ppsf, model_ppsf, delta_pct: a property's listed price against its model price."""
    listed, model = positive(F.col("price_per_sqft")), positive(F.col("pi_price_per_sqft"))
    return master.select("property_id", "city", "locality", F.round(listed, 0).alias("listed_ppsf"), F.round(model, 0).alias("model_ppsf"), F.round((listed - model) / model * 100, 2).alias("delta_pct"))


def with_defaults(master: DataFrame) -> DataFrame:
    """A property table with the columns every reader relies on: a synthetic id where none is given, a model price and an area under their usual names, keys of city and locality.

    The synthetic id is the hash of the row, so that it does not depend on how the table is read.
    """
    from plinth.functions.scalar import slug
    from plinth.operators.keys import forecast_city

    have = set(master.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    made = F.concat(F.lit("prop_"), F.hex(F.xxhash64(*[F.col(c) for c in sorted(have)])))
    x = master.withColumns({
        "property_id": F.coalesce(pick("property_id").cast("string"), made), "pi_price_per_sqft": pick("pi_price_per_sqft", "predicted_price_per_sqft").cast("double"),
        "covered_area_sqft": pick("covered_area_sqft", "plot_area").cast("double"), "city": F.trim(F.coalesce(pick("city").cast("string"), F.lit(""))), "locality": F.trim(F.coalesce(pick("locality").cast("string"), F.lit(""))),
    })
    return x.withColumns({"city_key": forecast_city(F.col("city")), "locality_key": slug(F.col("locality"))})


def by_id_or_locality(requests: DataFrame, rho: DataFrame) -> DataFrame:
    """``requests`` with the row of ``rho`` of their property_id, else the one of their locality (the first by id), as ``rho_0`` and ``matched_by``."""
    own = rho.select("property_id", F.col("rho_0").alias("__own"))
    place = rho.groupBy(F.lower(F.trim("locality")).alias("__l")).agg(F.min_by("rho_0", "property_id").alias("__place"))
    x = requests.join(own, "property_id", "left").join(place, F.lower(F.trim(requests["locality"])) == F.col("__l"), "left")
    by = F.when(F.col("__own").isNotNull(), "property").when(F.col("__place").isNotNull(), "locality")
    return x.withColumns({"rho_0": F.coalesce("__own", "__place"), "matched_by": by}).drop("__own", "__place", "__l")


def first_seen_order(df: DataFrame, by: list[str], id_: str, order: str, most: int) -> DataFrame:
    """by..., id, place: each group's first ``most`` distinct ids in the order in which they first come."""
    x = df.groupBy(*by, id_).agg(F.min(order).alias("__first"))
    return x.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("__first", id_))).where(F.col("place") <= most).drop("__first")


def reference_medians(df: DataFrame, by: list[str], defaults: dict[str, float]) -> DataFrame:
    """by..., and the median of each column of ``defaults``, which stands where a group has no usable value."""
    return df.groupBy(*by).agg(*[F.coalesce(F.median(positive(F.col(c))), F.lit(float(v))).alias(c) for c, v in defaults.items()])


def coverage_by(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by..., rows, matched, share: how many rows of each group have a usable ``column``."""
    ok = positive(F.col(column)).isNotNull()
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(ok).alias("matched"), F.avg(ok.cast("double")).alias("share"))
