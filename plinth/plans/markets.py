"""Queries of keys, filters, forecasts, rates and plot texts, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import plots, scalar
from plinth.operators import filters, forecast, keys, lookup, panel, series, stats
from plinth.plans import queries as base
from plinth.plans.queries import _L, _QUARTER, _listings, _quarters, _rates
from plinth.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ keys and filters

_CITY = "CASE {0} WHEN 'new delhi' THEN 'Delhi' WHEN 'delhi' THEN 'Delhi' WHEN 'gurugram' THEN 'Gurgaon' WHEN 'gurgaon' THEN 'Gurgaon' WHEN 'noida' THEN 'Noida' WHEN 'greater noida' THEN 'Greater Noida' WHEN 'greater noida west' THEN 'Greater Noida' WHEN 'gr noida' THEN 'Greater Noida' WHEN 'ghaziabad' THEN 'Ghaziabad' WHEN 'faridabad' THEN 'Faridabad' WHEN 'jaipur' THEN 'Jaipur' END"
_FLAT = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"


@query(f"""WITH {_L}, a AS (SELECT listing_id, {_FLAT.format('property_type')} AS k, lower(trim(event_type)) AS e, price / nullif(covered_area_sqft, 0) AS x, price_per_sqft, posting_date AS p, scrape_date AS s, trim(coalesce(locality, '')) AS name FROM l)
SELECT listing_id, CASE WHEN k IN ('apartment', 'studio apartment', 'penthouse') THEN 'apt' WHEN k IN ('builder floor', 'independent floor', 'builder floor apartment') THEN 'builder_floor' WHEN k IN ('plot', 'residential plot', 'land', 'residential land') THEN 'plot' WHEN k IN ('independent house', 'residential house', 'villa') THEN 'house_villa' END AS segment,
  name AS locality, coalesce(e IN ('new', 'unchanged', 'updated'), false)::INT AS is_active_event, coalesce(e = 'new', false)::INT AS is_new_event, coalesce(e = 'updated', false)::INT AS is_updated_event, round(CASE WHEN x > 0 AND NOT isnan(x) THEN x ELSE price_per_sqft END, 2) AS price_per_sqft,
  CASE WHEN p IS NULL OR CAST(p AS DATE) <> CAST(s AS DATE) THEN CAST(greatest(coalesce(date_diff('second', p, s) // 86400, 0), 0) AS DOUBLE) END AS days_on_market FROM a""")
def market_rows(spark, d):
    x = keys.market_rows(_listings(spark, d).withColumnRenamed("covered_area_sqft", "area_sqft").withColumn("area_sqft", F.when(F.col("area_sqft") != 0, F.col("area_sqft"))))
    return x.select("listing_id", "segment", "locality", "is_active_event", "is_new_event", "is_updated_event", F.round("price_per_sqft", 2).alias("price_per_sqft"), "days_on_market")


@query(f"""WITH n AS (SELECT locality_id, CASE locality_id % 7 WHEN 0 THEN 'New  Delhi' WHEN 1 THEN 'gurugram' WHEN 2 THEN 'Greater Noida West' WHEN 3 THEN 'Dwarka' WHEN 4 THEN 'South-Delhi' WHEN 5 THEN upper(city) ELSE city END AS c, locality FROM gazetteer), k AS (SELECT *, {_FLAT.format('c')} AS f, regexp_replace(regexp_replace({_FLAT.format('c')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM n)
SELECT locality_id, coalesce({_CITY.format('f')}, upper(c[1]) || lower(c[2:])) AS shown, coalesce(lower({_CITY.format('f')}), f) AS rate_key, CASE WHEN s IN ('new_delhi', 'north_delhi', 'south_delhi', 'east_delhi', 'west_delhi', 'central_delhi', 'ncr_delhi', 'dwarka') THEN 'delhi' WHEN s IN ('greater_noida', 'greaternoida', 'greater_noida_west') THEN 'noida' WHEN s = 'gurugram' THEN 'gurgaon' ELSE s END AS forecast_key,
  CASE WHEN f IN ('greater noida', 'greater noida west', 'gr noida') THEN 'greater noida,noida' ELSE coalesce(lower({_CITY.format('f')}), f) END AS looked_up FROM k WHERE c NOT LIKE 'South%' OR true""".replace("upper(c[1]) || lower(c[2:])", "CASE WHEN c LIKE 'South%' THEN 'South-Delhi' ELSE upper(c[1]) || lower(c[2:]) END"))
def city_keys(spark, d):
    at = F.col("locality_id") % 7
    c = F.when(at == 0, F.lit("New  Delhi")).when(at == 1, "gurugram").when(at == 2, "Greater Noida West").when(at == 3, "Dwarka").when(at == 4, "South-Delhi").when(at == 5, F.upper("city")).otherwise(F.col("city"))
    return table(spark, d, "gazetteer").select("locality_id", keys.market_city(c).alias("shown"), keys.rate_city(c).alias("rate_key"), keys.forecast_city(c).alias("forecast_key"), F.array_join(keys.rate_cities(c), ",").alias("looked_up"))


@query(f"""WITH {_L}, a AS (SELECT listing_id, {_FLAT.format('property_type')} AS k FROM l) SELECT listing_id, CASE WHEN contains(k, 'res') THEN 'Residential' WHEN contains(k, 'com') THEN 'Commercial' WHEN contains(k, 'inst') THEN 'Institutional' WHEN contains(k, 'agri') THEN 'Agricultural' WHEN contains(k, 'other') THEN 'Other'
  ELSE nullif(array_to_string(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || w[2:]), ' '), '') END AS rate_class FROM a""")
def rate_classes(spark, d):
    return _listings(spark, d).select("listing_id", keys.rate_class(F.regexp_replace(F.trim("property_type"), r"\s+", " ")).alias("rate_class"))


@query(f"""WITH {_L} SELECT listing_id, coalesce((SELECT g.city_key FROM (SELECT DISTINCT city_key FROM gazetteer) g WHERE g.city_key = s), s) AS city_key FROM (SELECT listing_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(city), '([a-z])(\\d)', '\\1_\\2', 'g'), '(\\d)([a-z])', '\\1_\\2', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM l)""")
def gazetteer_city_key(spark, d):
    return keys.gazetteer_city(_listings(spark, d).select("listing_id", "city"), "city", table(spark, d, "gazetteer"), {}).select("listing_id", "city_key")


_OK = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} BETWEEN {1} AND {2}"


@query(f"""SELECT property_id, (coalesce({_OK.format('bhk', 1, 6)} AND {_OK.format('covered_area_sqft', 350, 5000)} AND {_OK.format('price_per_sqft', 2000, 40000)}, false))::INT AS sale, coalesce({_OK.format('covered_area_sqft', 300, 100000)} AND {_OK.format('price_per_sqft', 1000, 350000)}, false)::INT AS plot,
  coalesce({_OK.format('pi_price_per_sqft', 2000, 500000)} AND {_OK.format('covered_area_sqft', 300, 5000)} AND {_OK.format('bhk', 1, 6)}, false)::INT AS rent, coalesce(price_per_sqft > 0 AND circle_rate > 0 AND NOT isnan(circle_rate) AND NOT isnan(price_per_sqft) AND price_per_sqft / circle_rate > 0.3 AND price_per_sqft / circle_rate < 25, false)::INT AS ratio FROM property_master""")
def plausible_rows(spark, d):
    names = {"area": "covered_area_sqft", "rent": "pi_price_per_sqft"}
    sale = {k: v for k, v in filters.LIMITS["sale"].items() if k != "floors"}
    return table(spark, d, "property_master").select(
        "property_id", filters.within(sale, names).cast("int").alias("sale"), filters.within(filters.LIMITS["plot"], names).cast("int").alias("plot"), filters.within(filters.LIMITS["apartment rent"], names).cast("int").alias("rent"),
        filters.plausible_ratio(F.col("price_per_sqft"), F.col("circle_rate")).cast("int").alias("ratio"),
    )


@query("SELECT property_id, city, circle_rate FROM property_master WHERE contains(lower(city), 'abad') AND circle_rate IS NOT NULL AND NOT isnan(circle_rate) AND property_type IN ('Apartment', 'Villa')")
def filtered_master(spark, d):
    x = filters.of_kinds(filters.complete(table(spark, d, "property_master"), "circle_rate"), "property_type", ["Apartment", "Villa"])
    return x.where(filters.contains_text(F.col("city"), " ABAD ")).select("property_id", "city", "circle_rate")


@query("WITH s AS (SELECT property_id, abs(price_per_sqft - 9000) AS score FROM property_master), q AS (SELECT quantile_cont(score, 0.98) AS q FROM s) SELECT property_id FROM property_master WHERE property_id NOT IN (SELECT property_id FROM s, q WHERE score > q.q)")
def without_outliers(spark, d):
    p = table(spark, d, "property_master")
    return filters.without_outliers(p, p.select("property_id", F.abs(F.col("price_per_sqft") - 9000).alias("score")), "property_id", "score").select("property_id")


# ------------------------------------------------------------------ forecasts

_KEYS = "segment, city, canonical_locality"
_NUMBERED = f"{_QUARTER}, n AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY quarter) AS k, count(*) OVER (PARTITION BY {_KEYS}) AS total FROM q)"
_SAME = "a.segment = b.segment AND a.city = b.city AND a.canonical_locality = b.canonical_locality"


def _dated(spark, d):
    return _quarters(spark, d).where("segment is not null and city is not null and canonical_locality is not null").withColumnRenamed("quarter", "date")


@query(f"""WITH {_QUARTER}, f AS (SELECT * FROM q WHERE segment IS NOT NULL AND city IS NOT NULL AND canonical_locality IS NOT NULL), b AS (SELECT {_KEYS}, coalesce(min(quarter) FILTER (quarter >= DATE '2024-06-01'), max(quarter)) AS base FROM f GROUP BY ALL),
t AS (SELECT {_KEYS}, base, coalesce(min(quarter) FILTER (quarter >= base + INTERVAL 12 MONTH), max(quarter)) AS target FROM f JOIN b USING ({_KEYS}) GROUP BY ALL)
SELECT {_KEYS}, strftime(base, '%Y-%m-%d') AS base_date, strftime(target, '%Y-%m-%d') AS target_date, round(x.value, 4) AS base_value, round(y.value, 4) AS target_value, round((y.value / x.value - 1) * 100, 5) AS yoy_pct
FROM t JOIN f x USING ({_KEYS}) JOIN f y USING ({_KEYS}) WHERE x.quarter = base AND y.quarter = target""")
def locality_yoy(spark, d):
    x = forecast.growth_from(_dated(spark, d), panel.KEYS, F.lit("2024-06-01"))
    return x.select(*panel.KEYS, scalar.iso_date(F.col("base_date")).alias("base_date"), scalar.iso_date(F.col("target_date")).alias("target_date"), *[F.round(c, n).alias(c) for c, n in (("base_value", 4), ("target_value", 4), ("yoy_pct", 5))])


@query(f"""WITH {_NUMBERED}, y AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS year_no) SELECT a.segment, a.city, a.canonical_locality, year_no, round(a.value, 4) AS anchor, round(b.value, 4) AS target, round((b.value - a.value) / a.value * 100, 5) AS yoy_pct
FROM y JOIN n a ON a.k = greatest(1, 4 * (year_no - 1)) JOIN n b ON b.k = 4 * year_no AND {_SAME}""")
def quarter_yoy(spark, d):
    x = forecast.quarter_growth(forecast.numbered(_dated(spark, d), panel.KEYS), panel.KEYS)
    return x.select(*panel.KEYS, "year_no", F.round("anchor", 4).alias("anchor"), F.round("target", 4).alias("target"), F.round("yoy_pct", 5).alias("yoy_pct"))


@query(f"WITH {_NUMBERED} SELECT segment, city, canonical_locality, CAST(k AS INT) AS quarter, round(value, 4) AS value FROM n WHERE k = least(greatest(1, 8), total) AND segment IS NOT NULL AND city IS NOT NULL AND canonical_locality IS NOT NULL")
def horizon_quarter(spark, d):
    return forecast.at_horizon(forecast.numbered(_dated(spark, d), panel.KEYS), panel.KEYS, 2).withColumn("value", F.round("value", 4))


_GOOD = "CASE WHEN {0} > 0 AND NOT isnan({0}) THEN {0} END"


@query(f"""WITH m AS (SELECT city, locality, median({_GOOD.format('price_per_sqft')}) AS p, count(*) AS listings, median({_GOOD.format('circle_rate')}) AS r FROM property_master GROUP BY 1, 2)
SELECT city, locality, round(p, 4) AS median_ppsf, listings, round(r, 4) AS median_rate, CASE WHEN r / p IS NOT NULL THEN round(greatest(0, least(100, r / p * 50)), 4) END AS affordability, round(CASE WHEN p > 0 THEN CASE WHEN r IS NULL THEN 2.8 ELSE 2.8 - 0.5 * greatest(-1, least(2, p / r - 1)) END END, 5) AS rental_yield FROM m""")
def locality_profile(spark, d):
    x = forecast.locality_profile(table(spark, d, "property_master"), ["city", "locality"], "apartment")
    return x.select("city", "locality", F.round("median_ppsf", 4).alias("median_ppsf"), "listings", F.round("median_rate", 4).alias("median_rate"), F.round("affordability", 4).alias("affordability"), F.round("rental_yield", 5).alias("rental_yield"))


@query(f"""WITH {_QUARTER}, t AS (SELECT city, canonical_locality, strftime(quarter, '%Y-%m-%d') AS date, round(median(value), 4) AS value, 'historical' AS type FROM q WHERE quarter < DATE '2025-01-01' GROUP BY 1, 2, 3 UNION ALL SELECT city, canonical_locality, strftime(quarter, '%Y-%m-%d'), round(median(value), 4), 'forecast' FROM q WHERE quarter >= DATE '2025-01-01' GROUP BY 1, 2, 3) SELECT * FROM t""")
def price_trend(spark, d):
    x = _quarters(spark, d).withColumnRenamed("quarter", "date")
    out = forecast.price_trend(x.where("date < date'2025-01-01'"), x.where("date >= date'2025-01-01'"), ["city", "canonical_locality"])
    return out.withColumns({"date": scalar.iso_date(F.col("date")), "value": F.round("value", 4)})


@query(f"""WITH m AS (SELECT city, locality, median({_GOOD.format('price_per_sqft')}) AS v FROM property_master GROUP BY 1, 2 HAVING v IS NOT NULL), j AS (SELECT a.city, a.locality, b.locality AS rival, b.v AS median, abs(b.v - a.v) AS gap FROM m a JOIN m b ON a.city = b.city AND a.locality <> b.locality),
r AS (SELECT *, row_number() OVER (PARTITION BY city, locality ORDER BY gap, rival) AS place FROM j) SELECT city, locality, rival, round(median, 4) AS median, round(gap, 4) AS gap, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def rival_localities(spark, d):
    x = forecast.competitors(table(spark, d, "property_master"), ["city"], "locality", "price_per_sqft")
    return x.select("city", "locality", "rival", F.round("median", 4).alias("median"), F.round("gap", 4).alias("gap"), F.col("place").cast("int").alias("place"))


@query(f"SELECT property_id, city, locality, round({_GOOD.format('price_per_sqft')}, 0) AS listed_ppsf, round({_GOOD.format('pi_price_per_sqft')}, 0) AS model_ppsf, round(({_GOOD.format('price_per_sqft')} - {_GOOD.format('pi_price_per_sqft')}) / {_GOOD.format('pi_price_per_sqft')} * 100, 2) + 0 AS delta_pct FROM property_master")
def property_summary(spark, d):
    return forecast.property_summary(table(spark, d, "property_master"))


@query(f"SELECT property_type, coalesce(median({_GOOD.format('price_per_sqft')}), 10000.0) AS price_per_sqft, coalesce(median({_GOOD.format('circle_rate')}), 8000.0) AS circle_rate, coalesce(median({_GOOD.format('covered_area_sqft')}), 1200.0) AS covered_area_sqft FROM property_master GROUP BY 1")
def reference_medians(spark, d):
    return forecast.reference_medians(table(spark, d, "property_master"), ["property_type"], {"price_per_sqft": 10000.0, "circle_rate": 8000.0, "covered_area_sqft": 1200.0})


@query("SELECT city, count(*) AS rows, count(*) FILTER (circle_rate > 0 AND NOT isnan(circle_rate)) AS matched, round(count(*) FILTER (circle_rate > 0 AND NOT isnan(circle_rate)) / count(*), 6) AS share FROM property_master GROUP BY 1")
def rate_coverage(spark, d):
    return forecast.coverage_by(table(spark, d, "property_master"), ["city"], "circle_rate").withColumn("share", F.round("share", 6))


@query("WITH f AS (SELECT city, locality, property_id, min(scrape_date) AS s FROM market_intelligence GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY city, locality ORDER BY s, property_id) AS place FROM f) SELECT city, locality, property_id, CAST(place AS INT) AS place FROM r WHERE place <= 250")
def property_ids(spark, d):
    return forecast.first_seen_order(table(spark, d, "market_intelligence"), ["city", "locality"], "property_id", "scrape_date", 250)


@query("""WITH r AS (SELECT property_id, locality, greatest(0.1, least(0.7, 0.25 + 0.3 * is_parking + 0.2 * is_corner - 0.25 * is_gated)) AS rho_0 FROM property_master WHERE is_corner = 1 OR is_parking = 1), p AS (SELECT lower(trim(locality)) AS l, arg_min(rho_0, property_id) AS rho_0 FROM r GROUP BY 1)
SELECT m.property_id, m.locality, round(coalesce(r.rho_0, p.rho_0), 6) AS rho_0, CASE WHEN r.rho_0 IS NOT NULL THEN 'property' WHEN p.rho_0 IS NOT NULL THEN 'locality' END AS matched_by FROM property_master m LEFT JOIN r USING (property_id) LEFT JOIN p ON lower(trim(m.locality)) = p.l""")
def rho_lookup(spark, d):
    p = table(spark, d, "property_master")
    rho = p.where("is_corner = 1 or is_parking = 1").select("property_id", "locality", scalar.clamp(0.25 + 0.3 * F.col("is_parking") + 0.2 * F.col("is_corner") - 0.25 * F.col("is_gated"), 0.1, 0.7).alias("rho_0"))
    return forecast.by_id_or_locality(p.select("property_id", "locality"), rho).withColumn("rho_0", F.round("rho_0", 6))


@query("SELECT segment, count(DISTINCT city) AS cities, list_aggregate(list_sort(list(DISTINCT city)), 'string_agg', ', ') AS names FROM market_intelligence WHERE city IS NOT NULL AND trim(lower(city)) NOT IN ('', 'nan', 'none') GROUP BY 1")
def segment_cities(spark, d):
    x = table(spark, d, "market_intelligence").where("city is not null and trim(lower(city)) not in ('', 'nan', 'none')").select("segment", "city").distinct()
    return x.groupBy("segment").agg(F.count("*").alias("cities"), F.array_join(F.array_sort(F.collect_list("city")), ", ").alias("names"))  # a few cities each


@query("SELECT property_id, coalesce(CAST(property_id AS VARCHAR), '') <> '' AS has_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(locality)), '([a-z])(\\d)', '\\1_\\2', 'g'), '(\\d)([a-z])', '\\1_\\2', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS locality_key, covered_area_sqft FROM property_master")
def master_with_defaults(spark, d):
    x = forecast.with_defaults(table(spark, d, "property_master").withColumnsRenamed({"covered_area_sqft": "plot_area", "pi_price_per_sqft": "predicted_price_per_sqft"}))
    return x.select("property_id", (F.col("property_id") != "").alias("has_id"), "locality_key", "covered_area_sqft")


# ------------------------------------------------------------------ rates

_KIND_RATES = f"{base._RATES}, k AS (SELECT city, locality, kind, max(rate) AS rate FROM r GROUP BY 1, 2, 3), dd AS (SELECT city, locality, coalesce(arg_max(rate, seq) FILTER (kind = 'Residential'), arg_min(rate, seq)) AS d FROM r GROUP BY 1, 2)"


@query(f"""WITH {_KIND_RATES}, w AS (SELECT city, locality, max(rate) FILTER (kind = 'Plot') AS plot, max(rate) FILTER (kind = 'Residential') AS res, max(rate) FILTER (kind = 'Commercial') AS com FROM k GROUP BY 1, 2)
SELECT city, locality, coalesce(plot, res, d) AS plot_rate, coalesce(com, res, d) AS commercial_rate, coalesce(res, d) AS plain_rate FROM w JOIN dd USING (city, locality)""")
def rate_resolution(spark, d):
    typed = lookup.typed_rates(_rates(spark, d), ["city", "locality"], "kind", "rate", "seq")
    e, r = lookup.rate_entries(typed), lambda k: lookup.resolved_rate(F.col("rates"), F.col("default_rate"), k)
    return e.select("city", "locality", r(F.lit("Plot")).alias("plot_rate"), r(F.lit("Commercial")).alias("commercial_rate"), r(None).alias("plain_rate"))


@query(f"""WITH {_KIND_RATES}, c AS (SELECT CASE WHEN ascii(city) % 2 = 0 THEN 'greater noida' ELSE 'noida' END AS key, city, locality, kind, rate FROM k), u AS (SELECT key, locality, kind, max(rate) AS rate FROM c GROUP BY 1, 2, 3),
x AS (SELECT 'Greater Noida' AS city, locality, kind, rate, CASE key WHEN 'greater noida' THEN 0 ELSE 1 END AS rank FROM u UNION ALL SELECT 'Noida', locality, kind, rate, 0 FROM u WHERE key = 'noida') SELECT city, locality, kind, arg_min(rate, rank) AS rate FROM x GROUP BY 1, 2, 3""")
def rates_over_cities(spark, d):
    """The tables' cities taken for two that are looked up one after the other."""
    typed = lookup.typed_rates(_rates(spark, d), ["city", "locality"], "kind", "rate", "seq").withColumn("city", F.when(F.ascii("city") % 2 == 0, "greater noida").otherwise("noida"))
    e = typed.groupBy("city", "locality", "kind").agg(F.max("rate").alias("rate"), F.max("default_rate").alias("default_rate"))
    cities = spark.createDataFrame([("Greater Noida",), ("Noida",)], "city string")
    return lookup.merged_cities(cities, lookup.rate_entries(e)).select("city", "locality", F.explode("rates").alias("kind", "rate"))


@query()
def composite_lookup(spark, d):
    """Distinct typed localities against the rates of their city, by the composite score."""
    p = table(spark, d, "gazetteer").select(scalar.collapsed(F.col("city")).alias("city"), scalar.collapsed(F.col("locality")).alias("locality"), F.lit("Residential").alias("kind"), F.col("locality_id").cast("double").alias("rate"), F.col("locality_id").cast("double").alias("default_rate"))
    x = _listings(spark, d).select(scalar.collapsed(F.col("city")).alias("city"), "locality")
    return lookup.composite_lookup(x, lookup.rate_entries(p))


@query()
def trend_locality(spark, d):
    return lookup.trend_locality(_listings(spark, d).select("city", "locality").where("locality is not null"), table(spark, d, "gazetteer"))


@query()
def locality_suggestions(spark, d):
    """What each gazetteer locality's first word suggests in its city."""
    g = table(spark, d, "gazetteer")
    return lookup.suggestions(g.select("city", F.split_part("locality", F.lit(" "), F.lit(1)).alias("q")), g)


@query()
def place_of_text(spark, d):
    x = _listings(spark, d).select(F.col("listing_id").alias("id"), "city", "locality", F.col("address_full").alias("address"), "description")
    return lookup.place_of_text(x, table(spark, d, "gazetteer"))


@query()
def listing_rates(spark, d):
    x = _listings(spark, d).select(F.col("listing_id").alias("id"), "city", "locality", scalar.mapped(F.col("property_type"), {"Residential Plot": "Plot", "Apartment": "Residential"}, F.lit("House")).alias("kind"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    t = lookup.typed_rates(_rates(spark, d).withColumns({"city": scalar.collapsed(F.col("city")), "locality": scalar.locality_form(F.col("locality"))}), ["city", "locality"], "kind", "rate", "seq")
    return lookup.rates_for_listings(x.dropDuplicates(["id"]), t)


# ------------------------------------------------------------------ plots of land

_PLOT_TEXT = """CASE WHEN covered_area_sqft IS NOT NULL THEN CAST(CAST(covered_area_sqft AS BIGINT) AS VARCHAR) END || CASE WHEN is_corner = 1 THEN ' square yards Plot ' ELSE ' Sq-ft Residential Plot ' END || CASE WHEN is_parking = 1 THEN 'Sale Price ' || CAST(CAST(price_per_sqft AS BIGINT) AS VARCHAR) ELSE 'available at a price of Rs ' || CAST(CAST(price_per_sqft AS BIGINT) AS VARCHAR) || ' Lac' END
 || CASE WHEN is_gated = 1 THEN '. The plot is north - east facing, a gated enclave.' ELSE '. South Freehold, near Ganga park.' END || ' width of the facing road is ' || CAST(CAST(road_width_ft AS BIGINT) AS VARCHAR) || ' mt. permits up to ' || CAST(CAST(bhk AS BIGINT) AS VARCHAR) || ' floors. ' || CASE WHEN is_corner = 1 THEN 'Corner, RERA, Resale' ELSE 'New Property, back lane, overlooks the garden' END"""


def _plot_texts(spark, d):
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    text = F.concat(
        whole("covered_area_sqft"), F.when(F.col("is_corner") == 1, " square yards Plot ").otherwise(" Sq-ft Residential Plot "), F.when(F.col("is_parking") == 1, F.concat(F.lit("Sale Price "), whole("price_per_sqft"))).otherwise(F.concat(F.lit("available at a price of Rs "), whole("price_per_sqft"), F.lit(" Lac"))),
        F.when(F.col("is_gated") == 1, ". The plot is north - east facing, a gated enclave.").otherwise(". South Freehold, near Ganga park."), F.lit(" width of the facing road is "), whole("road_width_ft"), F.lit(" mt. permits up to "), whole("bhk"), F.lit(" floors. "),
        F.when(F.col("is_corner") == 1, "Corner, RERA, Resale").otherwise("New Property, back lane, overlooks the garden"),
    )
    floored = {c: F.floor(c) for c in ("covered_area_sqft", "price_per_sqft", "road_width_ft", "bhk")}
    return table(spark, d, "property_master").withColumns(floored).select("property_id", text.alias("t"))


@query(f"""WITH p AS (SELECT property_id, floor(covered_area_sqft) AS covered_area_sqft, floor(price_per_sqft) AS price_per_sqft, floor(road_width_ft) AS road_width_ft, floor(bhk) AS bhk, is_corner, is_parking, is_gated FROM property_master), t AS (SELECT *, {_PLOT_TEXT} AS t FROM p)
SELECT property_id, CASE WHEN t IS NOT NULL THEN covered_area_sqft END AS area_value, CASE WHEN t IS NOT NULL THEN CASE WHEN is_corner = 1 THEN 'Sq-yrd' ELSE 'Sq-ft' END END AS area_unit, CASE WHEN t IS NOT NULL THEN CASE WHEN is_parking = 1 THEN price_per_sqft ELSE price_per_sqft * 1e5 END END AS price, CASE WHEN t IS NOT NULL AND is_corner <> 1 THEN 'Residential Plot' END AS kind,
  CASE WHEN t IS NOT NULL THEN CASE WHEN is_gated = 1 THEN 'North-East' ELSE 'South' END END AS facing, CASE WHEN t IS NOT NULL THEN is_corner END AS corner, CASE WHEN t IS NOT NULL THEN road_width_ft END AS road_width_m, CASE WHEN t IS NOT NULL THEN is_gated END AS gated, CASE WHEN t IS NOT NULL THEN 1 - is_corner END AS backlane, CASE WHEN t IS NOT NULL THEN CAST(bhk AS INT) END AS floors_allowed,
  CASE WHEN t IS NOT NULL THEN 1 - is_corner END AS park_facing, CASE WHEN t IS NOT NULL AND is_gated <> 1 THEN 'Freehold' END AS tenure, CASE WHEN t IS NOT NULL THEN CASE WHEN is_corner = 1 THEN 'Resale' ELSE 'New' END END AS status, CASE WHEN t IS NOT NULL THEN is_corner END AS rera FROM t""")
def plot_fields(spark, d):
    """Descriptions in the form that plot listings have, put together from the property table."""
    return _plot_texts(spark, d).select("property_id", plots.plot_fields(F.col("t")).alias("p")).select("property_id", *[f"p.{c}" for c in ("area_value", "area_unit", "price", "kind", "facing", "corner", "road_width_m", "gated", "backlane", "floors_allowed", "park_facing", "tenure", "status", "rera")])


_AROUND = {
    "park": ["(?:near|facing|overlook|adjacent|close to|proximity to|access to)\\s+\\w*\\s*park\\b", "\\bpark\\s*facing\\b", "\\bgarden/park\\b", "garden.*?park", "\\bopen\\s+park\\b", "\\bbright.*?park\\b", "\\bexpansive park\\b", "\\blarge park\\b"], "school": ["\\bschool\\b", "\\bvidyalaya\\b", "\\beducational institution\\b"],
    "hospital": ["\\bhospital\\b", "\\bclinic\\b", "\\bmedical cent(?:re|er)\\b", "\\bnursing home\\b", "\\bdiagnostic cent(?:re|er)\\b"], "market": ["\\bmarket\\b", "\\bshopping mall\\b", "\\bshopping cent(?:re|er)\\b"], "metro": ["\\bmetro\\s+station\\b", "\\bmetro\\s+connectivity\\b", "\\bnear\\s+metro\\b", "\\bmetro\\s+line\\b", "\\bupcoming\\s+metro\\b"],
    "airport": ["\\bairport\\b"], "highway": ["\\bhighway\\b", "\\bexpressway\\b", "\\bouter ring road\\b", "\\bperipheral\\b", "\\bnh[-\\s]?\\d+\\b"], "water_supply": ["\\bwater supply\\b", "\\bwater connection\\b", "\\b24.hour water\\b", "\\bwater\\s+availability\\b"],
    "electricity": ["\\belectricity\\s+connection\\b", "\\bpower supply\\b", "\\bpower connection\\b", "\\belectricity\\s+available\\b"], "security": ["\\bsecurity\\b", "\\bcctv\\b", "\\bguard\\b", "\\bsurveillance\\b"], "gymnasium": ["\\bgymnasium\\b", "\\bgym\\s+facilit", "\\bfitness cent(?:re|er)\\b"], "swimming_pool": ["\\bswimming pool\\b"],
    "club_house": ["\\bclub\\s*house\\b", "\\bcommunity hall\\b", "\\bcommunity cent(?:re|er)\\b"], "boundary_wall": ["\\bboundary wall\\b"], "sewerage": ["\\bsewerage\\b", "\\bdrainage\\b", "\\bsewer\\b"], "college": ["\\bcollege\\b", "\\buniversity\\b"], "bank_atm": ["\\batm\\b", "\\bbank branch\\b", "\\bnear.*?bank\\b"], "restaurant": ["\\brestaurant\\b", "\\bcafeteria\\b"],
    "temple": ["\\btemple\\b", "\\bmandir\\b", "\\bmasjid\\b", "\\bchurch\\b"], "vastu": ["\\bvastu\\b"], "street_light": ["\\bstreet light\\b", "\\bstreet lighting\\b"], "wide_road": ["\\bwide\\s+road\\b", "\\bwide\\s+(?:clean\\s+)?roads\\b", "\\bpaved road\\b"],
}
_AROUND_SQL = ", ".join("CASE WHEN {} THEN '{}' END".format(" OR ".join(f"regexp_matches(t, '{p}')" for p in ps), k) for k, ps in _AROUND.items())


@query(f"WITH {_L}, a AS (SELECT listing_id, array_to_string(list_filter([{_AROUND_SQL}], lambda x: x IS NOT NULL), ', ') AS around FROM (SELECT listing_id, lower(concat_ws(' ', description, amenities)) AS t FROM l)) SELECT listing_id, nullif(around, '') AS around FROM a")
def surroundings(spark, d):
    return _listings(spark, d).select("listing_id", F.array_join(plots.surroundings(F.concat_ws(" ", "description", "amenities")), ", ").alias("around"))


_WORDS = ", ".join(f"('{t}', '{k}')".replace("children's", "children''s") for k, ts in plots.AMENITY_KEYWORDS.items() for t in ts)


@query(f"""WITH {_L}, t AS (SELECT listing_id, unnest(string_split(amenities, ',')) AS t FROM l WHERE amenities IS NOT NULL), k AS (SELECT listing_id, string_agg(DISTINCT k, ', ' ORDER BY k) AS keywords FROM t JOIN (VALUES {_WORDS}) w(t, k) ON lower(trim(split_part(t.t, ':', 1))) = w.t GROUP BY 1) SELECT l.listing_id, coalesce(keywords, '') AS keywords FROM l LEFT JOIN k USING (listing_id)""")
def amenity_keywords(spark, d):
    return _listings(spark, d).select("listing_id", F.array_join(plots.amenity_keywords(F.col("amenities")), ", ").alias("keywords"))


# ------------------------------------------------------------------ statistics and tables


@query("WITH e AS (SELECT abs(price_per_sqft - pi_price_per_sqft) AS e FROM property_master), q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS q, unnest(quantile_cont(e, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) AS limit_value FROM e) SELECT q.q, round(q.limit_value, 4) AS limit_value, count(*) FILTER (e.e <= q.limit_value) AS n FROM e, q GROUP BY 1, q.limit_value")
def error_percentiles(spark, d):
    x = table(spark, d, "property_master").select(F.abs(F.col("price_per_sqft") - F.col("pi_price_per_sqft")).alias("e"))
    return stats.error_percentiles(x, "e", [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]).withColumn("limit_value", F.round("limit_value", 4))


@query("SELECT city, locality, round(median(price_per_sqft), 4) AS median, CASE WHEN median(price_per_sqft) <= (SELECT quantile_cont(m, 0.25) FROM (SELECT median(price_per_sqft) AS m FROM property_master GROUP BY city, locality)) THEN 'budget' WHEN median(price_per_sqft) <= (SELECT quantile_cont(m, 0.5) FROM (SELECT median(price_per_sqft) AS m FROM property_master GROUP BY city, locality)) THEN 'mid' WHEN median(price_per_sqft) <= (SELECT quantile_cont(m, 0.75) FROM (SELECT median(price_per_sqft) AS m FROM property_master GROUP BY city, locality)) THEN 'premium' ELSE 'luxury' END AS tier FROM property_master GROUP BY 1, 2")
def locality_tiers_upto(spark, d):
    p = table(spark, d, "property_master").withColumn("key", F.struct("city", "locality"))
    return stats.quartile_tiers(p, "key", "price_per_sqft", upto=True).select("key.city", "key.locality", F.round("median", 4).alias("median"), "tier")


@query("SELECT 'property_master' AS name, count(*) AS rows FROM property_master UNION ALL SELECT 'market_intelligence', count(*) FROM market_intelligence UNION ALL SELECT 'gazetteer', count(*) FROM gazetteer")
def table_rows(spark, d):
    out = None
    for name in ("property_master", "market_intelligence", "gazetteer"):
        one = table(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_QUARTER}, w AS (SELECT *, lag(value) OVER k AS l1, lag(value, 2) OVER k AS l2, avg(value) OVER (PARTITION BY segment, city, quarter) AS cm, rank() OVER (PARTITION BY segment, city, quarter ORDER BY value DESC) AS r FROM q WINDOW k AS (PARTITION BY segment, city, canonical_locality ORDER BY quarter)) SELECT segment, city, canonical_locality, strftime(quarter, '%Y-%m-%d') AS quarter, round(ln(l1), 6) AS log_lag1, round(l1 / l2 - 1, 6) AS growth_lag1, round(value / cm, 6) AS to_city, CAST(r AS INT) AS city_rank FROM w")
def zone_features(spark, d):
    x = series.zone_features(_quarters(spark, d), panel.KEYS, ["segment", "city"])
    return x.select(*panel.KEYS, scalar.iso_date(F.col("quarter")).alias("quarter"), *[F.round(c, 6).alias(c) for c in ("log_lag1", "growth_lag1", "to_city")], "city_rank")
