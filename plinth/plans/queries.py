"""Queries of the core operators over whole tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import extract, fuzzy, scalar
from plinth.operators import ingest, learn, lookup, nearest, panel, series, stats
from plinth.operators.units import SPELLINGS, area_graph, convert_units, spelling_table, unit_alias
from plinth.session import table, written
from plinth.schema import RENAMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _listings(spark: SparkSession, d: str) -> DataFrame:
    parts = {f"src{i}": ingest.renamed(table(spark, d, f"listing_src{i}"), RENAMES) for i in (1, 2)}
    return ingest.union_sources(parts)


_L = "l AS (SELECT *, 'src1' AS source FROM (SELECT * EXCLUDE (developer_uuid) FROM listing_src1) UNION ALL BY NAME SELECT *, 'src2' AS source FROM (SELECT * EXCLUDE (user_type) FROM listing_src2))"


# ------------------------------------------------------------------ market panel

_ACTIVE = """
u AS (SELECT * FROM market_intelligence WHERE is_active_event = 1 AND property_id IS NOT NULL AND scrape_date IS NOT NULL
      AND lower(trim(city)) NOT IN ('', 'nan', 'none', 'null', 'no info', 'n/a', 'na', '-') AND lower(trim(canonical_locality)) NOT IN ('', 'nan', 'none', 'null', 'no info', 'n/a', 'na', '-')),
seen AS (SELECT segment, property_id, min(scrape_date) AS first_seen FROM market_intelligence GROUP BY 1, 2),
a AS (SELECT u.*, greatest(coalesce(CASE WHEN NOT isnan(days_on_market) THEN days_on_market END, greatest(date_diff('second', first_seen, scrape_date) // 86400, 0)), 0) AS dom
      FROM u LEFT JOIN seen USING (segment, property_id))"""
_SHARE = "round(coalesce({} / nullif(active_supply, 0), 0), 4)"
_BASE = f"""
b AS (SELECT segment, city, canonical_locality, scrape_date, count(DISTINCT property_id) AS active_supply, sum(coalesce(is_new_event, 0)) AS new_count, sum(coalesce(is_updated_event, 0)) AS updated_count,
  sum(coalesce(is_ready, 0)) AS ready_count, sum(coalesce(is_under_construction, 0)) AS uc_count, count(*) FILTER (dom > 90) AS stale_count, coalesce(median(dom), 0) AS md,
  coalesce(median(CASE WHEN price > 0 AND NOT isnan(price) THEN price END), 0) AS mp, coalesce(quantile_cont(CASE WHEN price_per_sqft > 0 AND NOT isnan(price_per_sqft) THEN price_per_sqft END, [0.25, 0.5, 0.75]), [0.0, 0.0, 0.0]) AS q,
  count(DISTINCT nullif(agent_type, 'nan')) AS agent_count, count(DISTINCT nullif(developer_id, 'nan')) AS developer_count FROM a GROUP BY 1, 2, 3, 4),
base AS (SELECT segment, city, canonical_locality, scrape_date, active_supply, new_count, {_SHARE.format('new_count')} AS new_velocity, updated_count, round(md, 1) AS median_dom, stale_count, {_SHARE.format('stale_count')} AS stale_share,
  round(mp, 0) AS median_price, round(q[2], 0) AS median_ppsf, round(q[1], 0) AS p25_ppsf, round(q[3], 0) AS p75_ppsf, {_SHARE.format('ready_count')} AS ready_share, {_SHARE.format('uc_count')} AS uc_share, agent_count, developer_count FROM b)"""
_ABSORB = """
dates AS (SELECT segment, scrape_date, lead(scrape_date) OVER (PARTITION BY segment ORDER BY scrape_date) AS next_date FROM (SELECT DISTINCT segment, scrape_date FROM a)),
here AS (SELECT DISTINCT segment, city, canonical_locality, scrape_date, property_id FROM a),
visited AS (SELECT DISTINCT segment, city, canonical_locality, scrape_date FROM here),
ab AS (SELECT h.segment, h.city, h.canonical_locality, h.scrape_date, CASE WHEN any_value(v.scrape_date) IS NOT NULL THEN count(*) FILTER (t.property_id IS NULL) ELSE 0 END AS absorbed_count, any_value(v.scrape_date) IS NOT NULL AS absorption_computable
  FROM here h JOIN dates USING (segment, scrape_date)
  LEFT JOIN here t ON t.segment = h.segment AND t.city = h.city AND t.canonical_locality = h.canonical_locality AND t.scrape_date = next_date AND t.property_id = h.property_id
  LEFT JOIN visited v ON v.segment = h.segment AND v.city = h.city AND v.canonical_locality = h.canonical_locality AND v.scrape_date = next_date GROUP BY 1, 2, 3, 4)"""
_REVISE = """
per AS (SELECT segment, city, canonical_locality, property_id, scrape_date, last(p ORDER BY ingested_at NULLS FIRST, p NULLS FIRST) AS last_price
  FROM (SELECT *, CASE WHEN NOT isnan(price) THEN price END AS p FROM a) GROUP BY 1, 2, 3, 4, 5),
prior AS (SELECT *, lag(last_price) OVER (PARTITION BY segment, city, canonical_locality, property_id ORDER BY scrape_date) AS prior FROM per),
pc AS (SELECT a.segment, a.city, a.canonical_locality, a.scrape_date, CASE WHEN prior > 0 AND NOT isnan(a.price) THEN (a.price - prior) / prior * 100 END AS pct
  FROM a JOIN prior USING (segment, city, canonical_locality, property_id, scrape_date) WHERE is_updated_event = 1),
rev AS (SELECT segment, city, canonical_locality, scrape_date, count(*) FILTER (pct < 0) AS cut_count, count(*) FILTER (pct > 0) AS hike_count,
  round(coalesce(median(pct) FILTER (pct < 0), 0), 2) AS cut_median_pct, round(coalesce(median(pct) FILTER (pct > 0), 0), 2) AS hike_median_pct FROM pc GROUP BY 1, 2, 3, 4)"""
_PANEL = f"""{_ACTIVE}, {_BASE}, {_ABSORB}, {_REVISE},
panel AS (SELECT base.*, coalesce(absorbed_count, 0) AS absorbed_count, coalesce(absorption_computable, false) AS absorption_computable, coalesce(cut_count, 0) AS cut_count, coalesce(hike_count, 0) AS hike_count,
  coalesce(cut_median_pct, 0) AS cut_median_pct, coalesce(hike_median_pct, 0) AS hike_median_pct, round(coalesce(coalesce(absorbed_count, 0) / nullif(active_supply, 0), 0), 4) AS absorption_rate,
  round(coalesce(coalesce(cut_count, 0) / nullif(updated_count, 0), 0), 4) AS cut_frequency, round(coalesce(coalesce(hike_count, 0) / nullif(updated_count, 0), 0), 4) AS hike_frequency
  FROM base LEFT JOIN ab USING (segment, city, canonical_locality, scrape_date) LEFT JOIN rev USING (segment, city, canonical_locality, scrape_date))"""
_RANK = "(rank() OVER (PARTITION BY segment, city ORDER BY {0}) + (count(*) OVER (PARTITION BY segment, city, {0}) - 1) / 2) / count(*) OVER (PARTITION BY segment, city) * 100"
_INDEX = f"""{_PANEL},
s AS (SELECT *, {_RANK.format('active_supply')} AS s_active, {_RANK.format('new_velocity')} AS s_velocity, {_RANK.format('stale_share')} AS s_stale, {_RANK.format('uc_share')} AS s_uc, {_RANK.format('absorption_rate')} AS s_absorb,
  100 - {_RANK.format('median_dom')} AS s_fast, median(median_ppsf) OVER (PARTITION BY segment, city) AS cm FROM panel),
x AS (SELECT *, greatest(0, least(100, 0.40 * s_active + 0.25 * s_velocity + 0.20 * s_stale + 0.15 * s_uc)) AS supply, greatest(0, least(100, 0.50 * s_absorb + 0.30 * s_fast + 0.20 * (100 - s_stale))) AS liquidity,
  CASE WHEN updated_count > 0 THEN greatest(0, least(100, 50 + 40 * hike_frequency - 40 * cut_frequency)) ELSE 50 END AS momentum, greatest(0, least(100, 50 + 50 * (median_ppsf / (CASE WHEN cm > 0 THEN cm ELSE 1 END) - 1))) AS premium FROM s),
y AS (SELECT *, greatest(0, least(100, 0.35 * s_absorb + 0.25 * liquidity + 0.20 * momentum + 0.20 * premium)) AS demand FROM x),
z AS (SELECT *, greatest(0, least(100, 50 + 0.5 * demand - 0.5 * supply)) AS heat FROM y)"""


@query(f"WITH {_ACTIVE}, {_BASE} SELECT * FROM base")
def panel_metrics(spark, d):
    return panel.base_metrics(panel.days_on_market(table(spark, d, "market_intelligence")))


@query(f"WITH {_ACTIVE}, {_ABSORB} SELECT segment, city, canonical_locality, scrape_date, absorbed_count, absorption_computable FROM ab")
def absorption(spark, d):
    return panel.absorption(panel.days_on_market(table(spark, d, "market_intelligence")))


@query(f"WITH {_ACTIVE}, {_REVISE} SELECT * FROM rev")
def price_revision_asof(spark, d):
    return panel.price_revisions(panel.days_on_market(table(spark, d, "market_intelligence")))


@query("SELECT segment, property_id, min(scrape_date) AS first_seen FROM market_intelligence GROUP BY 1, 2")
def first_seen(spark, d):
    return panel.first_seen(table(spark, d, "market_intelligence"))


@query(f"WITH {_PANEL} SELECT * FROM panel")
def market_panel(spark, d):
    return panel.market_panel(table(spark, d, "market_intelligence"))


@query(f"WITH {_INDEX} SELECT segment, city, canonical_locality, scrape_date, round(supply, 1) AS supply, round(liquidity, 1) AS liquidity, round(demand, 1) AS demand, round(heat, 1) AS heat FROM z")
def market_indices(spark, d):
    x = panel.market_indices(panel.market_panel(table(spark, d, "market_intelligence")))
    return x.select(*panel.KEYS, "scrape_date", "supply", "liquidity", "demand", "heat")


@query(f"WITH {_PANEL}, last AS (SELECT DISTINCT ON (segment, city, canonical_locality) * FROM panel ORDER BY segment, city, canonical_locality, scrape_date DESC) SELECT segment, count(*) AS localities, sum(active_supply) AS supply, round(median(median_ppsf), 2) AS median_ppsf, (SELECT count(DISTINCT scrape_date) FROM panel p WHERE p.segment = last.segment) AS dates FROM last GROUP BY segment")
def market_summary(spark, d):
    return panel.segment_summary(panel.market_panel(table(spark, d, "market_intelligence")))


_LABEL = "CASE WHEN heat >= 75 THEN 'Hot demand-led market' WHEN heat >= 60 THEN 'Positive market' WHEN heat >= 45 THEN 'Balanced market' WHEN heat >= 30 THEN 'Supply-heavy market' ELSE 'Weak / stale market' END"


@query(f"""WITH {_INDEX}, h AS (SELECT segment, city, canonical_locality, scrape_date, round(heat, 1) AS heat FROM z)
SELECT *, round(avg(heat) OVER (PARTITION BY segment, city, canonical_locality ORDER BY scrape_date ROWS 3 PRECEDING), 4) AS heat_rolling4, {_LABEL} AS market_label FROM h""")
def market_heat_rolling(spark, d):
    x = panel.market_indices(panel.market_panel(table(spark, d, "market_intelligence")), rolling_digits=4)
    return x.select(*panel.KEYS, "scrape_date", "heat", "heat_rolling4", "market_label")


@query(f"""WITH {_INDEX}, h AS (SELECT segment, city, canonical_locality, scrape_date, active_supply, median_ppsf, round(heat, 1) AS heat FROM z),
l AS (SELECT segment, city, canonical_locality, count(*) AS points, arg_max({{'h': heat, 's': active_supply, 'p': median_ppsf}}, scrape_date) AS m FROM h GROUP BY 1, 2, 3),
r AS (SELECT k.segment, g.city, g.locality FROM (SELECT DISTINCT segment FROM h) k, (SELECT DISTINCT city, locality FROM gazetteer) g),
o AS (SELECT r.*, coalesce(m.h, 50.0) AS heat, m IS NULL AS none, m.s AS active_supply, CAST(coalesce(points, 0) AS INT) AS points FROM r LEFT JOIN l ON r.segment = l.segment AND r.city = l.city AND r.locality = l.canonical_locality)
SELECT segment, city, locality, heat, CASE WHEN none THEN 'Balanced market' ELSE {_LABEL} END AS market_label, active_supply, points, CASE WHEN none THEN 'no data for this locality' END AS reason FROM o""")
def market_context(spark, d):
    x = written(panel.market_indices(panel.market_panel(table(spark, d, "market_intelligence"))), "market-indices")  # read twice below
    places = table(spark, d, "gazetteer").select("city", "locality").distinct()
    return panel.market_context(x, x.select("segment").distinct().join(F.broadcast(places)))  # every segment with every place of the fixed gazetteer


_SIGNAL = "CASE WHEN t IS NULL THEN 0 WHEN t <= 0 THEN 2 WHEN t < 1.0::DOUBLE / 3 THEN 1 WHEN t <= 2.0::DOUBLE / 3 THEN 0 WHEN t < 1 THEN -1 ELSE -2 END"


@query(f"""WITH {_PANEL}, g AS (SELECT segment, city, canonical_locality, scrape_date, unnest([{{'i': 0, 'n': 'supply', 't': (stale_share - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE)}}, {{'i': 1, 'n': 'absorption', 't': (absorption_rate - 0.3::DOUBLE) / (0.05::DOUBLE - 0.3::DOUBLE)}},
  {{'i': 2, 'n': 'cuts', 't': (cut_frequency - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE)}}, {{'i': 3, 'n': 'hikes', 't': (hike_frequency - 0.4::DOUBLE) / (0.05::DOUBLE - 0.4::DOUBLE)}}, {{'i': 4, 'n': 'speed', 't': (median_dom - 30::DOUBLE) / 90::DOUBLE}}]) AS s FROM panel),
c AS (SELECT segment, city, canonical_locality, scrape_date, s.i AS i, s.n AS signal, {_SIGNAL.replace('t <', 's.t <').replace('t IS', 's.t IS')} AS score FROM g)
SELECT segment, city, canonical_locality, scrape_date, signal, score, CAST(row_number() OVER (PARTITION BY segment, city, canonical_locality, scrape_date ORDER BY abs(score) DESC, i) AS INT) AS strength_rank FROM c""")
def market_signals(spark, d):
    return panel.signals(panel.market_panel(table(spark, d, "market_intelligence")))


@query("SELECT city, price_per_sqft, property_id, round((rank() OVER (PARTITION BY city ORDER BY price_per_sqft) + (count(*) OVER (PARTITION BY city, price_per_sqft) - 1) / 2) / count(*) OVER (PARTITION BY city) * 100, 6) AS pct FROM property_master")
def average_rank_percentile(spark, d):
    return table(spark, d, "property_master").select("city", "price_per_sqft", "property_id", F.round(panel.average_rank_pct("price_per_sqft", ["city"]), 6).alias("pct"))


# ------------------------------------------------------------------ ingestion


@query("SELECT 'src1' AS source, listing_id, developer_uuid AS developer_id, NULL::VARCHAR AS agent_type FROM listing_src1 UNION ALL SELECT 'src2', listing_id, NULL, user_type FROM listing_src2")
def union_align(spark, d):
    return _listings(spark, d).select("source", "listing_id", "developer_id", "agent_type")


@query(f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY source, listing_id) AS k FROM l) SELECT property_id, source, listing_id, price FROM r WHERE k = 1")
def dedup_keep_first(spark, d):
    x = _listings(spark, d).select("property_id", "source", "listing_id", "price")
    return ingest.first_by_key(x, ["property_id"], [F.col("source"), F.col("listing_id")])


@query("SELECT segment, event_type, count(*) AS n, count(DISTINCT property_id) AS properties FROM (SELECT DISTINCT * FROM market_intelligence) GROUP BY 1, 2")
def full_row_dedup(spark, d):
    return table(spark, d, "market_intelligence").distinct().groupBy("segment", "event_type").agg(F.count("*").alias("n"), F.count_distinct("property_id").alias("properties"))


@query(f"""WITH {_L}, c AS (SELECT source, unnest([{{'c': 'covered_area_unit', 't': covered_area_unit}}, {{'c': 'price', 't': CAST(price AS VARCHAR)}}, {{'c': 'floors', 't': floors}}, {{'c': 'road_width', 't': road_width}}, {{'c': 'price_raw', 't': price_raw}}]) AS v FROM l)
SELECT source, v.c AS column_name, count(*) AS rows, count(*) FILTER (v.t IS NULL) AS missing, count(*) FILTER (v.t IS NOT NULL AND (try_cast(v.t AS DOUBLE) IS NULL OR isnan(try_cast(v.t AS DOUBLE)))) AS lost FROM c GROUP BY 1, 2""")
def numeric_coercion(spark, d):
    audit = lambda i: ingest.coercion_audit(table(spark, d, f"listing_src{i}"), ["covered_area_unit", "price", "floors", "road_width", "price_raw", "no_such_column"]).withColumn("source", F.lit(f"src{i}"))
    return audit(1).unionByName(audit(2)).select("source", "column_name", "rows", "missing", "lost")


@query(f"WITH {_L} SELECT listing_id FROM l WHERE coalesce(regexp_replace(trim(lower(city)), '\\s+', ' ', 'g') NOT IN (SELECT lower(city) FROM gazetteer WHERE pincode LIKE '900%' OR pincode LIKE '901%'), true)")
def anti_exclusion(spark, d):
    gone = table(spark, d, "gazetteer").where("pincode like '900%' or pincode like '901%'").select("city")
    return ingest.excluded(_listings(spark, d), "city", gone).select("listing_id")


@query("""WITH a AS (SELECT property_id, 'none' AS scope FROM property_master WHERE city = 'Nowhere' OR NOT EXISTS (SELECT 1 FROM property_master WHERE city = 'Nowhere')),
b AS (SELECT property_id, 'plots' AS scope FROM property_master WHERE property_type = 'Residential Plot' OR NOT EXISTS (SELECT 1 FROM property_master WHERE property_type = 'Residential Plot')) SELECT * FROM a UNION ALL SELECT * FROM b""")
def scoped_fallback_filter(spark, d):
    p = table(spark, d, "property_master").select("property_id", "city", "property_type")
    scope = lambda name, c: ingest.scoped_or_all(p, c).select("property_id", F.lit(name).alias("scope"))
    return scope("none", F.col("city") == "Nowhere").unionByName(scope("plots", F.col("property_type") == "Residential Plot"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {_L} SELECT listing_id, property_id, event_type, CAST(bhk AS DOUBLE) AS bhk, CAST(price AS DOUBLE) AS price, CAST(covered_area_value AS DOUBLE) AS covered_area_value, floors, developer_uuid AS developer_id, user_type AS agent_type, scrape_date, ingested_at,
  length(concat_ws('|', city, locality, address_full, description, amenities, covered_area_unit, price_raw, age_of_property, furnishing_type, facing_direction, possession_status, road_width, project_society_name)) AS letters,
  round(coalesce(covered_area_sqft, 0) + coalesce(price_per_sqft, 0) + coalesce(bathrooms, 0) + coalesce(balconies, 0) + coalesce(latitude, 0) + coalesce(longitude, 0) + coalesce(corner_property, 0) + coalesce(gated_plot, 0), 3) AS numbers, NULL::VARCHAR AS added
FROM (SELECT *, 'src1' AS source FROM listing_src1 UNION ALL BY NAME SELECT *, 'src2' AS source FROM listing_src2) l""")
def ensured_schema(spark, d):
    from pyspark.sql import types as T

    from plinth.schema import LISTING

    x = ingest.ensure_columns(_listings(spark, d), T.StructType([*LISTING, T.StructField("added", T.StringType())]), only=True)
    texts = ["city", "locality", "address_full", "description", "amenities", "covered_area_unit", "price_raw", "age_of_property", "furnishing_type", "facing_direction", "possession_status", "road_width", "project_society_name"]
    numbers = ["covered_area_sqft", "price_per_sqft", "bathrooms", "balconies", "latitude", "longitude", "corner_property", "gated_plot"]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in numbers[1:]), F.coalesce(numbers[0], F.lit(0.0)))
    kept = ["listing_id", "property_id", "event_type", "bhk", "price", "covered_area_value", "floors", "developer_id", "agent_type", "scrape_date", "ingested_at"]
    return x.select(*kept, F.length(F.concat_ws("|", *texts)).cast("long").alias("letters"), F.round(total, 3).alias("numbers"), "added")


# ------------------------------------------------------------------ text and categories

_CNT = "CASE WHEN regexp_extract({t}, '{a}', 1, 'i') <> '' THEN CASE WHEN CAST(regexp_extract({t}, '{a}', 1, 'i') AS DOUBLE) <= 12 THEN CAST(regexp_extract({t}, '{a}', 1, 'i') AS DOUBLE) END WHEN regexp_extract({t}, '{b}', 1, 'i') <> '' THEN CASE WHEN CAST(regexp_extract({t}, '{b}', 1, 'i') AS DOUBLE) <= 12 THEN CAST(regexp_extract({t}, '{b}', 1, 'i') AS DOUBLE) END END"
_T = f"{_L}, t AS (SELECT listing_id, concat_ws(' ', CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(amenities) <> '' THEN amenities END) AS t FROM l)"


@query(f"""WITH {_T} SELECT listing_id, {_CNT.format(t='t', a='(\\d+)\\s*bhk', b='bedrooms?\\s*(\\d+)')} AS bhk, {_CNT.format(t='t', a='(\\d+)\\s*balcon', b='balcon\\w*\\s*(\\d+)')} AS balconies,
  {_CNT.format(t='t', a='bathrooms?\\s*(\\d+)', b='(\\d+)\\s*bathrooms?')} AS bathrooms FROM t""")
def text_counts(spark, d):
    t = extract.combined(F.col("description"), F.col("amenities"))
    return _listings(spark, d).select("listing_id", extract.bedrooms(t).alias("bhk"), extract.balconies(t).alias("balconies"), extract.bathrooms(t).alias("bathrooms"))


_PRICED = "t AS (SELECT listing_id, concat_ws(' ', description, CASE WHEN price > 0 AND listing_id % 3 = 0 THEN 'Sale Price ' || CAST(CAST(price AS BIGINT) AS VARCHAR) END, price_raw) AS t FROM l)"


@query(f"""WITH {_L}, {_PRICED}, p AS (SELECT listing_id, regexp_extract(t, 'sale\\s*price\\s*(\\d[\\d,]*)', 1, 'i') AS s, regexp_extract(t, '(\\d+\\.?\\d*)\\s*cr', 1, 'i') AS c, regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:lac|lakh)', 1, 'i') AS k FROM t)
SELECT listing_id, round(CASE WHEN try_cast(replace(s, ',', '') AS DOUBLE) > 0 THEN try_cast(replace(s, ',', '') AS DOUBLE) WHEN c <> '' THEN CAST(c AS DOUBLE) * 1e7 WHEN k <> '' THEN CAST(k AS DOUBLE) * 1e5 END, 2) AS price FROM p""")
def text_price(spark, d):
    """Every third listing states its price in digits as well, which goes before crores and lakhs."""
    digits = F.when((F.col("price") > 0) & (F.col("listing_id") % 3 == 0), F.concat(F.lit("Sale Price "), F.col("price").cast("long").cast("string")))
    return _listings(spark, d).select("listing_id", F.round(extract.price(F.concat_ws(" ", "description", digits, "price_raw")), 2).alias("price"))


_NUMBER = "(\\d[\\d,]*\\.?\\d*)\\s*"
_UNITS = [("Sq-ft", "(?:sq(?:uare)?[\\s._-]{0,4}f(?:ee|oo)?t|sft\\b)", 1.0), ("Sq-yrd", "sq(?:uare)?[\\s._-]{0,4}y(?:a?r?d)", 9.0), ("Sq-m", "sq(?:uare)?[\\s._-]{0,4}m", 10.7639), ("Acre", "acre", 43560.0), ("Bigha", "bigha", 27000.0),
          ("Hectare", "hectare", 107639.0), ("Marla", "marla", 272.25), ("Ground", "ground", 2400.0), ("Rood", "rood", 10890.0), ("Biswa", "biswa", 1350.0)]
_AREAS = ", ".join("{{'u': '{0}', 'n': try_cast(replace(regexp_extract(description, '{1}', 1, 'i'), ',', '') AS DOUBLE), 'f': {2}::DOUBLE}}".format(u, _NUMBER + p, f) for u, p, f in _UNITS)


@query(f"""WITH {_L}, a AS (SELECT listing_id, list_filter([{_AREAS}], lambda x: x.n IS NOT NULL)[1] AS m FROM l)
SELECT listing_id, CASE WHEN m.n * m.f >= 225 THEN round(m.n * m.f, 4) END AS area_sqft, m.n AS value, m.u AS unit FROM a""")
def text_area(spark, d):
    t = F.col("description")
    return _listings(spark, d).select("listing_id", F.round(extract.area_sqft(t), 4).alias("area_sqft"), extract.area_and_unit(t).alias("u")).select("listing_id", "area_sqft", "u.value", "u.unit")


# what each flag means, one alternative for each wording
_FLAG_SQL = {
    "is_parking": ["\\bparking\\b", "\\bgarage\\b", "\\bcarport\\b", "\\bcar\\s*space\\b", "\\bcar\\s*park\\b", "\\bcovered\\s*park", "\\bcovered\\s*car\\s*park", "\\bopen\\s*park", "\\bopen\\s*car\\s*park"],
    "is_pool": ["\\bpool\\b", "\\bswimming\\b", "\\binfinity\\s*pool\\b", "\\bsplash\\s*pool\\b", "\\bkids?\\s*pool\\b", "\\badult\\s*pool\\b", "\\bprivate\\s*pool\\b", "\\bjacuzzi\\b", "\\baqua\\s*park\\b", "\\baqua\\s*zone\\b"],
    "is_main_road": ["\\bmain[\\s-]road\\b", "\\broad[\\s-]facing\\b", "\\broad[\\s-]front\\b", "\\bfacing\\s+(?:the\\s+)?road\\b", "\\bfront\\s+(?:of\\s+)?road\\b", "\\bon\\s+(?:the\\s+)?road\\b", "\\b\\d+\\s*(?:meter|metre|mtr|feet|ft|m)\\s*(?:wide\\s*)?road\\b",
                     "\\broad\\s*(?:of\\s*)?\\d+\\s*(?:meter|metre|mtr|feet|ft|m)\\b", "\\bwide\\s*road\\b", "\\bexpressway\\b", "\\bnational\\s*highway\\b", "\\bnh[\\s-]\\d", "\\bsh[\\s-]\\d", "\\bring\\s*road\\b", "\\bbypass\\s*road\\b", "\\bbypass\\b", "\\bbroad\\s*road\\b", "\\barterial\\s*road\\b",
                     "\\b(?:60|75|80|100|120|130)\\s*(?:meter|metre|mtr|feet|ft|m)?\\s*road\\b"],
    "is_garden_park": ["\\bgarden\\b", "\\bpark\\b", "\\bgreen\\s*(?:area|zone|space|belt)\\b", "\\blandscaped?\\b", "\\bopen\\s*space\\b", "\\bjogging\\b", "\\bstrolling\\s*track\\b", "\\blawn\\b", "\\bamphitheatre\\b", "\\bchildren.?s?\\s*play\\b"],
    "is_gated": ["\\bgated\\b", "\\bboundary\\s*wall\\b", "\\benclosed\\s*(?:colony|complex)\\b", "\\bsecured?\\s*(?:compound|complex)\\b", "\\bguarded\\s*(?:complex|colony)\\b"],
    "is_corner": ["\\bcorner\\s*(?:plot|flat|house|floor|apartment|unit|villa|bungalow|build)\\b", "(?:3|three|two|2|4|four)\\s*side\\s*corner\\b", "\\bl[\\s-]?type\\s*corner\\b", "\\bcorner\\s*(?:facing|location|side)\\b", "\\bcorner\\s*(?:1st|2nd|3rd|first|second|third|ground)\\b", "\\b(?:plot|flat|house|floor|apartment)\\s*(?:on|at|in)?\\s*corner\\b"],
}
_FLAGGED = ", ".join("({})::INT AS {}".format(" OR ".join(f"regexp_matches(t, '{p}', 'i')" for p in ps), k) for k, ps in _FLAG_SQL.items())


@query(f"WITH {_T} SELECT listing_id, {_FLAGGED} FROM t")
def text_flags(spark, d):
    t = extract.combined(F.col("description"), F.col("amenities"))
    return _listings(spark, d).select("listing_id", *[c.alias(k) for k, c in extract.flags(t).items()])


@query(f"""WITH {_L}, f AS (SELECT listing_id, lower(trim(floors)) AS t FROM l) SELECT listing_id, CASE WHEN regexp_matches(t, '^ground\\b') THEN 0 WHEN starts_with(t, 'upper basement') THEN -1 WHEN starts_with(t, 'lower basement') THEN -2 ELSE try_cast(regexp_extract(t, '^(\\d+)\\b', 1) AS INT) END AS floor,
  try_cast(regexp_extract(t, '\\bof\\s+(\\d+)', 1) AS INT) AS floors_total FROM f""")
def floors_parse(spark, d):
    x = _listings(spark, d).select("listing_id", extract.floor_level(F.col("floors")).alias("f"))
    return x.select("listing_id", F.col("f.current").alias("floor"), F.col("f.total").alias("floors_total"))


@query(f"""WITH {_L} SELECT listing_id, CASE WHEN m BETWEEN 1 AND 100 THEN round(m, 6) END AS road_width_m FROM (SELECT listing_id, try_cast(regexp_extract(road_width, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN regexp_matches(road_width, 'f(?:ee)?t', 'i') THEN 0.3048 ELSE 1 END AS m FROM l)""")
def road_width(spark, d):
    return _listings(spark, d).select("listing_id", F.round(extract.road_width_m(F.col("road_width")), 6).alias("road_width_m"))


@query(f"""WITH {_L}, a AS (SELECT listing_id, regexp_replace(lower(facing_direction), '[^a-z]', '', 'g') AS f, regexp_replace(trim(lower(furnishing_type)), '\\s+', ' ', 'g') AS u, regexp_replace(trim(lower(property_type)), '\\s+', ' ', 'g') AS k FROM l)
SELECT listing_id, CASE f WHEN 'northeast' THEN 'North-East' WHEN 'northwest' THEN 'North-West' WHEN 'southeast' THEN 'South-East' WHEN 'southwest' THEN 'South-West' WHEN 'north' THEN 'North' WHEN 'south' THEN 'South' WHEN 'east' THEN 'East' WHEN 'west' THEN 'West' END AS facing,
  CASE u WHEN 'fully furnished' THEN 'Furnished' WHEN 'furnished' THEN 'Furnished' WHEN 'semi-furnished' THEN 'Semi-Furnished' WHEN 'semi furnished' THEN 'Semi-Furnished' WHEN 'unfurnished' THEN 'Unfurnished' END AS furnishing,
  CASE k WHEN 'apartment' THEN 'apartment' WHEN 'builder floor' THEN 'builder_floor' WHEN 'residential plot' THEN 'plot' WHEN 'independent house' THEN 'house_villa' WHEN 'villa' THEN 'house_villa' ELSE replace(k, ' ', '_') END AS kind FROM a""")
def category_map(spark, d):
    facing = extract.facing(F.concat(F.col("facing_direction"), F.lit(" facing")))
    return _listings(spark, d).select("listing_id", facing.alias("facing"), scalar.furnishing(F.col("furnishing_type")).alias("furnishing"), scalar.kind_group(F.col("property_type")).alias("kind"))


@query("SELECT property_id, (property_type = 'Apartment')::INT AS kind_Apartment, (property_type = 'Villa')::INT AS kind_Villa, coalesce((road_width_ft < 30)::INT, 0) AS narrow, coalesce((road_width_ft >= 30 AND road_width_ft <= 60)::INT, 0) AS medium, coalesce((road_width_ft > 60)::INT, 0) AS wide FROM property_master")
def one_hot_and_bands(spark, d):
    hot = scalar.one_hot(F.col("property_type"), ["Apartment", "Villa"], "kind_") | scalar.bands(F.col("road_width_ft"), [30.0, 60.0], ["narrow", "medium", "wide"])
    return table(spark, d, "property_master").select("property_id", *[c.alias(k) for k, c in hot.items()])


@query(f"""WITH {_L}, a AS (SELECT listing_id, regexp_replace(trim(lower(possession_status)), '\\s+', ' ', 'g') AS t, regexp_replace(replace(trim(possession_status), ',', ''), '(\\d)(st|nd|rd|th)', '\\1') AS p, trim(possession_status) AS o FROM l),
b AS (SELECT *, coalesce(try_strptime(p, '%d %b %Y'), try_strptime(regexp_replace('1 ' || o, '\\s*''(\\d\\d)$', ' 20\\1'), '%d %b %Y')) AS w FROM a)
SELECT listing_id, CASE WHEN regexp_matches(t, 'ready|immediate') THEN 'ready' WHEN regexp_matches(t, 'under construction|launch') THEN 'under_construction' WHEN w <= DATE '2026-06-01' THEN 'ready' WHEN w IS NOT NULL THEN 'under_construction' END AS possession FROM b""")
def possession_status(spark, d):
    return _listings(spark, d).select("listing_id", scalar.possession(F.col("possession_status"), F.lit("2025-12-01")).alias("possession"))


@query(f"""WITH {_L} SELECT listing_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(locality), '([a-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([a-z])', '\\1_\\2', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM l""")
def locality_slug(spark, d):
    return _listings(spark, d).select("listing_id", scalar.slug(F.col("locality")).alias("slug"))


@query(f"""WITH {_L} SELECT listing_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(amenities, ','), lambda x: trim(x)), lambda x: x <> ''))), ', ') AS amenities FROM l""")
def amenity_tokens(spark, d):
    return _listings(spark, d).select("listing_id", F.array_join(extract.token_set(F.col("amenities")), ", ").alias("amenities"))


@query(f"""WITH {_L}, c AS (SELECT DISTINCT city FROM gazetteer), t AS (SELECT listing_id, lower(trim(regexp_replace(city, '\\s+', ' ', 'g'))) AS t FROM l),
p AS (SELECT listing_id, t, trim(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM t)
SELECT listing_id, coalesce((SELECT city FROM c WHERE lower(city) = t), (SELECT city FROM c WHERE lower(city) = p), (SELECT arg_min(city, {{'n': -length(city), 'c': lower(city)}}) FROM c WHERE contains(' ' || p || ' ', ' ' || lower(city) || ' '))) AS city FROM p""")
def city_resolve(spark, d):
    return _listings(spark, d).select("listing_id", scalar.resolved_city(F.col("city"), _city_names(spark, d)).alias("city"))


def _city_names(spark, d, most: int = 10_000) -> dict[str, str]:
    """The gazetteer's cities by their names in lower case; more than ``most`` are refused, as they become part of the plan."""
    names = {r[0].lower(): r[0] for r in table(spark, d, "gazetteer").select("city").distinct().limit(most + 1).collect()}
    if len(names) > most:
        raise ValueError(f"the gazetteer has more than {most} cities")
    return names


_ALIASES = ", ".join(f"('{a}', '{u}')" for u, names in SPELLINGS.items() for a in names.split())
_FACTORS = "('sqft', 1.0), ('sqyd', 9.0), ('sqm', 10.7639), ('acre', 43560.0), ('hectare', 107639.0), ('bigha', 27000.0), ('biswa', 1350.0), ('marla', 272.25), ('kanal', 5445.0), ('guntha', 1089.0), ('ground', 2400.0)"


@query(f"""WITH {_L}, x AS (SELECT listing_id, covered_area_value AS v, nullif(regexp_replace(lower(covered_area_unit), '[^a-zऀ-ॿ]', '', 'g'), '') AS alias FROM l)
SELECT listing_id, u.unit, round(v * f.factor, 0) AS sqft FROM x LEFT JOIN (VALUES {_ALIASES}) u(alias, unit) USING (alias) LEFT JOIN (VALUES {_FACTORS}) f(unit, factor) ON u.unit = f.unit""")
def area_by_declared_unit(spark, d):
    x = _listings(spark, d).select("listing_id", "covered_area_value", unit_alias(F.col("covered_area_unit")).alias("alias"))
    x = x.join(F.broadcast(spelling_table(spark)), "alias", "left")
    return convert_units(x, "covered_area_value", "unit", "sqft", area_graph(), "sqft").select("listing_id", "unit", F.round("sqft", 0).alias("sqft"))


_CLEAN = f"""
p AS (SELECT * FROM l WHERE price IS NOT NULL),
x AS (SELECT *, concat_ws(' ', CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(amenities) <> '' THEN amenities END) AS t, regexp_replace(trim(lower(property_type)), '\\s+', ' ', 'g') AS k, regexp_replace(trim(lower(furnishing_type)), '\\s+', ' ', 'g') AS u,
  lower(coalesce(facing_direction, '') || ' facing') AS f, regexp_replace(trim(lower(age_of_property)), '\\s+', ' ', 'g') AS g, lower(trim(floors)) AS fl, regexp_replace(trim(lower(possession_status)), '\\s+', ' ', 'g') AS po,
  coalesce(try_strptime(regexp_replace(replace(trim(possession_status), ',', ''), '(\\d)(st|nd|rd|th)', '\\1'), '%d %b %Y'), try_strptime(regexp_replace('1 ' || trim(possession_status), '\\s*''(\\d\\d)$', ' 20\\1'), '%d %b %Y')) AS w,
  try_cast(regexp_extract(road_width, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN regexp_matches(road_width, 'f(?:ee)?t', 'i') THEN 0.3048 ELSE 1 END AS rw FROM p),
y AS (SELECT *, {_CNT.format(t='t', a='(\\d+)\\s*bhk', b='bedrooms?\\s*(\\d+)')} AS tb, {_CNT.format(t='t', a='bathrooms?\\s*(\\d+)', b='(\\d+)\\s*bathrooms?')} AS tt, {_CNT.format(t='t', a='(\\d+)\\s*balcon', b='balcon\\w*\\s*(\\d+)')} AS tc,
  regexp_extract(t, 'sale\\s*price\\s*(\\d[\\d,]*)', 1, 'i') AS ps, regexp_extract(t, '(\\d+\\.?\\d*)\\s*cr', 1, 'i') AS pc, regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:lac|lakh)', 1, 'i') AS pl, try_cast(nullif(regexp_extract(g, '(\\d+)', 1), '') AS INT) AS low FROM x)"""
_NUM = "CASE WHEN NOT isnan({0}) AND abs({0}) < 'inf'::DOUBLE THEN {0} END"
_TWELVE = "CASE WHEN coalesce({0}, {1}) <= 12 THEN coalesce({0}, {1}) END"
_FACING = " ".join(f"WHEN regexp_matches(f, '{a}\\s*-?\\s*{b}\\s*facing') THEN '{a.title()}-{b.title()}'" for a, b in (("north", "east"), ("north", "west"), ("south", "east"), ("south", "west"))) + " " + " ".join(f"WHEN regexp_matches(f, '{a}\\s*facing') THEN '{a.title()}'" for a in ("north", "south", "east", "west")) + " " + " ".join(f"WHEN regexp_matches(f, '{a}\\s*-?\\s*{b}') THEN '{a.title()}-{b.title()}'" for a, b in (("north", "east"), ("north", "west"), ("south", "east"), ("south", "west")))
_MISSING = ", ".join(f"'{w}'" for w in scalar.MISSING_WORDS)


@query(f"""WITH {_L}, {_CLEAN} SELECT listing_id, CASE k WHEN 'apartment' THEN 'apartment' WHEN 'studio apartment' THEN 'apartment' WHEN 'penthouse' THEN 'apartment' WHEN 'builder floor' THEN 'builder_floor' WHEN 'independent floor' THEN 'builder_floor' WHEN 'residential plot' THEN 'plot' WHEN 'independent house' THEN 'house_villa' WHEN 'residential house' THEN 'house_villa' WHEN 'villa' THEN 'house_villa' ELSE replace(k, ' ', '_') END AS kind,
  CASE u WHEN 'fully furnished' THEN 'Furnished' WHEN 'furnished' THEN 'Furnished' WHEN 'semi-furnished' THEN 'Semi-Furnished' WHEN 'semi furnished' THEN 'Semi-Furnished' WHEN 'unfurnished' THEN 'Unfurnished' ELSE CASE WHEN regexp_matches(lower(t), 'fully[ -]furnished') THEN 'Furnished' WHEN regexp_matches(lower(t), 'semi[ -]furnished') THEN 'Semi-Furnished' WHEN regexp_matches(lower(t), 'un-?furnished') THEN 'Unfurnished' WHEN contains(lower(t), 'furnished') THEN 'Furnished' END END AS furnishing,
  CASE {_FACING} END AS facing, CASE WHEN g IS NULL OR g IN ({_MISSING}) THEN NULL WHEN regexp_matches(g, '^(new|0[ -]|under|less than 1)') THEN 'New' WHEN low < 5 THEN 'Under 5 years' WHEN low < 10 THEN '5 to 10 years' WHEN low < 20 THEN '10 to 20 years' WHEN low >= 20 THEN 'Over 20 years' ELSE trim(age_of_property) END AS age,
  CASE WHEN regexp_matches(po, 'ready|immediate') THEN 'ready' WHEN regexp_matches(po, 'under construction|launch') THEN 'under_construction' WHEN w <= DATE '2026-06-01' THEN 'ready' WHEN w IS NOT NULL THEN 'under_construction' END AS possession,
  CASE WHEN regexp_matches(fl, '^ground\\b') THEN 0 WHEN starts_with(fl, 'upper basement') THEN -1 WHEN starts_with(fl, 'lower basement') THEN -2 ELSE try_cast(regexp_extract(fl, '^(\\d+)\\b', 1) AS INT) END AS floor, try_cast(regexp_extract(fl, '\\bof\\s+(\\d+)', 1) AS INT) AS floors_total, CASE WHEN rw BETWEEN 1 AND 100 THEN round(rw, 6) END AS road_width_m,
  {_TWELVE.format('tb', _NUM.format('bhk'))} AS bhk, {_TWELVE.format('tt', _NUM.format('bathrooms'))} AS bathrooms, {_TWELVE.format('tc', _NUM.format('balconies'))} AS balconies,
  round(coalesce(CASE WHEN try_cast(replace(ps, ',', '') AS DOUBLE) > 0 THEN try_cast(replace(ps, ',', '') AS DOUBLE) WHEN pc <> '' THEN CAST(pc AS DOUBLE) * 1e7 WHEN pl <> '' THEN CAST(pl AS DOUBLE) * 1e5 END, {_NUM.format('price')}), 2) AS price, {_FLAGGED} FROM y""")
def listings_clean(spark, d):
    return ingest.clean_listings(_listings(spark, d), F.lit("2025-12-01")).select("listing_id", "kind", "furnishing", "facing", "age", "possession", "floor", "floors_total", F.round("road_width_m", 6).alias("road_width_m"), "bhk", "bathrooms", "balconies", F.round("price", 2).alias("price"), *extract.FLAGS)


# ------------------------------------------------------------------ lookups

_RATES = "r AS (SELECT city, locality, CASE property_type WHEN 'Residential Plot' THEN 'Plot' WHEN 'Apartment' THEN 'Residential' ELSE 'House' END AS kind, circle_rate AS rate, row_number() OVER (ORDER BY property_id) AS seq FROM property_master WHERE circle_rate > 0 AND NOT isnan(circle_rate))"


def _rates(spark, d):
    kind = scalar.mapped(F.col("property_type"), {"Residential Plot": "Plot", "Apartment": "Residential"}, F.lit("House"))
    return table(spark, d, "property_master").select("city", "locality", kind.alias("kind"), F.col("circle_rate").alias("rate"), F.col("property_id").alias("seq"))


@query(f"WITH {_RATES}, k AS (SELECT city, locality, kind, max(rate) AS rate FROM r GROUP BY 1, 2, 3), dd AS (SELECT city, locality, coalesce(arg_max(rate, seq) FILTER (kind = 'Residential'), arg_min(rate, seq)) AS default_rate FROM r GROUP BY 1, 2) SELECT city, locality, kind, rate, default_rate FROM k JOIN dd USING (city, locality)")
def rate_typed_upsert(spark, d):
    return lookup.typed_rates(_rates(spark, d), ["city", "locality"], "kind", "rate", "seq")


@query(f"WITH {_RATES} SELECT city, locality, arg_max(rate, seq) AS rate FROM r GROUP BY 1, 2")
def rate_last_wins(spark, d):
    return lookup.last_rate(_rates(spark, d), ["city", "locality"], "rate", "seq")


@query()
def rate_lookup_ladder(spark, d):
    rates = lookup.last_rate(_rates(spark, d), ["city", "locality"], "rate", "seq")
    return lookup.ladder_lookup(_listings(spark, d), rates)


@query("SELECT locality_id, unnest(list_transform(range(CAST(regexp_extract(locality, '(\\d+)', 1) AS INT), CAST(regexp_extract(locality, '(\\d+)', 1) AS INT) + 3), lambda x: 'Sector ' || x)) AS sector FROM gazetteer WHERE regexp_matches(locality, '\\d')")
def sector_expand(spark, d):
    n = F.regexp_extract("locality", r"(\d+)", 1).cast("int")
    g = table(spark, d, "gazetteer").where(F.col("locality").rlike(r"\d")).select("locality_id", F.concat(n.cast("string"), F.lit(" TO "), (n + 2).cast("string")).alias("span"))
    return lookup.expanded_sectors(g, "span").select("locality_id", "sector")


_OVERLAP = "len(list_intersect(wa, wb)) / greatest(len(wa), len(wb))"


@query(f"""WITH n AS (SELECT DISTINCT city, CASE WHEN hash_at = 0 THEN locality WHEN hash_at = 1 THEN locality || ' Market' WHEN hash_at = 2 THEN split_part(locality, ' ', 1) || ' Old Town' ELSE split_part(locality, ' ', 1) END AS wanted FROM (SELECT city, locality, length(locality) % 4 AS hash_at FROM property_master)),
j AS (SELECT n.city, wanted, locality, lower(trim(wanted)) AS a, lower(trim(locality)) AS b, list_distinct(regexp_split_to_array(lower(trim(wanted)), '[\\s_]+')) AS wa, list_distinct(regexp_split_to_array(lower(trim(locality)), '[\\s_]+')) AS wb FROM n JOIN (SELECT DISTINCT city, locality FROM gazetteer) g ON n.city = g.city),
k AS (SELECT *, CASE WHEN a = b THEN 0 WHEN contains(a, b) OR contains(b, a) THEN 1 WHEN {_OVERLAP} > 0.3 THEN 2 END AS tier, {_OVERLAP} AS o FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY city, wanted ORDER BY tier, CASE WHEN tier = 1 THEN abs(length(a) - length(b)) ELSE -o END, locality) AS place FROM k WHERE tier IS NOT NULL) SELECT city, wanted, locality, tier FROM r WHERE place = 1""")
def locality_resolve(spark, d):
    """Names as they stand, with a word more, with another ending, and cut to their first word, by their length."""
    at, first = F.length("locality") % 4, F.split_part("locality", F.lit(" "), F.lit(1))
    wanted = F.when(at == 0, F.col("locality")).when(at == 1, F.concat("locality", F.lit(" Market"))).when(at == 2, F.concat(first, F.lit(" Old Town"))).otherwise(first)
    return lookup.resolved_locality(table(spark, d, "property_master").select("city", wanted.alias("wanted")), table(spark, d, "gazetteer"))


_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH {_L}, t AS (SELECT listing_id AS id, city, ' ' || {_PLAIN.format("concat_ws(' ', address_full, locality)")} || ' ' AS t FROM l), g AS (SELECT DISTINCT city, locality, {_PLAIN.format('locality')} AS run FROM gazetteer)
SELECT id, arg_max(locality, {{'n': length(run), 'l': locality}}) AS locality FROM t JOIN g ON t.city = g.city AND contains(t.t, ' ' || run || ' ') GROUP BY 1""")
def gazetteer_extract(spark, d):
    x = _listings(spark, d).select(F.col("listing_id").alias("id"), "city", F.concat_ws(" ", "address_full", "locality").alias("text"))
    return lookup.gazetteer_hit(x, table(spark, d, "gazetteer"))


@query()
def fuzzy_match(spark, d):
    x = _listings(spark, d).select(F.col("locality").alias("name")).distinct()
    return lookup.nearest_names(x, table(spark, d, "gazetteer").select("locality"), 0.8)


@query("""WITH g AS (SELECT city, locality, 'ab' AS a, chr(97 + CAST(locality_id % 3 AS INT)) || chr(97 + CAST(locality_id % 2 AS INT)) AS b FROM gazetteer)
SELECT city, locality, b, CASE b WHEN 'ab' THEN 100.0 WHEN 'aa' THEN 50.0 WHEN 'ba' THEN 50.0 WHEN 'bb' THEN 50.0 WHEN 'ca' THEN 50.0 WHEN 'cb' THEN 50.0 ELSE 0.0 END AS sorted_ratio,
  CASE b WHEN 'ab' THEN 100.0 WHEN 'aa' THEN 50.0 WHEN 'ba' THEN 50.0 WHEN 'bb' THEN 50.0 WHEN 'ca' THEN 50.0 WHEN 'cb' THEN 50.0 ELSE 0.0 END AS window_ratio, 100.0 AS reversed_ratio, round(200.0 * length(locality) / (2 * length(locality) + 6), 6) AS longer_ratio FROM g""")
def token_ratios(spark, d):
    """Ratios with values that can be counted by hand: two letters against two, a name against its words reversed, and against itself with six letters more."""
    g = table(spark, d, "gazetteer").withColumn("b", F.concat(F.char(F.lit(97) + F.col("locality_id") % 3), F.char(F.lit(97) + F.col("locality_id") % 2)))
    turned = F.array_join(F.reverse(F.split("locality", " ")), " ")
    return g.select(
        "city", "locality", "b", fuzzy.token_sort_ratio(F.lit("ab"), F.col("b")).alias("sorted_ratio"), fuzzy.partial_ratio(F.lit("ab"), F.col("b")).alias("window_ratio"), fuzzy.token_sort_ratio(F.col("locality"), turned).alias("reversed_ratio"),
        F.round(fuzzy.indel_ratio(F.col("locality"), F.concat("locality", F.lit("qzqzqz"))), 6).alias("longer_ratio"),
    )


@query("""WITH p AS (SELECT *, CASE WHEN circle_rate > 0 AND NOT isnan(circle_rate) THEN circle_rate END AS r FROM property_master), m AS (SELECT city, locality, count(*) AS listings FROM p WHERE r IS NULL GROUP BY 1, 2), o AS (SELECT city, locality, max(r) AS rate FROM p WHERE r > 9000 GROUP BY 1, 2)
SELECT coalesce(m.city, o.city) AS city, coalesce(m.locality, o.locality) AS locality, rate, coalesce(listings, 0) AS listings, CASE WHEN rate IS NOT NULL THEN 'override' ELSE 'missing' END AS status FROM m FULL JOIN o ON m.city = o.city AND m.locality = o.locality""")
def missing_rate_report(spark, d):
    p = table(spark, d, "property_master").withColumn("r", scalar.positive(F.col("circle_rate")))
    over = p.where("r > 9000").groupBy("city", "locality").agg(F.max("r").alias("rate"))
    return lookup.override_report(p.where("r is null"), over)


# ------------------------------------------------------------------ places

_HAV = "2 * 6371.0088 * asin(sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2)))"


@query(f"""WITH j AS (SELECT locality_id, station_id, {_HAV.format('g.latitude', 'm.latitude', 'g.longitude', 'm.longitude')} AS km FROM gazetteer g JOIN metro m ON m.latitude BETWEEN g.latitude - 0.1 AND g.latitude + 0.1 AND m.longitude BETWEEN g.longitude - 0.2 AND g.longitude + 0.2)
SELECT locality_id, arg_min(station_id, {{'k': km, 'i': station_id}}) AS station_id, round(min(km), 6) AS km FROM j WHERE km <= 5 GROUP BY 1""")
def nearest_station(spark, d):
    g = table(spark, d, "gazetteer").select(F.col("locality_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    m = table(spark, d, "metro").select(F.col("station_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("station_id").alias("value"))
    return nearest.nearest_within(g, m, 5.0).select(F.col("target_id").alias("locality_id"), F.col("donor_id").alias("station_id"), F.round("km", 6).alias("km"))


@query(f"""WITH g AS (SELECT g.locality_id AS id, g.city, g.latitude AS lat, g.longitude AS lon, CASE WHEN g.locality_id % 3 <> 0 THEN g.locality_id * 1.5 END AS value FROM gazetteer g),
j AS (SELECT t.id, dn.id AS donor, dn.value, t.city = dn.city AS same, {_HAV.format('t.lat', 'dn.lat', 't.lon', 'dn.lon')} AS km FROM g t JOIN g dn ON t.value IS NULL AND dn.value IS NOT NULL AND dn.lat BETWEEN t.lat - 0.06 AND t.lat + 0.06 AND dn.lon BETWEEN t.lon - 0.1 AND t.lon + 0.1),
k AS (SELECT id, 0 AS tier, donor, value, km FROM j WHERE same AND km <= 5 UNION ALL SELECT id, 1, donor, value, km FROM j WHERE km <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, km, donor) AS n FROM k) SELECT id, value, round(km, 6) AS km, tier FROM r WHERE n = 1""")
def nearest_donor_fill(spark, d):
    g = table(spark, d, "gazetteer").select(F.col("locality_id").alias("id"), "city", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.when(F.col("locality_id") % 3 != 0, F.col("locality_id") * 1.5).alias("value"))
    return nearest.tiered_fill(g, [["city"], []], 5.0).select("id", "value", F.round("km", 6).alias("km"), "tier")


@query("""WITH s AS (SELECT station_id, city, latitude AS lat1, longitude AS lon1, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2 FROM metro WINDOW w AS (PARTITION BY city ORDER BY station_id)),
p AS (SELECT locality_id, latitude AS lat, longitude AS lon FROM gazetteer), j AS (SELECT locality_id, (lon1 - lon) * 111.320 * cos(radians(lat)) AS x1, (lat1 - lat) * 110.574 AS y1, (lon2 - lon) * 111.320 * cos(radians(lat)) AS x2, (lat2 - lat) * 110.574 AS y2
  FROM p JOIN s ON lat2 IS NOT NULL AND least(lat1, lat2) - 0.05 <= lat AND greatest(lat1, lat2) + 0.05 >= lat AND least(lon1, lon2) - 0.05 <= lon AND greatest(lon1, lon2) + 0.05 >= lon),
t AS (SELECT *, greatest(0, least(1, coalesce(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS u FROM j)
SELECT locality_id, round(min(sqrt(pow(x1 + u * (x2 - x1), 2) + pow(y1 + u * (y2 - y1), 2))), 6) AS km FROM t GROUP BY 1 HAVING min(sqrt(pow(x1 + u * (x2 - x1), 2) + pow(y1 + u * (y2 - y1), 2))) <= 2""")
def nearest_segment_km(spark, d):
    line = F.transform(F.array_sort(F.collect_list(F.struct("station_id", "longitude", "latitude"))), lambda s: F.array(s["longitude"], s["latitude"]))
    lines = table(spark, d, "metro").groupBy("city").agg(line.alias("line")).select(F.col("city").alias("feature_id"), "line")
    p = table(spark, d, "gazetteer").select(F.col("locality_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return nearest.nearest_segment(p, nearest.segments_of(lines), 2.0).select(F.col("point_id").alias("locality_id"), F.round("km", 6).alias("km"))


# ------------------------------------------------------------------ series

_QUARTER = "q AS (SELECT segment, city, canonical_locality, CAST(date_trunc('quarter', scrape_date) AS DATE) AS quarter, median(price_per_sqft) AS value FROM market_intelligence WHERE price_per_sqft > 0 AND NOT isnan(price_per_sqft) GROUP BY 1, 2, 3, 4)"


def _quarters(spark, d):
    return series.quarterly_median(table(spark, d, "market_intelligence"), panel.KEYS, "scrape_date", "price_per_sqft")


@query(f"WITH {_QUARTER} SELECT segment, city, canonical_locality, strftime(quarter, '%Y-%m-%d') AS quarter, round(value, 4) AS value FROM q")
def quarterly_median(spark, d):
    return _quarters(spark, d).withColumns({"value": F.round("value", 4), "quarter": scalar.iso_date(F.col("quarter"))})


_K = "PARTITION BY segment, city, canonical_locality ORDER BY quarter"


@query(f"""WITH {_QUARTER}, s AS (SELECT segment, city, canonical_locality, CAST(unnest(generate_series(CAST(min(quarter) AS TIMESTAMP), CAST(max(quarter) AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM q GROUP BY 1, 2, 3),
x AS (SELECT s.*, value, row_number() OVER (PARTITION BY s.segment, s.city, s.canonical_locality ORDER BY s.quarter) AS i FROM s LEFT JOIN q ON s.segment = q.segment AND s.city = q.city AND s.canonical_locality = q.canonical_locality AND s.quarter = q.quarter),
y AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({_K}) AS pi, last_value(value IGNORE NULLS) OVER ({_K}) AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({_K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(value IGNORE NULLS) OVER ({_K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM x)
SELECT segment, city, canonical_locality, strftime(quarter, '%Y-%m-%d') AS quarter, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)), 3) AS value, value IS NULL AS filled FROM y""")
def quarters_filled(spark, d):
    return series.filled_quarters(_quarters(spark, d), panel.KEYS).withColumns({"value": F.round("value", 3), "quarter": scalar.iso_date(F.col("quarter"))})


@query(f"WITH {_QUARTER}, w AS (SELECT *, lag(value) OVER k AS lag1, lag(value, 4) OVER k AS l4, row_number() OVER k AS t, avg(value) OVER (PARTITION BY segment, city, canonical_locality ORDER BY quarter ROWS 3 PRECEDING) AS m FROM q WINDOW k AS (PARTITION BY segment, city, canonical_locality ORDER BY quarter)) SELECT segment, city, canonical_locality, strftime(quarter, '%Y-%m-%d') AS quarter, round(value / lag1 - 1, 6) AS growth, round(value / l4 - 1, 6) AS yoy, round(m, 4) AS mean4, t FROM w")
def series_features(spark, d):
    x = series.series_features(_quarters(spark, d), panel.KEYS)
    return x.select(*panel.KEYS, scalar.iso_date(F.col("quarter")).alias("quarter"), F.round("growth", 6).alias("growth"), F.round("yoy", 6).alias("yoy"), F.round("mean4", 4).alias("mean4"), "t")


@query(f"WITH {_QUARTER}, w AS (SELECT *, (value / lag(value) OVER (PARTITION BY segment, city, canonical_locality ORDER BY quarter) - 1) * 100 AS c FROM q) SELECT segment, city, canonical_locality, round(stddev_samp(c), 6) AS volatility FROM w GROUP BY 1, 2, 3")
def qoq_volatility(spark, d):
    return series.volatility(_quarters(spark, d), panel.KEYS).withColumn("volatility", F.round("volatility", 6))


@query(f"""WITH {_QUARTER}, y AS (SELECT segment, city, canonical_locality, n AS year_no, arg_min(value, quarter) AS value FROM q, range(0, 3) r(n) WHERE quarter >= DATE '2024-01-01' + to_years(CAST(n AS INT)) GROUP BY 1, 2, 3, 4),
z AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w - 1 AS k FROM y WINDOW w AS (PARTITION BY segment, city, canonical_locality ORDER BY year_no)) SELECT segment, city, canonical_locality, CAST(year_no AS INT) AS year_no, round(value, 4) AS value, round(value / before * 100 - 100, 6) AS yoy_pct FROM z WHERE k = year_no AND year_no > 0""")
def yoy_chain(spark, d):
    x = series.yoy_chain(_quarters(spark, d), panel.KEYS, F.lit("2024-01-01"), 2)
    return x.select(*panel.KEYS, "year_no", F.round("value", 4).alias("value"), F.round("yoy_pct", 6).alias("yoy_pct"))


@query("""WITH p AS (SELECT property_id, price_per_sqft AS p, pi_price_per_sqft AS l, 0.327 * pow(0.9, 4) AS r FROM property_master) SELECT property_id, round((r * l + (1 - r) * p) * 1.062, 4) AS linear, round(p * 1.062 * pow(l / p, r), 4) AS geometric FROM p""")
def forecast_blend(spark, d):
    w = F.lit(0.327) * F.pow(F.lit(0.9), F.lit(4))
    p, level, i = F.col("price_per_sqft"), F.col("pi_price_per_sqft"), F.lit(1.062)
    return table(spark, d, "property_master").select("property_id", F.round(series.blend_linear(p, level, w, i), 4).alias("linear"), F.round(series.blend_geometric(p, level, w, i), 4).alias("geometric"))


@query("SELECT scrape_date, round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 2) AS mean, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75 FROM (SELECT scrape_date, CASE WHEN NOT isnan(price_per_sqft) THEN price_per_sqft END AS v FROM market_intelligence) GROUP BY 1 HAVING count(v) > 0")
def distribution_by_date(spark, d):
    x = series.distribution(table(spark, d, "market_intelligence"), ["scrape_date"], "price_per_sqft")
    return x.select("scrape_date", F.round("median", 4).alias("median"), F.round("mean", 2).alias("mean"), "least", "most", F.round("p25", 4).alias("p25"), F.round("p75", 4).alias("p75"))


@query("""WITH v AS (SELECT locality_id AS k, latitude AS v FROM gazetteer), j AS (SELECT a.k, b.k AS other, abs(a.v - b.v) AS gap FROM v a JOIN v b ON a.k <> b.k), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, other) AS place FROM j) SELECT k AS locality_id, other, round(gap, 9) AS gap, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def competing_topk(spark, d):
    x = series.nearest_by_value(table(spark, d, "gazetteer").select("locality_id", "latitude"), "locality_id", "latitude", 5)
    return x.withColumn("gap", F.round("gap", 9))


@query(f"""WITH {_QUARTER}, g AS (SELECT segment, city, canonical_locality, quarter, value, value / lag(value) OVER ({_K}) - 1 AS g FROM q), s AS (SELECT segment, city, canonical_locality, arg_max(value, quarter) AS last, coalesce(avg(g), 0) AS mean, coalesce(arg_max(g, quarter) FILTER (g IS NOT NULL), 0) AS now FROM g GROUP BY 1, 2, 3),
f AS (SELECT s.*, CAST(k AS INT) AS step, 1 + mean + pow(0.6, k) * (now - mean) AS f FROM s, range(1, 21) r(k)) SELECT segment, city, canonical_locality, step, round(last * product(f) OVER (PARTITION BY segment, city, canonical_locality ORDER BY step), 2) AS value FROM f""")
def forecast_roll_forward(spark, d):
    return series.roll_forward(_quarters(spark, d), panel.KEYS, 20).withColumn("value", F.round("value", 2))


@query("SELECT property_id, round(price_per_sqft * 1.07, 4) AS invested, round((price_per_sqft * 1.5 * 0.98 + price_per_sqft * 0.02 * 5 - price_per_sqft * 1.07) / (price_per_sqft * 1.07) * 100, 6) AS roi_pct FROM property_master")
def roi_cashflow(spark, d):
    p = F.col("price_per_sqft")
    x = table(spark, d, "property_master").select("property_id", series.cash_flow(p, p * 1.5, 5, 7.0, 1.0, 2.0, 3.0).alias("c"))
    return x.select("property_id", F.round("c.invested", 4).alias("invested"), F.round("c.roi_pct", 6).alias("roi_pct"))


@query("SELECT property_id, feature, setting, CASE feature WHEN 'is_corner' THEN (setting - is_corner) * 3.0 ELSE (setting - is_gated) * 2.0 END AS delta FROM property_master, (VALUES ('is_corner', 0.0), ('is_corner', 1.0), ('is_gated', 1.0)) t(feature, setting)")
def whatif_sweep(spark, d):
    x = series.scenario_sweep(table(spark, d, "property_master").select("property_id", "is_corner", "is_gated"), "property_id", {"is_corner": [0.0, 1.0], "is_gated": [1.0]}, lambda c: c["is_corner"] * 3 + c["is_gated"] * 2)
    return x.select("property_id", "feature", "setting", "delta")


# ------------------------------------------------------------------ statistics


@query("SELECT count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(abs(e / y)), 6) AS mape, round(sqrt(avg(e * e)), 4) AS rmse, round(median(abs(e)), 4) AS median_ae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT price_per_sqft AS y, price_per_sqft - pi_price_per_sqft AS e FROM property_master)")
def model_metrics(spark, d):
    x = stats.model_errors(table(spark, d, "property_master"), "price_per_sqft", "pi_price_per_sqft")
    return x.select("n", F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"), F.round("median_ae", 4).alias("median_ae"), F.round("r2", 6).alias("r2"))


@query("WITH e AS (SELECT price_per_sqft - pi_price_per_sqft AS e FROM property_master) SELECT x AS \"limit\", count(*) FILTER (abs(e) <= x) AS n, round(count(*) FILTER (abs(e) <= x) / count(*), 6) AS share FROM e, (VALUES (100.0::DOUBLE), (300.0), (1000.0)) t(x) GROUP BY x")
def error_coverage(spark, d):
    x = table(spark, d, "property_master").select((F.col("price_per_sqft") - F.col("pi_price_per_sqft")).alias("e"))
    return stats.error_coverage(x, "e", [100.0, 300.0, 1000.0]).withColumn("share", F.round("share", 6))


@query("SELECT bhk, coalesce(round(avg(e) FILTER (property_type = 'Apartment'), 4), 0) AS Apartment, coalesce(round(avg(e) FILTER (property_type = 'Villa'), 4), 0) AS Villa FROM (SELECT *, abs(price_per_sqft - pi_price_per_sqft) AS e FROM property_master) GROUP BY bhk")
def pivot_error(spark, d):
    x = table(spark, d, "property_master").withColumn("e", F.abs(F.col("price_per_sqft") - F.col("pi_price_per_sqft")))
    x = stats.pivot_mean(x, "bhk", "property_type", "e", ["Apartment", "Villa"])
    return x.select("bhk", F.round("Apartment", 4).alias("Apartment"), F.round("Villa", 4).alias("Villa"))


@query("SELECT CAST(CASE WHEN price_per_sqft < 2000 THEN 0 WHEN price_per_sqft >= 26000 THEN 25 ELSE floor((price_per_sqft - 2000) / 1000) + 1 END AS INT) AS bin, count(*) AS n FROM property_master GROUP BY 1")
def price_histogram(spark, d):
    return stats.histogram(table(spark, d, "property_master"), "price_per_sqft", 2000.0, 26000.0, 24)


@query("SELECT 0.05::DOUBLE AS q, round(quantile_cont(price_per_sqft, 0.05), 6) AS value FROM property_master UNION ALL SELECT 0.5, round(quantile_cont(price_per_sqft, 0.5), 6) FROM property_master UNION ALL SELECT 0.95, round(quantile_cont(price_per_sqft, 0.95), 6) FROM property_master")
def exact_quantiles(spark, d):
    return stats.quantiles(table(spark, d, "property_master"), "price_per_sqft", [0.05, 0.5, 0.95]).withColumn("value", F.round("value", 6))


@query("SELECT column_name, round(r, 6) AS r FROM (SELECT 'pi_price_per_sqft' AS column_name, corr(pi_price_per_sqft, price_per_sqft) AS r FROM property_master UNION ALL SELECT 'covered_area_sqft', corr(covered_area_sqft, price_per_sqft) FROM property_master UNION ALL SELECT 'is_corner', corr(is_corner, price_per_sqft) FROM property_master) ORDER BY abs(r) DESC LIMIT 2")
def top_correlations(spark, d):
    return stats.correlations(table(spark, d, "property_master"), "price_per_sqft", ["pi_price_per_sqft", "covered_area_sqft", "is_corner"], 2).withColumn("r", F.round("r", 6))


@query("WITH m AS (SELECT locality, median(price_per_sqft) AS median FROM property_master GROUP BY 1), c AS (SELECT quantile_cont(median, [0.25, 0.5, 0.75]) AS q FROM m) SELECT locality, round(median, 4) AS median, CASE WHEN median >= q[3] THEN 'luxury' WHEN median >= q[2] THEN 'premium' WHEN median >= q[1] THEN 'mid' ELSE 'budget' END AS tier FROM m, c")
def locality_tiers(spark, d):
    return stats.quartile_tiers(table(spark, d, "property_master"), "locality", "price_per_sqft").withColumn("median", F.round("median", 4))


@query("WITH c AS (SELECT quantile_cont(covered_area_sqft, [0.25, 0.75]) AS q FROM property_master) SELECT property_id, CASE WHEN covered_area_sqft <= q[1] THEN 'low' WHEN covered_area_sqft >= q[2] THEN 'high' WHEN covered_area_sqft IS NOT NULL THEN 'medium' END AS band FROM property_master, c")
def area_bands(spark, d):
    return stats.quantile_bands(table(spark, d, "property_master").select("property_id", "covered_area_sqft"), "covered_area_sqft").select("property_id", "band")


@query("SELECT locality, round(avg(price_per_sqft), 4) AS mean, (SELECT round(median(price_per_sqft), 4) FROM property_master) AS default_value FROM property_master GROUP BY 1")
def locality_encoding(spark, d):
    x = stats.mean_encoding(table(spark, d, "property_master"), "locality", "price_per_sqft")
    return x.select("locality", F.round("mean", 4).alias("mean"), F.round("default_value", 4).alias("default_value"))


@query("SELECT city, arg_min(property_type, {'n': -n, 't': property_type}) AS mode FROM (SELECT city, property_type, count(*) AS n FROM property_master GROUP BY 1, 2) GROUP BY 1")
def kind_mode(spark, d):
    return stats.mode_by(table(spark, d, "property_master"), ["city"], "property_type")


# ------------------------------------------------------------------ models


@query()
def kmeans_cells(spark, d):
    g = table(spark, d, "gazetteer").select("locality_id", "latitude", "longitude")
    return learn.cell_features(g, learn.fit_cells(g, "latitude", "longitude", 12), "latitude", "longitude").select("locality_id", "cell", "cell_km")


@query()
def cluster_median_fill(spark, d):
    p = table(spark, d, "property_master").select("property_id", "covered_area_sqft", "price_per_sqft", "road_width_ft", F.when(F.col("bathrooms").between(1, 12), F.col("bathrooms")).alias("bathrooms"))
    return learn.cluster_median_fill(p, ["covered_area_sqft", "price_per_sqft", "road_width_ft"], ["bathrooms"])


@query("""WITH p AS (SELECT locality_id AS k, city, latitude AS a, longitude AS b, CASE WHEN locality_id % 4 <> 0 THEN latitude * 100 END AS y FROM gazetteer),
j AS (SELECT n.k, h.y, sqrt(pow(n.a - h.a, 2) + pow(n.b - h.b, 2)) AS dist, row_number() OVER (PARTITION BY n.k ORDER BY sqrt(pow(n.a - h.a, 2) + pow(n.b - h.b, 2)), h.k) AS r FROM p n JOIN p h ON n.city = h.city AND n.y IS NULL AND h.y IS NOT NULL)
SELECT k AS locality_id, round(coalesce(avg(y) FILTER (dist = 0), sum(y / dist) FILTER (dist > 0) / sum(1 / dist) FILTER (dist > 0)), 5) AS value FROM j WHERE r <= 7 GROUP BY 1""")
def knn_fill(spark, d):
    g = table(spark, d, "gazetteer").select("locality_id", "city", "latitude", "longitude", F.when(F.col("locality_id") % 4 != 0, F.col("latitude") * 100).alias("y"))
    return learn.knn_fill(g, "locality_id", ["city"], ["latitude", "longitude"], "y").withColumn("value", F.round("value", 5))


@query()
def price_model(spark, d):
    num, cat = ["covered_area_sqft", "is_parking", "is_corner", "is_gated", "road_width_ft"], ["city", "property_type"]
    train, test = learn.hash_split(table(spark, d, "property_master"), "property_id")
    model = learn.fit_price_model(train, num, cat, "price_per_sqft", trees=20)
    return stats.model_errors(learn.scored(model, test, num, cat), "price_per_sqft", "prediction")


@query()
def isolation_outliers(spark, d):
    return learn.isolation_scores(table(spark, d, "property_master"), "property_id", ["covered_area_sqft", "price_per_sqft"], trees=50)


# ------------------------------------------------------------------ streams


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """The events table read as a stream to its end, in daily windows."""
    import os
    import uuid

    from plinth.session import shared_dir
    from plinth.streaming.panel import windowed_counts

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").parquet(d) if not os.path.isdir(f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    x = windowed_counts(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], late="60 days")


    def keep(part: DataFrame, _: int) -> None:
        part.write.mode("overwrite").parquet(f"{base}/out")  # the whole result so far; executors write it, none of it goes to the driver

    x.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
