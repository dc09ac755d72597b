"""Queries of the general data problems (units, places, fills), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.operators.fill import fill_property_master
from plinth.operators.geo import listing_targets
from plinth.operators.units import normalise_listing_units, unit_findings
from plinth.session import table


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Both listing tables together, only ``columns``."""
    a, b = (table(spark, sf_dir, f"listing_src{i}") for i in (1, 2))
    return a.select(*columns).unionByName(b.select(*columns))


UNIT_COLUMNS = ("listing_id", "covered_area_value", "covered_area_unit", "covered_area_sqft", "price", "price_raw", "price_per_sqft", "description")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_findings(listings(spark, sf_dir, *UNIT_COLUMNS))


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_listing_units(listings(spark, sf_dir, *UNIT_COLUMNS))


def p6_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_targets(listings(spark, sf_dir, "listing_id", "latitude", "longitude"), table(spark, sf_dir, "metro"), table(spark, sf_dir, "rate_zone"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_targets(spark, sf_dir).select("listing_id", "target_kind", "target_id")


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_property_master(table(spark, sf_dir, "property_master")).where("filled")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_filled(spark, sf_dir).select("property_id", "field_name")


QUERIES = {f.__name__: f for f in (p1_found, p1_normalised, p6_found, p6_targets, p7_found, p7_filled)}

_RESTORED = """
pos AS (
  SELECT listing_id,
    CASE WHEN latitude BETWEEN 8 AND 37 AND longitude BETWEEN 68 AND 97 THEN latitude
         WHEN longitude BETWEEN 8 AND 37 AND latitude BETWEEN 68 AND 97 THEN longitude
         WHEN latitude / 1e6 BETWEEN 8 AND 37 AND longitude / 1e6 BETWEEN 68 AND 97 THEN latitude / 1e6
         WHEN longitude / 1e6 BETWEEN 8 AND 37 AND latitude / 1e6 BETWEEN 68 AND 97 THEN longitude / 1e6 END AS lat,
    CASE WHEN latitude BETWEEN 8 AND 37 AND longitude BETWEEN 68 AND 97 THEN longitude
         WHEN longitude BETWEEN 8 AND 37 AND latitude BETWEEN 68 AND 97 THEN latitude
         WHEN latitude / 1e6 BETWEEN 8 AND 37 AND longitude / 1e6 BETWEEN 68 AND 97 THEN longitude / 1e6
         WHEN longitude / 1e6 BETWEEN 8 AND 37 AND latitude / 1e6 BETWEEN 68 AND 97 THEN latitude / 1e6 END AS lon
  FROM (SELECT listing_id, latitude, longitude FROM listing_src1 UNION ALL SELECT listing_id, latitude, longitude FROM listing_src2)
)"""

#: Even-odd rule over every edge of every zone whose bounding box holds the point.
_P6 = f"""
WITH {_RESTORED},
zone AS (SELECT zone_id, list_min(ring_lat) AS y0, list_max(ring_lat) AS y1, list_min(ring_lon) AS x0, list_max(ring_lon) AS x1, ring_lat, ring_lon FROM rate_zone),
edge AS (SELECT zone_id, y0, y1, x0, x1, ring_lat[i] AS ay, ring_lon[i] AS ax, ring_lat[i % len(ring_lat) + 1] AS by_, ring_lon[i % len(ring_lat) + 1] AS bx
  FROM (SELECT *, unnest(range(1, len(ring_lat) + 1)) AS i FROM zone)),
hit AS (
  SELECT p.listing_id, e.zone_id, count(*) AS n FROM pos p JOIN edge e
    ON p.lat BETWEEN e.y0 AND e.y1 AND p.lon BETWEEN e.x0 AND e.x1
   AND (e.ax > p.lon) <> (e.bx > p.lon) AND (e.ay + (p.lon - e.ax) * (e.by_ - e.ay) / (e.bx - e.ax)) < p.lat
  GROUP BY 1, 2)
SELECT listing_id, 'zone' AS target_kind, zone_id AS target_id FROM hit WHERE n % 2 = 1
UNION ALL
SELECT p.listing_id, 'station', m.station_id FROM pos p JOIN metro m
  ON m.latitude BETWEEN p.lat - 0.01 AND p.lat + 0.01 AND m.longitude BETWEEN p.lon - 0.02 AND p.lon + 0.02
WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(m.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(m.latitude)) * pow(sin(radians(m.longitude - p.lon) / 2), 2))) <= 1.0
"""

_P7 = """
WITH c AS (
  SELECT property_id, property_type, bathrooms, balconies, circle_rate,
         regexp_replace(regexp_replace(lower(coalesce(facing_direction, '')), 'facing', '', 'g'), '[^a-z]', '', 'g') AS f
  FROM property_master)
SELECT property_id, 'bathrooms' AS field_name FROM c WHERE property_type IS DISTINCT FROM 'Residential Plot' AND NOT coalesce(bathrooms BETWEEN 1 AND 12 AND NOT isnan(bathrooms), false)
UNION ALL SELECT property_id, 'balconies' FROM c WHERE property_type IS DISTINCT FROM 'Residential Plot' AND NOT coalesce(balconies BETWEEN 0 AND 12 AND NOT isnan(balconies), false)
UNION ALL SELECT property_id, 'facing_direction' FROM c WHERE f NOT IN ('north', 'south', 'east', 'west', 'northeast', 'northwest', 'southeast', 'southwest', 'n', 's', 'e', 'w', 'ne', 'nw', 'se', 'sw')
UNION ALL SELECT property_id, 'circle_rate' FROM c WHERE NOT coalesce(circle_rate > 0 AND NOT isnan(circle_rate), false)
"""

ORACLE = {"p6_found": _P6, "p7_found": _P7}
