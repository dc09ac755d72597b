"""Nearest donors, stations and roads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.geo import EARTH_KM, haversine_km

KM_LAT, KM_LON = 110.574, 111.320


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("int")


def nearest_within(targets: DataFrame, donors: DataFrame, km: float, on: list[str] | None = None, *, finest: float = 0.02) -> DataFrame:
    """target_id, donor_id, value, km: the nearest donor within ``km``, by great-circle distance, then donor id. Both: id, lat, lon, ``on``...; donors: value.

    Donors of one position count as the first of them by id, and each stands in one cell of each of some nested grids, from ``km`` down to
    ``finest`` km, four times finer each time. A target takes the finest grid in which its own cell holds a donor; the nearest donor of that
    cell bounds the distance, and only the cells that a circle of this radius touches are searched. So the pairs grow with the targets and not
    with targets times donors, unless many of either lie apart from the other. All joins are equi-joins, and pairs meet no sort before the
    distance has been bounded. Recorded latitudes beyond 85 degrees stay in the widest grid.
    """
    on = on or []
    dy = km / 111.0 * 1.001
    dx = dy / math.cos(math.radians(60))
    deepest = max(0, math.ceil(math.log(km / finest, 4)))
    lat, lon, usual = F.col("a_lat"), F.col("a_lon"), lambda c: F.abs(c) <= 85
    fine = lambda lv: F.pow(F.lit(4.0), lv)
    cell = lambda c, width, lv: F.floor(c / F.lit(width) * fine(lv))
    levels = lambda c: F.explode(F.when(usual(c), F.sequence(F.lit(0), F.lit(deepest))).otherwise(F.array(F.lit(0))))
    b = donors.where("lat is not null and lon is not null and value is not null").groupBy(*on, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.min_by(F.struct(F.col("id").alias("donor_id"), "value"), "id").alias("d"))
    b = b.select(*on, "b_lat", "b_lon", "d", levels(F.col("b_lat")).alias("lv")).withColumns({"cy": cell(F.col("b_lat"), dy, F.col("lv")), "cx": cell(F.col("b_lon"), dx, F.col("lv"))})
    at, key = [*on, "lv", "cy", "cx"], ["target_id", "a_lat", "a_lon", *on]
    own = lambda x: x.withColumns({"cy": cell(lat, dy, F.col("lv")), "cx": cell(lon, dx, F.col("lv"))})
    a = own(targets.select(F.col("id").alias("target_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *on).where("a_lat is not null and a_lon is not null").withColumn("lv", levels(lat)))
    a = a.join(b.select(*at).distinct().withColumn("held", F.lit(True)), at, "left").groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("held"), F.col("lv"))), F.lit(0)).alias("lv"))
    d = haversine_km(lat, lon, F.col("b_lat"), F.col("b_lon"))
    a = own(a).join(b, at, "left").groupBy(*key, "lv").agg(F.min(d).alias("r"))
    a = a.withColumn("r", F.least(F.coalesce("r", F.lit(float(km))), F.lit(float(km))) * (1 + 1e-9) + 1e-9)
    # the circle's extent in degrees: exact up to the poles; beyond them, where a position is no place, the neighbouring cells
    up, wide = F.col("r") / 111.0 * 1.001, F.sin(F.col("r") / F.lit(EARTH_KM)) / F.cos(F.radians(lat))
    side = F.when(F.abs(lat) > 90, F.lit(dx)).when((F.col("r") < 1e4) & (wide >= 0) & (wide < 1), F.degrees(F.asin(wide)) * 1.001).otherwise(F.lit(360.0))
    reached = lambda c, by, width: F.explode(F.sequence(cell(c - by, width, F.col("lv")), cell(c + by, width, F.col("lv"))))
    x = a.select(*key, "r", "lv", reached(lat, up, dy).alias("cy"), side.alias("side")).select(*key, "r", "lv", "cy", reached(lon, F.col("side"), dx).alias("cx"))
    x = x.join(b, at).withColumn("km", d).where((F.col("km") <= F.col("r")) & (F.col("km") <= km))
    return x.groupBy("target_id").agg(F.min_by(F.struct("d.donor_id", "d.value", "km"), F.struct("km", "d.donor_id")).alias("m")).select("target_id", "m.*")


def tiered_fill(rows: DataFrame, pools: list[list[str]], km: float) -> DataFrame:
    """id, value, km, tier: rows without a value take that of the nearest row that has one, from the first pool that holds any such row within ``km``.

    ``rows``: id, lat, lon, value and the pools' columns. Pools are lists of columns that must agree, tried in order ([city, kind], [city],
    [kind], []); a later one only takes up the rows that the earlier left. Fills never serve as donors. Rows that find none are left out.
    Runs jobs.
    """
    from plinth.session import written

    have, need = rows.where("value is not null"), rows.where("value is null and lat is not null and lon is not null")
    out = None
    for i, on in enumerate(pools):
        hit = written(nearest_within(need, have, km, on).select(F.col("target_id").alias("id"), "value", "km", F.lit(i).alias("tier")), "tier")
        out = hit if out is None else out.unionByName(hit)
        need = need.join(hit.select("id"), "id", "left_anti")
    return out


def nearest_any(rows: DataFrame, km: float = 5.0, farthest: float = 320.0, salts: int = 64) -> DataFrame:
    """id, value, km: rows without a value take that of the nearest row that has one, however far it is.

    ``rows``: id, lat, lon, value. The search goes as far as ``km``, then, for the rows that are still without a donor, as far as
    ``farthest``; rows with no donor within ``farthest`` are the few that lie apart, and these, as the stated query set, meet
    all donors in ``salts`` blocks. Rows without a position are left out. Runs jobs.
    """
    from plinth.session import written

    have, need = rows.where("value is not null and lat is not null and lon is not null"), rows.where("value is null and lat is not null and lon is not null")
    out = None
    for reach in (km, farthest):
        if not need.limit(1).count():
            break
        hit = written(nearest_within(need, have, reach).select(F.col("target_id").alias("id"), "value", "km"), "nearest")
        out = hit if out is None else out.unionByName(hit)
        need = written(need.join(hit.select("id"), "id", "left_anti"), "apart")
    a = need.select("id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("block"))
    b = have.select(F.col("id").alias("donor"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "value", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("block"))
    x = a.join(b, "block").withColumn("km", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    rest = x.groupBy("id").agg(F.min_by(F.struct("value", "km"), F.struct("km", "donor")).alias("m")).select("id", "m.*")
    return rest if out is None else out.unionByName(rest)


def to_segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance from a point to a segment in km on the plane that touches the earth at the point."""
    kx = F.lit(KM_LON) * F.cos(F.radians(lat))
    x1, y1, x2, y2 = (lon1 - lon) * kx, (lat1 - lat) * KM_LAT, (lon2 - lon) * kx, (lat2 - lat) * KM_LAT
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide(-(x1 * dx + y1 * dy), F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x1 + t * dx, 2) + F.pow(y1 + t * dy, 2))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x, y in the metres of the web map projection, which overstate distances by 1 / cos(latitude)."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def segments_of(features: DataFrame) -> DataFrame:
    """feature_id, lat1, lon1, lat2, lon2 of the consecutive points of each line. ``features``: feature_id, line (array of [lon, lat])."""
    n = F.size("line")
    pairs = F.arrays_zip(F.slice("line", F.lit(1), n - 1).alias("a"), F.slice("line", F.lit(2), n - 1).alias("b"))
    x = features.where("line is not null and size(line) >= 2").select("feature_id", F.explode(pairs).alias("s"))
    return x.select("feature_id", F.col("s.a")[1].alias("lat1"), F.col("s.a")[0].alias("lon1"), F.col("s.b")[1].alias("lat2"), F.col("s.b")[0].alias("lon2"))


def nearest_segment(points: DataFrame, segments: DataFrame, km: float, by: list[str] | None = None) -> DataFrame:
    """point_id, ``by``..., km: the distance to the nearest segment within ``km``, for each class in ``by``. Points: id, lat, lon.

    A segment goes to every grid cell that its box, widened by ``km``, touches; long segments cost cells in proportion to their length.
    """
    by = by or []
    w = max(km, 0.2) / 111.0 * 1.001
    wx = w / math.cos(math.radians(60))
    p = points.select(F.col("id").alias("point_id"), "lat", "lon", _cell(F.col("lat"), w).alias("cy"), _cell(F.col("lon"), wx).alias("cx"))
    lo = lambda a, b, width: F.floor(F.least(a, b) / width).cast("int") - 1
    hi = lambda a, b, width: F.floor(F.greatest(a, b) / width).cast("int") + 1
    s = segments.withColumn("cy", F.explode(F.sequence(lo(F.col("lat1"), F.col("lat2"), w), hi(F.col("lat1"), F.col("lat2"), w)))).withColumn("cx", F.explode(F.sequence(lo(F.col("lon1"), F.col("lon2"), wx), hi(F.col("lon1"), F.col("lon2"), wx))))
    d = to_segment_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return p.join(s, ["cy", "cx"]).withColumn("km", d).where(F.col("km") <= km).groupBy("point_id", *by).agg(F.min("km").alias("km"))
