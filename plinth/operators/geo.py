"""Points near other points, and points in regions, by grid cells and by trapezoidal decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.session import bounded_broadcast

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.19  # a little under the length of a degree of latitude at EARTH_KM, so cells err on the large side


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km (radius 6371.0088); NULL if any coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))  # least() alone would skip a NULL


def restored_position(lat: Column, lon: Column, lat_range: tuple[float, float] = (8.0, 37.0), lon_range: tuple[float, float] = (68.0, 97.0)) -> Column:
    """struct(lat, lon) of a recorded position, NULL where it cannot be restored with certainty.

    The two numbers are tried as degrees, micro-degrees (1e6), ten-millionths (1e7) and negated degrees, each in
    the order given and swapped. The reading counts if exactly one lies in the ranges; the ranges are disjoint, so
    at most one order can fit at any scale. Nulls, NaN and zeros fit none.
    """
    lat, lon = lat.try_cast("double"), lon.try_cast("double")
    readings = []
    for scale in (1.0, 1e6, 1e7, 1e5):
        for sign in (1.0, -1.0):
            for a, b in ((lat, lon), (lon, lat)):
                y, x = a / F.lit(scale * sign), b / F.lit(scale * sign)
                readings.append(F.when(y.between(*lat_range) & x.between(*lon_range) & ~F.isnan(y) & ~F.isnan(x), F.struct(y.alias("lat"), x.alias("lon"))))
    return F.coalesce(*readings)


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("int")


def points_within(points: DataFrame, others: DataFrame, km: float, *, max_lat: float = 60.0, broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs (point_id, other_id, km) at most ``km`` apart. Both sides: id, lat, lon.

    Cells are a little larger than ``km`` at ``max_lat``; ``others`` go to the nine cells around their own, then
    the join is an equi-join on the cell and the exact distance follows. ``others`` is broadcast if it has at most
    ``broadcast_rows`` rows; otherwise the cells are shuffled, and adaptive execution splits a hot one. Null
    positions are in no pair; repeated rows give repeated pairs; empty sides give no pairs. A pair whose latitude
    is beyond ``max_lat`` may be missed. Each side may carry further columns; they are ignored.
    """
    import math

    dy = km / KM_PER_DEGREE * 1.001
    dx = dy / math.cos(math.radians(max_lat))
    a = points.select(F.col("id").alias("point_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), _cell(F.col("lat"), dy).alias("cy"), _cell(F.col("lon"), dx).alias("cx")).where("cy is not null and cx is not null")
    b = others.select(F.col("id").alias("other_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).where("b_lat is not null and b_lon is not null")
    near = F.explode(F.array(*[F.struct((_cell(F.col("b_lat"), dy) + i).alias("cy"), (_cell(F.col("b_lon"), dx) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = bounded_broadcast(b, broadcast_rows).select("*", near.alias("n")).select("other_id", "b_lat", "b_lon", "n.cy", "n.cx")
    d = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return a.join(b, ["cy", "cx"]).withColumn("km", d).where(F.col("km") <= km).select("point_id", "other_id", "km")


def trapezoids(regions: DataFrame, *, cell: float = 0.02) -> DataFrame:
    """The trapezoidal decomposition of simple polygons. ``regions``: region_id, ring_lat, ring_lon.

    The vertical lines through a polygon's corners cut it into slabs, and inside a slab its edges are ordered and
    never cross. One row for each slab and each ``cell`` column and row of the grid it touches: region_id, cy, cx,
    x0, x1, edges, an array of (slope, intercept) from south to north. An edge goes only to the slabs it spans, so
    the size is that of the decomposition. Corners that repeat the first or the one before are dropped; rings with
    null arrays, arrays of unequal length or fewer than three corners give no rows.
    """
    ring = regions.where("ring_lat is not null and ring_lon is not null and size(ring_lat) = size(ring_lon) and size(ring_lat) >= 3")
    ring = ring.select("region_id", F.monotonically_increasing_id().alias("__r"), F.arrays_zip(F.col("ring_lon").alias("x"), F.col("ring_lat").alias("y")).alias("p"))
    # edges from each corner to the next, the last to the first; vertical ones bound no trapezoid
    closed = F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1))
    xs = F.array_sort(F.array_distinct(F.transform("p", lambda q: q["x"])))
    edge = ring.select("region_id", "__r", xs.alias("xs"), F.explode(F.arrays_zip(F.col("p").alias("a"), closed.alias("b"))).alias("e"))
    edge = edge.select(
        "region_id", "__r", "xs",
        F.least("e.a.x", "e.b.x").alias("lo"), F.greatest("e.a.x", "e.b.x").alias("hi"),
        ((F.col("e.b.y") - F.col("e.a.y")) / F.nullif(F.col("e.b.x") - F.col("e.a.x"), F.lit(0.0))).alias("m"),
        F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
    ).where("lo < hi")
    i, j = F.array_position("xs", F.col("lo")), F.array_position("xs", F.col("hi"))
    piece = edge.select("region_id", "__r", "m", (F.col("ay") - F.col("m") * F.col("ax")).alias("c"), "xs", F.explode(F.sequence(i, j - 1)).alias("slab"))
    piece = piece.select("region_id", "__r", "slab", "m", "c", F.element_at("xs", F.col("slab").cast("int")).alias("x0"), F.element_at("xs", (F.col("slab") + 1).cast("int")).alias("x1"))
    mid = F.col("m") * (F.col("x0") + F.col("x1")) / 2 + F.col("c")
    slab = piece.groupBy("region_id", "__r", "slab", "x0", "x1").agg(F.array_sort(F.collect_list(F.struct(mid.alias("k"), F.col("m"), F.col("c")))).alias("edges"))
    at = lambda x, q: q["m"] * x + q["c"]
    ends = F.concat(F.transform("edges", lambda q: at(F.col("x0"), q)), F.transform("edges", lambda q: at(F.col("x1"), q)))
    slab = slab.withColumns({"y0": F.array_min(ends), "y1": F.array_max(ends)})
    slab = slab.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), cell), _cell(F.col("x1"), cell))))
    slab = slab.withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell), _cell(F.col("y1"), cell))))
    return slab.select("region_id", "cy", "cx", "x0", "x1", F.transform("edges", lambda q: F.struct(q["m"].alias("m"), q["c"].alias("c"))).alias("edges"))


def _edges_below(edges: Column, x: Column, y: Column) -> Column:
    """How many of a slab's ordered edges lie south of (x, y), by binary search, a fold over as many halvings as the array needs."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(edges) + 1.0)).cast("int")))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        e = F.get(edges, mid)
        south = e["m"] * x + e["c"] < y
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & south, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~south, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def regions_containing(points: DataFrame, regions: DataFrame, *, cell: float = 0.02, broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs (point_id, region_id) of the regions whose polygon contains the point. Points: id, lat, lon; regions: region_id, ring_lat, ring_lon.

    Regions are decomposed into trapezoids, which are distributed by grid cell; a point meets the slabs of its own
    cell by an equi-join and finds its place among a slab's edges by binary search: inside if the number of edges
    to its south is odd. Regions may overlap. The decomposition is broadcast if it has at most ``broadcast_rows``
    rows. Null positions are in no pair; repeated points give repeated pairs, repeated regions repeated ids; empty
    sides give no pairs. Further columns are ignored.
    """
    p = points.select(F.col("id").alias("point_id"), "lat", "lon", _cell(F.col("lat"), cell).alias("cy"), _cell(F.col("lon"), cell).alias("cx")).where("cy is not null and cx is not null")
    t = bounded_broadcast(trapezoids(regions, cell=cell), broadcast_rows)
    hit = (F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1"))
    # the conditional keeps the search from running on the slabs of the cell that the point is not in
    inside = F.when(hit, _edges_below(F.col("edges"), F.col("lon"), F.col("lat")) % 2 == 1).otherwise(False)
    return p.join(t, ["cy", "cx"]).where(hit).where(inside).select("point_id", "region_id")


def listing_targets(listings: DataFrame, stations: DataFrame, zones: DataFrame, *, km: float = 1.0) -> DataFrame:
    """listing_id, target_kind, target_id, km, circle_rate: stations within ``km`` of each listing, and zones containing it.

    Positions are restored first (``restored_position``); listings without one are in no row. Positions that many
    listings share are looked up once and joined back only if that is fewer rows; here each listing is its own point.
    """
    pos = listings.select(F.col("listing_id").alias("id"), restored_position(F.col("latitude"), F.col("longitude")).alias("q"))
    pts = pos.where("q is not null").select("id", "q.lat", "q.lon")
    st = points_within(pts, stations.select(F.col("station_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), km, max_lat=37.0)
    zn = regions_containing(pts, zones.select(F.struct("zone_id", "circle_rate").alias("region_id"), "ring_lat", "ring_lon"))
    null = F.lit(None).cast(T.DoubleType())
    return st.select(F.col("point_id").alias("listing_id"), F.lit("station").alias("target_kind"), F.col("other_id").alias("target_id"), "km", null.alias("circle_rate")).unionByName(
        zn.select(F.col("point_id").alias("listing_id"), F.lit("zone").alias("target_kind"), F.col("region_id.zone_id").alias("target_id"), null.alias("km"), F.col("region_id.circle_rate").alias("circle_rate"))
    )
