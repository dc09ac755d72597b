import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators.geo import haversine_km, listing_targets, points_within, regions_containing, restored_position, trapezoids


def _inside(x, y, xs, ys):
    hit = False
    for i in range(len(xs)):
        j = (i + 1) % len(xs)
        if (xs[i] > x) != (xs[j] > x) and ys[i] + (x - xs[i]) * (ys[j] - ys[i]) / (xs[j] - xs[i]) < y:
            hit = not hit
    return hit


def _star(rng, cx, cy, n):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    r = [rng.uniform(0.01, 0.05) for _ in range(n)]
    return [cx + q * math.cos(t) for q, t in zip(r, a)], [cy + q * math.sin(t) for q, t in zip(r, a)]


def test_regions_against_even_odd_rule(spark, rows):
    rng = random.Random(1)
    regions = [(i, *reversed(_star(rng, 77 + rng.random() * 0.2, 28 + rng.random() * 0.2, 3 + i % 14))) for i in range(40)]
    points = [(i, 28 + rng.random() * 0.25, 77 + rng.random() * 0.25) for i in range(600)]
    got = rows(regions_containing(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(regions, "region_id long, ring_lat array<double>, ring_lon array<double>")))
    want = sorted(((p, r) for p, y, x in points for r, ys, xs in regions if _inside(x, y, xs, ys)), key=lambda t: tuple((False, str(v)) for v in t))
    assert got == want and len(want) > 50


def test_large_regions_take_the_unhinted_join(spark):
    square = spark.createDataFrame([(1, [28.0, 28.1, 28.1, 28.0], [77.0, 77.0, 77.1, 77.1])], "region_id long, ring_lat array<double>, ring_lon array<double>")
    p = spark.createDataFrame([(1, 28.05, 77.05), (2, 28.2, 77.05), (3, None, 77.0)], "id long, lat double, lon double")
    assert [tuple(r) for r in regions_containing(p, square, broadcast_rows=0).collect()] == [(1, 1)]


def test_bad_rings_give_nothing(spark):
    bad = spark.createDataFrame([(1, None, [1.0]), (2, [1.0, 2.0], [1.0, 2.0]), (3, [1.0, 2.0, 3.0], [1.0, 2.0])], "region_id long, ring_lat array<double>, ring_lon array<double>")
    assert trapezoids(bad).count() == 0


def test_points_within_against_brute_force(spark, rows):
    rng = random.Random(2)
    a = [(i, 28 + rng.random() * 0.1, 77 + rng.random() * 0.1) for i in range(200)]
    b = [(i, 28 + rng.random() * 0.1, 77 + rng.random() * 0.1) for i in range(60)]
    da, db = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (a, b))
    cross = da.alias("a").crossJoin(db.alias("b")).where(haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 1).select("a.id", "b.id")
    assert sorted(tuple(r) for r in points_within(da, db, 1.0).select("point_id", "other_id").collect()) == sorted(tuple(r) for r in cross.collect())


def test_restored_positions(spark):
    x = spark.createDataFrame([(28.5, 77.1), (77.1, 28.5), (28500000.0, 77100000.0), (77100000.0, 28500000.0), (0.0, 0.0), (None, 77.1), (float("nan"), 77.1), (50.0, 50.0)], "la double, lo double")
    got = [tuple(r[0]) if r[0] else None for r in x.select(restored_position(F.col("la"), F.col("lo"))).collect()]
    assert got == [(28.5, 77.1)] * 4 + [None] * 4


def test_distance_of_unknown_positions_is_null(spark):
    r = spark.sql("select cast(null as double) a, 77.0d b, 28.0d c, 77.0d d").select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()
    assert r[0] is None


def test_listing_targets_empty_and_repeated(spark):
    l = spark.createDataFrame([(1, 28.05, 77.05), (1, 28.05, 77.05)], "listing_id long, latitude double, longitude double").withColumn("cy", F.lit(3))
    s = spark.createDataFrame([(5, 28.051, 77.05)], "station_id long, latitude double, longitude double")
    z = spark.createDataFrame([(7, 4000.0, [28.0, 28.1, 28.1, 28.0], [77.0, 77.0, 77.1, 77.1])], "zone_id long, circle_rate double, ring_lat array<double>, ring_lon array<double>")
    assert sorted((r.target_kind, r.target_id, r.circle_rate) for r in listing_targets(l, s, z).collect()) == [("station", 5, None)] * 2 + [("zone", 7, 4000.0)] * 2
    assert listing_targets(l.where("false"), s, z).count() == 0 and listing_targets(l, s.where("false"), z.where("false")).count() == 0
    assert pytest.approx(0.111, abs=0.002) == listing_targets(l, s, z).where("target_kind = 'station'").first().km
