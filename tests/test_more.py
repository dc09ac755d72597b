import json

import pytest
from pyspark.sql import functions as F

from plinth.functions import fuzzy, plots
from plinth.operators import filters, forecast, keys, learn, lookup, nearest, stats
from plinth.operators.fill import Field, propagate_labels
from plinth.session import release, shared_dir, small_side, stored_bytes, written
from plinth.sources import readers, writers


def _put(tmp_path, name, data):
    p = tmp_path / name
    p.write_text(json.dumps(data, ensure_ascii=False))
    return f"file://{p}"


def test_rate_files_in_load_order(spark, tmp_path, rows):
    deep = readers.rates_under(spark, _put(tmp_path, "d.json", {"r": {"Town": {"land": [{"locality": "Rajpur Road (A to B)", "big": None, "small": 50}, {"locality": "", "small": 1}, {"locality": "Mall", "big": 9, "small": 7}]}}}), "$.r.Town.land", "town", ("big", "small"))
    assert rows(deep, "locality", "rate") == [("Mall", 9.0), ("Rajpur Road", 50.0), ("Rajpur Road (A to B)", 50.0)]
    zone = readers.rates_with_zone(spark, _put(tmp_path, "alwar_circle.json", [{"locality": "L", "property_type": "krishi", "zone": "Z", "circle_rate_sqft": 4}, {"locality": None, "zone": "Z", "circle_rate_sqft": 9}, {"locality": "M", "circle_rate_sqft": "x"}]))
    assert rows(zone, "city", "locality", "rate") == [("alwar", "L", 4.0), ("alwar", "Z", 4.0)]
    mixed = readers.rates_nested(spark, _put(tmp_path, "noida_circle_rate.json", {"Delhi": {"A": 3, "_note": 1}, "Sector 5": 8, "_meta": 2}))
    assert rows(mixed, "city", "locality", "rate") == [("delhi", "A", 3.0), ("noida", "Sector 5", 8.0)]
    first = readers.rates_records(spark, _put(tmp_path, "x_circle_rates.json", [{"city": "delhi", "locality": "A", "property_type": "Commercial", "rate": 30}, {"city": "delhi", "locality": "A", "property_type": "Residential", "rate": 20}, {"city": "delhi", "locality": "A", "property_type": "Residential", "rate": 10}]))
    got = {(r.kind): (r.rate, r.default_rate) for r in readers.all_rates([first, mixed]).where("locality = 'a'").collect()}
    assert got == {"Commercial": (30.0, 3.0), "Residential": (20.0, 3.0)}  # the file loaded last gives the default
    (tmp_path / "Main_Road.geojson").write_text("{}")
    assert [p.rsplit("/", 1)[-1] for p in readers.road_files(spark, f"file://{tmp_path}")] == ["Main_Road.geojson"]


def test_keys(spark):
    x = spark.createDataFrame([("New  delhi", "Com. shop", None, "Penthouse"), ("gr noida", "other", "res_house", "x"), (" ", None, "", "Land"), (None, "Agri", "nan", None)], "c string, k string, g string, t string")
    got = x.select(keys.market_city(F.col("c")), keys.rate_city(F.col("c")), keys.forecast_city(F.col("c")), keys.rate_class(F.col("k")), keys.segment(F.col("g"), F.col("t")), keys.donor_city(F.col("c"), {"delhi": "Delhi"})).collect()
    assert [tuple(r) for r in got] == [("Delhi", "delhi", "delhi", "Commercial", "apt", "Delhi"), ("Greater Noida", "greater noida", "gr_noida", "Other", "house_villa", "gr noida"), (None, "", "", None, "plot", ""), (None, None, None, "Agricultural", None, "")]
    d = spark.createDataFrame([("2025-01-01 10:00:00", "2025-01-01 20:00:00"), ("2025-01-01 10:00:00", "2025-01-03 09:00:00"), (None, "2025-01-03 09:00:00"), ("2025-02-01 00:00:00", "2025-01-01 00:00:00")], "p string, s string")
    assert [r[0] for r in d.select(keys.days_listed(F.col("p").cast("timestamp"), F.col("s").cast("timestamp"))).collect()] == [None, 1.0, 0.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([("noida extension",), ("x",)], "l string").select(keys.overridden_city(F.lit("Noida"), F.col("l"))).collect()] == ["Greater Noida", "Noida"]


def test_filters_and_nulls(spark):
    x = spark.createDataFrame([(1, 2.0, 900.0, 5000.0), (2, float("nan"), 900.0, 5000.0), (3, None, 900.0, 5000.0), (4, 7.0, 900.0, 5000.0), (5, 6.0, 350.0, 40000.0)], "id int, bhk double, area double, price_per_sqft double")
    limits = {k: v for k, v in filters.LIMITS["sale"].items() if k != "floors"}
    assert [r.id for r in x.where(filters.within(limits)).collect()] == [1, 5]
    assert [r[0] for r in x.select(filters.plausible_ratio(F.col("bhk"), F.lit(2.0))).collect()] == [True, False, False, True, True]
    y = spark.createDataFrame([("A.B",), ("axb",), (None,)], "t string")
    assert [r[0] for r in y.select(filters.contains_text(F.col("t"), "a.b")).collect()] == [True, False, False] and y.where(filters.contains_text(F.col("t"), " ")).count() == 3
    s = spark.createDataFrame([(i, float(i)) for i in range(100)], "id int, s double")
    assert filters.without_outliers(s, s, "id", "s", 0.05).count() == 95


PLOT = "250 square yards Plot. The plot is South West facing. available at a price of Rs 1.5 Cr. width of the facing road is 12 mt. maximum floor allowed for construction on this plot is 4. Corner, back-lane, Leasehold, New Property, RERA. most popular landmarks near this plot are Big Park, City School, ab, Old Fort  Residential Plot. near metro and water supply"


def test_plot_texts(spark):
    x = spark.createDataFrame([(PLOT,), ("for 45 Lacs, road of 9 mtr, up to three floors, North - East Sale Price 100",), ("",), (None,)], "t string")
    a, b, c, d = [r[0] for r in x.select(plots.plot_fields(F.col("t"))).collect()]
    assert (a.area_value, a.area_unit, a.price, a.facing, a.road_width_m, a.floors_allowed, a.tenure, a.status, a.corner, a.backlane, a.rera) == (250.0, "Sq-yrd", 1.5e7, "South-West", 12.0, 4, "Leasehold", "New", 1, 1, 1)
    assert (b.price, b.road_width_m, b.floors_allowed, b.facing, b.gated) == (100.0, 9.0, 3, "North-East", 0) and c.corner == 0 and c.price is None and d is None
    around = [r[0] for r in x.select(plots.surroundings(F.col("t"))).collect()]
    assert around[0] == ["Big Park", "City School", "Old Fort", "school", "metro", "water_supply"] or around[0][:3] == ["Big Park", "City School", "Old Fort"] and "metro" in around[0]
    assert around[2] is None and around[3] is None
    k = spark.createDataFrame([("Gym, Garden/Park: big, Unknown, ATM",), (None,)], "a string").select(plots.amenity_keywords(F.col("a"))).collect()
    assert [r[0] for r in k] == [["atm_bank", "garden", "gymnasium", "park"], []]
    assert [r[0] for r in spark.createDataFrame([("the North - East facing",), (None,)], "f string").select(plots.plain_direction(F.col("f"))).collect()] == ["North East", None]


def test_scores_of_localities(spark, rows):
    pairs = [("sector 5 block a", "sector 5"), ("sector 5", "sector 6"), ("green park", "green park extension"), ("abc", "xyz"), ("same", "same")]
    x = spark.createDataFrame(pairs, "q string, c string").withColumn("r", fuzzy.best_of_three("q", "c"))
    got = {(r.q, r.c): (r.r, r.s) for r in x.withColumn("s", lookup.composite_score(F.col("q"), F.col("c"), F.col("r"))).collect()}
    assert got["same", "same"][1] == 1000.0 and got["green park", "green park extension"] == (100.0, 100.0 + 28 + 10 + 12)
    assert got["sector 5", "sector 6"][1] == pytest.approx(got["sector 5", "sector 6"][0] + 28.0 / 1 * 0 - 25.0) and got["abc", "xyz"][1] == 0.0
    y = spark.createDataFrame([("a_b", "a_b_c", 0.75), ("a", "a", 0.0)], "q string, c string, r double").select(lookup.slug_score(F.col("q"), F.col("c"), F.col("r")))
    assert [r[0] for r in y.collect()] == [75 + 12 + 8 + 20, 100.0]
    e = spark.createDataFrame([("delhi", "green park extension", {"Residential": 5.0}, 4.0), ("delhi", "saket", {"Plot": 3.0}, None)], "city string, locality string, rates map<string,double>, default_rate double")
    r = spark.createDataFrame([("delhi", "Green  Park"), ("delhi", "SAKET"), ("delhi", "qqqq"), ("pune", "saket"), (None, "saket"), ("delhi", None)], "city string, locality string")
    assert rows(lookup.composite_lookup(r, e), "locality", "found", "rate") == [("Green  Park", "green park extension", 5.0), ("SAKET", "saket", 3.0)]
    t = spark.createDataFrame([("new delhi", "saket 2"), ("pune", "baner")], "city string, locality string")
    assert rows(lookup.trend_locality(spark.createDataFrame([("Delhi", "Saket2"), ("Delhi", "baner"), ("Agra", "Baner"), ("Delhi", "zzzz")], "city string, locality string"), t), "city", "locality", "found") == [("Agra", "Baner", "baner"), ("Delhi", "Saket2", "saket 2")]


def test_place_of_text(spark, rows):
    g = spark.createDataFrame([("delhi", "Green Park"), ("delhi", "Saket"), ("delhi", "Hauz Khas")], "city string, locality string")
    x = spark.createDataFrame([(1, "delhi", "Saket", "Sec 5, x", None), (2, "delhi", None, "near saket, sector 9a", "Flat in Green Park"), (3, "delhi", " ", "Huaz Khas, 110016", None), (4, "delhi", None, "sector 12", None), (5, "delhi", None, None, None), (6, None, None, "sector 3", "x")], "id int, city string, locality string, address string, description string")
    assert rows(lookup.place_of_text(x, g), "id", "place") == [(1, "Saket, Sector 5"), (2, "Green Park, Sector 9A"), (3, "Hauz Khas"), (4, "Sector 12"), (6, "Sector 3")]


def test_rates_for_listings_and_far_donors(spark, rows):
    t = spark.createDataFrame([("delhi", "saket", "Residential", 5.0, 5.0), ("delhi", "saket", "Plot", 7.0, 5.0)], "city string, locality string, kind string, rate double, default_rate double")
    x = spark.createDataFrame([(1, "Delhi", "Saket", "Plot", 28.5, 77.2), (2, "Delhi", "Nowhere", "Plot", 28.51, 77.2), (3, "Delhi", "Nowhere", "Plot", 12.0, 80.0), (4, "Delhi", None, None, None, None)], "id int, city string, locality string, kind string, lat double, lon double")
    assert rows(lookup.rates_for_listings(x, t), "id", "rate", "source") == [(1, 7.0, "place"), (2, 7.0, "nearest")]
    assert rows(lookup.rates_for_listings(x, t, None, drop_unresolved=False), "id", "rate", "source") == [(1, 7.0, "place"), (2, 7.0, "nearest"), (3, 7.0, "nearest"), (4, None, None)]
    assert nearest.nearest_any(x.select("id", "lat", "lon", F.lit(None).cast("double").alias("value"))).count() == 0


def test_series_growth(spark, rows):
    s = spark.createDataFrame([("a", f"2024-{m:02d}-01", float(v)) for m, v in ((1, 100), (4, 110), (7, 120), (10, 130))] + [("a", "2025-01-01", 150.0), ("b", "2020-01-01", 5.0), ("c", "2024-01-01", 0.0)], "k string, date string, value double")
    g = {r.k: (str(r.base_date), str(r.target_date), r.yoy_pct) for r in forecast.growth_from(s, ["k"], F.lit("2024-02-01")).collect()}
    assert g == {"a": ("2024-04-01", "2025-01-01", pytest.approx((150 / 110 - 1) * 100)), "b": ("2020-01-01", "2020-01-01", 0.0)}
    q = forecast.numbered(s, ["k"])
    assert rows(forecast.quarter_growth(q, ["k"]), "k", "year_no", "anchor", "target") == [("a", 1, 100.0, 130.0)]
    assert rows(forecast.at_horizon(q, ["k"], 3), "k", "value") == [("a", 150.0), ("b", 5.0), ("c", 0.0)]
    assert stats.with_tier(spark.createDataFrame([("x",), ("y",)], "l string"), spark.createDataFrame([("x", 1.0, "mid")], "l string, median double, tier string"), "l").orderBy("l").collect()[1].tier == "budget"


def test_votes_and_frequent_values(spark):
    x = spark.createDataFrame([(1, "b", 0.0, "N"), (2, "b", 1.0, "S"), (3, "b", 1.1, "S"), (4, "b", 0.9, None), (5, "b", 0.0, None), (6, "z", 0.0, None)], "id int, g string, f double, y string")
    assert {r.id: r.value for r in learn.knn_vote(x, "id", ["g"], ["f"], "y", k=3).collect()} == {4: "S", 5: "N"}
    assert [r.y for r in learn.most_frequent(x, ["y"]).orderBy("id").collect()] == ["N", "S", "S", "S", "S", "S"]
    p = learn.mixed_preprocessor(["f"], ["y"]).fit(learn.most_frequent(x, ["y"])).transform(learn.most_frequent(x, ["y"]))
    assert len(p.first().features) == 3


def test_trainers(spark, tmp_path):
    rows_ = [(f"p{i}", 500.0 + i * 7 % 3000, float(1 + i % 4), 4000.0 + (i % 5) * 500, (4000.0 + (i % 5) * 500) * 2, "AB"[i % 2], 9000.0 + i % 5 * 1000) for i in range(400)]
    x = spark.createDataFrame(rows_, "property_id string, area double, bhk double, circle_rate double, price_per_sqft double, kind string, rent double")
    model, errors = learn.train_segment(x, "sale", ["area", "bhk", "circle_rate"], ["kind"], "property_id", {}, trees=5)
    assert errors.first()["mape"] < 0.05
    _, errors = learn.train_segment(x, "apartment rent", ["area", "bhk", "circle_rate"], ["kind"], "property_id", {}, trees=5)
    assert errors.first()["n"] > 20
    train, test = learn.hash_split(x, "property_id")
    best, tried = learn.random_search(train, test, ["area", "circle_rate"], ["kind"], "price_per_sqft", "area", draws=1)
    assert len(tried) == 2 and tried[0][0] == {} and best is not None
    curve = learn.learning_curve(train, test, ["circle_rate"], ["kind"], "price_per_sqft", "property_id", (0.5, 1.0), trees=5)
    assert [s for s, _ in curve] == [0.5, 1.0]
    model.write().overwrite().save(f"file://{tmp_path}/m")
    writers.register_model(spark, f"file://{tmp_path}/r", "sale", {"mae": 1.0}, f"file://{tmp_path}/m")
    assert writers.load_model(spark, f"file://{tmp_path}/r", "sale").stages and writers.load_model(spark, f"file://{tmp_path}/none", "sale") is None


def test_written_tables_are_measured_and_released(spark):
    t = written(spark.range(1000).toDF("id"), "t")
    assert stored_bytes(t) > 0 and small_side(t) is not None and small_side(t, 10) is None and t.count() == 1000
    assert release(spark) >= 1 and release(spark) == 0 and shared_dir(spark)


def test_labels_beyond_the_broadcast_bound_are_the_same(spark):
    rows_ = [(i, "hot" if i % 3 else f"g{i % 7}", f"h{i % 5}", float(i % 4) if i % 5 else None, "NS"[i % 2] if i % 4 else None) for i in range(300)]
    x = spark.createDataFrame(rows_, "id int, g string, h string, v double, c string")
    f = [Field("v", F.col("v"), F.lit(True)), Field("c", F.col("c"), F.lit(True), ("N", "S"), (("g", 1.0),))]
    hubs = {"g": ([F.col("g")], 2.0), "h": ([F.col("h")], 1.0)}
    get = lambda **o: {(r.id, r.field_name): (None if r.value_num is None else round(r.value_num, 6), r.value_cat, r.filled) for r in propagate_labels(x, "id", f, hubs, **o).collect()}
    one, two = get(), get(small=0, salts=3)
    assert one == two and len(one) == 600 and all(v[0] is not None or v[1] for v in one.values())


def test_a_long_chain_of_groups_is_filled_to_its_end(spark):
    n = 12
    x = spark.createDataFrame([(0, "a0", "b0", 8.0)] + [(i, f"a{(i + 1) // 2}", f"b{i // 2}", None) for i in range(1, n)], "id int, g string, h string, v double")
    got = {r.id: r.value_num for r in propagate_labels(x, "id", [Field("v", F.col("v"), F.lit(True))], {"g": ([F.col("g")], 1.0), "h": ([F.col("h")], 1.0)}).collect()}
    assert got == pytest.approx(dict.fromkeys(range(n), 8.0), rel=1e-2)
