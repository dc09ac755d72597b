import json

import pytest
from pyspark.sql import functions as F

from plinth.schema import LISTING
from plinth.sources import readers, writers
from plinth.streaming import panel as streams


def _put(tmp_path, name, data):
    p = tmp_path / name
    p.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False))
    return f"file://{p}"


def test_rate_shapes(spark, tmp_path, rows):
    flat = readers.rates_flat(spark, _put(tmp_path, "Greater-Noida_CircleRate (1).json", {"Sector 1": 10.5, "Sector 2": [1, 20], "x": "-"}))
    assert rows(flat, "city", "locality", "rate") == [("greater noida", "Sector 1", 10.5), ("greater noida", "Sector 2", 20.0)]
    nested = readers.rates_nested(spark, _put(tmp_path, "o.json", {"Delhi": {"A": 3, "B": None}, "_meta": {"A": 1}}))
    assert rows(nested, "city", "locality", "rate") == [("delhi", "A", 3.0)]
    rec = readers.rates_records(spark, _put(tmp_path, "jaipur_circle_rates.json", [{"locality": "A", "property_type": "Residential", "circle_rate_sqft": "0", "rate": 7}, {"city": "Alwar", "locality": "B", "circle_rate": 5}]))
    assert rows(rec, "city", "locality", "rate") == [("alwar", "B", 5.0), ("jaipur", "A", 7.0)]
    rng = readers.rates_ranges(spark, _put(tmp_path, "pune.json", {"K": {"Residential_Flats_Apts": [100, 200], "Land": [10, 20], "Office": [300, 400], "Shop": [500, 700]}}))
    assert rows(rng, "property_type", "rate") == [("Commercial", 600.0), ("Residential", 150.0)]
    zone = readers.rates_zones(spark, _put(tmp_path, "z.json", [{"Zones": [{"Zone": "Zone A", "Rows": [{"Type Of Land": "Residential", "Exterior": "1,200", "Colony": "Red Colony, Other"}, {"Type Of Land": "Commercial", "Exterior": "9000", "Colony": None}]}]}]))
    assert rows(zone, "locality", "rate") == [("Red Colony", 1200.0), ("Zone A", 1200.0)]
    assert readers.with_order([flat, nested]).count() == 3


def test_roads_stations_series(spark, tmp_path, rows):
    g = {"features": [{"properties": {"ref": "NH48", "fclass": " ", "highway": "trunk"}, "geometry": {"type": "LineString", "coordinates": [[77, 28], [77.1, 28.1]]}}, {"properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[77, 28], [77, 29]], [[1, 1]]]}}]}
    r = readers.read_roads(spark, _put(tmp_path, "road.geojson", g))
    assert rows(r, "ref", "fclass") == [("NH48", "trunk"), (None, None)]
    assert readers.read_stations(spark, _put(tmp_path, "m.csv", "Latitude,Longitude\n28.1,77.1\nx,77\n")).count() == 1
    (tmp_path / "t" / "delhi").mkdir(parents=True)
    _put(tmp_path / "t" / "delhi", "saket.csv", "date,price_per_sqft\n2025-01-01,100\nbad,5\n")
    assert rows(readers.read_series(spark, f"file://{tmp_path}/t"), "city", "locality", "value") == [("delhi", "saket", 100.0)]


def test_csv_and_versions(spark, tmp_path):
    p = _put(tmp_path, "a.csv", 'listing_id,description,extra\n1,"two\nlines, ""quoted""",z\n')
    assert readers.preferred(spark, p) == p
    r = readers.read_csv(spark, p, LISTING, ["listing_id", "description", "price"]).first()
    assert (r.listing_id, r.description) == (1, 'two\nlines, "quoted"')
    _put(tmp_path, "a_new.csv", "listing_id\n2\n")
    assert readers.preferred(spark, p).endswith("a_new.csv")
    for v in ("v9", "v10"):
        (tmp_path / "m" / v).mkdir(parents=True)
    assert readers.latest_version(spark, f"file://{tmp_path}/m").rstrip("/").endswith("v10")
    assert readers.quoted('public.a"b') == '"public"."a""b"'
    with pytest.raises(ValueError, match="password"):
        readers.connection({"host": "h", "dbname": "d", "user": "u"})


def test_writers(spark, tmp_path, rows):
    x = spark.createDataFrame([("a", 900.0, 1), ("a", 700.0, 2), ("b", 5.0, 3)], "kind string, price_per_sqft double, gate int")
    writers.write_by_kind(x, f"file://{tmp_path}/k", "kind", {"a": 800.0, "b": 1.0}, drop={"b": ["gate"]})
    assert rows(spark.read.parquet(f"file://{tmp_path}/k"), "kind", "gate") == [("a", 1), ("b", None)]
    writers.write_table(x, f"file://{tmp_path}/t", partition_by=["kind"], sort_by=["gate"])
    assert "gate" in str(spark.read.parquet(f"file://{tmp_path}/t").where("gate = 2")._jdf.queryExecution().executedPlan().toString())
    assert writers.write_database(x, "jdbc:none", "t", dry_run=True) == {"kind": "TEXT", "price_per_sqft": "DOUBLE PRECISION", "gate": "DOUBLE PRECISION"}
    reg = f"file://{tmp_path}/registry"
    assert [writers.register_model(spark, reg, "m", {"r2": 0.9}, f"p{i}") for i in (1, 2)] == [1, 2] and writers.promoted(spark, reg, "m") == "p2"
    writers.write_report(x, f"file://{tmp_path}/r", run="1")
    assert spark.read.json(f"file://{tmp_path}/r").where("run = '1'").count() == 3


def test_streams(spark, tmp_path, rows):
    e = spark.createDataFrame([("k", "2025-01-01", "a"), ("k", "2025-01-01", "b"), ("k", "2025-01-08", "b"), ("k", "2025-01-15", "c")], "key string, d string, property_id string").select("key", F.to_timestamp("d").alias("snapshot"), "property_id")
    e.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = streams.absorption_stream(streams.event_stream(spark, f"file://{tmp_path}/in", e.schema))
    streams.run_to_end(s, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("snapshot").select("supply", "absorbed").collect()] == [(2, 1), (1, 1)]
