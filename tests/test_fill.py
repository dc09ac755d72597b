import pytest
from pyspark.sql import functions as F

from plinth.operators.fill import COMPASS, Field, compass, fill_property_master, propagate_labels

SCHEMA = "property_id string, city string, locality string, property_type string, project_society_name string, covered_area_sqft double, bhk double, bathrooms double, balconies double, facing_direction string, circle_rate double, as_of date"


def _p(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_compass(spark):
    x = spark.createDataFrame([(s,) for s in ("North-East Facing", "north east", "NE", "?", "No Info", "", None, "South - West", "nan", "west")], "f string")
    assert [r[0] for r in x.select(compass(F.col("f"))).collect()] == ["North-East", "North-East", "North-East", None, None, None, None, "South-West", None, "West"]


def test_fills_flags_and_clamping(spark):
    import datetime as dt

    d = dt.date(2025, 1, 1)
    x = _p(spark, [
        ("a", "C", "L", "Apartment", "S", 1000.0, 2.0, 2.0, 1.0, "North", 4000.0, d), ("b", "C", "L", "Apartment", "S", 1010.0, 2.0, 2.0, 1.0, "North", 4100.0, d),
        ("c", "C", "L", "Apartment", "S", 990.0, 2.0, None, -1.0, "?", 0.0, d), ("p", "C", "L", "Residential Plot", None, 2000.0, None, None, None, "NA", 5000.0, d),
        ("z", None, None, None, None, None, None, 99.0, float("nan"), None, -999.0, None),
    ])
    got = {(r.property_id, r.field_name): r for r in fill_property_master(x).collect()}
    assert (got["a", "bathrooms"].value_num, got["a", "bathrooms"].filled) == (2.0, False)
    c = {f: got["c", f] for f in ("bathrooms", "balconies", "facing_direction", "circle_rate")}
    assert all(r.filled for r in c.values()) and c["bathrooms"].value_num == 2 and c["balconies"].value_num == 1 and c["facing_direction"].value_cat == "North" and 4000 <= c["circle_rate"].value_num <= 4600
    assert ("p", "bathrooms") not in got and got["p", "facing_direction"].filled
    assert all(got["z", f].filled and (got["z", f].value_num is not None or got["z", f].value_cat) for f in ("bathrooms", "balconies", "circle_rate", "facing_direction"))


def test_labels_travel_through_unlabelled_groups(spark):
    x = spark.createDataFrame([(1, "a", "x", 10.0), (2, "a", "y", None), (3, "b", "y", None)], "id int, g string, h string, v double")
    f = [Field("v", F.col("v"), F.lit(True))]
    got = {r.id: r.value_num for r in propagate_labels(x, "id", f, {"g": ([F.col("g")], 1.0), "h": ([F.col("h")], 1.0)}, rounds=4).collect()}
    assert got == pytest.approx({1: 10.0, 2: 10.0, 3: 10.0})


def test_empty_repeats_and_nothing_known(spark):
    x = _p(spark, [("a", "C", "L", "Apartment", "S", 1.0, 2.0, None, None, None, None, None)] * 2).withColumn("pair", F.lit(1))
    got = fill_property_master(x)
    assert got.count() == 8 and got.where("filled and value_num is null and value_cat is null").count() >= 6
    assert fill_property_master(x.where("false")).count() == 0
    assert set(COMPASS) and got.columns == ["property_id", "field_name", "value_num", "value_cat", "filled"]


def test_each_kind_of_hub_is_sent_by_its_own_size(spark):
    x = spark.range(4000).select("id", (F.col("id") % 3).alias("few"), (F.col("id") % 1500).alias("many"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("double")).alias("v"))
    f = [Field("v", F.col("v"), F.lit(True))]
    hubs = {"few": ([F.col("few")], 1.0), "many": ([F.col("many")], 1.0)}
    results = {}
    for small in (0, 10_000, 4 << 20):  # none broadcast, only the few, both
        got = propagate_labels(x, "id", f, hubs, small=small)
        joins = got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
        results[small] = joins, {r.id: r.value_num for r in got.collect()}
    assert [results[s][0] for s in results] == [0, 1, 2]
    assert all(results[s][1] == pytest.approx(results[0][1]) for s in results) and len(results[0][1]) == 4000
    met = propagate_labels(x, "id", f, hubs)
    met.collect()
    sides, stack = [], [met._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            stack.append(p.plan())
        elif p.nodeName() == "BroadcastExchange":
            sides.append(p.metrics().apply("numOutputRows").value())
        stack.extend(p.children().apply(i) for i in range(p.children().size()))
    assert sorted(sides) == [3, 1500]  # no broadcast holds the hubs of another kind
