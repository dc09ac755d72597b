import pytest
from pyspark.sql import functions as F

from plinth.operators.units import UnitConflict, UnitGraph, area_graph, convert_units, described_area, described_rate, normalise_listing_units, parsed_price, rate_graph, unit_alias, unit_findings

COLUMNS = "listing_id long, covered_area_value double, covered_area_unit string, covered_area_sqft double, price double, price_raw string, price_per_sqft double, description string"


def test_graph_composes_shortest_affine_paths():
    g = UnitGraph([("c", "f", 1.8, 32.0), ("k", "c", 1.0, -273.15)])
    scale, offset, hops = g.compose("f")["k"]
    assert hops == 2 and scale * 300 + offset == pytest.approx(80.33)
    g.check("f")


def test_graph_refuses_inconsistent_cycles():
    with pytest.raises(UnitConflict):
        UnitGraph([("a", "b", 2.0, 0.0), ("b", "c", 3.0, 0.0), ("a", "c", 7.0, 0.0)]).check("c")
    with pytest.raises(UnitConflict):
        UnitGraph([("a", "b", 0.0, 1.0)])


def test_known_factors():
    to = area_graph().compose("sqft")
    want = {"sqyd": 9, "sqm": 10.7639, "acre": 43560, "hectare": 107639, "bigha": 27000, "biswa": 1350, "marla": 272.25, "kanal": 5445, "guntha": 1089, "ground": 2400}
    assert {k: to[k][0] for k in want} == pytest.approx(want)
    area_graph().check("sqft")
    rate_graph().check("rate:sqft")
    assert rate_graph().compose("rate:sqft")["rate:sqyd"][0] == pytest.approx(1 / 9)


@pytest.mark.parametrize(
    "text, value, alias, second",
    [
        ("Ek dum vastu 425 वर्ग गज ka makan. Balcony alone is 87 sq ft.", 425, "वर्गगज", None),
        ("Club spread over 7700 sq m. Total 1,261 sqft, freehold.", 1261, "sqft", None),
        ("SUPER AREA: 0.019 HA. SOCIETY PARK OF 400 SQ YARDS NEXT DOOR.", 0.019, "ha", None),
        ("Size - 2 kanal 5 marla Registry", 2, "kanal", 5),
        ("168 गज me bana hua, rain water harvesting across 44 acres of township", 168, "गज", None),
        ("Rate Rs 7,813 per sq ft. School within 2 km.", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_described_area(spark, text, value, alias, second):
    r = spark.createDataFrame([(text,)], "t string").select(described_area(F.col("t")).alias("d")).select("d.value", unit_alias(F.col("d.alias")), "d.value2").first()
    assert tuple(r) == (value, alias, second)


def test_rates_and_prices_in_text(spark):
    x = spark.createDataFrame([("Demand 8,184/- per sq.ft. now", "1.93 Cr"), ("Asking @ 3,225 / sq yards", "₹ 64.5 L"), (None, None), ("x", "Rs 7,720,000"), ("x", "call")], "t string, p string")
    assert [tuple(r) for r in x.select(described_rate(F.col("t"))["value"], F.round(parsed_price(F.col("p")), 2)).collect()] == [(8184, 19300000), (3225, 6450000), (None, None), (None, 7720000), (None, None)]


def test_findings_declared_undeclared_and_rates(spark, rows):
    x = spark.createDataFrame([
        (1, 149.95, "sqm", 149.95, 12610000.0, None, 7812.89, None),  # recorded in the declared unit
        (2, 425.44, "Sq.Ft.", 425.44, 16360000.0, None, 4272.66, None),  # in another unit than declared
        (3, 1204.0, "sqft", 1204.0, 1204 * 7000.0, None, 63000.0, None),  # rate per square yard
        (4, 1204.0, "sqft", 1204.0, 1204 * 7000.0, None, 7.0, None),  # rate in thousands
        (5, 1600.0, "sqft", 1600.0, 16000000.0, None, 10000.0, "Area 178 gaj."),  # text in another unit
        (6, 1600.0, None, 1600.0, 16000000.0, None, 10000.0, "Area 1600 sqft."),
        (7, None, None, None, None, None, None, None),
        (8, float("nan"), "", 0.0, float("nan"), "nan", -1.0, "nan"),
    ], COLUMNS)
    assert rows(unit_findings(x)) == [(1, "covered_area_sqft", "sqm"), (2, "covered_area_sqft", "sqyd"), (3, "price_per_sqft", "sqyd"), (4, "price_per_sqft", "thousand"), (5, "description", "sqyd")]
    n = {r.listing_id: r for r in normalise_listing_units(x).collect()}
    assert n[2].area_sqft == pytest.approx(3828.96) and n[4].rate_per_sqft == pytest.approx(7000) and n[7].area_sqft is None and n[8].rate_per_sqft is None


def test_empty_repeated_and_extra_columns(spark):
    one = spark.createDataFrame([(1, 149.95, "sqm", 149.95, 12610000.0, None, 7812.89, None)], COLUMNS).withColumns({"unit": F.lit("x"), "scale": F.lit(1), "t_d": F.lit(2)})
    assert unit_findings(one.where("false")).count() == 0
    assert unit_findings(one.unionAll(one)).count() == 2
    assert convert_units(one, "covered_area_value", "covered_area_unit", "sqft", area_graph()).first().converted == pytest.approx(149.95 * 10.7639)


def test_long_text(spark):
    t = "Gas pipeline and 24x7 water. " * 5000 + "Area 178 gaj."
    assert spark.createDataFrame([(t,)], "t string").select(described_area(F.col("t"))["value"]).first()[0] == 178
