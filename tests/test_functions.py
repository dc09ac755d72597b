import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import extract, fuzzy, scalar


def _one(spark, c):
    return spark.range(1).select(c).first()[0]


def _each(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


ODD = ["", "nan", "-", None, " ", "0", "\u0000", "x" * 20000, "नमस्ते"]


@pytest.mark.parametrize("f", [scalar.collapsed, scalar.present, scalar.slug, scalar.title_case, scalar.number, scalar.positive, scalar.age_band, scalar.furnishing, scalar.kind_group, scalar.locality_form, scalar.sector_of, extract.bedrooms, extract.bathrooms, extract.balconies, extract.price, extract.area_sqft, extract.area_and_unit, extract.age, extract.furnishing, extract.facing, extract.road_width_ft, extract.road_width_m, extract.floor_level, extract.token_set, extract.split_outside_parentheses, lambda c: scalar.possession(c, F.lit("2025-12-01"))])
def test_nothing_throws(spark, f):
    assert len(_each(spark, f, ODD)) == len(ODD)


def test_text_forms(spark):
    assert _each(spark, scalar.title_case, ["south-west DELHI"]) == ["South-West Delhi"]
    assert _each(spark, scalar.slug, ["Sector 77A, Phase-II"]) == ["sector_77_a_phase_ii"]
    assert _each(spark, scalar.locality_form, ["Sec-2", "Palam Vihar II", "SECTOR  10A"]) == ["sector 2", "palam vihar 2", "sector 10a"]
    assert _each(spark, scalar.sector_of, ["near sec 10a", "Sector No. 5", "x"]) == ["Sector 10A", "Sector 5", None]
    assert _one(spark, scalar.resolved_city(F.lit("Old New Delhi city"), {"delhi": "Delhi", "new delhi": "New Delhi"})) == "New Delhi"


def test_arithmetic_guards(spark):
    assert _one(spark, scalar.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert _one(spark, scalar.share(F.lit(1), F.lit(0))) == 0.0
    assert _one(spark, scalar.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert [_one(spark, scalar.ladder(F.lit(x), [(75.0, "a"), (50.0, "b")], "c")) for x in (80.0, 75.0, 60.0, 1.0)] == ["a", "a", "b", "c"]
    assert [_one(spark, scalar.two_sided_score(F.lit(x), 0.1, 0.4)) for x in (0.05, 0.15, 0.25, 0.35, 0.5)] == [2, 1, 0, -1, -2]
    assert [_one(spark, scalar.two_sided_score(F.lit(x), 0.4, 0.1)) for x in (0.5, 0.05)] == [2, -2]


def test_golden_fields(spark):
    assert _each(spark, extract.bedrooms, ["3 BHK flat", "Bedrooms 4", "13 BHK Bedrooms 2", "none"]) == [3.0, 4.0, None, None]
    assert _each(spark, extract.price, ["Sale Price 3,600,000", "₹3.57 Cr", "36 Lac", "free"]) == [3600000.0, 35700000.0, 3600000.0, None]
    assert _each(spark, extract.area_sqft, ["1,200 sq ft", "100 sq yrd", "2 acres", "100 sqft"]) == [1200.0, 900.0, 87120.0, None]
    assert _each(spark, extract.road_width_ft, ["9m road facing north", "30 ft wide road", "no road"]) == [29.53, 30.0, None]
    assert _each(spark, extract.facing, ["north - east facing", "facing west", "west facing", "south east"]) == ["North-East", None, "West", "South-East"]
    assert _each(spark, extract.split_outside_parentheses, ["A Road (From x / y)/ Bheem marg(a/b)/Birla Road/abc"]) == [["A Road (From x / y)", "Bheem marg(a/b)", "Birla Road"]]
    assert [tuple(r)[:2] if r else None for r in _each(spark, extract.floor_level, ["3 of 10", "Ground of 4", "Upper Basement of 2", "x"])] == [(3, 10), (0, 4), (-1, 2), None]
    assert _each(spark, lambda c: scalar.possession(c, F.lit("2025-12-01")), ["Ready to Move", "29th Jan, 2026", "Nov '30", "Under Construction", "2th Mar, 2026", "?"]) == ["ready", "ready", "under_construction", "under_construction", "ready", None]
    assert _each(spark, extract.age, ["3 years old", "5 to 10 years", "new construction", "25 years old", "old"]) == ["Less than 5 years", "5 to 10 years", "New Construction", "Above 20 years", None]


def test_parking_is_no_park(spark):
    x = {k: _one(spark, c) for k, c in extract.flags(F.lit("covered parking, corner plot in a gated society")).items()}
    assert x == {"is_parking": 1, "is_pool": 0, "is_main_road": 0, "is_garden_park": 0, "is_gated": 1, "is_corner": 1}


def test_token_lists(spark):
    assert _one(spark, extract.merged_tokens(F.lit("Lift, Gym"), F.lit("Gym,Park, "))) == "Gym, Lift, Park"
    assert _one(spark, extract.normal_tokens(F.lit("lift: yes, kids area"), {"lift": ["Lift"], "kids area": ["Kids", "Park"]})) == ["Kids", "Park", "Lift"]
    assert _one(spark, extract.named_rules(F.lit("pool and gym"), {"Gym": "gym", "Pool": "pool", "Lift": "lift"})) == ["Gym", "Pool"]
    assert _one(spark, extract.road_class(F.lit("NH48"), F.lit(None).cast("string"), F.lit("primary"))) == "national"


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc ", max_size=9), st.text("abc ", max_size=9)), min_size=1, max_size=20))
def test_common_subsequence(spark, pairs):
    x = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in x.select(fuzzy.lcs_length(F.col("a"), F.col("b"))).collect()] == [_lcs(a, b) for a, b in pairs]


def test_ratios(spark):
    assert _one(spark, fuzzy.token_sort_ratio(F.lit("Palam  Vihar"), F.lit("vihar palam"))) == 100.0
    assert _one(spark, fuzzy.token_set_ratio(F.lit("Palam Vihar"), F.lit("Palam Vihar Extension"))) == 100.0
    assert _one(spark, fuzzy.partial_ratio(F.lit("vihar"), F.lit("palam vihar"))) == 100.0
    assert _one(spark, fuzzy.indel_ratio(F.lit("abcd"), F.lit("abxd"))) == 75.0
    assert _one(spark, fuzzy.matching_blocks_ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
