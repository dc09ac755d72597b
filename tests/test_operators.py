import datetime as dt

import pytest
from pyspark.sql import functions as F

from plinth.operators import ingest, learn, lookup, nearest, panel, series, stats
from plinth.schema import LISTING


def test_ingest(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, developer_uuid string")
    b = spark.createDataFrame([(3, 1.5)], "id int, price double")
    u = ingest.union_sources({"a": ingest.renamed(a, {"developer_uuid": "developer_id", "nothing": "z"}), "b": b})
    assert u.columns == ["id", "developer_id", "source", "price"] and u.count() == 3
    assert ingest.ensure_columns(u, LISTING, only=True).columns == LISTING.names
    c = ingest.coerced(spark.createDataFrame([("1.5",), ("x",), ("NaN",)], "v string"), ["v", "w"])
    assert rows(c) == [(1.5,), (None,), (None,)]
    k = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 3, "c")], "key string, n int, v string")
    assert rows(ingest.first_by_key(k, ["key"], [F.col("n")])) == rows(spark.createDataFrame([(None, 1, "a"), ("k", 3, "c")], "key string, n int, v string"))
    assert rows(ingest.scoped_or_all(k, F.col("key") == "k"), "n") == [(3,)] and ingest.scoped_or_all(k, F.col("key") == "zz").count() == 3


def test_text_precedence(spark):
    x = spark.createDataFrame([("4 BHK", None, 3.0, None, None, 5.0)], "description string, amenities string, bhk double, bathrooms double, balconies double, price double")
    assert ingest.filled_from_text(x).first().bhk == 4.0 and ingest.filled_from_text(x, text_first=False).first().bhk == 3.0


def test_sectors(spark):
    def run(t):
        return [r[0] for r in lookup.expanded_sectors(spark.createDataFrame([(t,)], "s string"), "s").select("sector").collect()]

    assert run("Sector 99 TO 101") == ["Sector 99", "Sector 100", "Sector 101"]
    assert run("33,34,37A") == ["Sector 33", "Sector 34", "Sector 37A"]
    assert run("16-17") == ["Sector 16", "Sector 17"] and run("23-23A") == ["Sector 23", "Sector 23A"] and run("17 (P)") == ["Sector 17"]
    assert run("110 TO 99") == [] and run(None) == [] and run("none") == []


def test_rate_lookup(spark):
    rates = spark.createDataFrame([("delhi", "Palam Vihar", 10.0), ("delhi", "Sector 14", 20.0), ("delhi", "Green Park Extension", 30.0)], "city string, locality string, rate double")
    want = {"Palam Vihar": (10.0, 0), "Sector 14, Old Town": (20.0, 10), "Greenpark Old": (None, None), "Extension Green Park": (30.0, 100), "Sector 99": (None, None), "Palam Vihar sector 14": (10.0, 30)}
    p = spark.createDataFrame([("Delhi", k) for k in want] + [(None, "x"), ("Delhi", None)], "city string, locality string")
    got = {r.locality: (r.rate, r.level) for r in lookup.ladder_lookup(p, rates).collect()}
    assert got == want


def test_fuzzy_rate_without_a_common_word(spark):
    rates = spark.createDataFrame([("delhi", "mapaneku ganj", 1.0), ("delhi", "dhatiha enclave", 2.0), ("delhi", "shobhashova ganj", 3.0), ("agra", "mapanekku gunj", 9.0)], "city string, locality string, rate double")
    p = spark.createDataFrame([("Delhi", k) for k in ("mapanekku gunj", "dhaatihaenclv", "shobhasshova gnj", "ganj", "")], "city string, locality string")
    got = {r.locality: (r.rate, r.level) for r in lookup.ladder_lookup(p, rates).collect()}
    assert got == {"mapanekku gunj": (1.0, 100), "dhaatihaenclv": (2.0, 100), "shobhasshova gnj": (3.0, 100), "ganj": (None, None), "": (None, None)}


def test_gazetteer_name_of_many_words(spark):
    l = spark.createDataFrame([("c", "Old Mill Road Near The Third Gate"), ("c", "Mill Road")], "city string, locality string")
    t = spark.createDataFrame([(1, "c", "a flat at old mill road, near the third gate"), (2, "c", "by mill road")], "id int, city string, text string")
    assert sorted(tuple(x) for x in lookup.gazetteer_hit(t, l).collect()) == [(1, "Old Mill Road Near The Third Gate"), (2, "Mill Road")]
    assert lookup.gazetteer_hit(t, l.where("false")).count() == 0


def test_nearest_names_without_a_common_key(spark):
    import difflib

    choices = ["Sector 52", "Rokarocha Bagh", "Mapaneku Ganj", "Shorehiya Enclave Phase 2, Jorayagarh Old Town", ""]
    names = ["Sctor 52", " Rokaarocha-Bagh ", "Mpaneku Gnj", "Shorehiya Enclave Phase 2 Jorayagarh Old Towm", "zzz", None]
    got = {r.name: r.choice for r in lookup.nearest_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c,) for c in choices], "choice string"), 0.75).collect()}
    assert got == {n: m[0] for n in names if n and (m := difflib.get_close_matches(n, choices, 1, 0.75))}
    assert len(got) == 4


def test_typed_rates(spark, rows):
    x = spark.createDataFrame([("c", "l", "Commercial", 9.0, 1), ("c", "l", "Residential", 5.0, 2), ("c", "l", "Residential", 4.0, 3), ("c", "m", "Plot", 7.0, 1), ("c", "m", "Plot", 0.0, 2)], "city string, locality string, kind string, rate double, seq int")
    assert rows(lookup.typed_rates(x, ["city", "locality"], "kind", "rate", "seq")) == [("c", "l", "Commercial", 9.0, 4.0), ("c", "l", "Residential", 5.0, 4.0), ("c", "m", "Plot", 7.0, 7.0)]


def test_locality_resolution(spark):
    l = spark.createDataFrame([("c", "Palam Vihar"), ("c", "Palam Vihar Extension"), ("c", "Green Park Main Road")], "city string, locality string")
    r = spark.createDataFrame([("c", "palam vihar"), ("c", "Palam"), ("c", "Park Green"), ("c", "zzz")], "city string, wanted string")
    assert {x.wanted: (x.locality, x.tier) for x in lookup.resolved_locality(r, l).collect()} == {"palam vihar": ("Palam Vihar", 0), "Palam": ("Palam Vihar", 1), "Park Green": ("Green Park Main Road", 2)}
    t = spark.createDataFrame([(1, "c", "flat in palam vihar, extension road"), (2, "c", "nothing"), (3, "c", None)], "id int, city string, text string")
    assert [tuple(x) for x in lookup.gazetteer_hit(t, l).collect()] == [(1, "Palam Vihar Extension")]


def test_nearest(spark, rows):
    d = spark.createDataFrame([(1, 28.0, 77.0, 5.0, "a"), (2, 28.01, 77.0, 6.0, "b"), (3, 28.0, 77.001, None, "b"), (4, 30.0, 77.0, None, "a")], "id int, lat double, lon double, value double, g string")
    assert rows(nearest.tiered_fill(d, [["g"], []], 5.0), "id", "value", "tier") == [(3, 6.0, 0)]
    line = spark.createDataFrame([("r", [[77.0, 28.0], [77.0, 28.1], [77.1, 28.1]])], "feature_id string, line array<array<double>>")
    s = nearest.segments_of(line)
    p = spark.createDataFrame([(1, 28.05, 77.01), (2, 29.0, 77.0)], "id int, lat double, lon double")
    got = nearest.nearest_segment(p, s, 2.0).collect()
    assert s.count() == 2 and len(got) == 1 and got[0].km == pytest.approx(0.9825, abs=0.001)
    x, y = spark.range(1).select(*nearest.web_mercator(F.lit(0.0), F.lit(180.0))).first()
    assert x == pytest.approx(20037508.34, abs=1) and abs(y) < 1e-6


def _pairs_met(df):
    """The most rows that any join of the last plan of ``df`` gave out."""
    df.collect()
    plan, most, stack = df._jdf.queryExecution().executedPlan(), 0, []
    stack.append(plan)
    while stack:
        p = stack.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(p.plan())
        elif "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        stack.extend(p.children().apply(i) for i in range(p.children().size()))
    return most


def test_nearest_in_a_crowd(spark):
    import math
    import random

    r = random.Random(3)
    at = lambda n, s: [(i, 28.0 + r.gauss(0, s), 77.0 + r.gauss(0, s)) for i in range(n)]
    targets = [*at(300, 0.004), (300, 28.05, 77.05), (301, 28.0, 78.0), (302, 0.0, 0.0), (303, 77.0, 28.1), (304, 28459312.0, 77026314.0), (305, None, 77.0), (306, float("nan"), 77.0)]
    donors = [*at(1500, 0.004), (1500, 28.03, 77.06), *[(k, 0.0, 0.0) for k in range(1501, 1801)], (1801, 77.0, 28.25), (1802, 28459312.0, 77026314.0), (1803, 77.0, None)]
    a = spark.createDataFrame(targets, "id int, lat double, lon double")
    b = spark.createDataFrame([(*d, float(d[0])) for d in donors], "id int, lat double, lon double, value double")

    def km(p, q):
        p1, p2 = math.radians(p[1]), math.radians(q[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    want = {}
    for t in targets[:304]:
        best = min((km(t, d), d[0]) for d in donors[:1802])
        if best[0] <= 5.0:
            want[t[0]] = best[1]
    want[304] = 1802
    got = nearest.nearest_within(a, b, 5.0)
    assert {x.target_id: x.donor_id for x in got.collect()} == want
    assert want[302] == 1501 and want[303] == 1801 and 301 not in want
    assert _pairs_met(nearest.nearest_within(a, b, 5.0)) < 20_000  # of 300 x 1500 within reach


def _market(spark, rows):
    base = dict(segment="apt", city="C", canonical_locality="L", is_active_event=1, is_new_event=0, is_updated_event=0, price=100.0, price_per_sqft=10.0, is_ready=1, is_under_construction=0, agent_type="x", developer_id="nan", days_on_market=None, ingested_at=None)
    schema = "property_id string, scrape_date timestamp_ntz, segment string, city string, canonical_locality string, is_active_event int, is_new_event int, is_updated_event int, price double, price_per_sqft double, is_ready int, is_under_construction int, agent_type string, developer_id string, days_on_market double, ingested_at timestamp_ntz"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema)


def test_panel(spark):
    d1, d2, d3 = (dt.datetime(2025, 1, d) for d in (1, 8, 15))
    m = _market(spark, [
        dict(property_id="a", scrape_date=d1), dict(property_id="b", scrape_date=d1), dict(property_id="b", scrape_date=d1),
        dict(property_id="a", scrape_date=d2, is_updated_event=1, price=90.0), dict(property_id="c", scrape_date=d2, is_new_event=1, price=float("nan")),
        dict(property_id="q", scrape_date=d3, canonical_locality="M"), dict(property_id="r", scrape_date=d3, canonical_locality="nan"), dict(property_id="s", scrape_date=d3, city=None),
    ])
    p = {(r.canonical_locality, r.scrape_date): r for r in panel.market_panel(m).collect()}
    assert set(p) == {("L", d1), ("L", d2), ("M", d3)}
    one, two = p["L", d1], p["L", d2]
    assert (one.active_supply, one.absorbed_count, one.absorption_rate, one.absorption_computable, one.ready_share) == (2, 1, 0.5, True, 1.5)
    assert (two.active_supply, two.absorbed_count, two.absorption_computable, two.cut_count, two.cut_median_pct, two.hike_count) == (2, 0, False, 1, -10.0, 0)
    assert one.median_dom == 0.0 and two.median_dom == 3.5 and one.developer_count == 0
    i = panel.market_indices(panel.market_panel(m))
    assert all(0 <= r[c] <= 100 for r in i.collect() for c in ("supply", "liquidity", "momentum", "premium", "demand", "heat", "heat_rolling4"))
    assert panel.market_panel(m.where("false")).count() == 0
    c = panel.market_context(i, spark.createDataFrame([("apt", "C", "L"), ("apt", "C", "Z")], "segment string, city string, locality string"))
    got = {r.locality: r for r in c.collect()}
    assert got["Z"].heat == 50.0 and got["Z"].reason and got["L"].points == 2


def test_average_rank_and_rolling(spark):
    x = spark.createDataFrame([(5.0,), (5.0,), (9.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted(r[0] for r in x.select(panel.average_rank_pct("v", ["g"])).collect()) == [50.0, 50.0, 100.0]


def test_series(spark):
    q = lambda y, m: dt.date(y, m, 1)
    s = spark.createDataFrame([("a", q(2024, 1), 100.0), ("a", q(2024, 10), 130.0), ("a", q(2025, 1), 110.0)], "k string, quarter date, value double")
    f = series.filled_quarters(s, ["k"]).orderBy("quarter").collect()
    assert [(r.value, r.filled) for r in f] == [(100.0, False), (110.0, True), (120.0, True), (130.0, False), (110.0, False)]
    assert [(r.year_no, round(r.yoy_pct, 6)) for r in series.yoy_chain(s, ["k"], F.lit("2024-01-01"), 3).collect()] == [(1, 10.0)]
    assert series.exponential_smoothing(s, ["k"], 0.5).first().smoothed == pytest.approx(112.5)
    r = series.roll_forward(s, ["k"], 3).orderBy("step").collect()
    assert len(r) == 3 and r[0].value > 0
    assert [tuple(x)[1:] for x in series.nearest_by_value(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, None)], "k int, v double"), "k", "v", 1).orderBy("k").collect()] == [(2, 1.0, 1), (1, 1.0, 1), (2, 2.0, 1)]


def test_golden_forecast_numbers(spark):
    r = spark.range(1).select(
        series.blend_geometric(F.lit(15936.0), F.lit(15000.0), F.lit(0.327) * F.pow(F.lit(0.9), F.lit(4)), F.lit(1.062)), series.rho(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)),
        series.cash_flow(F.lit(9500.0) * 1500, F.lit(16695.0) * 1500, 5, 7.0, 1.0, 2.0, 3.0),
    ).first()
    assert r[0] == pytest.approx(16705.67, abs=0.01) and r[1] == 0.25
    assert (r[2].profit, r[2].roi_pct, r[2].cagr_pct) == pytest.approx((10719150.0, 70.301, 11.2355), abs=0.001)


def test_stats(spark):
    x = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (float("nan"), 1.0)], "y double, p double")
    r = stats.model_errors(x, "y", "p").first()
    assert (r.n, r.mae, r.r2) == pytest.approx((3, 2 / 3, 0.75))
    assert [tuple(t) for t in stats.histogram(x, "p", 1.0, 5.0, 4).orderBy("bin").collect()] == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert stats.quartile_tiers(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), "k", "v").where("tier is not null").count() == 0


def test_models(spark):
    rows = [(i, float(i % 7), 100.0 + 10 * (i % 7), "ab"[i % 2], 28.0 + i % 5, 77.0) for i in range(200)]
    x = spark.createDataFrame(rows, "id int, a double, y double, c string, lat double, lon double")
    train, test = learn.hash_split(x, "id")
    assert train.count() + test.count() == 200 and 10 < test.count() < 80 and learn.hash_split(x, "id")[1].count() == test.count()
    m = learn.fit_price_model(train, ["a"], ["c"], "y", trees=10)
    assert stats.model_errors(learn.scored(m, test, ["a"], ["c"]), "y", "prediction").first().r2 > 0.9
    assert learn.importances(m)[0][1] > 0.5
    cells = learn.cell_features(x, learn.fit_cells(x, "lat", "lon", 5), "lat", "lon")
    assert cells.select("cell").distinct().count() == 5 and cells.agg(F.max("cell_km")).first()[0] < 1
    gap = x.withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    f = learn.cluster_median_fill(gap, ["a"], ["y"], k=7)
    assert f.where("y is null").count() == 0 and f.where("y_filled").count() == 20
    s = {r.id: r.score for r in learn.isolation_scores(x.unionByName(spark.createDataFrame([(999, 500.0, 1.0, "a", 0.0, 0.0)], x.schema)), "id", ["a", "lat"], trees=30).collect()}
    assert max(s, key=s.get) == 999
    assert learn.feature_matrix(x.withColumn("a", F.lit("nan")), ["a", "gone"]).first() == (0.0, 0.0)
