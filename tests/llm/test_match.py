import numpy as np
import pytest

from plinth.llm.match import MASKS, NAMES, PRIOR, _classifier, fit_logistic, isotonic, matched_listings, minhash, titled_society, winners, with_masks

SCHEMA = "listing_id long, property_id string, property_type string, locality string, address_full string, covered_area_value double, covered_area_unit string, covered_area_sqft double, price double, price_raw string, price_per_sqft double, bhk double, bathrooms double, balconies double, floors string, facing_direction string, latitude double, longitude double, project_society_name string"


def _rows(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def _flat(i, p, **more):
    return dict(listing_id=i, property_id=p, property_type="Apartment", locality="Mapaneku Ganj", covered_area_value=1200.0, covered_area_unit="sqft", price=9e6, bhk=2.0, bathrooms=2.0, balconies=1.0, floors="5 of 9", facing_direction="North", latitude=20.7, longitude=74.66, project_society_name="Rutalu Homes") | more


def test_addresses_decide_and_deliveries_stand_together(spark, rows):
    one = _rows(spark, [_flat(1, "a", address_full="Flat 503, T-H, Rutalu Homes"), _flat(2, "a", address_full="Flat 503, T-H, Rutalu Homes", price=9.1e6), _flat(3, "b", address_full="Flat 504, T-H, Rutalu Homes")])
    two = _rows(spark, [_flat(11, "z", address_full="H503, Rutaloo Hms"), _flat(12, "y", address_full="H503, Rutalu Homes", property_type="Villa"), dict(listing_id=13), _flat(14, "z", price=None, latitude=0.0)])
    got = rows(matched_listings(one, two), "listing_id_a", "listing_id_b")
    assert got == [(1, 11), (1, 14), (2, 11), (2, 14)]
    assert matched_listings(one.where("false"), two).count() == 0 and matched_listings(one, two.where("false")).count() == 0


def test_repeated_rows_give_one_pair(spark):
    one, two = _rows(spark, [_flat(1, None, address_full="Flat 503, T-H, Rutalu Homes")] * 2), _rows(spark, [_flat(11, None, address_full="H503, Rutalu Homes")])
    assert [tuple(r)[:2] for r in matched_listings(one, two).collect()] == [(1, 11)]


def test_minhash_estimates_overlap():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 2**62, size=(2, 40), dtype=np.uint64)
    t[1, :20] = t[0, :20]  # 20 of 60 distinct tokens are shared
    h = minhash(t, np.ones_like(t, dtype=bool), 600)
    assert (h[0] == h[1]).mean() == pytest.approx(1 / 3, abs=0.06)
    assert (minhash(t, np.zeros_like(t, dtype=bool), 4) == 0).all()


def test_classifier_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    y = (rng.random(4000) < p).astype(float)
    w = fit_logistic(x, y)
    assert w == pytest.approx([2, 0, -1], abs=0.25)
    steps = isotonic(np.c_[x, np.ones(4000)] @ w, y)
    probs = [q for _, q in steps]
    assert probs == sorted(probs) and probs[0] < 0.1 and probs[-1] > 0.9


def test_blocking_finds_most_pairs_by_attributes(spark):
    """Held-out check: dwellings that only attributes can tell, against labelled ones."""
    rng = np.random.default_rng(3)
    one, two = [], []
    for k in range(300):
        f = _flat(k, f"a{k}", covered_area_value=float(rng.integers(700, 3000)), price=float(rng.integers(30, 300) * 1e5), floors=f"{rng.integers(0, 20)} of 24", latitude=20.7 + rng.random() * 0.05, longitude=74.6 + rng.random() * 0.05, project_society_name=f"Soc{chr(97 + k % 20)}ko Homes", bathrooms=float(rng.integers(1, 5)))
        g = f | dict(listing_id=1000 + k, property_id=f"b{k}", price=f["price"] * 1.02, latitude=f["latitude"] + 0.0002)
        if k % 2:
            f, g = f | dict(address_full=f"Flat {k}, T-A, Soc{chr(97 + k % 20)}ko Homes"), g | dict(address_full=f"A-{k}, Soc{chr(97 + k % 20)}ko Homes")
        one.append(f)
        two.append(g)
    got = {tuple(r)[:2] for r in matched_listings(_rows(spark, one), _rows(spark, two)).collect()}
    want = {(k, 1000 + k) for k in range(300) if k % 2}
    assert len(got & want) / len(want) > 0.95 and len(got - {(k, 1000 + k) for k in range(300)}) <= 3


def test_rows_that_share_only_their_door(spark):
    """Full rows against rows that have only the address: no band is left to chance."""
    full = [_flat(k, f"a{k}", address_full=f"Flat {k + 100}, T-A, Rutalu Homes") for k in range(300)]
    bare = [dict.fromkeys(full[0]) | dict(listing_id=1000 + k, property_id=f"b{k}", address_full=f"A-{k + 100}, Rutalu Homes") for k in range(300)]
    got = {tuple(r)[:2] for r in matched_listings(_rows(spark, full), _rows(spark, bare)).collect()}
    assert got == {(k, 1000 + k) for k in range(300)}


def test_pairs_without_any_label_are_scored(spark):
    """No address reaches a door, so there are no labels: the prior decides on attributes, and does not match what differs."""
    one = _rows(spark, [_flat(k, f"a{k}", latitude=20.7 + k * 0.01, price=9e6 + k * 3e5, floors=f"{5 + k} of 20") for k in range(5)])
    two = _rows(spark, [_flat(100 + k, f"b{k}", latitude=20.7 + k * 0.01, price=9.05e6 + k * 3e5, floors=f"{5 + k} of 20") for k in range(5)] + [_flat(200, "c", latitude=20.71, price=9.3e6, floors="6 of 20", facing_direction="South")])
    got = {tuple(r)[:2]: r.confidence for r in matched_listings(one, two).collect()}
    assert set(got) == {(k, 100 + k) for k in range(5)} and all(0.5 <= c < 1 for c in got.values())


def test_few_labels_stay_near_the_prior():
    w, steps = _classifier(np.zeros((0, len(NAMES))), np.zeros(0))
    assert w == pytest.approx(list(PRIOR.values())) and [p for _, p in steps] == sorted(p for _, p in steps) and steps[0][1] < 0.01 and steps[-1][1] > 0.99
    one, _ = _classifier(np.zeros((2, len(NAMES))), np.array([1.0, 0.0]))
    assert np.abs(np.array(one) - np.array(list(PRIOR.values()))).max() < 2.0


def test_masks_hide_doors_and_names():
    data = np.ones((3, len(NAMES)))
    x, y = with_masks(data, np.array([1.0, 0.0, 1.0]))
    assert x.shape == (9, len(NAMES)) and y.tolist() == [1.0, 0.0, 1.0] * len(MASKS)
    assert (x[:3] == 1).all() and (x[3:, NAMES.index("unit")] == 0).all() and (x[6:, NAMES.index("society")] == 0).all() and (x[3:6, NAMES.index("society")] == 1).all()


@pytest.mark.parametrize(("text", "want"), [
    ("2 BHK builder floor available for sale in Misusu Greens", ("misusu", 0)), ("Spacious 3BHK Residential Plot, Rarosho Avenue Phase 2, Jhinivetu Ganj Phase 2", ("rarosho", 2)), ("Ready to move apartment in a gated society", ("", 0)),
    ("2 BHK apartment available", ("", 0)), ("3 km from the ring road", ("", 0)), (None, ("", 0)), ("", ("", 0)),
])
def test_names_in_titles(text, want):
    assert titled_society(text) == want


def test_winning_tokens_meet_wherever_bands_do():
    rng = np.random.default_rng(4)
    t = rng.integers(1, 2**62, size=(200, 12), dtype=np.uint64)
    t[100:, :6] = t[:100, :6]
    present = rng.random(t.shape) < 0.8
    h, w = minhash(t, present, 16), winners(t, present, 16)
    for i in range(100):
        bands = (h[i] == h[100 + i]) & (h[i] > 0)
        common = set(t[i][w[i]].tolist()) & set(t[100 + i][w[100 + i]].tolist())
        assert not bands.any() or common
    assert not (w & ~present).any() and w.sum(axis=1).max() <= 12 and not winners(t, np.zeros_like(present), 4).any()
