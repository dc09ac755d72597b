import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm.address import Places, assigned_score, best_assignment, parse_address, place_key, same_address_pairs
from plinth.llm.canonical import canonical_localities, match_places
from plinth.llm.components import connected
from plinth.llm.index import edit_join
from plinth.llm.places import latin, phonetic, place_tokens

GAZ = [(1, "pulaso", "Pulaso", "Mapaneku Ganj", "900000", 20.70, 74.66), (2, "pulaso", "Pulaso", "Sector 77A", "900001", 20.71, 74.66), (3, "nonabad", "Nonabad", "Bhade Bagh Phase 2", "903002", 23.6, 82.2), (4, "nonabad", "Nonabad", "Bhade Bagh Phase 3", "903003", 23.61, 82.2), (5, "nonabad", "Nonabad", "Sector 77A", "903004", 23.62, 82.2)]


def gazetteer(spark):
    return spark.createDataFrame(GAZ, "locality_id long, city_key string, city string, locality string, pincode string, latitude double, longitude double")


@pytest.mark.parametrize("text, tokens", [
    ("Mapaneku Ganj", ("mapaneku", "ganj")), ("MAAPANEKU-GNJ,", ("mapaneku", "ganj")), ("मापानेकु गंज", ("mapaneku", "ganj")), ("Mapanekugunj", ("mapaneku", "ganj")),
    ("sec.77-a", ("sector 77a",)), ("77A Sector", ("sector 77a",)), ("सेक्टर 77A", ("sector 77a",)), ("Sector No. 7", ("sector 7",)), ("bhade bag, 2nd Phase", ("bhade", "bagh", "phase 2")),
    ("Near Bhade Bagh Ph. II", ("bhade", "bagh", "phase 2")), ("nan", ()), ("", ()), (None, ()),
])
def test_tokens(text, tokens):
    assert place_tokens(text) == tokens


def test_scripts_and_sounds():
    assert latin("वाधाबाद") == "vadhabad" and phonetic("meetuno") == phonetic("mitunno") == "mituno"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parsing_never_throws(t):
    place_tokens(t), place_key(t), parse_address(t), parse_address(t, need_number=False)


def test_edit_join_against_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(150)})
    vocab = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(80)})

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(w, v) for w in words for v in vocab if dist(w, v) <= (0 if len(w) < 4 else 1 if len(w) < 6 else 2)}
    got = edit_join(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "word string"), spark.createDataFrame([(v,) for v in vocab], "entry string"))
    assert {(r.word, r.entry) for r in got.collect()} == want


def test_canonical_localities(spark, rows):
    typed = [
        (1, "Pulaso", "Mapaneku Ganj"), (2, "PULASO", "mapaneku gnj, Pulaso"), (3, "Mapaneku Ganj", "Pulaso"), (4, None, "Mapanekugunj"), (5, "Nonabad", "bhade bag ph 3"), (6, "Nonabad", "Bhade Bagh Phase 7"),
        (7, "Pulaso", "sec 77-a"), (8, "Nonabad", "Mapaneku Ganj"), (9, "Pulaso", "City Centre"), (10, "Pulaso", None), (11, "Pulaso", " nan "), (12, "Pulaso", ""), (13, "Pulaso", "x" * 5000), (2, "PULASO", "mapaneku gnj, Pulaso"),
    ]
    x = spark.createDataFrame(typed, "listing_id long, city string, locality string")
    from pyspark.sql import functions as F

    got = rows(canonical_localities(x.withColumn("pair", F.lit(1)), gazetteer(spark)))
    assert got == sorted([(2, 1), (2, 1), (3, 1), (4, 1), (5, 4), (6, -1), (7, 2), (8, -1), (9, -1), (13, -1)], key=lambda t: tuple((False, str(v)) for v in t))
    assert canonical_localities(x.where("false"), gazetteer(spark)).count() == 0
    assert {r[0] for r in match_places(x.select("city", "locality"), gazetteer(spark).where("false")).select("locality_id").collect()} == {-1}


@pytest.mark.parametrize("text, want", [
    ("Flat 503, T-H, Rutalu Homes, Rukonane Enclave, Somipubad, 904085", ("h", "503", "904085", "rutalu", "homes", 0)), ("unit 903, tower-f - luginemanor", ("f", "903", None, "lugine", "manor", 0)), ("#298, E-BLOCK, GAPURO CRES.", ("e", "298", None, "gapuro", "crescent", 0)),
    ("h no 252-a, kesonigali, sec-77b, distt. yatanagarh, 911441", ("a", "252", "911441", "kesoni", "gali", 0)), ("1707/D , Sanme Greens , near gate no 2 , 900 015", ("d", "1707", "900015", "sanme", "greens", 0)), ("C/45\nKauchala Path Ph-II\nPin-906016", ("c", "45", "906016", "kochala", "path", 2)),
    ("Tunoma Meadows, Nonabad, near flyover pillar 17, 903064", None), ("", None), (None, None), ("-", None),
])
def test_addresses(text, want):
    got = parse_address(text)
    assert (got[:6] if got else None) == want


def test_component_assignment():
    assert assigned_score(["a", "b"], ["b", "a"]) == 1.0 and assigned_score([], ["a"]) == 0.0 and assigned_score(["abcd"], ["abxd", "zz"]) == 0.75


def test_same_address_pairs(spark, rows):
    a = [
        (1, "Pulaso", "Mapaneku Ganj", "Flat 503, T-H, Rutalu Homes, Mapaneku Ganj, Pulaso, 900000"), (2, "pulaso", "mapaneku gnj", "Rutaloo Hms; Apt 503 Tower H"), (3, "Pulaso", "Mapaneku Ganj", "H-504, Rutalu Homes, Mapaneku Ganj"), (4, "Pulaso", "Mapaneku Ganj", "G503, Rutalu Homes"),
        (5, "Pulaso", "Mapaneku Ganj", "H503, Rutalu Homes Phase 2"), (6, "Pulaso", "Mapaneku Ganj", "Rutalu Homes, Mapaneku Ganj"), (7, "Pulaso", None, None), (8, "Nonabad", "Sector 77A", "Flat 503, T-H, Rutalu Homes, 903004"), (9, "Pulaso", "Mapaneku Ganj", "F.No.503,Tw H,Ruatlu Homes"),
        (10, "Pulaso", "x", "y" * 3000),
    ]
    x = spark.createDataFrame(a, "listing_id long, city string, locality string, address_full string")
    assert rows(same_address_pairs(x, gazetteer(spark))) == [(1, 2), (1, 9), (2, 9)]
    assert same_address_pairs(x.where("false"), gazetteer(spark)).count() == 0


def test_places_index():
    p = Places([(r[0], r[2], r[3], r[4]) for r in GAZ])
    assert p.city("Nonabad City") == "nonabad" and p.city("Nonbad") == "nonabad" and p.city("zzz") is None
    assert p.locality("pulaso", place_key("Mapanku Ganj")) == 1 and p.locality(None, "sector 77a") is None and p.locality("nonabad", "sector 77a") == 5


def test_assignment_against_all_permutations():
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 4)
        m = rng.randint(n, 6)
        g = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        assert best_assignment(g) == pytest.approx(max(sum(g[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n)))
    assert best_assignment([]) == 0.0 and assigned_score(list("abcdefgh"), list("hgfedcba")) == 1.0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 90)
    chain, star = ids[:60], ids[60:80]
    edges = [(chain[i], chain[i + 1]) for i in range(59)] + [(star[0], x) for x in star[1:]] + [(ids[80], ids[80]), (ids[81], ids[82]), (ids[82], ids[81])]
    got = {r.node: r.label for r in connected(spark.createDataFrame([(i,) for i in ids], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: min(c) for c in (chain, star, ids[81:83], *[[i] for i in [ids[80], *ids[83:]]]) for i in c}
    assert got == want
    assert connected(spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([], "a long, b long")).collect() == [(1, 1)]


def test_long_words_meet_by_their_parts(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (61, 62, 63, 64, 65, 66, 67, 90, 300)]
    off = [w[:20] + w[21:] for w in base] + [w[:5] + "z" + w[5:40] + "z" + w[40:] for w in base] + [w[:-1] for w in base]
    far = [w[:10] + w[13:] for w in base]
    got = edit_join(spark.createDataFrame([(w,) for w in base], "word string"), spark.createDataFrame([(v,) for v in off + far], "entry string"))
    want = {(w, v) for i, w in enumerate(base) for v in (off[i], off[i + 9], off[i + 18])}
    assert {(r.word, r.entry) for r in got.collect()} == want


def test_entries_of_common_words_only(spark):
    g = [(i, "Pulaso", f"Bagh {k}") for i, k in enumerate(["Nagar"] * 1 + ["Vihar"])] + [(10 + i, "Pulaso", f"Name{chr(97 + i)}lo {k}") for i in range(12) for k in ("Bagh", "Nagar", "Vihar")]
    ref = spark.createDataFrame([(j, c, n) for j, (_, c, n) in enumerate(g)], "locality_id long, city string, locality string")
    got = match_places(spark.createDataFrame([("Pulaso", "bag nagar")], "city string, locality string"), ref).collect()
    assert [r.locality_id for r in got] == [0]


def test_addresses_without_a_block_and_across_borders(spark, rows):
    g = [*GAZ, (6, "tuba", "Tuba", "Zalo Kunj", "911000", 20.701, 74.661)]
    gaz = spark.createDataFrame(g, "locality_id long, city_key string, city string, locality string, pincode string, latitude double, longitude double")
    a = [(1, "Pulaso", "Mapaneku Ganj", "Flat 503, T-H, Rutalu Homes, 900000"), (2, None, None, "Tower H, Flat 503, Rutalu Homes"), (3, "Tuba", "Zalo Kunj", "H503, Rutalu Homes, Zalo Kunj"), (4, "Nonabad", "Sector 77A", "H503, Rutalu Homes"), (5, None, "Zalo Kunj", "H 503 Rutalu Hms"), (6, None, None, "H-777, Rutalu Homes")]
    x = spark.createDataFrame(a, "listing_id long, city string, locality string, address_full string")
    got = rows(same_address_pairs(x, gaz))
    assert {(1, 3), (1, 5), (3, 5), (1, 2)} <= set(got) and not any(6 in p for p in got)


def test_streets_of_more_than_64_letters(spark, rows):
    long = "b" + "anabelu" * 12
    a = [(1, "Pulaso", "Mapaneku Ganj", f"Flat 503, T-H, {long} Homes, 900000"), (2, "Pulaso", "Mapaneku Ganj", f"H503, {long[:30] + long[31:]} Homes, 900000"), (3, "Pulaso", "Mapaneku Ganj", f"H504, {long} Homes, 900000")]
    x = spark.createDataFrame(a, "listing_id long, city string, locality string, address_full string")
    assert rows(same_address_pairs(x, gazetteer(spark))) == [(1, 2)]
