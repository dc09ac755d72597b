import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm.leak import FMIndex, Passages, leaked_passages, leaked_spans, removal_spans, mended, shard_hits, squashed, suffix_array, word_bytes
from plinth.llm.spam import FEATURES, curve_features, curve_score, fit_weights, spectra, stuffed_pages, stuffed_share, training_rows

PASSAGE = "The register records a deposit of 29.9 lakh, followed by 28 instalments paid every second month. As Prithvik Group delayed the second block, 27 allottees withdrew and recovered 9.5 percent of what they paid."
OTHER = "A third of the orchard behind Menoluro Kunj was leased to a school until 2025. Elders recalled that the arch at Kolugi Manor tilted in January 2015, well before the sale."
PROSE = ["The balcony faces south and catches the evening breeze.", "Power backup in the tower is steady through summer.", "Roads in the pocket were widened before the October rains.", "The agent quoted a price that was slightly negotiable.", "Loan approval came quickly because the builder was vetted.", "A cousin rented a place here during the lull last year.", "Open space around the club is mostly paved with stone.", "Older floors lack piped gas and covered parking."]


def test_a_sequence_without_an_end():
    index = FMIndex(np.array([1, 4, 4, 4]), 5)
    lo, hi = index.search(np.array([[4, 4]]))
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [1, 2]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=120), st.integers(1, 5))
def test_suffix_array_and_search(seq, width):
    seq = [*seq, 0]
    t = np.array(seq, dtype=np.int32)
    sa = suffix_array(t, 3)
    n = len(seq)
    zeros = {p: i for i, p in enumerate(np.flatnonzero(t == 0).tolist())}
    key = lambda i: [(0, zeros[j]) if seq[j] == 0 else (1, seq[j]) for j in range(i, n)]
    assert sa.tolist() == sorted(range(n), key=key)
    pats = sorted({tuple(seq[i : i + width]) for i in range(n - width + 1) if 0 not in seq[i : i + width]} | {(5,) * width})
    index = FMIndex(t, 5, sample=3)
    lo, hi = index.search(np.array(pats, dtype=np.int64))
    for p, a, b in zip(pats, lo.tolist(), hi.tolist()):
        want = [i for i in range(n - width + 1) if tuple(seq[i : i + width]) == p]
        assert b - a == len(want)
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_hits_against_brute_force():
    rng = random.Random(1)
    p = Passages([(1, PASSAGE), (2, OTHER), (3, None), (4, "too short")])
    words = [w.decode() for w in word_bytes(PASSAGE + " " + OTHER).split()] + ["zz", "yy"]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)] + [PASSAGE, None, "", OTHER + " " + PASSAGE] + [PASSAGE] * 3
    place = {tuple(x): i for i, x in enumerate(p.phrases)}
    want = defaultdict(lambda: defaultdict(list))
    for d, t in enumerate(texts):
        w = word_bytes(t or "").split()
        for i in range(len(w) - 3):
            k = place.get(tuple(w[i : i + 4]))
            for o in p.owners[k] if k is not None else ():
                want[d][o].append(i)
    got = shard_hits(texts, p)
    assert {d: {o: sorted(v) for o, v in x.items()} for d, x in got.items()} == {d: dict(x) for d, x in want.items()}


def test_leaks(spark, rows):
    w = PASSAGE.split()
    changed = " ".join(x if i % 6 else "certain" for i, x in enumerate(w))
    docs = [
        (1, "Intro. " + " ".join(w[3:15]) + " tail."), (2, " ".join(w[3:14])), (3, changed), (4, " ".join(x if i % 3 else "certain" for i, x in enumerate(w))), (5, "<p>" + PASSAGE.upper().replace(" ", "<br/> ").replace("instalments", "instal-\nments") + "</p>"),
        (6, PASSAGE[:60] + "­" + PASSAGE[60:]), (7, None), (8, ""), (9, "x " * 60000 + PASSAGE), (10, OTHER + " " + PASSAGE), (11, "which claim does the passage support?"), (1, "nothing"), (12, " ".join(w[:8]) + " and then " + " ".join(w[20:28])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    i = spark.createDataFrame([(100, PASSAGE), (200, OTHER), (300, None), (400, "")], "item_id long, passage string")
    want = [(1, 100), (10, 100), (10, 200), (3, 100), (5, 100), (6, 100), (9, 100)]
    assert rows(leaked_passages(d, i)) == want
    assert rows(leaked_passages(d, i, block=1)) == want
    assert leaked_passages(d.where("false"), i).count() == 0 and leaked_passages(d, i.where("false")).count() == 0


def test_leaks_without_an_intact_phrase(spark, rows):
    w = PASSAGE.split()
    every_fourth = " ".join(x if i % 4 != 3 else "certain" for i, x in enumerate(w))
    parted = " ".join(" ".join(x if len(x) < 3 else x[:2] + " " + x[2:] for x in w[3 + i * 3 : 6 + i * 3]) for i in range(4))
    far = "29.9 a.b.c " * 400
    docs = [(1, every_fourth), (2, far + every_fourth + " " + far), (3, far + parted + " " + far), (4, " ".join(x if i % 3 else "certain" for i, x in enumerate(w)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(100, PASSAGE), (200, OTHER)], "item_id long, passage string")
    assert rows(leaked_passages(d, i)) == [(1, 100), (2, 100), (3, 100)]


def test_spans_and_removals(spark, rows):
    w = PASSAGE.split()
    text = "Intro. " + " ".join(w[3:15]) + " middle part of the page " + PASSAGE + " tail. " + OTHER
    docs = [(1, text), (2, "<b class='" + "x" * 500 + "'>" + PASSAGE.replace(" ", "  ") + "</b> end"), (3, "nothing at all"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(100, PASSAGE), (200, OTHER)], "item_id long, passage string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in leaked_spans(d, i).collect()}
    one, whole, other = text.index(w[3]), text.index(PASSAGE), text.index(OTHER)
    assert {(1, 100, one, one + len(" ".join(w[3:15]))), (1, 100, whole, whole + len(PASSAGE)), (1, 200, other, other + len(OTHER))} == {g for g in got if g[0] == 1}
    assert [(docs[1][1][a:z]).split() for x, _, a, z in got if x == 2] == [PASSAGE.split()]
    s = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 9), (1, 3, 2, 4), (1, 1, 20, 30), (2, 1, 1, 2)], "doc_id int, item_id int, start int, end int")
    assert rows(removal_spans(s), "doc_id", "start", "end") == [(1, 0, 9), (1, 20, 30), (2, 1, 2)]
    assert removal_spans(leaked_spans(d.where("false"), i)).count() == 0


def test_short_passages(spark, rows):
    d = spark.createDataFrame([(1, "the arch at Kolugi Manor tilted"), (2, "Manor Kolugi"), (3, "KOLUGI, manor!")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "Kolugi Manor"), (2, "tilted"), (3, "")], "item_id long, passage string")
    assert rows(leaked_passages(d, i)) == [(1, 1), (1, 2), (3, 1)]


def test_broken_encoding():
    for t in ("₹1.89 Cr. गए", "सेक्टर 15B के तालाब", "it’s “quoted” – café"):
        cp1252 = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode())
        assert mended(cp1252) == t and squashed(t.encode().decode("latin-1")) == squashed(t)
    assert mended("plain Â text à") == "plain Â text à"


def test_squashing():
    assert squashed("Rs. 1,710 <b>sq</b> ft &amp; गए।") == "rs1710sqftगए" and squashed("wa-\nter") == squashed("wa ter") == "water"


SPAM = {
    "phrases": " | ".join(["flats in Pulaso", "2 bhk flats in Pulaso", "cheap plots Pulaso", "no brokerage flats"] * 8), "one": "kothi Nonabad kothi-Nonabad KOTHI NONABAD " * 15, "links": "\n".join(f"http://a{i}.example/flats-in-pulaso?id={i}" for i in range(15)),
    "titles": "\n".join(f"Flats In Sector {i} - site{i}.invalid" for i in range(15)), "markdown": "\n".join(f"[buy house {i}](https://x.example/{i})" for i in range(12)), "tags": " ".join(f"#plots_{i} #flats{i}" for i in range(15)),
    "doorway": "\n".join(f"Plots in {n} Nagar" for n in ("Ralino", "Salipa", "Mobiluja", "Hajolu", "Regi", "Gija", "Nimabi", "Tisolu")), "stuffed": "Get no brokerage flats today, no brokerage flats offers, no brokerage flats deals. no brokerage flats is best no brokerage flats. If no brokerage flats is what you need then no brokerage flats! " * 3,
}
HAM = {
    "prose": " ".join(PROSE), "tail": " ".join(PROSE) + "\nTags: flats in Pulaso, cheap plots, https://a.example/x", "units": "Unit, floor, area, status\n" + "\n".join(f"A-{i}05, {i}, {900 + i * 37}, {('open', 'sold')[i % 2]}" for i in range(20)),
    "rates": "Schedule of circle rates\n" + "\n".join(f"Ralino Nagar | {7000 + i * 31} | residential | {i + 1}.10.2024" for i in range(15)), "amenities": "Naro Terraces\n- Security: from 2018\n* Lift: planned\n- Park: yes\n* Gym: shared\n- Pool: block D\nPossession: 2024",
    "sources": "\n".join(f"http://a{i}.example/r{i} {PROSE[i]}" for i in range(8)), "empty": "", "mark": "!!!",
}


@pytest.mark.parametrize("kind", sorted(SPAM))
def test_stuffed_texts(kind):
    assert stuffed_share(SPAM[kind]) > 0.5


@pytest.mark.parametrize("kind", sorted(HAM))
def test_other_texts(kind):
    assert stuffed_share(HAM[kind]) <= 0.5


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_share_never_throws(t):
    assert 0.0 <= stuffed_share(t) <= 1.0


def test_stuffed_pages(spark):
    rng = random.Random(2)
    prose = [(i, " ".join(rng.sample(PROSE, rng.randint(2, 8)))) for i in range(150)]
    odd = [(1000 + k, t) for k, t in enumerate(SPAM.values())] + [(2000 + k, t) for k, t in enumerate(HAM.values())] + [(3000, None), (1000, SPAM[next(iter(SPAM))]), (4000, "word " * 40000)]
    d = spark.createDataFrame(prose + odd, "doc_id long, text string").withColumns({"slope": F.lit(1), "share": F.lit(2)})
    got = sorted(r.doc_id for r in stuffed_pages(d).select("doc_id").collect())
    assert [g for g in got if g < 4000] == [1000 + k for k in range(len(SPAM))]
    assert stuffed_pages(d.where("false")).count() == 0


def test_many_copies_of_one_stuffed_page(spark):
    prose = [(i, " ".join(PROSE[i % 3 :])) for i in range(60)]
    d = spark.createDataFrame(prose + [(1000 + i, SPAM["links"]) for i in range(30)], "doc_id long, text string")
    assert sorted(r.doc_id for r in stuffed_pages(d).collect()) == list(range(1000, 1030))


def test_curve_of_a_zipf_page(spark):
    words = " ".join(w for r in range(1, 60) for w in [f"w{r}"] * max(1, round(600 / r)))
    r = curve_features(spectra(spark.createDataFrame([(1, words), (2, "a b c d e f g h"), (3, "!!!"), (4, None)], "doc_id long, text string"))).collect()
    by = {x.doc_id: x for x in r}
    assert by[1].w_slope == pytest.approx(-1.0, abs=0.1) and by[1].w_residual < 0.2 and by[2].w_slope == 0.0 and set(by) == {1, 2, 3}
    assert by[2].w_c0 == 1.0 and by[1].w_divergence > by[2].w_divergence and by[3].w_divergence == 0.0


def test_curves_alone_tell_stuffed_pages(spark):
    rng = random.Random(4)
    names = ["Ralino", "Salipa", "Mobiluja", "Hajolu", "Regi", "Gija", "Nimabi", "Tisolu"]
    ads = ["flats in", "2 bhk flats in", "cheap plots", "resale flat", "kothi", "new launch", "office space"]
    ham = [(i, " ".join(rng.sample(PROSE, rng.randint(3, 8)))) for i in range(60)]
    bad = [(1000 + i, rng.choice([" | ", ", ", "; ", " / "]).join(f"{rng.choice(ads)} {rng.choice(names[:3])}" for _ in range(rng.randint(10, 40)))) for i in range(60)]
    scored = curve_features(spectra(spark.createDataFrame(ham + bad, "doc_id long, text string"))).select("doc_id", curve_score().alias("z")).collect()
    assert sum((r.z > 0) == (r.doc_id >= 1000) for r in scored) >= 114


def test_a_page_is_judged_alike_in_any_corpus(spark):
    d = spark.createDataFrame([(1, SPAM["tags"]), (2, HAM["prose"])], "doc_id long, text string")
    alone = {r.doc_id: r.z for x in (d.where("doc_id = 1"), d.where("doc_id = 2")) for r in curve_features(spectra(x)).select("doc_id", curve_score().alias("z")).collect()}
    assert {r.doc_id: r.z for r in curve_features(spectra(d.union(d))).select("doc_id", curve_score().alias("z")).collect()} == pytest.approx(alone)


def test_the_model_is_fitted_on_distinct_texts(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*SPAM.values(), *HAM.values()] * 3)], "doc_id long, text string")
    rows = training_rows(d, most=100)
    assert len(rows) == len({*SPAM.values(), *HAM.values()} - {""})
    weights, intercept = fit_weights(rows, rows["share"] > 0.5)
    assert set(weights) == set(FEATURES) and len(intercept) == 4
