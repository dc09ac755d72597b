import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plinth.llm.packing import best_fit, pack, plan_rows, reduce_by_dominance
from plinth.llm.percentiles import code_value, daily_counts, market_percentiles, percentiles, value_code


def test_codes_order_and_error(spark):
    rng = random.Random(1)
    v = [0.0, 1.0, -1.0, 1e-9, 1e300, 2.0**53, 0.1, 127.0, 128.0, 1e-300] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(500)]
    r = spark.createDataFrame([(x,) for x in v], "v double").select("v", value_code(F.col("v")).alias("c")).select("v", "c", code_value(F.col("c")).alias("b")).collect()
    assert all(abs(x.b - x.v) <= abs(x.v) / 256 + 1e-30 for x in r)
    s = sorted(r, key=lambda x: x.v)
    assert [x.c for x in s] == sorted(x.c for x in s)


def test_percentiles_against_sorting_and_merging(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"2025-01-0{rng.randint(1, 5)}", rng.choice([rng.lognormvariate(8, 1), None, float("nan")]), float(rng.randint(0, 5))) for _ in range(3000)]
    x = spark.createDataFrame(rows, "g string, d string, v double, w double")
    c = daily_counts(x, ["g"], "d", ["v", "w"])
    for days in ({"2025-01-02"}, {f"2025-01-0{i}" for i in range(1, 6)}):
        got = {(r.g, r.metric): r for r in percentiles(c.where(F.col("day").cast("string").isin(*days)), ["g"], [0.25, 0.5, 0.99], partitions=5).collect()}
        for g in ("a", "b", None):
            for m in (0, 1):
                true = sorted(t for r in rows if r[0] == g and r[1] in days and (t := r[2 + m]) is not None and t == t)
                for q, name in ((0.25, "p25"), (0.5, "p50"), (0.99, "p99")):
                    want = true[math.ceil(q * len(true)) - 1]
                    assert got[g, m].n == len(true) and abs(got[g, m][name] - want) <= want / 256 + 1e-12


def test_market_percentiles_odd_rows(spark):
    schema = "segment string, city string, canonical_locality string, scrape_date timestamp_ntz, price_per_sqft double, price double, days_on_market double, code int"
    import datetime as dt

    x = spark.createDataFrame([("apt", None, "L", dt.datetime(2025, 1, 1), float("inf"), None, 0.0, 1), ("apt", None, "L", dt.datetime(2025, 1, 1), float("inf"), None, 0.0, 1)], schema)
    got = {r.metric: r for r in market_percentiles(x).collect()}
    assert set(got) == {"price_per_sqft", "days_on_market"} and got["days_on_market"].p99 == 0.0 and got["price_per_sqft"].n == 2 and got["price_per_sqft"].error_bound == 2**-8
    assert market_percentiles(x.where("false")).count() == 0 and market_percentiles(x, first="2025-02-01").count() == 0


def _bins(plan):
    return sum(n for _, n in plan)


def _check(counts, cap):
    fixed, rest = reduce_by_dominance(dict(counts), cap)
    plan = fixed + best_fit(rest, cap)
    assert all(sum(items) <= cap for items, _ in plan)
    packed = Counter()
    for items, n in plan:
        for s in items:
            packed[s] += n
    assert packed == Counter(counts)
    return _bins(plan)


def _optimum(items, cap):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k, room in enumerate(bins):
            if room >= items[i] and room not in seen:
                seen.add(room)
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(cap - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = reduce_by_dominance(dict(Counter(items)), 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert _bins(fixed) + _optimum(left, 20) == _optimum(items, 20), items


def test_packing_is_full_and_near_the_bound():
    rng = random.Random(4)
    for _ in range(20):
        c = Counter(min(2048, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(3000))
        total = sum(s * n for s, n in c.items())
        assert _check(c, 2048) <= math.ceil(total / 2048) * 1.01 + 1
    assert _check({}, 10) == 0 and _check({10: 3}, 10) == 3 and _check({1: 25}, 10) == 3


def test_plan_covers_every_rank():
    c = {7: 5, 3: 9, 2: 4}
    rows = plan_rows(c, 10)
    for s, n in c.items():
        spans = sorted((lo, hi) for size, lo, hi, _, _ in rows if size == s)
        assert spans[0][0] == 0 and spans[-1][1] == n - 1 and all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:]))


def test_pack(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice([0, 5, 60, 100, 100, 33, 250, 199])) for i in range(500)] + [(900, None), (901, -4), (1, 60)]
    x = spark.createDataFrame(docs, "doc_id long, n_tokens long").repartition(6).withColumn("part", F.lit(1))
    got = pack(x, capacity=100).collect()
    fill = Counter()
    for r in got:
        if r.n_tokens:
            fill[r.container_id] += r.n_tokens
        else:
            assert r.container_id is None
    want = sum(max(0, n or 0) for _, n in docs)
    assert max(fill.values()) <= 100 and sum(fill.values()) == want and len(fill) <= math.ceil(want / 100) * 1.02 + 1
    pieces = Counter((r.doc_id, r.piece) for r in got)
    assert sum(pieces.values()) == sum(max(1, math.ceil((n or 0) / 100)) for _, n in docs)
    long = sorted((r.first_token, r.n_tokens) for r in got if r.doc_id == next(i for i, n in docs if n == 250))
    assert long[:3] == [(0, 100), (100, 100), (200, 50)]
    assert pack(x.where("false")).count() == 0


def test_token_counts_round_trip(spark):
    from plinth.llm.packing import token_counter, token_counts
    from plinth.llm.queries import TOKENIZER

    n = token_counter(TOKENIZER)
    texts = ["", "hello world", "पुलासो में फ्लैट", "x" * 3000, None, "<|endoftext|>"]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts(x, TOKENIZER).orderBy("doc_id").collect()] == [n(t) if t else 0 for t in texts]
    assert n("hello world") == 2 and n("<|endoftext|>") > 1


def test_bits_of_precision(spark):
    r = spark.range(1).select(code_value(value_code(F.lit(1000.0), 12), 12)).first()[0]
    assert r == pytest.approx(1000, rel=2**-13)
