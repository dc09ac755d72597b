"""Rows of two sources that describe the same thing, without a common key: MinHash candidates, pair features, a calibrated classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.address import parse_address, place_key
from plinth.llm.places import STREET_KINDS, latin, phonetic, place_tokens
from plinth.operators.fill import compass
from plinth.operators.geo import haversine_km, restored_position
from plinth.operators.units import area_graph, parsed_price, spelling_table, unit_alias
from plinth.session import written

BANDS = 24
#: The log odds at most of a pair with two different doors.
NO_MATCH = -8.0
_BONES = re.compile("[aeiouy]")
_FEATURES = "listing_id long, src int, entity string, kind string, area double, price double, lat double, lon double, floor int, floors int, bathrooms int, balconies int, facing string, bhk int, society string, place string, letter string, number string, phase int, sign int, bands array<int>"


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs, others look unrelated."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _join(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = _mix(h * np.uint64(31) + p.astype(np.uint64) + np.uint64(1))
    return h


def _hashed(tokens: np.ndarray, present: np.ndarray, bands: int) -> Iterator[np.ndarray]:
    """For each band the hashes of each row's tokens (rows x slots), the largest value in slots that are not ``present``."""
    for b in range(bands):
        with np.errstate(over="ignore"):
            h = _mix(tokens + np.uint64((b + 1) * 0x632BE59BD9B4E019 % 2**64))
        yield np.where(present, h, np.uint64(0xFFFFFFFFFFFFFFFF))


def minhash(tokens: np.ndarray, present: np.ndarray, bands: int) -> np.ndarray:
    """``bands`` MinHash values of each row's set of tokens (rows x slots), only slots ``present``; 0 for an empty set."""
    some = present.any(axis=1)
    return np.stack([np.where(some, h.min(axis=1), 0) for h in _hashed(tokens, present, bands)], axis=1).astype(np.uint64)


def winners(tokens: np.ndarray, present: np.ndarray, bands: int) -> np.ndarray:
    """Which slots hold the least hash of some band. Rows whose MinHash values agree in a band have a winning token in common; a token that wins several bands needs one key."""
    out = np.zeros(tokens.shape, dtype=bool)
    at = np.arange(len(tokens))
    for h in _hashed(tokens, present, bands):
        out[at, h.argmin(axis=1)] = True
    return out & present


def _sign(area: np.ndarray, price: np.ndarray, floor: np.ndarray, floors: np.ndarray, bathrooms: np.ndarray, balconies: np.ndarray) -> np.ndarray:
    """What two rows of one dwelling must agree in, coarsely, in 31 bits; 0 in a field stands for unknown."""
    part = lambda x, lo, hi: np.where(np.isnan(x) | (x < lo) | (x > hi), 0, np.nan_to_num(x) - lo + 1).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, p = np.floor(np.log(area / 540.0) / 0.02), np.floor(np.log(price / 2e5) / 0.03)
    return (part(a, 0, 126) | part(p, 0, 254) << 7 | part(floor, 0, 30) << 15 | part(floors, 1, 31) << 20 | part(bathrooms, 1, 7) << 25 | part(balconies, 0, 6) << 28).astype(np.int32)


def _signs_agree(a: Column, b: Column) -> Column:
    """Whether two signs leave room for one dwelling: no later test is anticipated that could pass."""
    get = lambda s, at, bits: F.shiftright(s, at).bitwiseAND((1 << bits) - 1)
    ok = F.lit(True)
    for at, bits, most in ((0, 7, 4), (7, 8, 6), (15, 5, 0), (20, 5, 0), (25, 3, 0), (28, 3, 0)):
        x, y = get(a, at, bits), get(b, at, bits)
        ok = ok & ((x == 0) | (y == 0) | (F.abs(x - y) <= most))
    return ok


def society_key(name: str | None) -> tuple[str, int]:
    """The phonetic name and phase of a building or street on its own: ('neka', 2)."""
    a = parse_address(name, need_number=False) if name else None
    return (a[3], a[5]) if a else ("", 0)


_TITLE = re.compile(r"[^\W\d_]+|\d+")
#: Words that stand before a street's kind without naming it, and kinds that are written for a property's own.
_NO_NAME = frozenset("ring main wide front facing good gated builder service link high independent premium spacious residential this".split())
_OWN_KIND = frozenset(["apartment", "floor", "home"])


def titled_society(title: str | None) -> tuple[str, int]:
    """The phonetic name and phase of the building or street that a listing's first sentence names before its kind ('for sale in Neka Homes'), ('', 0) if none."""
    words = _TITLE.findall(title.lower()) if title else []
    for a, b, c, d in zip(words, words[1:], [*words[2:], "", ""], [*words[3:], "", "", ""]):
        kind = place_tokens(b)
        if len(kind) == 1 and kind[0] in STREET_KINDS and b not in _OWN_KIND and len(a) >= 4 and a.isalpha() and a not in _NO_NAME:
            return phonetic(latin(a)), int(d) if c == "phase" and d.isdigit() else 0
    return "", 0


def listing_features(listings: DataFrame, *, bands: int = BANDS, area_range: tuple[float, float] = (550.0, 5200.0)) -> DataFrame:
    """One row for each listing with what identifies its dwelling, and the MinHash bands of its attributes.

    ``listings``: the columns of a listing table and ``src``. Areas come from the declared value and unit (or price over rate where
    no unit fits); one that no reading brings into ``area_range`` is in a unit that cannot be told and counts as unknown, prices from the number or its text, the building's name from the address, its own field or the description's first sentence. The set of a row holds its attributes in combinations that few dwellings share:
    place (position cell, building or locality) with area, price or floor; numbers are in buckets with two offsets, so near values
    share one. Unknown attributes add nothing. ``bands`` has the tokens that
    win a MinHash band and, negative where they do not, those that hold a door number.
    """
    spark = listings.sparkSession
    pos = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    scale = area_graph().table(spark, "sqft").select(F.col("source_unit").alias("unit"), "scale")
    units = F.broadcast(spelling_table(spark).join(scale, "unit").select("alias", "unit", "scale"))  # a constant of a hundred rows
    v, price, rate = pos(F.col("covered_area_value")), F.coalesce(pos(F.col("price")), parsed_price(F.col("price_raw"))), pos(F.col("price_per_sqft"))
    sized = lambda c: F.when(c.between(*area_range), c)
    x = listings.withColumn("__alias", unit_alias(F.col("covered_area_unit"))).join(units, F.col("__alias") == F.col("alias"), "left")
    area = F.coalesce(F.when(F.col("unit") != "sqft", sized(v * F.col("scale"))), sized(v), sized(pos(F.col("covered_area_sqft"))), sized(price / rate))
    q = restored_position(F.col("latitude"), F.col("longitude"))
    floor = F.when(F.col("floors").rlike(r"(?i)^\s*ground of"), F.lit(0)).otherwise(F.nullif(F.regexp_extract("floors", r"^\s*(\d+) of", 1), F.lit("")).cast("int"))
    whole = lambda c, lo, hi: F.when(~F.isnan(F.col(c)) & F.col(c).between(lo, hi) & (F.col(c) == F.floor(F.col(c))), F.col(c).cast("int"))
    x = x.select(
        "listing_id", "src", F.coalesce("property_id", F.concat(F.lit("#"), F.col("listing_id").cast("string"))).alias("entity"), F.lower(F.trim("property_type")).alias("kind"), area.alias("area"), price.alias("price"),
        q["lat"].alias("lat"), q["lon"].alias("lon"), floor.alias("floor"), F.nullif(F.regexp_extract("floors", r"of (\d+)", 1), F.lit("")).cast("int").alias("floors"),
        whole("bathrooms", 1, 12).alias("bathrooms"), whole("balconies", 0, 12).alias("balconies"), compass(F.col("facing_direction")).alias("facing"), whole("bhk", 1, 10).alias("bhk"),
        "address_full", "project_society_name", "locality",
        F.when(F.coalesce(F.length(F.trim("project_society_name")), F.lit(0)) < 4, F.substring_index(F.regexp_replace("description", r"<[^<>]{0,200}>", " "), ".", 1)).alias("title"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}

        def once(f, s):
            if (f, s) not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[f, s] = f(s)
            return seen[f, s]

        for b in batches:
            n = len(b)
            if not n:
                continue
            a = [parse_address(s, need_number=False) for s in b["address_full"]]
            named = [once(society_key, s) for s in b["project_society_name"]]
            named = [s if s[0] or y and y[3] else titled_society(t) for y, s, t in zip(a, named, b["title"], strict=True)]
            society = [y[3] if y and y[3] else s[0] for y, s in zip(a, named, strict=True)]
            phase = [y[5] if y and y[3] else s[1] for y, s in zip(a, named, strict=True)]
            place = [once(place_key, s) or (y and place_key(y[6])) or "" for y, s in zip(a, b["locality"], strict=True)]
            letter, number = [y[0] if y and y[1] else None for y in a], [y[1] if y else None for y in a]
            num = lambda c: b[c].to_numpy(dtype="float64", na_value=np.nan)
            code = lambda xs: pd.util.hash_array(np.array(xs, dtype=object)).astype(np.uint64)
            kind, soc, loc, unit = code(b["kind"].fillna("").tolist()), code([f"{s} {p}" for s, p in zip(society, phase, strict=True)]), code(place), code([f"{x} {y}" for x, y in zip(letter, number, strict=True)])
            pin = code([y[2] if y and y[2] else "" for y in a])
            has_pin = np.array([bool(y and y[2]) for y in a])
            bones = [_BONES.sub("", s) for s in society]  # consonants outlast most typing errors
            bone, has_bone = code([f"{s} {p}" for s, p in zip(bones, phase, strict=True)]), np.array([len(s) > 1 for s in bones])
            has_soc, has_loc, has_unit = np.array([bool(s) for s in society]), np.array([bool(s) for s in place]), np.array([x is not None for x in number])
            la, lp = np.log(num("area")) / 0.05, np.log(num("price")) / 0.14
            has_a, has_p = ~np.isnan(la), ~np.isnan(lp)
            lat, lon, fl, fls, ba = num("lat"), num("lon"), num("floor"), num("floors"), num("bathrooms")
            has_c, has_f, has_b = ~np.isnan(lat) & ~np.isnan(lon), ~np.isnan(fl) & ~np.isnan(fls), ~np.isnan(ba)
            whole_ = lambda z, o: np.floor(np.nan_to_num(z) + o).astype(np.int64)
            floors = whole_(fl, 0) * 1000 + whole_(fls, 0)
            slots: list[tuple[np.ndarray, np.ndarray]] = []
            doors: list[np.ndarray] = []
            tag = lambda k: np.full(n, k, dtype=np.int64)
            for o in (0.0, 0.5):
                cell = _join(tag(7), whole_(lat / 0.005, o), whole_(lon / 0.0055, o), tag(int(o * 2)))
                slots += [(_join(tag(10), kind, cell, floors), has_c & has_f), (_join(tag(9), cell, unit), has_c & has_unit), (_join(tag(8), kind, cell, bone), has_c & has_bone)]
                doors.append(slots[-2][0])
                for i, p in enumerate((0.0, 0.5)):
                    slots += [(_join(tag(11 + i), kind, cell, whole_(la, p)), has_c & has_a), (_join(tag(13 + i), kind, cell, whole_(lp, p)), has_c & has_p)]
                    slots += [(_join(tag(15 + i), kind, loc, whole_(la, o), whole_(lp, p), tag(int(2 * o))), has_loc & has_a & has_p)]
                k = int(2 * o)
                slots += [
                    (_join(tag(20 + k), kind, soc, whole_(la, o)), has_soc & has_a), (_join(tag(22 + k), kind, soc, whole_(lp, o)), has_soc & has_p),
                    (_join(tag(24 + k), kind, loc, whole_(la, o), whole_(ba, 0)), has_loc & has_a & has_b), (_join(tag(26 + k), kind, loc, whole_(la, o), floors), has_loc & has_a & has_f),
                ]
            slots += [(_join(tag(30), kind, soc, floors), has_soc & has_f), (_join(tag(31), soc, unit), has_soc & has_unit), (_join(tag(32), bone, unit), has_bone & has_unit), (_join(tag(33), loc, unit), has_loc & has_unit), (_join(tag(34), pin, unit), has_pin & has_unit)]
            doors += [t for t, _ in slots[-4:]]
            slots += [(_join(tag(35), kind, loc, bone, floors), has_loc & has_bone & has_f), (_join(tag(36), kind, bone, floors), has_bone & has_f)]
            tokens, present = np.stack([s for s, _ in slots], axis=1), np.stack([h for _, h in slots], axis=1)
            decisive = [i for i, (t, _) in enumerate(slots) if any(t is u for u in doors)]
            # a door in a building, place, postcode or cell is met by itself: beside the slots that differ, a band would find it by chance only
            exact = present.copy()
            exact[:, -6] &= ~has_bone  # one building has one skeleton, whose door stands there as well
            doors_at = np.zeros(len(slots), dtype=bool)
            doors_at[decisive] = True
            won = winners(tokens, present, bands)
            keys = np.maximum((_mix(tokens) >> np.uint64(33)).astype(np.int32), 1)  # 31 bits: two sets that meet by chance are told apart by their attributes
            use = won | (exact & doors_at)
            signed = np.where(won, keys, -keys)
            out = b.drop(columns=["address_full", "project_society_name", "locality", "title"]).assign(society=society, place=place, letter=letter, number=number, phase=phase)
            out["sign"] = _sign(num("area"), num("price"), fl, fls, ba, num("balconies"))
            yield out.assign(bands=[np.unique(row[u]) for row, u in zip(signed, use, strict=True)])

    return x.mapInPandas(run, _FEATURES)


VETO_AREA, VETO_PRICE, VETO_KM = 0.06, 0.16, 2.5
NAMES = ["area", "no_area", "price", "no_price", "km", "no_km", "floor", "bathrooms", "balconies", "facing", "bhk", "other_bhk", "society", "no_society", "phase", "place", "unit", "other_unit", "no_unit"]
#: What a masked copy of a labelled pair does not show: its door numbers, and with the second its building's name as well.
MASKS: list[dict[str, float]] = [{}, {"unit": 0.0, "other_unit": 0.0, "no_unit": 1.0}, {"unit": 0.0, "other_unit": 0.0, "no_unit": 1.0, "society": 0.0, "no_society": 1.0, "phase": 0.0}]
#: Weights that few labels are drawn to, intercept last: those fitted on the listings at sf0.1.
PRIOR = {
    "area": -3.262, "no_area": -1.912, "price": -4.444, "no_price": -1.751, "km": -1.377, "no_km": -1.252, "floor": 1.746, "bathrooms": 0.611, "balconies": 0.383, "facing": 1.139, "bhk": -0.018, "other_bhk": -2.136,
    "society": 6.774, "no_society": 5.835, "phase": -0.67, "place": 0.067, "unit": 1.731, "other_unit": -4.617, "no_unit": 0.325, "intercept": -2.561,
}


def _pair_features() -> dict[str, Column]:
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = lambda c: a(c).isNotNull() & b(c).isNotNull()
    same = lambda c: F.when(both(c) & (a(c) == b(c)), 1.0).otherwise(0.0)
    gap = lambda c: F.coalesce(F.abs(F.log(a(c) / b(c))), F.lit(0.0))
    km = haversine_km(a("lat"), a("lon"), b("lat"), b("lon"))
    named = (a("society") != "") & (b("society") != "")
    doors = a("number").isNotNull() & b("number").isNotNull()
    same_door = (a("number") == b("number")) & (F.coalesce(a("letter"), F.lit("")) == F.coalesce(b("letter"), F.lit("")))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    like = 1 - F.levenshtein(a("society"), b("society")) / F.greatest(F.length(a("society")), F.length(b("society")))
    return {
        "area": gap("area") * 20, "no_area": F.when(both("area"), 0.0).otherwise(1.0), "price": gap("price") * 8, "no_price": F.when(both("price"), 0.0).otherwise(1.0),
        "km": F.coalesce(F.log1p(km * 20), F.lit(0.0)), "no_km": F.when(km.isNotNull(), 0.0).otherwise(1.0),
        "floor": F.when(both("floor") & both("floors") & (a("floor") == b("floor")) & (a("floors") == b("floors")), 1.0).otherwise(0.0),
        "bathrooms": same("bathrooms"), "balconies": same("balconies"), "facing": same("facing"), "bhk": same("bhk"), "other_bhk": F.when(both("bhk") & (a("bhk") != b("bhk")), 1.0).otherwise(0.0),
        "society": F.when(named, like).otherwise(0.0), "no_society": F.when(named, 0.0).otherwise(1.0), "place": F.when((a("place") != "") & (a("place") == b("place")), 1.0).otherwise(0.0),
        "phase": flag(named & (a("phase") != b("phase"))), "unit": flag(doors & same_door), "other_unit": flag(doors & ~same_door), "no_unit": flag(~doors),
    }


def _possible() -> Column:
    """What two rows of one dwelling cannot differ in, where both state it."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    ok = F.coalesce(a("kind") == b("kind"), F.lit(True))
    for c in ("floor", "floors", "bathrooms", "balconies", "facing"):
        ok = ok & F.coalesce(a(c) == b(c), F.lit(True))
    ok = ok & F.coalesce(F.abs(F.log(a("area") / b("area"))) <= VETO_AREA, F.lit(True)) & F.coalesce(F.abs(F.log(a("price") / b("price"))) <= VETO_PRICE, F.lit(True))
    return ok & F.coalesce(haversine_km(a("lat"), a("lon"), b("lat"), b("lon")) <= VETO_KM, F.lit(True))


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, steps: int = 40, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method with a ridge that draws them to ``prior`` (zeros if not given, and then not the intercept)."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1]) if prior is None else np.array(prior, dtype=float)
    centre = w.copy()
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6 if prior is None else ridge
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * (w - centre))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray, *, edges: np.ndarray | None = None, weight: float = 4.0) -> list[tuple[float, float]]:
    """(upper score, probability) steps that never fall: the share of matches in ranges of the score, pooled until they rise.

    Each range begins with ``weight`` observations of what its score says as log odds, so few labels, or none, leave the scores' own
    probabilities.
    """
    edges = np.arange(-6.0, 6.5, 0.5) if edges is None else edges
    at = np.searchsorted(edges, score, side="left")
    middle = np.concatenate([[edges[0] - 1], (edges[:-1] + edges[1:]) / 2, [edges[-1] + 1]])
    pools: list[list[float]] = []
    for i, m in enumerate(middle):
        mine = y[at == i]
        pools.append([float(edges[i]) if i < len(edges) else float("inf"), float(mine.sum()) + weight / (1 + np.exp(-m)), len(mine) + weight])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [top[0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
    return [(u, float(s / n)) for u, s, n in pools]


def with_masks(data: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled pairs (columns ``NAMES``) as they are, without their door numbers, and without their building's name as well: what other pairs lack, the classifier learns to do without."""
    out = []
    for mask in MASKS:
        x = data.copy()
        for k, v in mask.items():
            x[:, NAMES.index(k)] = v
        out.append(x)
    return np.concatenate(out), np.tile(y, len(MASKS))


def matched_listings(one: DataFrame, two: DataFrame, *, confidence: float = 0.5, sample: int = 10_000, bands: int = BANDS) -> DataFrame:
    """listing_id_a, listing_id_b, confidence: a row of ``one`` and a row of ``two`` that offer the same dwelling, the smaller id first.

    Candidates share a MinHash band or a door number with its building, place, postcode or position cell; those that differ in what they
    both state and cannot differ in (kind, floor, bathrooms, balconies, direction, area beyond 6 %, price beyond 17 %, 2.5 km) are dropped. A
    logistic classifier over ``NAMES`` (gaps of area, price and position, agreement of the counts, names, phase and door number, and what is
    missing) decides every pair; two different door numbers are one more thing that cannot be. Its weak labels are pairs whose addresses both reach the door: equal doors in buildings of similar name are
    matches, other doors or names are not. It is fitted on at most ``sample`` of them, half kept back, each also with its door and its name
    hidden (``with_masks``), and drawn to ``PRIOR``, so that few labels or none need no other rule; the half kept back calibrates the scores
    (``isotonic``). Pairs under ``confidence`` are left out. Rows of one source with the same property_id are deliveries of one dwelling: the
    best pair of two such dwellings, those with both doors first, decides for all of them.

    Nulls in any column are unknown attributes; a row with no usable combination of attributes is in no pair. Repeated rows are rows of their
    own. Empty input gives no pairs. Further columns are ignored. Runs jobs.
    """
    columns = ["listing_id", "property_id", "property_type", "locality", "address_full", "covered_area_value", "covered_area_unit", "covered_area_sqft", "price", "price_raw", "price_per_sqft", "bhk", "bathrooms", "balconies", "floors", "facing_direction", "latitude", "longitude", "project_society_name"]
    said = lambda df: F.col("description") if "description" in df.columns else F.lit(None).cast("string").alias("description")
    x = one.select(*columns, said(one), F.lit(1).alias("src")).unionByName(two.select(*columns, said(two), F.lit(2).alias("src")))
    rows = listing_features(x, bands=bands)
    each = written(rows, "listing-features")
    keyed = each.select("listing_id", "src", "sign", F.explode("bands").alias("band")).where("band <> 0")
    met = F.abs("band").alias("key")
    left = keyed.where("src = 1").select(F.col("listing_id").alias("ea"), F.when(F.col("band") > 0, F.col("sign")).otherwise(F.col("sign").bitwiseOR(F.lit(-(1 << 31)).cast("int"))).alias("sa"), met)  # the spare bit: not by chance
    right = keyed.where("src = 2").select(F.col("listing_id").alias("eb"), F.col("sign").alias("sb"), met)
    pair = left.join(right, "key").where(_signs_agree(F.col("sa"), F.col("sb"))).groupBy("ea", "eb").agg(F.max(F.col("sa") >= 0).alias("chance"))
    side = [c for c in rows.columns if c not in ("listing_id", "src", "sign", "bands")]
    whole = lambda src, name: each.where(F.col("src") == src).select(F.col("listing_id").alias(f"e{name}"), F.struct(*side).alias(name))
    f = pair.join(whole(1, "a"), "ea").join(whole(2, "b"), "eb").where(_possible())
    f = f.select("chance", F.col("a.entity").alias("na"), F.col("b.entity").alias("nb"), F.xxhash64("ea", "eb").alias("draw"), (F.col("a.number").isNotNull() & F.col("b.number").isNotNull() & (F.col("a.society") != "") & (F.col("b.society") != "")).alias("full"), *[v.alias(f"x_{k}") for k, v in _pair_features().items()])
    f = written(f, "pair-features")
    match = (F.col("x_unit") == 1) & (F.col("x_society") >= 0.6) & (F.col("x_phase") == 0)
    told = F.when(F.col("full"), match.cast("int")).when(F.col("x_other_unit") == 1, F.lit(0))
    labelled = f.where("chance").withColumn("told", told).where("told is not null")  # drawn as the pairs are that the score has to tell
    drawn = written(labelled.select("draw", "told", *[f"x_{k}" for k in NAMES]).orderBy("draw").limit(sample), "labels")  # written first: no more than the sample goes to the driver
    got = drawn.toPandas().sort_values("draw")
    linear, steps = _classifier(got[[f"x_{k}" for k in NAMES]].to_numpy(dtype=float), got["told"].to_numpy(dtype=float))
    score = F.lit(linear[-1])
    for k, c in zip(NAMES, linear[:-1], strict=True):
        score = score + F.lit(c) * F.col(f"x_{k}")
    score = F.when(F.col("x_other_unit") == 1, F.least(score, F.lit(NO_MATCH))).otherwise(score)  # no likeness makes one dwelling of two doors
    best = f.groupBy("na", "nb").agg(F.max(F.struct((F.col("x_no_unit") == 0).alias("doors"), score.alias("z"))).alias("m")).select("na", "nb", F.col("m.z").alias("z"))
    sure = F.lit(steps[-1][1])
    for upper, p in reversed(steps[:-1]):
        sure = F.when(F.col("z") <= upper, F.lit(p)).otherwise(sure)
    hits = best.select("na", "nb", sure.alias("confidence")).where(F.col("confidence") >= confidence)
    owner = lambda src, e, n: each.where(F.col("src") == src).select(F.col("listing_id").alias(e), F.col("entity").alias(n))
    out = hits.join(owner(1, "p", "na"), "na").join(owner(2, "q", "nb"), "nb")
    return out.select(F.least("p", "q").alias("listing_id_a"), F.greatest("p", "q").alias("listing_id_b"), "confidence").distinct()


def _classifier(data: np.ndarray, y: np.ndarray) -> tuple[list[float], list[tuple[float, float]]]:
    """Weights over ``NAMES`` (intercept last) fitted on every other labelled pair, and calibration steps from the rest."""
    fit = np.arange(len(y)) % 2 == 0
    w = fit_logistic(*with_masks(data[fit], y[fit]), prior=np.array(list(PRIOR.values())))
    x, held = with_masks(data[~fit], y[~fit])
    return [float(v) for v in w], isotonic(np.c_[x, np.ones(len(x))] @ w, held)
