"""Postal addresses in different writing: parsing, a deletion-neighbourhood index, and component assignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.components import connected
from plinth.llm.index import LONG, long_keys, near_keys, short_keys
from plinth.llm.places import BLANK, LOCALITY_KINDS, STREET_KINDS, place_tokens
from plinth.session import cut, written

#: Landmarks say nothing of the address itself; numbers in them are no door numbers.
_LANDMARK = re.compile(
    r"\b(?:near|nr|opp(?:osite)?\.?|behind|next to|facing|above|below|adjacent to|beside)\s+(?:[a-z.]+\s+){0,2}?"
    r"(?:shop|mandi|school|hall|park|pillar|tank|gate|depot|station|temple|mandir|hospital|bank|market|chowk|metro|college|church|mosque|masjid|pump|office|mall|stop)\b(?:\s*(?:no\.?\s*)?\d{1,2}\b)?"
)
_PIN = re.compile(r"(\bpin(?:\s?code)?\b[\s\-:.]*)?(?<![/#\d])\b([1-9]\d{2}) ?(\d{3})\b")
_PHASE = re.compile(r"(?:(?:\b(?:phase|phas|phse|pahse|phs|ph)|फेज|फेज़|फेस|चरण)[\s.\-]*(\d+|i{1,3}|iv|v)\b|\b(\d+)\s?(?:st|nd|rd|th)\s+ph(?:ase)?\b)")
_SECTOR = re.compile(r"(?:\b(?:sec(?:tor|ter|t)?|sctor|sectr|setcor|secotr|sctr)\b[\s.\-]*(?:no\.?|number)?[\s.\-]*(\d{1,3})[\s\-]?([a-d]\b)?|सेक्टर\s*(\d{1,3})[\s\-]?([a-d]\b)?)")
_SECTOR_AFTER = re.compile(r"\b(\d{1,3})[\s\-]?([a-d])?\s+sector\b")
_NO = r"(?:no\b\.?|number\b)?[\s.\-]*"
#: Door numbers, most telling form first; each gives a letter and a number, either may be missing.
_UNIT = [
    (re.compile(r"(?:#|\b(?:flat|flt|apt|apartment|unit|house|plot|makan|door|hno|fno|[hf][\s.]{0,2}no)\b[\s.]*" + _NO + r")\s*(\d{1,5})\s*[-/]\s*([a-z])\b"), (2, 1)),
    (re.compile(r"(?:#|\b(?:flat|flt|apt|apartment|unit|house|plot|makan|door|hno|fno|[hf][\s.]{0,2}no)\b[\s.]*" + _NO + r")\s*([a-z])[\s\-/]*(\d{1,5})\b"), (1, 2)),
    (re.compile(r"(?:#|\b(?:flat|flt|apt|apartment|unit|house|plot|makan|door|hno|fno|[hf][\s.]{0,2}no)\b[\s.]*" + _NO + r")\s*(\d{1,5})\b"), (0, 1)),
    (re.compile(r"\b([a-z])\s?[\-/]?\s?(\d{1,5})\b"), (1, 2)),
    (re.compile(r"\b(\d{1,5})\s*[-/]?\s*([a-z])\b(?![\s.\-]*bl)"), (2, 1)),
    (re.compile(r"\b(\d{1,5})\b"), (0, 1)),
]
_LETTER = re.compile(r"\b(?:block|blk|tower|twr|tw|t|wing)\b[\s.\-]*([a-z])\b|\b([a-z])[\s\-]*(?:block|blk|tower|twr|wing)\b")
_JOINED = sorted(
    ((w, k) for k, ws in STREET_KINDS.items() for w in ws.split() if w.isalpha() and len(w) >= 3 and w not in ("ave", "resi", "hab", "str", "green", "avn", "apt")),
    key=lambda x: (-len(x[0]), x[0]),
)


#: Endings too short to be told from a name's own letters, tried only where an address shows no street kind at all.
_SHORT = sorted(((w, k) for k, ws in STREET_KINDS.items() for w in ws.split() if w.isalpha() and len(w) >= 2), key=lambda x: (-len(x[0]), x[0]))


@lru_cache(maxsize=300_000)
def _joined(word: str, short: bool = False) -> tuple[str, str] | None:
    """The name and kind in a street typed without its space: luginemanor."""
    for w, k in _SHORT if short else _JOINED:
        if len(word) >= len(w) + 4 and word.endswith(w):
            return word[: -len(w)], k
    return None


_LANDMARK_WORDS = ("near", "nr ", "opp", "behind", "next", "facing", "above", "below", "adjacent", "beside")
_SIX = re.compile(r"\d{3} ?\d{3}")
_PIN_WORD = re.compile(r"\bpin(?:code)?\b[\s\-:.]*")
_PARTS = re.compile(r"[,;|\n]|\s-\s")
_WORDS = re.compile(r"[a-zऀ-ॿ'’]+|\d+")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}


def _mark(m: re.Match) -> str:
    n = _ROMAN.get(m[1]) or int(m[1]) if m[1] else int(m[2])
    return f" ph{chr(96 + n % 26)}ph "


@lru_cache(maxsize=300_000)
def _word(w: str) -> tuple[str, ...]:
    """The tokens of one written word: a marked phase, a kind, or a name with the kind joined to it."""
    if len(w) == 5 and w[:2] == w[3:] == "ph":
        return (f"phase {ord(w[2]) - 96}",)
    ws = place_tokens(w)
    if ws and ws[-1].isalpha() and ws[-1] not in STREET_KINDS and ws[-1] not in LOCALITY_KINDS and (j := _joined("".join(c for c in w if "a" <= c <= "z"))):
        return (*ws[:-1], *place_tokens(j[0]), j[1])
    return ws


def parse_address(text: str | None, need_number: bool = True) -> tuple | None:
    """(letter, number, pin, street, kind, phase, rest) of an address, or None if it names no door or plot number and ``need_number`` is set.

    ``street`` is the phonetic name of the building or street, '' if none can be told apart; ``rest`` the remaining
    place tokens (locality, city). Null, blank and words for null give None.
    """
    if text is None:
        return None
    t = text.strip().lower()
    if t in BLANK:
        return None
    if any(k in t for k in _LANDMARK_WORDS):
        t = _LANDMARK.sub(" ; ", t)
    pin = None
    if _SIX.search(t) and (found := list(_PIN.finditer(t))):
        m = next((m for m in found if m[1]), found[-1])
        pin = m[2] + m[3]
        t = t[: m.start()] + " , " + t[m.end() :]
    if "pin" in t:
        t = _PIN_WORD.sub(" , ", t)
    sector = None
    if ("s" in t or "स" in t) and (m := _SECTOR.search(t) or ("sector" in t and _SECTOR_AFTER.search(t))):
        n, s = next((m[i], m[i + 1] or "") for i in (1, 3) if m[i])
        sector = f"sector {int(n)}{s}"
        t = t[: m.start()] + " , " + t[m.end() :]
    # phases stay where they are, as a mark that the words around them can be told by
    work = _PHASE.sub(_mark, t) if "ph" in t or "फ" in t or "चरण" in t else t
    letter, number = None, None
    if m := _LETTER.search(work):
        letter = m[1] or m[2]
        work = work[: m.start()] + " , " + work[m.end() :]
    for p, (a, b) in _UNIT:
        if m := p.search(work):
            number = str(int(m[b]))
            if a and not letter:
                letter = m[a]
            work = work[: m.start()] + " , " + work[m.end() :]
            break
    if number is None and need_number:
        return None
    street, kind, phase, rest = "", "", 0, []
    for q in _PARTS.split(work):
        ws: list[str] = []
        for w in _WORDS.findall(q):
            ws += _word(w)
        i = 0
        while i < len(ws):
            w = ws[i]
            if w in STREET_KINDS and i and not street and ws[i - 1] not in LOCALITY_KINDS and not ws[i - 1].startswith("phase "):
                street, kind = ws[i - 1], w
                rest = rest[:-1] if rest and rest[-1] == ws[i - 1] else rest
                if i + 1 < len(ws) and ws[i + 1].startswith("phase "):
                    phase = int(ws[i + 1][6:])
                    i += 1
            elif not w.isdigit():
                rest.append(w)
            i += 1
    if not street:  # a short kind written on to its name, else the first name that no locality kind follows
        for i, w in enumerate(rest):
            if w.isalpha() and w not in LOCALITY_KINDS and (j := _joined(w, short=True)):
                street, kind = j
                rest = rest[:i] + rest[i + 1 :]
                if i < len(rest) and rest[i].startswith("phase "):
                    phase = int(rest.pop(i)[6:])
                break
    if not street:
        for i, w in enumerate(rest):
            if w.isalpha() and w not in LOCALITY_KINDS and w not in STREET_KINDS and (i + 1 >= len(rest) or rest[i + 1] not in LOCALITY_KINDS):
                street = w
                rest = rest[:i] + rest[i + 1 :]
                break
    if sector:
        rest.append(sector)
    return letter or "", number, pin, street, kind, phase, " ".join(rest)


def _similar(a: str, b: str) -> float:
    """Edit similarity of two names, exchanged neighbours counting as one edit."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > 2:
        return 0.0
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        new = [i] + [0] * m
        for j in range(1, m + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                new[j] = min(new[j], before[j - 2] + 1)
        before, row = row, new
    return 1.0 - row[m] / max(n, m)


def best_assignment(gain: list[list[float]]) -> float:
    """The largest sum of one entry of each row (no more rows than columns), no two in one column: shortest augmenting paths, in time rows^2 x columns."""
    rows, columns = len(gain), len(gain[0]) if gain else 0
    u, v, owner = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, before, seen = [float("inf")] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while owner[at]:
            seen[at] = True
            row, step, nearest = owner[at], float("inf"), 0
            for j in range(1, columns + 1):
                if not seen[j]:
                    slack = -gain[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], before[j] = slack, at
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(columns + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nearest
        while at:
            owner[at] = owner[before[at]]
            at = before[at]
    return sum(gain[owner[j] - 1][j - 1] for j in range(1, columns + 1) if owner[j])


def assigned_score(a: list[str], b: list[str]) -> float:
    """The best mean similarity over one-to-one assignments of the shorter list's components to the longer's; all components count."""
    a, b = sorted((a, b), key=len)
    return best_assignment([[_similar(x, y) for y in b] for x in a]) / len(a) if a else 0.0


@F.pandas_udf(T.DoubleType())
def _assigned(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([assigned_score(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _street_score(a: Column, b: Column) -> Column:
    """Edit similarity of two names; an exchange of two letters counts as one edit."""
    d = F.levenshtein(a, b)
    letters = lambda c: F.array_sort(F.split(c, ""))
    edits = F.when((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), 1).otherwise(d)
    return 1 - edits / F.greatest(F.length(a), F.length(b))


def deleted(word: str, most: int) -> set[str]:
    """``word`` and what is left of it after deleting up to ``most`` characters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Places:
    """Cities and localities of a gazetteer by their typed names: equal in normal form, or within two edits through a deletion index."""

    def __init__(self, rows: list[tuple]) -> None:
        self.district: dict[str, str] = {}
        self.city_of_district: dict[str, str] = {}
        self.by_key: dict[tuple[str, str], int] = {}
        self.pins: dict[str, int | None] = {}
        self.owners: dict[str, set[str]] = {}
        self.district_of: dict[int, str] = {}
        near_city: dict[str, set[str]] = {}
        near_key: dict[tuple[str, str], set[str]] = {}
        for i, city, locality, pin in sorted(rows, key=lambda r: r[0]):
            c, k = "".join(place_tokens(city)), place_key(locality)
            if pin:
                self.district.setdefault(c, pin[:3])
                self.city_of_district.setdefault(pin[:3], c)
                self.pins[pin] = None if pin in self.pins else i
            self.by_key.setdefault((c, k), i)
            if pin:
                self.district_of[i] = pin[:3]
            self.owners.setdefault(k, set()).add(c)
        for c in self.district:
            for v in deleted(c, 2) if len(c) <= LONG + 2 else {c}:
                near_city.setdefault(v, set()).add(c)
        for c, k in self.by_key:
            if not k.startswith("sector "):
                for v in deleted(k.split()[0], 2) if len(k.split()[0]) <= LONG + 2 else {k.split()[0]}:
                    near_key.setdefault((c, v), set()).add(k)
        self.near_city, self.near_key = near_city, near_key
        #: long names have too many deletions; a long word is held against each of them
        self.long_cities = [c for c in self.district if len(c) > LONG - 2]
        self.long_keys = [(c, k) for c, k in self.by_key if len(k.split()[0]) > LONG - 2]
        self._city: dict[str | None, str | None] = {}
        self._loc: dict[tuple[str, str], int | None] = {}

    def _cities_like(self, word: str) -> set[str]:
        near = {c for v in deleted(word, 2) for c in self.near_city.get(v, ())} if len(word) <= LONG + 2 else set()
        return near | {c for c in self.long_cities if abs(len(c) - len(word)) <= 2}

    def _keys_like(self, city: str, name: str) -> set[str]:
        near = {k for v in deleted(name, 2 if len(name) >= 6 else 1) for k in self.near_key.get((city, v), ())} if len(name) <= LONG + 2 else set()
        return near | {k for c, k in self.long_keys if c == city and abs(len(k.split()[0]) - len(name)) <= 2}

    def city(self, text: str | None) -> str | None:
        """The city a text names, as the gazetteer writes it in normal form."""
        if text not in self._city:
            if len(self._city) > 500_000:
                self._city.clear()
            t = place_tokens(text)
            words = ["".join(t), *(a + b for a, b in zip(t, t[1:], strict=False)), *t]
            hit = next((w for w in words if w in self.district), None)
            if hit is None:
                close = {(1 - _similar(w, c), c) for w in words if len(w) >= 5 for c in self._cities_like(w)}
                hit = min((x for x in close if x[0] <= 0.3), default=(0, None))[1]
            self._city[text] = hit
        return self._city[text]

    def locality(self, city: str | None, key: str) -> int | None:
        """The entry that a place key (``place_key``) names in a city; without a city, the only one of that name."""
        if not key:
            return None
        if city is None:
            who = self.owners.get(key, ())
            return self.by_key[next(iter(who)), key] if len(who) == 1 else None
        at = city, key
        if at not in self._loc:
            if len(self._loc) > 500_000:
                self._loc.clear()
            hit = self.by_key.get(at)
            if hit is None and not key.startswith("sector "):
                name, *rest = key.split(" ", 1)
                close = {(1 - _similar(name, k.split()[0]), k) for k in self._keys_like(city, name) if k.split(" ", 1)[1:] == rest}
                good = sorted(x for x in close if x[0] <= 0.34)
                if good and (len(good) == 1 or good[1][0] > good[0][0]):
                    hit = self.by_key[city, good[0][1]]
            self._loc[at] = hit
        return self._loc[at]


def place_key(text: str | None) -> str:
    """A locality's name, kind and phase in normal form, without the city or a landmark word beside it; '' if none is named."""
    t = place_tokens(text)
    for x in t:
        if x.startswith("sector "):
            return x
    for i, x in enumerate(t):
        if i and x in LOCALITY_KINDS:
            return " ".join((t[i - 1], x, *(y for y in t[i + 1 : i + 2] if y.startswith("phase "))))
    return ""


def address_rows(listings: DataFrame, gazetteer: DataFrame, *, most_places: int = 200_000) -> DataFrame:
    """listing_id, block, letter, number, street, kind, phase, loc, rest of each row whose address reaches a door or plot number.

    ``loc`` is the gazetteer entry the address lies in, by its postcode where that is one entry's, else by the typed locality, else by the
    address's own words; NULL if none can be told. ``block`` is the postcode's district (its first three digits), of the city that the row
    names, else of its postcode, else of ``loc``; NULL where none can be told. The gazetteer goes to every task; one of more than ``most_places`` entries
    is refused.
    """
    places = [tuple(r) for r in gazetteer.select("locality_id", "city", "locality", "pincode").limit(most_places + 1).collect()]
    if len(places) > most_places:
        raise ValueError(f"the gazetteer has more than {most_places} entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Places(places)
        for b in batches:
            out = []
            for i, city, locality, text in zip(b["listing_id"].tolist(), b["city"].tolist(), b["locality"].tolist(), b["address_full"].tolist(), strict=True):
                a = parse_address(text)
                if a is None or not a[3]:
                    continue
                letter, number, pin, street, kind, phase, rest = a
                c = known.city(city) or known.city(locality) or known.city(rest)
                if c is None and pin:
                    c = known.city_of_district.get(pin[:3])
                loc = known.pins.get(pin) if pin else None
                if loc is None:
                    loc = known.locality(c, place_key(locality))
                if loc is None:
                    loc = known.locality(c, place_key(rest))
                block = known.district.get(c) if c else pin[:3] if pin else known.district_of.get(loc)
                out.append((i, block, letter, number, street, kind, phase, loc, rest))
            yield pd.DataFrame(out, columns=_ROW).astype({"loc": "Int64"})

    kind = listings.schema["listing_id"].dataType.simpleString()
    return listings.select("listing_id", "city", "locality", "address_full").where("address_full is not null").mapInPandas(run, f"listing_id {kind}, block string, letter string, number string, street string, kind string, phase int, loc long, rest string")


_ROW = ["listing_id", "block", "letter", "number", "street", "kind", "phase", "loc", "rest"]


def neighbouring(gazetteer: DataFrame, km: float) -> DataFrame:
    """loc, near: each gazetteer entry with those whose centres are within ``km``, itself included."""
    from plinth.operators.geo import points_within

    g = gazetteer.select(F.col("locality_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return points_within(g, g, km).select(F.col("point_id").alias("loc"), F.col("other_id").alias("near"))


def address_classes(rows: DataFrame, gazetteer: DataFrame, *, street_similarity: float = 0.66, neighbour_km: float = 3.0) -> DataFrame:
    """listing_id, address_class: rows of ``address_rows`` with one class for each flat, house or plot.

    Nodes are the distinct parsed addresses of a block, so repeats cost one node. Unit letter and number must be
    equal, as must known kinds, and phases, of which none is one of its own: a name without a phase is another building than that name with one (vetoes); the street names meet in a
    deletion-neighbourhood index (``near_keys``) of their block and unit, and places must be the same, neighbours
    within ``neighbour_km``, or unknown. A node near a border is also in the index of the blocks that its neighbouring localities lie in, and
    one without a block meets all blocks' nodes of its unit. Pairs are then judged by the optimal assignment of their components.
    Classes are the connected components (``connected``).
    """
    keys = ["block", "letter", "number", "street", "kind", "phase", "loc"]
    rows = written(rows, "addresses")
    x = rows.withColumn("node", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys]))
    nodes = written(x.groupBy("node", *keys).agg(F.min("rest").alias("rest")), "address-nodes")
    near = neighbouring(gazetteer, neighbour_km)
    place = gazetteer.where("pincode is not null").select(F.col("locality_id").alias("near"), F.left("pincode", F.lit(3)).alias("other"))
    beside = near.join(place, "near").groupBy("loc").agg(F.collect_set("other").alias("beside"))  # the few districts around a locality
    most = F.when(F.length("street") >= 6, 2).when(F.length("street") >= 4, 1).otherwise(0)
    here = nodes.where("block is not null").join(beside, "loc", "left").withColumn("in", F.explode(F.array_union(F.array("block"), F.coalesce("beside", F.array().cast("array<string>")))))
    street = F.col("street")
    key = lambda df, keys, block: df.select("node", F.explode(keys).alias("v"), "letter", "number", *block).select("node", F.xxhash64(*block, "letter", "number", "v").alias("k"))
    ends = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    short, long = key(here, short_keys(street, most), ["in"]), here.where(F.length("street") > LONG - 2)
    pair = ends(short, short).where("a < b").unionByName(ends(key(long, long_keys(street, True), ["in"]), key(long, long_keys(street, False), ["in"])).where("a < b"))
    lost = nodes.where("block is null")
    same_unit = nodes.join(lost.select("letter", "number").distinct(), ["letter", "number"], "left_semi")
    homeless = ends(key(lost, near_keys(street, most, True), []), key(same_unit, near_keys(street, most, False), [])).where("a <> b")
    pair = pair.unionByName(homeless.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("street", "kind", "phase", "loc", "rest", "letter", "number", "block")])
    pair = pair.join(side("a"), "a").join(side("b"), "b")
    agree = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    kinds = agree("kind") | (F.col("a_kind") == "") | (F.col("b_kind") == "")
    pair = pair.where(agree("letter") & agree("number") & kinds & agree("phase"))
    one_block = F.coalesce(agree("block"), F.lit(True))  # a missing block is unknown
    pair = pair.join(near, (F.col("a_loc") == F.col("loc")) & (F.col("b_loc") == F.col("near")), "left").where(F.col("near").isNotNull() | agree("loc") | ((F.col("a_loc").isNull() | F.col("b_loc").isNull()) & one_block)).drop("loc", "near")
    pair = written(pair.withColumn("street_score", _street_score(F.col("a_street"), F.col("b_street"))).where(F.col("street_score") >= street_similarity), "address-pairs")
    # close street names in known places need no second look; the rest are judged by all their components
    sure = F.col("a_loc").isNotNull() & F.col("b_loc").isNotNull() & (F.col("street_score") > 0.8)
    parts = lambda s: F.concat(F.array(f"{s}_street"), F.filter(F.split(f"{s}_rest", " "), lambda w: F.length(w) > 2))
    judged = pair.where(~sure).select("a", "b", _assigned(parts("a"), parts("b")).alias("score")).where(F.col("score") >= 0.62).select("a", "b")
    label = connected(nodes, pair.where(sure).select("a", "b").unionByName(judged))
    return x.select("listing_id", "node").join(label, "node").select("listing_id", F.col("label").alias("address_class"))


def same_address_pairs(listings: DataFrame, gazetteer: DataFrame, **options) -> DataFrame:
    """listing_id_a, listing_id_b, the smaller first: different rows whose address denotes the same flat, house or plot.

    ``listings``: listing_id, city, locality, address_full. Null, blank and unreadable addresses, and those that stop
    before the door or plot number, are in no pair. Repeated rows are rows of their own if their ids differ. Empty
    input gives no pairs; further columns are ignored. The result lists every pair of a class, as problem 2 states it.
    """
    c = cut(address_classes(address_rows(listings, gazetteer), gazetteer, **options))
    a, b = c.select(F.col("listing_id").alias("listing_id_a"), "address_class"), c.select(F.col("listing_id").alias("listing_id_b"), "address_class")
    return a.join(b, "address_class").where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
