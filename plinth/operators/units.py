"""Quantities recorded in different units: conversion graph, normalisation, and findings.

Units are nodes and conversions are edges carrying an affine function ``target = scale * source + offset``.
``UnitGraph`` composes the shortest path from each unit to the canonical one, and refuses a graph in which two
paths between the same units disagree. The composed table is equi-joined on (source unit, canonical target).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Square feet in one unit.
AREA_EDGES = [
    ("sqyd", "sqft", 9.0, 0.0),
    ("sqm", "sqft", 10.7639, 0.0),
    ("marla", "sqyd", 30.25, 0.0),
    ("biswa", "sqyd", 150.0, 0.0),
    ("bigha", "biswa", 20.0, 0.0),
    ("kanal", "marla", 20.0, 0.0),
    ("acre", "kanal", 8.0, 0.0),
    ("acre", "guntha", 40.0, 0.0),
    ("guntha", "sqft", 1089.0, 0.0),
    ("ground", "sqft", 2400.0, 0.0),
    ("hectare", "sqm", 10000.0, 0.0),
    ("acre", "sqyd", 4840.0, 0.0),
    ("bigha", "sqyd", 3000.0, 0.0),
]
# Rate units besides the rates per area unit.
RATE_EDGES = [("rate:thousand", "rate:sqft", 1000.0, 0.0)]

# Spellings of each unit, lower case, letters only.
SPELLINGS = {
    "sqft": "sqft sft sf sqfeet sqfoot squarefeet squarefoot squareft sqfts वर्गफुट वर्गफीट वर्गफ़ुट",
    "sqyd": "sqyd sqyds sqyrd sqyrds sqyard sqyards squareyard squareyards squareyds gaj gaz gajj sqgaj गज वर्गगज",
    "sqm": "sqm sqmt sqmts sqmtr sqmtrs sqmeter sqmeters sqmetre sqmetres squaremeter squaremeters squaremetre squaremetres squaremtr m msq वर्गमीटर वर्गमी",
    "acre": "acre acres ac एकड़ एकड",
    "hectare": "hectare hectares hectar ha हेक्टेयर हैक्टेयर",
    "bigha": "bigha bighas beegha beeghas bighaa बीघा बिघा",
    "biswa": "biswa biswas biswaa बिस्वा बिसवा",
    "marla": "marla marlas मरला मारला",
    "kanal": "kanal kanals कनाल",
    "guntha": "guntha gunthas gunta guntas गुंठा गुंटा गुन्ठा",
    "ground": "ground grounds grd ग्राउंड ग्राउण्ड",
}


class UnitConflict(ValueError):
    """Two conversion paths between the same units disagree."""


@dataclass
class UnitGraph:
    """A graph of affine conversions. ``edges`` are (source, target, scale, offset)."""

    edges: list[tuple[str, str, float, float]]
    tolerance: float = 1e-9
    _out: dict[str, list[tuple[str, float, float]]] = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        for a, b, scale, offset in self.edges:
            if scale == 0:
                raise UnitConflict(f"{a} -> {b} cannot be inverted")
            self._out.setdefault(a, []).append((b, scale, offset))
            self._out.setdefault(b, []).append((a, 1 / scale, -offset / scale))

    def compose(self, target: str) -> dict[str, tuple[float, float, int]]:
        """(scale, offset, hops) from each reachable unit to ``target`` along a shortest path."""
        found, queue = {target: (1.0, 0.0, 0)}, deque([target])
        while queue:
            at = queue.popleft()
            s0, o0, hops = found[at]
            for other, scale, offset in self._out.get(at, []):
                if other not in found:  # other -> at is the inverse of at -> other, then at -> target
                    found[other] = (s0 / scale, o0 - s0 * offset / scale, hops + 1)
                    queue.append(other)
        return found

    def check(self, target: str) -> None:
        """Raise unless each edge agrees with the shortest compositions of its ends, so all cycles are consistent."""
        to = self.compose(target)
        for a, b, scale, offset in self.edges:
            if a not in to:
                continue
            (sa, oa, _), (sb, ob, _) = to[a], to[b]
            for x in (0.0, 1.0, 1000.0):
                direct, around = sa * x + oa, sb * (scale * x + offset) + ob
                if abs(direct - around) > self.tolerance * max(1.0, abs(direct)):
                    raise UnitConflict(f"{a} -> {b} disagrees with another path to {target}: {direct} and {around}")

    def table(self, spark: SparkSession, target: str) -> DataFrame:
        """source_unit, target_unit, scale, offset, hops: one row for each unit that reaches ``target``."""
        self.check(target)
        rows = [(u, target, s, o, h) for u, (s, o, h) in sorted(self.compose(target).items())]
        return spark.createDataFrame(rows, "source_unit string, target_unit string, scale double, offset double, hops int")


def area_graph() -> UnitGraph:
    return UnitGraph(AREA_EDGES)


def rate_graph() -> UnitGraph:
    """Rates per area unit: a rate per a unit of ``k`` square feet is the rate per square foot times ``k``."""
    area = area_graph().compose("sqft")
    return UnitGraph([(f"rate:{u}", "rate:sqft", 1 / s, 0.0) for u, (s, _, h) in area.items() if h] + RATE_EDGES)


def spelling_table(spark: SparkSession) -> DataFrame:
    rows = [(alias, unit) for unit, names in SPELLINGS.items() for alias in names.split()]
    return spark.createDataFrame(rows, "alias string, unit string")


def unit_alias(c: Column) -> Column:
    """A written unit as ``SPELLINGS`` has it: lower case, letters and marks only; NULL if none are left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^a-zऀ-ॿ]", ""), F.lit(""))


def convert_units(df: DataFrame, value: str, unit: str, target: str, graph: UnitGraph, out: str = "converted") -> DataFrame:
    """``df`` with ``out``: ``value`` converted from the unit named in ``unit`` to ``target``; NULL if the unit is unknown.

    Null values or units give NULL; all rows and all other columns are kept, whatever their names. An empty table
    gives an empty table with the added column.
    """
    t = graph.table(df.sparkSession, target).select(F.col("source_unit").alias("__u"), F.col("scale").alias("__s"), F.col("offset").alias("__o"))
    return df.join(F.broadcast(t), df[unit] == F.col("__u"), "left").withColumn(out, df[value] * F.col("__s") + F.col("__o")).drop("__u", "__s", "__o")


_NUM = r"(\d+(?:,\d{2,3})*(?:\.\d+)?)"
_SQ = r"sq(?:uare)?s?[\s.\-]*(?:feet|foot|ft|fts|yards?|yrds?|yds?|gaj|met(?:er|re)s?|mtrs?|mts?|m)\.?(?![a-z])"
_UNIT = (
    r"(" + _SQ + r"|s\.?\s?f\.?\s?t?\b|gaj\b|gaz\b|m²|m2\b|गज|वर्ग\s*(?:फुट|फ़ुट|फीट|गज|मीटर|मी)"
    r"|acres?\b|ac\b|एकड़|एकड|hectares?\b|hectar\b|ha\b|हेक्टेयर|हैक्टेयर|b(?:i|ee)ghas?\b|बीघा|बिघा|biswas?\b|बिस्वा|बिसवा|marlas?\b|मरला|मारला"
    r"|kanals?\b|कनाल|gunt(?:h)?as?\b|गुंठा|गुंटा|grounds?\b|ग्राउंड|ग्राउण्ड)"
)
#: What else is measured in a listing's text, and so is not the listing's own area.
_OTHER = r"\b(?:club(?: house)?|clubhouse|balcony|balconies|terrace|garden|lawn|park|pool|lobby|harvesting|township|campus|tiles?|kitchen|parking|gym|open space|green)\b"


def plain_text(c: Column) -> Column:
    """Lower case, without tags and blanks written as entities, Devanagari digits as ASCII ones."""
    return F.translate(F.regexp_replace(F.lower(c), r"<[^>]{0,200}>|&(?:nbsp|amp|#160);", " "), "०१२३४५६७८९", "0123456789")


_RATE = _NUM + r"\s*(?:/-)?\s*(?:/|per\b|प्रति|a\b)\s*-?\s*" + _UNIT
_TWO = _NUM + r"\s*" + _UNIT + r"(?:\s*(?:,|&|\+|-|=|/|\(|and\b|aur\b|और|व)?\s*" + _NUM + r"\s*" + _UNIT + r")?"
_LEAD = r"(?:vastu|area is about|floor size|super area|carpet area|covered area|measures|measuring|total|built[ -]?up area(?: of)?|\barea\b|\bsize\b|क्षेत्रफल|क्षेत्र)\s*(?:of|is|about|:|-|=|approx\.?)?\s*"


def own_areas(t: Column) -> Column:
    """Plain text without rates and the areas of other things."""
    t = F.regexp_replace(t, _RATE, " ; ")
    t = F.regexp_replace(t, _OTHER + r"[^.।;\d]{0,30}" + _NUM + r"\s*" + _UNIT, " ; ")
    return F.regexp_replace(t, _NUM + r"\s*" + _UNIT + r"\s*(?:of\s+)?(?:township|next door|park|campus|garden|lawn)", " ; ")


def own_mention(t: Column) -> Column:
    """The words that state a listing's own area in ``own_areas``: after a phrase that announces it, else the first bare mention; '' if none."""
    announced = F.regexp_extract(t, _LEAD + _TWO, 0)
    return F.when(announced != "", announced).otherwise(F.regexp_extract(t, r"(?:^|(?<![\d.,x]))" + _TWO, 0))


def mention_parts(m: Column) -> Column:
    """struct(value, alias, value2, alias2) of the few words of a mention, NULL fields where absent."""
    g = [F.nullif(F.regexp_extract(m, _TWO + "$", i), F.lit("")) for i in (1, 2, 3, 4)]
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    return F.struct(number(g[0]).alias("value"), g[1].alias("alias"), number(g[2]).alias("value2"), g[3].alias("alias2"))


def described_area(c: Column) -> Column:
    """struct(value, alias, value2, alias2) of the listing's own area in free text, NULL fields where absent.

    A mention is a number followed by an area unit; rates (a number per unit) and areas of other things (club,
    balcony, park, township) do not count. Phrases that announce the own area win over a bare mention. The second
    pair is set when the area is given in two units at once, as in '2 kanal 5 marla'.
    """
    return mention_parts(own_mention(own_areas(plain_text(c))))


_SAID = _NUM + r"\s*(?:/-)?\s*(?:/|per\b|प्रति)\s*-?\s*" + _UNIT


def described_rate(c: Column) -> Column:
    """struct(value, alias) of a rate stated in free text ('Rs 7,813 per sq ft', '3,225 / sq yd'), NULL fields where absent."""
    return rate_parts(F.regexp_extract(plain_text(c), _SAID, 0))


def rate_parts(m: Column) -> Column:
    g = [F.nullif(F.regexp_extract(m, _SAID + "$", i), F.lit("")) for i in (1, 2)]
    return F.struct(F.regexp_replace(g[0], ",", "").try_cast("double").alias("value"), g[1].alias("alias"))


def parsed_price(c: Column) -> Column:
    """Rupees in a price as written: '1.93 Cr', '₹ 64.5 L', 'Rs 7,720,000', '94.2 lakh'; NULL if unreadable."""
    t = F.lower(c)
    n = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    scale = F.when(t.rlike(r"\d\s*(?:cr|करोड़)"), 1e7).when(t.rlike(r"\d\s*(?:l\b|lac|lakh|लाख)"), 1e5).when(t.rlike(r"\d\s*k\b"), 1e3).otherwise(1.0)
    return F.when(n > 0, n * scale)


def _positive(c: Column) -> Column:
    c = c.try_cast("double")
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)


def _nearest(x: Column, factors: list[tuple[str, float]], tolerance: float) -> Column:
    """The unit whose factor is nearest to ``x`` on a log scale, NULL beyond ``tolerance``. ``factors`` has a fixed dozen entries."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.log(x / f)).alias("e"), F.lit(u).alias("u")) for u, f in factors]))
    return F.when(x.isNotNull() & (best["e"] <= tolerance), best["u"])


def normalise_listing_units(
    listings: DataFrame, *, tolerance: float = 0.085, area_range: tuple[float, float] = (550.0, 5200.0), rate_range: tuple[float, float] = (300.0, 26000.0)
) -> DataFrame:
    """One row for each row of ``listings``: area in square feet, rate in rupees per square foot, and the units recorded.

    Columns: listing_id, area_unit (of covered_area_sqft), rate_unit (of price_per_sqft, or ``thousand``), text_unit
    (of the own area in description), area_sqft, rate_per_sqft. The unit of a recorded number is the one that makes
    it agree, within ``tolerance`` (natural log), with the best other evidence in the row: the area in the text, the
    declared value and unit, or price over rate. ``area_range`` and ``rate_range`` are the plausible square feet and
    rupees per square foot of one dwelling; they decide only where a row has no other evidence.

    Nulls, NaN, zero, negative and infinite numbers count as missing; unreadable units as undeclared; a row with
    nothing usable gives NULLs. Repeated rows give repeated rows. Empty input gives an empty result. Columns of
    ``listings`` beyond those read are ignored.
    """
    spark = listings.sparkSession
    area, rate = area_graph(), rate_graph()
    # two equi-joins on the written unit, one on each unit in the text; the table is a constant of about a hundred rows
    units = spelling_table(spark).join(F.broadcast(area.table(spark, "sqft")), F.col("unit") == F.col("source_unit")).where(F.col("target_unit") == "sqft").select("alias", "unit", "scale", "offset")
    # each step on the column before it, so that no pass over a text is written out twice
    x = listings.select(
        "listing_id",
        _positive(F.col("covered_area_value")).alias("v"),
        unit_alias(F.col("covered_area_unit")).alias("a_d"),
        _positive(F.col("covered_area_sqft")).alias("s"),
        F.coalesce(_positive(F.col("price")), parsed_price(F.col("price_raw"))).alias("p"),
        _positive(F.col("price_per_sqft")).alias("r"),
        plain_text(F.col("description")).alias("text"),
    )
    x = x.select("*", own_mention(own_areas(F.col("text"))).alias("m"), F.regexp_extract("text", _SAID, 0).alias("mr")).drop("text")
    x = x.select("*", mention_parts(F.col("m")).alias("own"), rate_parts(F.col("mr")).alias("said")).select(
        "listing_id", "v", "a_d", "s", "p", "r",
        F.col("own.value").alias("v1"), unit_alias(F.col("own.alias")).alias("a_1"),
        F.col("own.value2").alias("v2"), unit_alias(F.col("own.alias2")).alias("a_2"),
        F.col("said.value").alias("v3"), unit_alias(F.col("said.alias")).alias("a_3"),
    )
    for k in ("d", "1", "2", "3"):
        t = F.broadcast(units.select(F.col("alias").alias(f"t_{k}"), F.col("unit").alias(f"u_{k}"), F.col("scale").alias(f"f_{k}"), F.col("offset").alias(f"o_{k}")))
        x = x.join(t, F.col(f"a_{k}") == F.col(f"t_{k}"), "left")
    factors = [(u, s) for u, (s, _, _) in sorted(area.compose("sqft").items())]
    rates = [(u.removeprefix("rate:"), 1 / s) for u, (s, _, _) in sorted(rate.compose("rate:sqft").items())]
    lo, hi = area_range
    both = F.col("v2").isNotNull() & F.col("f_2").isNotNull() & (F.col("u_2") != F.col("u_1")) & (F.col("u_1") != "sqft")
    x = x.withColumns({
        "text_unit": F.when(both & (F.col("f_2") > F.col("f_1")), F.col("u_2")).otherwise(F.col("u_1")),
        "d": F.col("v1") * F.col("f_1") + F.col("o_1") + F.when(both, F.col("v2") * F.col("f_2") + F.col("o_2")).otherwise(0.0),
        "declared": F.when(F.col("u_d") != "sqft", F.col("v") * F.col("f_d") + F.col("o_d")),
        "implied": F.col("p") / F.col("r"),
        "said_rate": F.col("v3") / F.col("f_3"),
    })
    by_text = _nearest(F.col("d") / F.col("s"), factors, tolerance)
    by_declared = _nearest(F.col("declared") / F.col("s"), factors, tolerance)
    by_said = _nearest(F.col("p") / F.col("said_rate") / F.col("s"), factors, tolerance)
    by_price = F.when(F.col("implied").between(lo, hi), _nearest(F.col("implied") / F.col("s"), factors, tolerance))
    plain = F.when(F.col("s").between(lo, hi), F.lit("sqft"))
    #: without other evidence, the first unit in this order under which the number is a plausible dwelling
    guess = F.coalesce(*[F.when((F.col("s") * f).between(lo, hi), F.lit(u)) for u, f in sorted(factors, key=lambda q: (q[0] != "sqyd", q[1]))])
    x = x.withColumn("area_unit", F.when(F.col("s").isNotNull(), F.coalesce(by_declared, by_text, by_price, by_said, plain, guess)))
    x = convert_units(x, "s", "area_unit", "sqft", area, "s_sqft")  # equi-joins of the unit found with the composed shortest paths
    x = x.withColumn("area_sqft", F.coalesce(F.col("s_sqft"), F.col("declared"), F.when(F.col("u_d") == "sqft", F.when(F.col("v").between(lo, hi), F.col("v"))), F.col("d")))
    true_rate = F.coalesce(F.col("p") / F.col("area_sqft"), F.col("said_rate"))
    rlo, rhi = rate_range
    magnitude = F.when(F.col("r") < rlo, F.lit("thousand")).when(F.col("r") > rhi, F.lit("sqyd")).otherwise(F.lit("sqft"))
    x = x.withColumn("rate_unit", F.when(F.col("r").isNotNull(), F.coalesce(_nearest(F.col("r") / true_rate, rates, tolerance), magnitude)))
    x = convert_units(x.withColumn("rate_of", F.concat(F.lit("rate:"), "rate_unit")), "r", "rate_of", "rate:sqft", rate, "r_sqft")
    return x.select("listing_id", "area_unit", "rate_unit", "text_unit", "area_sqft", F.coalesce(F.col("r_sqft"), true_rate).alias("rate_per_sqft"))


def unit_findings(listings: DataFrame, **options) -> DataFrame:
    """listing_id, field_name, unit_name: each field of ``listings`` whose number is not in the common unit."""
    n = normalise_listing_units(listings, **options)
    found = F.array(
        F.struct(F.lit("covered_area_sqft").alias("field_name"), F.col("area_unit").alias("unit_name")),
        F.struct(F.lit("price_per_sqft").alias("field_name"), F.col("rate_unit").alias("unit_name")),
        F.struct(F.lit("description").alias("field_name"), F.col("text_unit").alias("unit_name")),
    )
    return n.select("listing_id", F.inline(found)).where("unit_name <> 'sqft'")
