"""Fields of plots of land read out of their descriptions, and what lies around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.extract import found, token_set

_DIRECTION = r"((?:north|south)[\s-]+(?:east|west)|north|south|east|west)"
_METRE = r"(?:m|mtr|meter|metre)s?"
# Numbers of floors written as words.
_WORDS = ["one", "two", "three", "four", "five", "six"]
# What stands before or after the number of floors that may be built, most telling first.
_FLOORS = [
    (r"maximum floor allowed for construction on this plot is\s+", ""), (r"allows the buyer to build\s+", ""), (r"permitted to construct\s+", r"\s+for construction floors"), (r"permits up to\s+", r"\s+floors"), (r"construction of up to\s+", r"\s+floors"),
    (r"potential with\s+", r"\s+floors allowed"), ("", r"\s+floors allowed for the plot"), ("", r"\s+for construction floors"), (r"construct\s+", r"\s+(?:of\s+)?floors"), (r"up to\s+", r"\s+floors"),
]


def _said(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern).cast("int"), F.lit(0))


def _direction(c: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(F.trim(c), r"[\s-]+", " ")), " ", "-")


def plot_fields(c: Column) -> Column:
    """struct of a plot's description: area_value, area_unit, price, kind, facing, corner, rectangular, road_width_m, gated, backlane, floors_allowed, park_facing, tenure, status, rera.

    Flags are 0 or 1; what the text does not say is NULL, and NULL text gives a NULL struct. Ladders take the first form that occurs: areas as
    'N square yards plot', then 'N Sq-yrd Residential Plot'; prices as 'Sale Price N', 'at a price of Rs N Cr', then 'for N Lac';
    directions as 'The plot is X facing', 'X Sale Price', 'X facing', then beside the tenure.
    """
    number = r"(\d+\.?\d*)"
    spelled = number + r"\s+(?:square\s+(meters?|yards?|feet?)|square_(meter|yard|feet))\s+plot"
    kinds = r"(residential plot|commercial land|agricultural land|industrial land)"
    coded = number + r"\s+(sq-ft|sq-yrd|sq-m|acre)\s+(?:residential plot|commercial land|agricultural land|industrial land)"
    acres = number + r"\s+acre\s+(?:residential|commercial|agricultural|industrial)"
    n = lambda p, g=1: found(c, "(?i)" + p, g).try_cast("double")
    word = F.lower(F.coalesce(found(c, "(?i)" + spelled, 2), found(c, "(?i)" + spelled, 3)))
    unit = F.coalesce(
        F.when(n(spelled).isNotNull(), F.when(word.startswith("meter"), "Sq-m").when(word.startswith("yard"), "Sq-yrd").otherwise("Sq-ft")),
        found(c, "(?i)" + coded, 2), F.when(n(acres).isNotNull(), F.lit("Acre")),
    )
    scale = lambda u: F.when(F.lower(u).startswith("c"), 1e7).when(F.lower(u).startswith("l"), 1e5).otherwise(1.0)
    at, lately = r"available at a price of rs\s+" + number + r"\s*(crore|cr|lakh|lac|l)?", r"for\s+" + number + r"\s*(crore|cr|lac|lakh|l)"
    price = F.coalesce(found(c, r"\bSale Price\s+(\d+)").try_cast("double"), n(at) * scale(F.regexp_extract(c, "(?i)" + at, 2)), n(lately) * scale(F.regexp_extract(c, "(?i)" + lately, 2)))
    facing = F.coalesce(*[
        _direction(found(c, "(?i)" + p))
        for p in (r"the plot is\s+" + _DIRECTION + r"\s+facing", r"\b((?:north|south) - (?:east|west)|north|south|east|west|central)\s+sale price", r"\b" + _DIRECTION + r"[\s-]+facing\b", r"\b((?:north|south) - (?:east|west)|north|south|east|west)\s+(?:facing\s+)?(?:freehold|leasehold|resale|new property)")
    ])
    road = F.coalesce(n(r"width of the facing road is\s+" + number + r"\s*mt"), n(r"road of\s+" + number + r"\s*" + _METRE), n(number + r"[\s-]?\s*" + _METRE + r"(?:\s*(?:wide\s+)?|[-\s]?)road"))
    words = F.create_map(*[F.lit(x) for i, w in enumerate(_WORDS) for x in (w, i + 1)])
    floors = F.coalesce(*[found(c, "(?i)" + a + r"(\d+)" + b).try_cast("int") for a, b in _FLOORS], words[F.lower(found(c, r"(?i)up to\s+(" + "|".join(_WORDS) + r")\s+floors"))])
    status = F.lower(found(c, r"(?i)\b(new property|resale)\b"))
    fields = {
        "area_value": F.coalesce(n(spelled), n(coded), n(acres)), "area_unit": unit, "price": price, "kind": F.initcap(found(c, r"(?i)\b" + kinds + r"\b")), "facing": facing,
        "corner": _said(c, r"\bcorner\b"), "rectangular": _said(c, r"\brectangular\b"), "road_width_m": road, "gated": _said(c, r"\bgated\b|gated\s+(?:community|locality|enclave|society|plot|area|complex|development)"), "backlane": _said(c, r"back[\s-]?lane"),
        "floors_allowed": floors, "park_facing": _said(c, r"park\s*facing|facing\s+(?:a\s+)?park|park\s+view|garden/park|overlooks.*?(?:park|garden)"),
        "tenure": F.initcap(found(c, r"(?i)\b(freehold|leasehold)\b")), "status": F.when(status.startswith("new"), "New").when(status.isNotNull(), "Resale"), "rera": _said(c, r"\brera\b"),
    }
    return F.when(c.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def plain_direction(c: Column) -> Column:
    """A direction without 'the' before it, 'facing' after it and dashes, in title case."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^the\s+", ""), r"(?i)\s*facing$", "")
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*[-–]\s*", " "), r"\s+", " ")))


# What lies at or near a plot, by what its description says, in the order of the list that comes out.
SURROUNDINGS = {
    "park": r"(?:near|facing|overlook|adjacent|close to|proximity to|access to)\s+\w*\s*park\b|\bpark\s*facing\b|garden.*?park|\b(?:open|expansive|large)\s+park\b|\bbright.*?park\b",
    "school": r"\b(?:school|vidyalaya|educational institution)\b",
    "hospital": r"\b(?:hospital|clinic|nursing home|(?:medical|diagnostic) cent(?:re|er))\b",
    "market": r"\b(?:market|shopping (?:mall|cent(?:re|er)))\b",
    "metro": r"\b(?:metro\s+(?:station|connectivity|line)|(?:near|upcoming)\s+metro)\b",
    "airport": r"\bairport\b",
    "highway": r"\b(?:highway|expressway|outer ring road|peripheral|nh[-\s]?\d+)\b",
    "water_supply": r"\b(?:water (?:supply|connection)|24.hour water|water\s+availability)\b",
    "electricity": r"\b(?:electricity\s+(?:connection|available)|power (?:supply|connection))\b",
    "security": r"\b(?:security|cctv|guard|surveillance)\b",
    "gymnasium": r"\b(?:gymnasium|fitness cent(?:re|er))\b|\bgym\s+facilit",
    "swimming_pool": r"\bswimming pool\b",
    "club_house": r"\b(?:club\s*house|community (?:hall|cent(?:re|er)))\b",
    "boundary_wall": r"\bboundary wall\b",
    "sewerage": r"\b(?:sewerage|drainage|sewer)\b",
    "college": r"\b(?:college|university)\b",
    "bank_atm": r"\b(?:atm|bank branch|near.*?bank)\b",
    "restaurant": r"\b(?:restaurant|cafeteria)\b",
    "temple": r"\b(?:temple|mandir|masjid|church)\b",
    "vastu": r"\bvastu\b",
    "street_light": r"\bstreet light(?:ing)?\b",
    "wide_road": r"\b(?:wide\s+(?:clean\s+)?roads?|paved road)\b",
}


def surroundings(c: Column, landmarks: int = 5) -> Column:
    """array of a plot's first named landmarks (3 to 59 characters each) and the ``SURROUNDINGS`` its description mentions, each once; NULL where there are none."""
    named = found(c, r"(?i)most popular landmarks near this plot are\s+(.+?)(?:\s{2,}|Residential Plot|Property in|$)")
    parts = F.transform(F.split(F.regexp_replace(F.trim(named), r"\.+$", ""), ","), lambda x: F.trim(x))
    first = F.slice(F.filter(parts, lambda x: F.length(x).between(3, 59)), 1, landmarks)
    rules = F.filter(F.array(*[F.when(F.lower(c).rlike(p), F.lit(k)) for k, p in SURROUNDINGS.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    extra = F.filter(rules, lambda r: ~F.array_contains(F.coalesce(first, none), r))
    out = F.concat(F.coalesce(first, none), F.coalesce(extra, none))
    return F.when(F.size(out) > 0, out)


# The amenity keywords that listed tokens stand for.
AMENITY_KEYWORDS = {
    "boundary_wall": ["boundary wall"], "park": ["garden/park", "park"], "garden": ["garden/park", "garden"], "playground": ["children's play area", "children play area"], "gated_community": ["gated community"],
    "water_supply": ["24x7 water supply", "24x7water supply", "ro water system"], "gymnasium": ["gymnasium", "gym"], "security": ["24x7 security", "security guards", "security guard", "security", "24x7 cctv surveillance", "cctv"],
    "power_backup": ["power backup"], "club_house": ["club house", "clubhouse"], "swimming_pool": ["swimming pool"], "parking": ["car parking", "parking"], "atm_bank": ["atm"], "restaurant": ["restaurant"],
    "jogging_track": ["jogging track", "jogging and strolling track", "cycling & jogging track", "cycling track", "cycling and jogging track"], "vastu_compliant": ["vastu compliant"], "wide_road": ["main road", "internal roads & footpaths", "internal road"],
    "sports_court": ["outdoor tennis courts", "tennis court", "badminton court"], "community_hall": ["community hall", "banquet hall"], "landscaping": ["landscaping & tree planting", "landscaping"], "street_lighting": ["street lighting"],
    "rainwater_harvesting": ["rain water harvesting"], "sewage_treatment": ["sewage treatment plant"], "storm_drains": ["storm water drains"], "intercom": ["intercom facility"], "fire_fighting": ["fire fighting system"],
    "yoga_meditation": ["yoga / meditation area", "yoga/meditation area"], "maintenance": ["maintenance staff"],
}


def amenity_keywords(c: Column) -> Column:
    """The keywords of a delimited amenity list, sorted, each once; text after a colon is dropped, tokens without a keyword are left out, NULL gives an empty array."""
    table: dict[str, list[str]] = {}
    for keyword, tokens in AMENITY_KEYWORDS.items():
        for t in tokens:
            table.setdefault(t, []).append(keyword)
    known = F.create_map(*[x for t, ks in table.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
    none = F.array().cast("array<string>")
    tokens = F.transform(F.coalesce(token_set(c), none), lambda t: known[F.lower(F.trim(F.split_part(t, F.lit(":"), F.lit(1))))])
    return F.array_sort(F.array_distinct(F.flatten(F.filter(tokens, lambda t: t.isNotNull()))))
