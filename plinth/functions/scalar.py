"""Scalar column expressions: cleaning, coercion, mapping, banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value in text columns.
MISSING_WORDS = ("", "nan", "none", "null", "no info", "n/a", "na", "-")


def collapsed(c: Column) -> Column:
    """Lower case, one space between words, none around."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def present(c: Column) -> Column:
    """Text that is not a word for missing; NULL otherwise."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING_WORDS), c)


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter, as Python's ``str.title`` for ASCII (``initcap`` leaves 'south-west' half done)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), F.initcap), "")


def slug(c: Column) -> Column:
    """Lower-case words and numbers parted by single underscores: 'Sector 77A' -> 'sector_77_a'."""
    t = F.regexp_replace(F.lower(c), r"([a-z])(\d)", "$1_$2")
    t = F.regexp_replace(t, r"(\d)([a-z])", "$1_$2")
    t = F.regexp_replace(t, r"[^a-z0-9]+", "_")
    return F.regexp_replace(t, r"^_+|_+$", "")


def number(c: Column) -> Column:
    """A finite double, or NULL for text that is no number, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive(c: Column) -> Column:
    x = number(c)
    return F.when(x > 0, x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero or either is NULL."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def share(a: Column, b: Column) -> Column:
    """``a / b``, 0.0 where it is undefined."""
    return F.coalesce(ratio(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """``c`` within limits; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def capped(c: Column, most: float) -> Column:
    """``c`` if it is at most ``most``, else NULL."""
    return F.when(c <= most, c)


def at_least(c: Column, least: float) -> Column:
    return F.when(c >= least, c)


def mapped(c: Column, values: dict[str, object], default: Column | None = None) -> Column:
    """``values[c]``; unmatched values give ``default``, NULL if that is not given."""
    hit = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c] if values else F.lit(None).cast("string")
    return hit if default is None else F.coalesce(hit, default)


def first_present(*cs: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def any_flag(*cs: Column) -> Column:
    """1 if any flag is set; unknown flags count as 0."""
    return F.greatest(*[F.coalesce(c.cast("int"), F.lit(0)) for c in cs])


def one_hot(c: Column, values: list[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each of a fixed list of values, all 0 for others and NULL."""
    return {f"{prefix}{v}": F.coalesce((c == v).cast("int"), F.lit(0)) for v in values}


def bands(c: Column, edges: list[float], names: list[str]) -> dict[str, Column]:
    """0/1 columns of the intervals between ``edges``: below the first, ..., above the last; the upper edge of each middle one belongs to it. NULL is in none."""
    out = {}
    for i, name in enumerate(names):
        inside = F.lit(True)
        if i:
            inside = inside & (c >= edges[0] if i == 1 else c > edges[i - 1])
        if i < len(edges):
            inside = inside & (c < edges[0] if i == 0 else c <= edges[i])
        out[name] = F.coalesce(inside.cast("int"), F.lit(0))
    return out


def ladder(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose threshold ``c`` reaches."""
    out = F.lit(otherwise)
    for least, value in reversed(steps):
        out = F.when(c >= least, F.lit(value)).otherwise(out)
    return out


def two_sided_score(c: Column, good: float, bad: float) -> Column:
    """-2..2: 2 at or beyond ``good``, -2 at or beyond ``bad``, 1 and -1 in the outer thirds between, 0 in the middle; NULL counts 0. Either limit may be the larger."""
    t = (c - F.lit(good)) / F.lit(bad - good)
    score = F.when(t <= 0, 2).when(t < 1 / 3, 1).when(t <= 2 / 3, 0).when(t < 1, -1).when(t >= 1, -2)
    return F.coalesce(score, F.lit(0))


def mentions(c: Column, keywords: list[str]) -> Column:
    """1 if the text contains any keyword, whatever its case; NULL text gives 0."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(t, k)).cast("int")


def rounded_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours from ``start`` to ``end``, not calendar days."""
    return F.timestamp_diff("DAY", start, end)


def arabic_suffix(c: Column) -> Column:
    """A trailing Roman numeral up to five as a number: 'phase ii' -> 'phase 2'."""
    tail = F.regexp_extract(c, r"(?i)(?:^|\s)(i{1,3}|iv|v)\s*$", 1)
    value = mapped(F.lower(tail), {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"})
    return F.when(value.isNull(), c).otherwise(F.concat(F.regexp_replace(c, r"(?i)(i{1,3}|iv|v)\s*$", ""), value))


def locality_form(c: Column) -> Column:
    """Localities in one form: sector written out, single spaces around separators, trailing Roman numerals as numbers."""
    t = collapsed(c)
    t = F.regexp_replace(t, r"\bsec(?:tor|t)?[\s.\-]*(?:no\.?\s*)?(\d+)[\s\-]?([a-z]\b)?", "sector $1$2")
    t = F.regexp_replace(t, r"\s*([/,-])\s*", " $1 ")
    return F.trim(F.regexp_replace(arabic_suffix(t), r"\s+", " "))


def sector_of(c: Column) -> Column:
    """'Sector 10A' from text that names a sector; NULL otherwise."""
    p = r"(?i)\bsec(?:tor|t)?[\s.\-]*(?:no\.?\s*)?(\d{1,3})[\s\-]?([a-z]\b)?"
    n = F.regexp_extract(c, p, 1)
    return F.when(n != "", F.concat(F.lit("Sector "), n, F.upper(F.regexp_extract(c, p, 2))))


def resolved_city(c: Column, aliases: dict[str, str]) -> Column:
    """The city a text names: itself, itself without punctuation, or the longest alias that stands in it as a word; NULL if none.

    ``aliases``: alias in lower case -> city.
    """
    t = collapsed(c)
    plain = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    inside = [F.when(F.concat(F.lit(" "), plain, F.lit(" ")).contains(f" {a} "), F.lit(v)) for a, v in sorted(aliases.items(), key=lambda x: (-len(x[0]), x[0]))]
    return F.coalesce(mapped(t, aliases), mapped(plain, aliases), *inside)


def age_band(c: Column) -> Column:
    """Age of a property in five bands, from the usual wordings; other text as it is."""
    t = collapsed(c)
    low = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    return (
        F.when(t.isNull() | t.isin(*MISSING_WORDS), None)
        .when(t.rlike(r"^(new|0[ -]|under|less than 1)"), F.lit("New"))
        .when(low < 5, F.lit("Under 5 years")).when(low < 10, F.lit("5 to 10 years")).when(low < 20, F.lit("10 to 20 years")).when(low >= 20, F.lit("Over 20 years"))
        .otherwise(F.trim(c))
    )


FURNISHING = {"furnished": "Furnished", "fully furnished": "Furnished", "semi-furnished": "Semi-Furnished", "semi furnished": "Semi-Furnished", "unfurnished": "Unfurnished"}
KINDS = {
    "apartment": "apartment", "studio apartment": "apartment", "penthouse": "apartment", "builder floor": "builder_floor", "independent floor": "builder_floor",
    "residential plot": "plot", "plot": "plot", "independent house": "house_villa", "residential house": "house_villa", "villa": "house_villa",
}


def furnishing(c: Column) -> Column:
    return mapped(collapsed(c), FURNISHING)


def kind_group(c: Column) -> Column:
    """Property kinds in four groups; an unknown kind as a name with underscores."""
    return mapped(collapsed(c), KINDS, F.regexp_replace(collapsed(c), " ", "_"))


def possession(c: Column, as_of: Column) -> Column:
    """'ready', 'under_construction' or NULL, from words, a full date ('29th Jan, 2026') or a month ("Nov '30").

    A date up to six months after ``as_of`` counts as ready.
    """
    t = collapsed(c)
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)(\d)(st|nd|rd|th)", "$1"), ",", "")
    day = F.coalesce(F.try_to_date(plain, "d MMM yyyy"), F.try_to_date(plain, "d MMMM yyyy"))
    month = F.try_to_date(F.concat(F.lit("1 "), F.regexp_replace(F.trim(c), r"\s*'(\d\d)$", " 20$1")), "d MMM yyyy")
    when = F.coalesce(day, month)
    by_date = F.when(when <= F.add_months(as_of.cast("date"), 6), F.lit("ready")).when(when.isNotNull(), F.lit("under_construction"))
    return F.when(t.rlike("ready|immediate"), F.lit("ready")).when(t.rlike("under construction|launch"), F.lit("under_construction")).otherwise(by_date)
