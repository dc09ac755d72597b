"""Keys that rows of different sources are joined and grouped by: cities, segments, rate classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import scalar

# The city a name is shown under in market tables, keyed in lower case.
MARKET_CITIES = {
    "new delhi": "Delhi", "delhi": "Delhi", "gurugram": "Gurgaon", "gurgaon": "Gurgaon", "noida": "Noida", "greater noida": "Greater Noida",
    "greater noida west": "Greater Noida", "gr noida": "Greater Noida", "ghaziabad": "Ghaziabad", "faridabad": "Faridabad", "jaipur": "Jaipur",
}
# Cities whose names are one in forecast keys.
FORECAST_CITIES = {
    "new_delhi": "delhi", "north_delhi": "delhi", "south_delhi": "delhi", "east_delhi": "delhi", "west_delhi": "delhi", "central_delhi": "delhi", "ncr_delhi": "delhi", "dwarka": "delhi",
    "greater_noida": "noida", "greaternoida": "noida", "greater_noida_west": "noida", "gurugram": "gurgaon",
}
# Localities that sources put into another city than theirs.
CITY_OVERRIDES = {"Noida Extension": "Greater Noida", "Greater Noida West": "Greater Noida"}
# The market segment of a grouped type, and of a type as typed.
SEGMENT_OF_GROUP = {"apartment": "apt", "builder_floor": "builder_floor", "plot": "plot", "res_house": "house_villa", "villa": "house_villa"}
SEGMENT_OF_TYPE = {
    "apartment": "apt", "studio apartment": "apt", "penthouse": "apt", "builder floor": "builder_floor", "independent floor": "builder_floor", "builder floor apartment": "builder_floor",
    "plot": "plot", "residential plot": "plot", "land": "plot", "residential land": "plot", "independent house": "house_villa", "residential house": "house_villa", "villa": "house_villa",
}


def market_city(c: Column) -> Column:
    """The name a city is shown under: a known one's standard name, else the text in title case; blank gives NULL."""
    return F.coalesce(scalar.mapped(scalar.collapsed(c), MARKET_CITIES), F.nullif(scalar.title_case(F.trim(c)), F.lit("")))


def rate_city(c: Column) -> Column:
    """The lower-case key of a city in rate tables; an unknown city keeps its own."""
    k = scalar.collapsed(c)
    return F.coalesce(F.lower(scalar.mapped(k, MARKET_CITIES)), k)


def forecast_city(c: Column) -> Column:
    """A city as a key of forecasts: words joined by underscores, names of one city brought together."""
    k = F.regexp_replace(F.regexp_replace(scalar.collapsed(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(scalar.mapped(k, FORECAST_CITIES), k)


def rate_cities(c: Column) -> Column:
    """array of the rate keys under which a city's rates are looked up, best first."""
    k = rate_city(c)
    return F.when(k == "greater noida", F.array(F.lit("greater noida"), F.lit("noida"))).otherwise(F.array(k))


def donor_city(c: Column, names: dict[str, str]) -> Column:
    """The key by which donors are grouped: the city a text resolves to, else the text itself in lower case, '' for NULL."""
    return F.coalesce(scalar.resolved_city(c, names), scalar.collapsed(c), F.lit(""))


def gazetteer_city(df: DataFrame, column: str, gazetteer: DataFrame, aliases: dict[str, str], out: str = "city_key") -> DataFrame:
    """``df`` with ``out``: the gazetteer's city key that an alias, else the text's own key, stands for if the gazetteer has it, else the text's own key.

    ``gazetteer``: city_key. The distinct keys are one column, joined once; NULL stays NULL.
    """
    own = scalar.slug(F.col(column))
    known = gazetteer.select(F.col("city_key").alias("__k")).where("__k is not null").distinct()
    x = df.withColumn("__a", F.coalesce(scalar.mapped(scalar.collapsed(F.col(column)), aliases), own))
    return x.join(known, F.col("__a") == F.col("__k"), "left").withColumn(out, F.coalesce("__k", own)).drop("__a", "__k")


def segment(grouped: Column, typed: Column) -> Column:
    """The market segment by the grouped type where there is one, else by the type as typed; NULL if neither is known."""
    g = F.when(F.trim(grouped).isin("", "nan", "None"), None).otherwise(grouped)
    return F.when(g.isNotNull(), scalar.mapped(g, SEGMENT_OF_GROUP)).otherwise(scalar.mapped(scalar.collapsed(typed), SEGMENT_OF_TYPE))


def overridden_city(city: Column, locality: Column, overrides: dict[str, str] = CITY_OVERRIDES) -> Column:
    """The city of a locality that sources misplace, else ``city``."""
    return F.coalesce(scalar.mapped(scalar.title_case(F.trim(locality)), overrides), city)


def rate_class(c: Column) -> Column:
    """Residential, Commercial, Institutional, Agricultural or Other by what a type contains, in this order; other text in title case, blank NULL."""
    k = scalar.collapsed(c)
    named = {"res": "Residential", "com": "Commercial", "inst": "Institutional", "agri": "Agricultural", "other": "Other"}
    return F.coalesce(*[F.when(k.contains(p), F.lit(v)) for p, v in named.items()], F.nullif(scalar.title_case(F.trim(c)), F.lit("")))


def price_per_area(price: Column, area: Column, stated: Column) -> Column:
    """Price over area where that is positive, else the stated rate."""
    x = F.when(area > 0, price / area)
    return F.coalesce(F.when((x > 0) & ~F.isnan(x), x), stated)


def days_listed(posted: Column, scraped: Column) -> Column:
    """Whole days of 24 hours between posting and scrape, at least 0; unknown if both fall on one calendar day, 0 if the posting date is missing."""
    days = F.greatest(F.timestamp_diff("DAY", F.coalesce(posted, scraped), scraped), F.lit(0)).cast("double")
    return F.when(posted.isNull() | (F.to_date(posted) != F.to_date(scraped)), days)


def market_rows(listings: DataFrame) -> DataFrame:
    """Listings as rows of the market table: segment, city, locality, canonical_locality, event flags, price_per_sqft, days_on_market.

    ``listings``: listing_id, property_type, city, locality, event_type, price, area_sqft, price_per_sqft, posting_date, scrape_date.
    """
    name = F.trim(F.coalesce("locality", F.lit("")))
    event = F.lower(F.trim("event_type"))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return listings.select(
        "listing_id", segment(F.lit(None).cast("string"), F.col("property_type")).alias("segment"), overridden_city(market_city(F.col("city")), name).alias("city"), name.alias("locality"), scalar.title_case(name).alias("canonical_locality"),
        event.alias("event_type"), flag(event.isin("new", "unchanged", "updated")).alias("is_active_event"), flag(event == "new").alias("is_new_event"), flag(event == "updated").alias("is_updated_event"),
        price_per_area(F.col("price"), F.col("area_sqft"), F.col("price_per_sqft")).alias("price_per_sqft"), days_listed(F.col("posting_date"), F.col("scrape_date")).alias("days_on_market"),
    )
