"""Declared schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: str) -> T.StructType:
    names = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampNTZType(), "a": T.DateType()}
    return T.StructType([T.StructField(k, names[v]) for k, v in kinds.items()])


LISTING = _struct(
    listing_id="l", id="d", property_id="s", event_type="s", property_type="s", city="s", locality="s", address_full="s", description="s", amenities="s", covered_area_value="d", covered_area_unit="s",
    covered_area_sqft="d", price_raw="s", price="d", price_per_sqft="d", bhk="d", bathrooms="d", balconies="d", floors="s", age_of_property="s", furnishing_type="s", facing_direction="s", possession_status="s",
    latitude="d", longitude="d", corner_property="d", gated_plot="d", road_width="s", project_society_name="s", developer_id="s", agent_type="s", posting_date="t", scrape_date="t", ingested_at="t",
)
MARKET = _struct(
    property_id="s", source="s", property_type_raw="s", segment="s", city="s", locality="s", canonical_locality="s", event_type="s", is_active_event="i", is_new_event="i", is_updated_event="i", price="d", area_sqft="d",
    price_per_sqft="d", possession_status="s", is_ready="i", is_under_construction="i", posting_date="t", scrape_date="t", agent_type="s", developer_id="s", days_on_market="d", ingested_at="t",
)
FORECAST = _struct(property_id="s", locality="s", trend_locality="s", date="a", quarter="i", decay_t="i", P_i="d", L_i="d", rho_0="d", rho_t="d", I_lt="d", forecast_price_per_sqft="d", forecast_price_numeric="d")
RATE = _struct(city="s", locality="s", property_type="s", rate="d", seq="l")
RENAMES = {"developer_uuid": "developer_id", "user_type": "agent_type"}
