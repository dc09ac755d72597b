"""The market panel: metrics per segment, city, locality and snapshot date, and indices over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions.scalar import clamp, ladder, present, share

KEYS = ["segment", "city", "canonical_locality"]
# What a market is called from a score on, and below all of them.
LABELS = [(75.0, "Hot demand-led market"), (60.0, "Positive market"), (45.0, "Balanced market"), (30.0, "Supply-heavy market")]
LOWEST = "Weak / stale market"


def _num(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _usable(market: DataFrame) -> DataFrame:
    return market.where(present(F.col("city")).isNotNull() & present(F.col("canonical_locality")).isNotNull() & F.col("scrape_date").isNotNull() & F.col("property_id").isNotNull())


def first_seen(market: DataFrame) -> DataFrame:
    """segment, property_id, first_seen over all events, active or not."""
    return market.groupBy("segment", "property_id").agg(F.min("scrape_date").alias("first_seen"))


def days_on_market(market: DataFrame) -> DataFrame:
    """Active rows with ``dom``: the recorded days, else those since the property was first seen, at least 0."""
    seen = first_seen(market)
    x = _usable(market).where("is_active_event = 1").join(seen, ["segment", "property_id"], "left")
    since = F.greatest(F.timestamp_diff("DAY", F.col("first_seen"), F.col("scrape_date")), F.lit(0)).cast("double")
    return x.withColumn("dom", F.greatest(F.coalesce(_num("days_on_market"), since), F.lit(0.0))).drop("first_seen")


def base_metrics(active: DataFrame) -> DataFrame:
    """Counts, shares and exact percentiles per key and date. Shares are of distinct properties, so those that count rows may exceed 1."""
    ppsf, price = F.when(_num("price_per_sqft") > 0, F.col("price_per_sqft")), F.when(_num("price") > 0, F.col("price"))
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    x = active.groupBy(*KEYS, "scrape_date").agg(
        F.count_distinct("property_id").alias("active_supply"), flag("is_new_event").alias("new_count"), flag("is_updated_event").alias("updated_count"),
        flag("is_ready").alias("ready_count"), flag("is_under_construction").alias("uc_count"), F.count_if(F.col("dom") > 90).alias("stale_count"),
        F.coalesce(F.median("dom"), F.lit(0.0)).alias("median_dom"), F.coalesce(F.median(price), F.lit(0.0)).alias("median_price"),
        F.coalesce(F.percentile(ppsf, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("q"),
        F.count_distinct(F.nullif("agent_type", F.lit("nan"))).alias("agent_count"), F.count_distinct(F.nullif("developer_id", F.lit("nan"))).alias("developer_count"),
    )
    s = lambda c: F.round(share(F.col(c), F.col("active_supply")), 4)
    return x.select(
        *KEYS, "scrape_date", "active_supply", "new_count", s("new_count").alias("new_velocity"), "updated_count", F.round("median_dom", 1).alias("median_dom"), "stale_count", s("stale_count").alias("stale_share"),
        F.round("median_price", 0).alias("median_price"), F.round(F.col("q")[1], 0).alias("median_ppsf"), F.round(F.col("q")[0], 0).alias("p25_ppsf"), F.round(F.col("q")[2], 0).alias("p75_ppsf"),
        s("ready_count").alias("ready_share"), s("uc_count").alias("uc_share"), "agent_count", "developer_count",
    )


def absorption(active: DataFrame) -> DataFrame:
    """KEYS, scrape_date, absorbed_count, absorption_computable: properties gone at the segment's next date, where the locality has rows then.

    The next date comes from the small table of distinct dates. When a property is next seen, and when its locality is, are the rows after
    theirs in order, so no table is joined to itself.
    """
    dates = active.select("segment", "scrape_date").distinct().withColumn("next_date", F.lead("scrape_date").over(W.partitionBy("segment").orderBy("scrape_date")))
    here = active.select(*KEYS, "property_id", "scrape_date").distinct()
    seen = here.withColumn("again", F.lead("scrape_date").over(W.partitionBy(*KEYS, "property_id").orderBy("scrape_date"))).join(F.broadcast(dates), ["segment", "scrape_date"])  # a row for each date of a handful of segments
    x = seen.groupBy(*KEYS, "scrape_date", "next_date").agg(F.count_if(F.coalesce(F.col("again") != F.col("next_date"), F.lit(True))).alias("gone"))
    visited = F.coalesce(F.lead("scrape_date").over(W.partitionBy(*KEYS).orderBy("scrape_date")) == F.col("next_date"), F.lit(False))
    x = x.withColumn("absorption_computable", visited)
    return x.select(*KEYS, "scrape_date", F.when(F.col("absorption_computable"), F.col("gone")).otherwise(F.lit(0)).alias("absorbed_count"), "absorption_computable")


def price_revisions(active: DataFrame) -> DataFrame:
    """KEYS, scrape_date, cut_count, hike_count, cut_median_pct, hike_median_pct of updated rows against the property's last row before that date.

    Rows of one property and date are told apart by price (the largest is its last); a last row without a price gives no comparison.
    """
    per = active.groupBy(*KEYS, "property_id", "scrape_date").agg(F.max(F.struct(F.col("ingested_at"), _num("price").alias("price"))).alias("last"))
    w = W.partitionBy(*KEYS, "property_id").orderBy("scrape_date")
    prior = per.withColumn("prior", F.lag("last.price").over(w)).select(*KEYS, "property_id", "scrape_date", "prior")
    now = active.where("is_updated_event = 1").select(*KEYS, "property_id", "scrape_date", _num("price").alias("price")).join(prior, [*KEYS, "property_id", "scrape_date"])
    pct = F.when((F.col("prior") > 0) & F.col("price").isNotNull(), (F.col("price") - F.col("prior")) / F.col("prior") * 100)
    x = now.withColumn("pct", pct).groupBy(*KEYS, "scrape_date").agg(
        F.count_if(F.col("pct") < 0).alias("cut_count"), F.count_if(F.col("pct") > 0).alias("hike_count"),
        F.round(F.coalesce(F.median(F.when(F.col("pct") < 0, F.col("pct"))), F.lit(0.0)), 2).alias("cut_median_pct"), F.round(F.coalesce(F.median(F.when(F.col("pct") > 0, F.col("pct"))), F.lit(0.0)), 2).alias("hike_median_pct"),
    )
    return x


def market_panel(market: DataFrame) -> DataFrame:
    """One row for each key and snapshot date with all metrics, one plan for all segments.

    The active rows with their days on the market are written once, in the columns that the steps read, so that no step scans the market or
    looks for first dates again. Runs a job.
    """
    from plinth.session import written

    read = [*KEYS, "scrape_date", "property_id", "ingested_at", "price", "price_per_sqft", "is_new_event", "is_updated_event", "is_ready", "is_under_construction", "agent_type", "developer_id", "dom"]
    active = written(days_on_market(market).select(*read), "active")
    x = base_metrics(active).join(absorption(active), [*KEYS, "scrape_date"], "left").join(price_revisions(active), [*KEYS, "scrape_date"], "left")
    zero = ["cut_count", "hike_count", "absorbed_count"]
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.lit(0.0)) for c in ("cut_median_pct", "hike_median_pct")} | {"absorption_computable": F.coalesce("absorption_computable", F.lit(False))})
    return x.withColumns({
        "absorption_rate": F.round(share(F.col("absorbed_count"), F.col("active_supply")), 4), "cut_frequency": F.round(share(F.col("cut_count"), F.col("updated_count")), 4), "hike_frequency": F.round(share(F.col("hike_count"), F.col("updated_count")), 4),
    })


def average_rank_pct(c: str, by: list[str], ascending: bool = True) -> Column:
    """Percentile rank with ties at their average, 0 to 100; not ``ascending`` gives 100 minus it."""
    w, ties = W.partitionBy(*by).orderBy(c), W.partitionBy(*by, c)
    r = (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(W.partitionBy(*by)) * 100
    return r if ascending else 100 - r


def market_indices(panel: DataFrame, rates: DataFrame | None = None, *, rolling_digits: int = 1) -> DataFrame:
    """The panel with supply, liquidity, momentum, premium, demand and heat indices, ``heat_rolling4`` and ``market_label``.

    Percentiles pool all dates of a city within its segment. ``rates``: city, canonical_locality, rate; without a rate the premium is against
    the city's median price. Each intermediate index stays unrounded until it is shown.
    """
    by = ["segment", "city"]
    x = panel if rates is None else panel.join(rates.select("city", "canonical_locality", "rate"), ["city", "canonical_locality"], "left")
    x = x if rates is not None else x.withColumn("rate", F.lit(None).cast("double"))
    names = {"s_active": ("active_supply", True), "s_velocity": ("new_velocity", True), "s_stale": ("stale_share", True), "s_uc": ("uc_share", True), "s_absorb": ("absorption_rate", True), "s_fast": ("median_dom", False)}
    x = x.withColumns({k: average_rank_pct(c, by, up) for k, (c, up) in names.items()})
    supply = clamp(0.40 * F.col("s_active") + 0.25 * F.col("s_velocity") + 0.20 * F.col("s_stale") + 0.15 * F.col("s_uc"), 0.0, 100.0)
    liquidity = clamp(0.50 * F.col("s_absorb") + 0.30 * F.col("s_fast") + 0.20 * (100 - F.col("s_stale")), 0.0, 100.0)
    momentum = F.when(F.col("updated_count") > 0, clamp(50.0 + 40.0 * F.col("hike_frequency") - 40.0 * F.col("cut_frequency"), 0.0, 100.0)).otherwise(50.0)
    city_median = F.median("median_ppsf").over(W.partitionBy(*by))
    base = F.coalesce(F.when(F.col("rate") > 0, F.col("rate")), F.when(city_median > 0, city_median), F.lit(1.0))
    x = x.withColumns({"supply": supply, "liquidity": liquidity, "momentum": momentum, "base": base})
    x = x.withColumn("premium", clamp(50.0 + 50.0 * (F.col("median_ppsf") / F.col("base") - 1.0), 0.0, 100.0))
    x = x.withColumn("demand", clamp(0.35 * F.col("s_absorb") + 0.25 * F.col("liquidity") + 0.20 * F.col("momentum") + 0.20 * F.col("premium"), 0.0, 100.0))
    x = x.withColumn("heat", F.round(clamp(50.0 + 0.5 * F.col("demand") - 0.5 * F.col("supply"), 0.0, 100.0), 1))
    x = x.withColumn("market_label", ladder(F.col("heat"), LABELS, LOWEST))
    roll = F.round(F.avg("heat").over(W.partitionBy(*KEYS).orderBy("scrape_date").rowsBetween(-3, 0)), rolling_digits)
    shown = {c: F.round(c, 1) for c in ("supply", "liquidity", "momentum", "premium", "demand")}
    return x.withColumn("heat_rolling4", roll).withColumns(shown).drop(*names, "base")


def latest_per_locality(panel: DataFrame) -> DataFrame:
    """The last row of each key, by a reduction before the shuffle and not a sort."""
    rest = [c for c in panel.columns if c not in KEYS]
    return panel.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "scrape_date").alias("r")).select(*KEYS, "r.*")


def segment_summary(panel: DataFrame) -> DataFrame:
    """segment, localities, dates, supply, median_ppsf over the latest row of each locality."""
    last = latest_per_locality(panel).groupBy("segment").agg(F.count("*").alias("localities"), F.sum("active_supply").alias("supply"), F.round(F.median("median_ppsf"), 2).alias("median_ppsf"))
    return last.join(panel.groupBy("segment").agg(F.count_distinct("scrape_date").alias("dates")), "segment")


def market_context(panel: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (segment, city, locality) the latest metrics and the heat series; a request without data gets neutral values and a reason."""
    series = panel.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("scrape_date", "heat"))).alias("series"), F.max_by(F.struct("active_supply", "median_ppsf", "heat", "market_label"), "scrape_date").alias("last"))
    x = requests.join(series, (requests.segment == series.segment) & (requests.city == series.city) & (requests.locality == series.canonical_locality), "left").select(requests.segment, requests.city, requests.locality, "series", "last")
    why = F.when(F.col("last").isNull(), "no data for this locality")
    return x.select("segment", "city", "locality", F.coalesce("last.heat", F.lit(50.0)).alias("heat"), F.coalesce("last.market_label", F.lit("Balanced market")).alias("market_label"), F.col("last.active_supply").alias("active_supply"), F.coalesce(F.size("series"), F.lit(0)).alias("points"), why.alias("reason"))


def signals(panel: DataFrame) -> DataFrame:
    """KEYS, scrape_date, signal, score: wide rows as one row for each signal, and their order by strength (``strength_rank``)."""
    from plinth.functions.scalar import two_sided_score

    sig = F.array(*[F.struct(F.lit(n).alias("signal"), two_sided_score(F.col(c), g, b).alias("score")) for n, c, g, b in (("supply", "stale_share", 0.1, 0.5), ("absorption", "absorption_rate", 0.3, 0.05), ("cuts", "cut_frequency", 0.1, 0.5), ("hikes", "hike_frequency", 0.4, 0.05), ("speed", "median_dom", 30.0, 120.0))])
    ordered = F.array_sort(F.transform(sig, lambda s, i: F.struct((-F.abs(s["score"])).alias("k"), i.alias("i"), s["signal"].alias("signal"), s["score"].alias("score"))))
    x = panel.select(*KEYS, "scrape_date", F.posexplode(ordered).alias("pos", "s"))
    return x.select(*KEYS, "scrape_date", "s.signal", "s.score", (F.col("pos") + 1).alias("strength_rank"))
