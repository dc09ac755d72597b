"""Price series and forecasts: gaps, lags, year-over-year walks, blends, roll-forward, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.session import cut


def quarterly_median(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """keys..., quarter (its first day), value: the exact median in each quarter; NULL, NaN and values of 0 or less do not count."""
    v = F.when(~F.isnan(value) & (F.col(value) > 0), F.col(value))
    return df.where(v.isNotNull()).groupBy(*keys, F.date_trunc("quarter", date).cast("date").alias("quarter")).agg(F.median(v).alias("value"))


def filled_quarters(series: DataFrame, keys: list[str]) -> DataFrame:
    """Every quarter between a key's first and last; values between known ones on a straight line, marked ``filled``."""
    span = series.groupBy(*keys).agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"))
    spine = span.select(*keys, F.explode(F.expr("sequence(a, b, interval 3 months)")).alias("quarter"))
    x = spine.join(series, [*keys, "quarter"], "left")
    w = W.partitionBy(*keys).orderBy("quarter")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("i", F.row_number().over(w))
    known = F.when(F.col("value").isNotNull(), F.struct("i", "value"))
    x = x.withColumns({"p": F.last(known, ignorenulls=True).over(back), "n": F.first(known, ignorenulls=True).over(ahead)})
    line = F.col("p.value") + (F.col("n.value") - F.col("p.value")) * F.try_divide(F.col("i") - F.col("p.i"), F.nullif(F.col("n.i") - F.col("p.i"), F.lit(0)))
    return x.select(*keys, "quarter", F.coalesce("value", line).alias("value"), F.col("value").isNull().alias("filled"))


def series_features(series: DataFrame, keys: list[str]) -> DataFrame:
    """Lags, growth, momentum, rolling mean and deviation over four quarters, year-over-year, and a time index."""
    w = W.partitionBy(*keys).orderBy("quarter")
    four = w.rowsBetween(-3, 0)
    v = F.col("value")
    lag = lambda n: F.lag("value", n).over(w)
    return series.withColumns({
        "lag1": lag(1), "lag2": lag(2), "growth": F.try_divide(v, lag(1)) - 1, "yoy": F.try_divide(v, lag(4)) - 1, "momentum": v - lag(2),
        "mean4": F.avg("value").over(four), "sd4": F.stddev_samp("value").over(four), "t": F.row_number().over(w),
    })


def volatility(series: DataFrame, keys: list[str], population: bool = False) -> DataFrame:
    """keys..., volatility: the standard deviation of quarter-on-quarter change in percent; ``population`` divides by n."""
    change = (F.try_divide(F.col("value"), F.lag("value").over(W.partitionBy(*keys).orderBy("quarter"))) - 1) * 100
    x = series.withColumn("change", change)
    return x.groupBy(*keys).agg((F.stddev_pop if population else F.stddev_samp)("change").alias("volatility"))


def exponential_smoothing(series: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """keys..., smoothed: the level after the last value, folded in order of the quarters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("quarter", "value"))), lambda s: s["value"])
    fold = F.aggregate(F.slice("o", F.lit(2), F.greatest(F.size("o") - 1, F.lit(0))), F.col("o")[0], lambda a, x: F.lit(alpha) * x + F.lit(1 - alpha) * a)
    return series.groupBy(*keys).agg(ordered.alias("o")).select(*keys, fold.alias("smoothed"))


def yoy_chain(series: DataFrame, keys: list[str], as_of: Column, years: int) -> DataFrame:
    """keys..., year_no, value, yoy_pct: from the first value on or after ``as_of``, then on or after each anniversary, up to the first year that has none."""
    x = series.crossJoin(F.broadcast(series.sparkSession.range(0, years + 1).select(F.col("id").cast("int").alias("year_no")))).where(F.col("quarter") >= F.add_months(as_of.cast("date"), F.col("year_no") * 12))
    at = x.groupBy(*keys, "year_no").agg(F.min_by("value", "quarter").alias("value"))
    w = W.partitionBy(*keys).orderBy("year_no")
    at = at.withColumns({"before": F.lag("value").over(w), "seq": F.row_number().over(w) - 1}).where(F.col("seq") == F.col("year_no"))
    return at.where("year_no > 0").select(*keys, "year_no", "value", (F.try_divide(F.col("value"), F.col("before")) * 100 - 100).alias("yoy_pct"))


def rho(confidence: Column, uniqueness: Column, model: Column, t: Column) -> Column:
    """The locality's weight after ``t`` quarters: 0.25 + 0.30 C + 0.20 U - 0.25 M within 0.10 to 0.70, times 0.90^t."""
    zero = F.least(F.greatest(F.lit(0.25) + 0.30 * confidence + 0.20 * uniqueness - 0.25 * model, F.lit(0.10)), F.lit(0.70))
    return zero * F.pow(F.lit(0.90), t)


def blend_linear(p: Column, level: Column, weight: Column, index: Column) -> Column:
    return (weight * level + (1 - weight) * p) * index


def blend_geometric(p: Column, level: Column, weight: Column, index: Column) -> Column:
    """P x I x (L / P)^rho, with both prices at least 1e-9."""
    a, b = F.greatest(p, F.lit(1e-9)), F.greatest(level, F.lit(1e-9))
    return a * index * F.pow(b / a, weight)


def validation_error(forecast: DataFrame) -> DataFrame:
    """mean_linear, max_linear, mean_geometric, max_geometric: the stored forecast against both formulas. ``forecast``: p, level, rho, idx, stored."""
    args = [F.col(c) for c in ("p", "level", "rho", "idx")]
    a, b = F.abs(blend_linear(*args) - F.col("stored")), F.abs(blend_geometric(*args) - F.col("stored"))
    return forecast.agg(F.avg(a).alias("mean_linear"), F.max(a).alias("max_linear"), F.avg(b).alias("mean_geometric"), F.max(b).alias("max_geometric"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., median, mean, least, most, p25, p75 of the values that are there."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    x = df.groupBy(*keys).agg(q.alias("q"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most")).where("q is not null")
    return x.select(*keys, F.col("q")[1].alias("median"), "mean", "least", "most", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def global_index(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``i``, each row's place from 1 on in ``order``, which should be unique. Rows are range-partitioned and numbered inside their partition;
    the partitions' offsets come from their counts, so no task sees all rows. Runs jobs."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))  # the numbers must not change between the two uses
    n = x.groupBy("__p").agg(F.count("*").alias("__n"))
    before = n.withColumn("__before", F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).select("__p", "__before")  # a row for each partition
    return x.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order))).join(F.broadcast(before), "__p").withColumn("i", F.col("__before") + F.col("__r")).drop("__p", "__r", "__before")


def nearest_by_value(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, other, gap, place: for each row the ``k`` others nearest in value. The neighbours of a row stand within ``k`` places of it in order, so a
    distributed index and an equi-join on places find them without comparing all pairs; ``df`` is one row for each key. NULL values are left out."""
    x = global_index(df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v")), ["v", "k"])
    y = x.select(F.col("k").alias("other"), F.col("v").alias("w"), F.col("i").alias("j"))
    near = x.withColumn("j", F.explode(F.sequence(F.col("i") - k, F.col("i") + k))).where("j <> i").join(y, "j").withColumn("gap", F.abs(F.col("v") - F.col("w")))
    top = F.slice(F.array_sort(F.collect_list(F.struct("gap", "other"))), 1, k)  # at most 2k entries
    return near.groupBy("k").agg(top.alias("top")).select(F.col("k").alias(key), F.posexplode("top").alias("place", "t")).select(key, "t.other", "t.gap", (F.col("place") + 1).alias("place"))


def roll_forward(series: DataFrame, keys: list[str], quarters: int, weight: float = 0.6) -> DataFrame:
    """keys..., step, value: each quarter's growth is ``weight`` times the last plus the rest times the mean growth; each step feeds the next.

    A key's history, which the calendar bounds, is one ordered array; the steps are a fold over it in column expressions. A key without two
    values does not grow.
    """
    x = series.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("quarter", "value"))), lambda s: s["value"].cast("double")).alias("v"))
    later = F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0)))
    growth = F.filter(F.zip_with(later, F.slice("v", F.lit(1), F.greatest(F.size("v") - 1, F.lit(0))), lambda b, a: F.try_divide(b, a) - 1), lambda g: g.isNotNull())
    x = x.withColumn("growth", growth).withColumns({"mean": F.coalesce(F.try_divide(F.aggregate("growth", F.lit(0.0), lambda s, g: s + g), F.size("growth")), F.lit(0.0)), "now": F.coalesce(F.try_element_at("growth", F.lit(-1)), F.lit(0.0))})
    start = F.struct(F.col("now").alias("g"), F.element_at("v", -1).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        g = F.lit(weight) * s["g"] + F.lit(1 - weight) * F.col("mean")
        last = s["last"] * (1 + g)
        return F.struct(g.alias("g"), last.alias("last"), F.concat(s["out"], F.array(last)).alias("out"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(quarters)), start, step, lambda s: s["out"])
    return x.select(*keys, F.posexplode(steps).alias("at", "value")).select(*keys, (F.col("at") + 1).alias("step"), "value")


def scenario_sweep(base: DataFrame, key: str, features: dict[str, list[float]], score) -> DataFrame:
    """key, feature, setting, score, delta: every setting of one feature at a time against the row as it is. ``score``: columns -> Column."""
    names = list(features)
    cases = base.sparkSession.createDataFrame([(f, float(v)) for f, vs in features.items() for v in vs], "feature string, setting double")  # as many rows as settings
    x = base.crossJoin(F.broadcast(cases))
    changed = {c: F.when(F.col("feature") == c, F.col("setting")).otherwise(F.col(c).cast("double")) for c in names}
    was, now = score({c: F.col(c).cast("double") for c in names}), score(changed)
    return x.select(key, "feature", "setting", now.alias("score"), (now - was).alias("delta"))


def cash_flow(price: Column, exit_price: Column, years: int, buy_pct: float, hold_pct: float, exit_pct: float, rent_pct: float) -> Column:
    """struct(invested, profit, roi_pct, cagr_pct) of holding for ``years``; percents are of the buying price, the exit cost of the exit price."""
    invested = price * (1 + buy_pct / 100)
    profit = exit_price * (1 - exit_pct / 100) + price * (rent_pct - hold_pct) / 100 * years - invested
    payoff = F.try_divide(invested + profit, invested)
    return F.struct(invested.alias("invested"), profit.alias("profit"), (F.try_divide(profit, invested) * 100).alias("roi_pct"), ((F.pow(payoff, F.lit(1.0 / years)) - 1) * 100).alias("cagr_pct"))




def zone_features(series: DataFrame, keys: list[str], zone: list[str]) -> DataFrame:
    """``series`` with log_lag1, growth_lag1, to_city and city_rank: the logarithm and growth of the quarter before, and a place's value against its zone's mean and in its order that quarter."""
    w, z = W.partitionBy(*keys).orderBy("quarter"), W.partitionBy(*zone, "quarter")
    lag = lambda n: F.lag("value", n).over(w)
    return series.withColumns({"log_lag1": F.log(lag(1)), "growth_lag1": F.try_divide(lag(1), lag(2)) - 1, "to_city": F.try_divide(F.col("value"), F.avg("value").over(z)), "city_rank": F.rank().over(z.orderBy(F.desc("value")))})
