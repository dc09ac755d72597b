"""Percentiles per group from mergeable value counts, by cumulative frequencies in SQL windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import written

#: Rows of one input partition whose codes go into one array of the daily store.
CHUNK_BITS = 16
#: Mantissa bits kept of a value. Values are counted under the middle of their bucket, at most 2^-(BITS+1) of the value away.
BITS = 7


def value_code(v: Column, bits: int = BITS) -> Column:
    """The bucket of a finite number as one integer that orders as the number does: its exponent and the first ``bits`` of its mantissa.

    Scaling by a power of two is exact, so the bucket is the same on every engine. Zero, and what is nearer to zero than 2^-200, is 0; NULL and NaN give NULL.
    """
    a = F.abs(v)
    # powers of two from 0 to 62 are shifts, which cost far less than a power and are as exact
    power = lambda e: F.when(e.between(0, 62), F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int")).cast("double")).otherwise(F.pow(F.lit(2.0), e))
    e = F.floor(F.log2(a))
    m = a / power(e)
    e = F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e)
    code = (e + 201) * F.lit(1 << bits) + F.floor((a / power(e) - 1) * F.lit(float(1 << bits)))
    return F.when(v.isNull() | F.isnan(v), None).when(a < 2.0**-200, F.lit(0)).otherwise(F.signum(v) * code).cast("int")


def code_value(c: Column, bits: int = BITS) -> Column:
    """The middle of the bucket that ``value_code`` gave."""
    k = F.abs(c)
    e = F.floor(k / F.lit(1 << bits)) - 201
    m = 1 + (k % F.lit(1 << bits) + 0.5) / F.lit(float(1 << bits))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * m * F.pow(F.lit(2.0), e))


def _finite(v: Column) -> Column:
    """Infinities as the largest doubles; NULL and NaN as they are."""
    return F.when(F.isnan(v), None).when(v > 1.7e308, F.lit(1.7e308)).when(v < -1.7e308, F.lit(-1.7e308)).otherwise(v)


def group_id(groups: list[str]) -> Column:
    """A hash of a group's values and of which of them are NULL."""
    return F.xxhash64(*groups, *[F.col(g).isNull() for g in groups])


def daily_counts(df: DataFrame, groups: list[str], day: str, metrics: list[str], bits: int = BITS) -> DataFrame:
    """gid, groups..., day, c0, c1, ...: for each group and day the bucket codes of each metric's values, as sorted arrays.

    An array says how often each bucket occurs, in four bytes a value before compression, so a day costs one row for each group instead of one
    for each bucket. Rows of separate days, partitions or files add up, so they are kept and merged: a group and day has one row for each 65,536
    rows of an input partition at most (``CHUNK_BITS``), which bounds every array, however many rows the group has. NULL and NaN do not
    count; infinities count under the outermost codes of a double. NULL group values are groups of their own. ``gid`` is the 64-bit hash
    of the group by which ``percentiles`` tells groups apart.
    """
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)  # of consecutive rows of one partition
    x = df.select(group_id(groups).alias("gid"), F.to_date(day).alias("day"), chunk.alias("chunk"), *groups, *[value_code(_finite(F.col(m).cast("double")), bits).alias(f"v{i}") for i, m in enumerate(metrics)])
    kept = x.groupBy("gid", "day", "chunk", *groups).agg(*[F.sort_array(F.collect_list(f"v{i}")).alias(f"c{i}") for i in range(len(metrics))])
    return kept.drop("chunk")


def percentiles(daily: DataFrame, groups: list[str], ranks: list[float], *, partitions: int | None = None, bits: int = BITS) -> DataFrame:
    """groups..., metric, n, one column ``pNN`` for each rank: values of ``daily`` (as ``daily_counts`` has them) at the target ranks.

    The codes of the days given are reduced to counts of each group, metric and bucket, partly before the shuffle; these are range-sorted by
    group and bucket, and summed in three steps: a running sum
    inside each range partition, each partition's total per group as an offset for the ones after it, and the first
    bucket whose sum reaches rank ``ceil(q * n)``. A group that spans partitions is never gathered into one task. Ranks are
    exact; a value is within 2^-(bits+1) of the true one, relatively. Empty input gives an empty result. Runs jobs.
    """
    spark = daily.sparkSession
    kinds = sorted((c for c in daily.columns if c[:1] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    codes = None
    for i, c in enumerate(kinds):  # metric and code in one number that orders as they do
        one = daily.select("gid", F.explode(c).alias("code")).select("gid", (F.col("code") + F.lit((i << 24) + (1 << 23))).alias("mc"))
        codes = one if codes is None else codes.unionByName(one)
    merged = codes.groupBy("gid", "mc").agg(F.count("*").alias("n"))
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = merged.repartitionByRange(width, "gid", "mc").select("gid", F.shiftright("mc", 24).alias("metric"), ((F.col("mc").bitwiseAND((1 << 24) - 1)) - (1 << 23)).alias("code"), "n", F.spark_partition_id().alias("part"))
    ranged = written(ranged, "ranged-counts")  # the partition numbers must not change between the two uses below
    totals = ranged.groupBy("gid", "metric", "part").agg(F.sum("n").alias("total"))
    totals.createOrReplaceTempView("__plinth_totals")
    ranged.createOrReplaceTempView("__plinth_ranged")
    offsets = spark.sql("""
        SELECT gid, metric, part, coalesce(sum(total) OVER (PARTITION BY gid, metric ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(total) OVER (PARTITION BY gid, metric) AS n_all FROM __plinth_totals""")
    running = spark.sql("SELECT *, sum(n) OVER (PARTITION BY part, gid, metric ORDER BY code ROWS UNBOUNDED PRECEDING) AS inside FROM __plinth_ranged")
    x = running.join(offsets, ["part", "gid", "metric"]).select("gid", "metric", "code", "n_all", (F.col("before") + F.col("inside")).alias("upto"), F.col("n").alias("own"))
    target = lambda q: F.ceil(F.lit(q) * F.col("n_all"))
    hit = lambda q: (F.col("upto") >= target(q)) & (F.col("upto") - F.col("own") < target(q))
    pick = [F.max(F.when(hit(q), F.col("code"))).alias(_name(q)) for q in ranks]
    out = x.groupBy("gid", "metric").agg(F.max("n_all").alias("n"), *pick)
    named = daily.select("gid", *groups).distinct()
    return out.join(named, "gid").select(*groups, "metric", "n", *[code_value(F.col(_name(q)), bits).alias(_name(q)) for q in ranks])


def _name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def market_percentiles(market: DataFrame, *, first: str | None = None, last: str | None = None, bits: int = BITS) -> DataFrame:
    """segment, city, canonical_locality, metric, n, p25, p50, p75, p95, p99, error_bound for price_per_sqft, price and days_on_market.

    The per-date counts are written first and read back for the dates between ``first`` and ``last``, as a store of daily
    results would be. ``error_bound`` is the largest relative distance of a value from the true one. Runs jobs.
    """
    metrics, groups = ["price_per_sqft", "price", "days_on_market"], ["segment", "city", "canonical_locality"]
    kept = written(daily_counts(market, groups, "scrape_date", metrics, bits), "daily-counts")
    if first is not None:
        kept = kept.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept.where(F.col("day") <= F.lit(last).cast("date"))
    out = percentiles(kept, groups, [0.25, 0.5, 0.75, 0.95, 0.99], bits=bits)
    name = F.get(F.array(*[F.lit(m) for m in metrics]), F.col("metric").cast("int"))
    return out.withColumn("metric", name).withColumn("error_bound", F.lit(2.0 ** -(bits + 1)))
