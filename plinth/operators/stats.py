"""Errors, distributions, pivots and correlations as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """n, mae, mape, rmse, median_ae, r2 of finite pairs; mape over truths that are not zero."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    x = df.select(y.alias("y"), p.alias("p")).where(~F.isnan("y") & ~F.isnan("p"))
    e = F.col("y") - F.col("p")
    return x.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_ae"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0)))).alias("r2"),
    )


def error_coverage(df: DataFrame, error: str, limits: list[float]) -> DataFrame:
    """limit, n, share: how many errors are within each limit, and their share of all."""
    counts = [F.count_if(F.abs(F.col(error)) <= x).alias(f"c{i}") for i, x in enumerate(limits)]
    one = df.agg(F.count(error).alias("total"), *counts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.col(f"c{i}").alias("n"), F.try_divide(F.col(f"c{i}"), F.col("total")).alias("share")) for i, x in enumerate(limits)])))


def quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """q, value: exact interpolated quantiles."""
    v = F.when(~F.isnan(value), F.col(value))
    one = df.agg(F.percentile(v, F.array(*[F.lit(x) for x in at])).alias("v"))
    return one.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*[F.lit(x) for x in at]), F.col("i")).alias("q"), "value")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: counts of equal bins from ``low`` to ``high``; 0 and ``bins`` + 1 hold what lies outside."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """The mean of ``value`` per row and fixed column; empty cells are 0. The columns are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value)).na.fill(0.0, columns)


def correlations(df: DataFrame, target: str, columns: list[str], top: int) -> DataFrame:
    """column_name, r: the ``top`` columns by absolute Pearson correlation with the target, one pass over the rows."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    x = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in columns])))
    return x.where("r is not null").orderBy(F.abs("r").desc(), "column_name").limit(top)  # a top-k report


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def mode_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value, the smallest among equals."""
    return df.groupBy(*keys).agg(F.mode(column, True).alias("mode"))


def mean_encoding(df: DataFrame, key: str, target: str) -> DataFrame:
    """key, mean, default_value: each key's mean of the target, and the median of all as the default for unseen keys."""
    t = F.when(~F.isnan(target), F.col(target))
    return df.groupBy(key).agg(F.avg(t).alias("mean")).crossJoin(F.broadcast(df.agg(F.median(t).alias("default_value"))))  # one row on the right


def quartile_tiers(df: DataFrame, key: str, value: str, names: tuple[str, str, str, str] = ("budget", "mid", "premium", "luxury"), upto: bool = False) -> DataFrame:
    """key, median, tier: keys in four tiers by the quartiles of their medians; fewer than four keys have no tier. A median on a quartile belongs to the upper tier, with ``upto`` to the lower one."""
    med = df.groupBy(key).agg(F.median(value).alias("median")).where("median is not null")
    cut = med.agg(F.percentile("median", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    m = F.col("median")
    tier = F.when(m >= F.col("q")[2], names[3]).when(m >= F.col("q")[1], names[2]).when(m >= F.col("q")[0], names[1]).otherwise(names[0])
    if upto:
        tier = F.when(m <= F.col("q")[0], names[0]).when(m <= F.col("q")[1], names[1]).when(m <= F.col("q")[2], names[2]).otherwise(names[3])
    return med.crossJoin(F.broadcast(cut)).select(key, "median", F.when(F.col("n") >= 4, tier).alias("tier"))  # one row on the right


def with_tier(df: DataFrame, tiers: DataFrame, key: str, unseen: str = "budget") -> DataFrame:
    """``df`` with ``tier`` of its key; a key that ``tiers`` (as ``quartile_tiers`` gives it) does not have is ``unseen``."""
    t = tiers.select(F.col(key).alias("__k"), F.col("tier").alias("__t"), F.lit(True).alias("__seen"))
    return df.join(t, F.col(key) == F.col("__k"), "left").withColumn("tier", F.when(F.col("__seen"), F.col("__t")).otherwise(F.lit(unseen))).drop("__k", "__t", "__seen")


def quantile_bands(df: DataFrame, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """``df`` with ``band``: low up to the lower quantile, high from the upper one on, medium between."""
    cut = df.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__q"))
    v: Column = F.col(value)
    return df.crossJoin(F.broadcast(cut)).withColumn("band", F.when(v <= F.col("__q")[0], "low").when(v >= F.col("__q")[1], "high").when(v.isNotNull(), "medium")).drop("__q")  # one row on the right


def error_percentiles(df: DataFrame, error: str, at: list[float]) -> DataFrame:
    """q, limit_value, n: the error at each share of all rows, and how many rows lie within it."""
    v = F.abs(F.col(error))
    limits = df.agg(F.percentile(v, F.array(*[F.lit(q) for q in at])).alias("l"))
    x = df.select(v.alias("e")).crossJoin(F.broadcast(limits))  # one row on the right
    one = x.agg(F.first("l").alias("l"), *[F.count_if(F.col("e") <= F.col("l")[i]).alias(f"n{i}") for i in range(len(at))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col("l")[i].alias("limit_value"), F.col(f"n{i}").alias("n")) for i, q in enumerate(at)])))
