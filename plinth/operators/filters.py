"""Row filters of the training tables: plausible ranges, ratios, text and outliers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inclusive bounds of plausible rows, by the table they are for; None leaves a side open.
LIMITS: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "sale": {"bhk": (1, 6), "area": (350, 5000), "price_per_sqft": (2000, 40000), "floors": (None, 50)},
    "apartment rent": {"rent": (2000, 500000), "area": (300, 5000), "bhk": (1, 6)},
    "floor rent": {"rent": (2000, 400000), "area": (300, 8000), "bhk": (1, 8)},
    "plot": {"area": (300, 100000), "price_per_sqft": (1000, 350000)},
}


def usable(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which none of ``columns`` is NULL or NaN."""
    return df.dropna(subset=list(columns))


def of_kinds(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(*kinds))


def within(limits: Mapping[str, tuple[float | None, float | None]], columns: Mapping[str, str] | None = None) -> Column:
    """Whether every limited column lies in its bounds; NULL and NaN do not. ``columns`` maps limit names to column names."""
    ok = F.lit(True)
    for name, (lo, hi) in limits.items():
        c = F.col((columns or {}).get(name, name)).cast("double")
        ok = ok & usable(c)
        ok = ok & (c >= lo) if lo is not None else ok
        ok = ok & (c <= hi) if hi is not None else ok
    return F.coalesce(ok, F.lit(False))


def plausible_ratio(value: Column, rate: Column, low: float = 0.3, high: float = 25.0) -> Column:
    """Whether both are positive and their ratio lies strictly between the limits."""
    return F.coalesce((value > 0) & (rate > 0) & usable(value) & usable(rate) & (F.try_divide(value, rate) > low) & (F.try_divide(value, rate) < high), F.lit(False))


def contains_text(c: Column, text: str) -> Column:
    """Whether ``text`` stands in a column in any case, as plain text; blank text holds everywhere."""
    return F.lit(True) if not text.strip() else F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))


def without_outliers(df: DataFrame, scores: DataFrame, key: str, score: str, contamination: float = 0.02) -> DataFrame:
    """The rows whose outlier score is not among the top ``contamination`` of all scores. One percentile over the scores, one join; unscored rows stay."""
    limit = scores.agg(F.percentile(score, F.lit(1.0 - contamination)).alias("__limit"))
    bad = scores.crossJoin(F.broadcast(limit)).where(F.col(score) > F.col("__limit")).select(key)  # one row on the right
    return df.join(bad, key, "left_anti")
