"""Bringing listing sources together: renames, alignment, coercion, filters and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions import extract, scalar


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the columns renamed that it has; names it does not have are no error. A name that is taken is replaced by the renamed column."""
    have = {a: b for a, b in names.items() if a in df.columns}
    return df.drop(*[b for a, b in have.items() if b in df.columns and b not in have and a != b]).withColumnsRenamed(have)


def ensure_columns(df: DataFrame, schema: T.StructType, only: bool = False) -> DataFrame:
    """``df`` with each column of ``schema`` in its type, missing ones NULL; with ``only``, these columns and no others, in the schema's order."""
    typed = [(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    rest = [] if only else [F.col(c) for c in df.columns if c not in schema.names]
    return df.select(*typed, *rest)


def union_sources(sources: dict[str, DataFrame], label: str | None = "source") -> DataFrame:
    """All rows of the sources by column name, columns in the order first seen, missing ones NULL; ``label`` names the source of each row."""
    named = [df.withColumn(label, F.lit(k)) if label else df for k, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as finite doubles; text that is no number, NaN and infinities become NULL. Columns ``df`` lacks are ignored."""
    return df.withColumns({c: scalar.number(F.col(c)) for c in columns if c in df.columns})


def coercion_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rows, missing, lost: how many values of each column were missing, and how many coercion would null. One pass."""
    have = [c for c in columns if c in df.columns]
    sums = [F.count("*").alias("rows")]
    for c in have:
        sums += [F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_if(F.col(c).isNotNull() & scalar.number(F.col(c)).isNull()).alias(f"l_{c}")]
    one = df.agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"m_{c}").alias("missing"), F.col(f"l_{c}").alias("lost")) for c in have])))


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end in a unique column; NULL keys are one key. Salting is not needed: a key's rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    named = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    best = F.min_by(F.struct(*rest), F.struct(*named)) if rest else F.first(F.lit(1))
    out = df.groupBy(*keys).agg(best.alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def excluded(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column``, in lower case and single spaces, is not among ``values`` (one column). Rows with NULL stay."""
    v = values.select(scalar.collapsed(values[values.columns[0]]).alias("__v")).distinct()
    return df.join(v, scalar.collapsed(df[column]) == F.col("__v"), "left_anti")


def scoped_or_all(df: DataFrame, scope: Column) -> DataFrame:
    """The rows in ``scope``, or all rows if none is in it. Whether any is is found by one small aggregate and not by a window over all rows."""
    any_ = df.agg(F.max(F.coalesce(scope, F.lit(False)).cast("int")).alias("__any"))
    return df.crossJoin(F.broadcast(any_)).where(F.coalesce(scope, F.lit(False)) | (F.coalesce("__any", F.lit(0)) == 0)).drop("__any")  # one row on the right


def filled_from_text(df: DataFrame, text_first: bool = True) -> DataFrame:
    """bhk, bathrooms, balconies and price completed from description and amenities. ``text_first``: what the text says wins over the column."""
    t = extract.combined(F.col("description"), F.col("amenities"))
    said = {"bhk": extract.bedrooms(t), "bathrooms": extract.bathrooms(t), "balconies": extract.balconies(t), "price": extract.price(t)}
    pick = lambda c, x: F.coalesce(x, scalar.number(F.col(c))) if text_first else F.coalesce(scalar.number(F.col(c)), x)
    limits = {"bhk": 12, "bathrooms": 12, "balconies": 12}
    return df.withColumns({c: scalar.capped(pick(c, x), limits[c]) if c in limits else pick(c, x) for c, x in said.items()})


def clean_listings(df: DataFrame, as_of: Column) -> DataFrame:
    """Listings with standard categories, flags from the text, floor levels, road width and possession, in one projection."""
    t = extract.combined(F.col("description"), F.col("amenities"))
    level = extract.floor_level(F.col("floors"))
    return filled_from_text(df.where(F.col("price").isNotNull())).withColumns({
        "kind": scalar.kind_group(F.col("property_type")), "furnishing": F.coalesce(scalar.furnishing(F.col("furnishing_type")), extract.furnishing(t)),
        "facing": extract.facing(F.concat(F.coalesce("facing_direction", F.lit("")), F.lit(" facing"))), "age": scalar.age_band(F.col("age_of_property")),
        "possession": scalar.possession(F.col("possession_status"), as_of), "floor": level["current"], "floors_total": level["total"],
        "road_width_m": extract.road_width_m(F.col("road_width")), **extract.flags(t),
    })
