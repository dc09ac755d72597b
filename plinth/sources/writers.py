"""Writers: partitioned tables, splits by kind, databases, reports and a model registry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources.readers import exists, listed, quoted


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, atomically replaced. Rows are sorted inside files, so that readers skip row groups; a partition's rows are spread over tasks by AQE."""
    if partition_by:
        df = df.repartition(*partition_by) if not sort_by else df.repartitionByRange(*partition_by, *sort_by)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_by_kind(df: DataFrame, path: str, kind: str, floors: dict[str, float], ppsf: str = "price_per_sqft", drop: dict[str, list[str]] | None = None) -> None:
    """One folder for each kind in ``floors``, rows under the kind's price floor left out, its columns in ``drop`` nulled."""
    keep = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col(kind)), F.lit(None).cast("double"))
    x = df.where(keep.isNotNull() & (F.col(ppsf) >= keep))
    gone: dict[str, list[str]] = {}
    for k, cs in (drop or {}).items():
        for c in cs:
            gone.setdefault(c, []).append(k)
    x = x.withColumns({c: F.when(~F.col(kind).isin(*ks), F.col(c)) for c, ks in gone.items() if c in x.columns})
    x.write.mode("overwrite").partitionBy(kind).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_database(df: DataFrame, url: str, table: str, *, batch: int = 10_000, dry_run: bool = False, **properties: str) -> dict[str, str]:
    """Replace a database table; returns the column types it gets. ``dry_run`` only returns them."""
    kinds = {"boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "string": "TEXT"}
    types = {c: kinds.get(t, "DOUBLE PRECISION") for c, t in df.dtypes}
    if not dry_run:
        df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", quoted(table)).option("batchsize", batch).option("createTableColumnTypes", ", ".join(f"{quoted(c)} {t}" for c, t in types.items())).options(**properties).save()
    return types


def write_report(df: DataFrame, path: str, **fields: str) -> None:
    """A report as JSON lines, sorted by all columns, NULLs left out."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns], *[F.lit(v).alias(k) for k, v in fields.items()])).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def register_model(spark: SparkSession, registry: str, name: str, metrics: dict[str, float], path: str) -> int:
    """Add a version of a model to the registry (a folder of JSON lines) and return its number."""
    rows = spark.read.schema("name string, version int, path string, metrics string").json(registry).where(F.col("name") == name) if exists(spark, registry) and listed(spark, f"{registry}/*.json") else None
    last = (rows.agg(F.max("version")).first()[0] or 0) if rows is not None else 0
    row = [(name, last + 1, path, json.dumps(metrics, sort_keys=True))]
    spark.createDataFrame(row, "name string, version int, path string, metrics string").write.mode("append").json(registry)
    return last + 1


def load_model(spark: SparkSession, registry: str, name: str):
    """The latest version of a model, ready to score; None if the registry has none."""
    from pyspark.ml import PipelineModel

    path = promoted(spark, registry, name)
    return PipelineModel.load(path) if path else None


def promoted(spark: SparkSession, registry: str, name: str) -> str | None:
    """The path of a model's latest version."""
    if not exists(spark, registry):
        return None
    r = spark.read.schema("name string, version int, path string, metrics string").json(registry).where(F.col("name") == name).orderBy(F.col("version").desc()).limit(1).collect()
    return r[0]["path"] if r else None
