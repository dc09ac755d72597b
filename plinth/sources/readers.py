"""Readers: listings, rate files of every shape, road geometry, stations, series and databases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.scalar import number, positive


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes, under a declared schema; only ``columns`` are parsed."""
    header = spark.read.option("header", True).csv(paths).columns  # no rows are read
    have = {f.name: f for f in schema}
    as_is = T.StructType([have.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(as_is).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(paths)
    return df.select(*[c for c in (columns or df.columns) if c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    got = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in got) if got else []


def preferred(spark: SparkSession, path: str, suffix: str = "_new") -> str:
    """``name_new.ext`` if it exists, else ``name.ext``."""
    newer = re.sub(r"(\.[^./]+)$", suffix + r"\1", path)
    return newer if newer != path and exists(spark, newer) else path


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """The ``v<number>`` folder with the largest number; v10 comes after v9."""
    found = [(int(m[1]), p) for p in listed(spark, f"{folder}/v*") if (m := re.search(r"/v(\d+)/?$", p))]
    return max(found)[1] if found else None


def read_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **properties: str) -> DataFrame:
    """A database table; with ``key`` and ``bounds`` it is read in parallel ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", quoted(table)).options(**properties)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def quoted(name: str) -> str:
    """An identifier in double quotes, part by part."""
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


def connection(options: dict[str, str | None]) -> dict[str, str]:
    """Database options under their usual aliases; a missing one is an error that names it."""
    alias = {"host": ("host", "db_host", "pghost"), "port": ("port", "db_port", "pgport"), "database": ("database", "dbname", "db_name", "pgdatabase"), "user": ("user", "username", "db_user", "pguser"), "password": ("password", "db_password", "pgpassword")}
    low = {k.lower(): v for k, v in options.items() if v}
    out = {k: next((low[a] for a in names if a in low), "5432" if k == "port" else "") for k, names in alias.items()}
    if gone := [k for k, v in out.items() if not v]:
        raise ValueError("missing database options: " + ", ".join(gone))
    return out


def city_of_path(path: Column) -> Column:
    """The city in a rate file's name: 'Greater-Noida_CircleRate (1).json' -> 'greater noida'."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), r"%20", " ")
    name = F.regexp_replace(F.lower(name), r"[\s_\-]*(circle[\s_\-]*rates?|rates?|circle|final|new|\(\d+\)|v\d+)", "")
    return F.trim(F.regexp_replace(name, r"[_\-\s]+", " "))


def _texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """city, seq_file, value: whole JSON files with the city in their names and their load order."""
    df = spark.read.option("wholetext", True).text(paths).withColumn("path", F.input_file_name())
    return df.select(city_of_path(F.col("path")).alias("city"), F.col("path"), "value")


def _rate(c: Column) -> Column:
    """A number, or the largest of a list of numbers, as text."""
    many = F.array_max(F.from_json(c, "array<double>"))
    return positive(F.coalesce(number(c), many).cast("string"))


def rates_flat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """city, locality, property_type, rate of {locality: number or [numbers]}, the largest of a list. Values are parsed one by one, so one list does not cost the others."""
    x = _texts(spark, paths).select("city", F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "locality", "v"))
    return x.select("city", "locality", F.lit(None).cast("string").alias("property_type"), _rate(F.col("v")).alias("rate"), "pos").where("rate is not null")


def rates_nested(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of {city: {locality: number}}, and of {locality: number} beside it, whose city is in the file's name; keys that begin with an underscore, and nulls, are skipped."""
    x = _texts(spark, paths).select(F.col("city").alias("file_city"), F.posexplode(F.from_json("value", "map<string,string>")).alias("outer", "name", "v")).where("not startswith(name, '_')")
    inner = F.when(F.startswith(F.ltrim("v"), F.lit("{")), F.from_json("v", "map<string,string>")).otherwise(F.create_map("name", "v"))
    city = F.when(F.startswith(F.ltrim("v"), F.lit("{")), F.lower("name")).otherwise(F.col("file_city"))
    x = x.select(city.alias("city"), "outer", F.posexplode(inner).alias("at", "locality", "v")).where("not startswith(locality, '_')")
    return x.select("city", "locality", F.lit(None).cast("string").alias("property_type"), _rate(F.col("v")).alias("rate"), (F.col("outer").cast("long") * (1 << 20) + F.col("at")).alias("pos")).where("rate is not null")


def rates_records(spark: SparkSession, paths: str | list[str], rate_keys: tuple[str, ...] = ("circle_rate_sqft", "circle_rate", "rate_sqft", "rate")) -> DataFrame:
    """The same of [{city?, locality, property_type?, one of the rate keys}]; the first rate that is not 0 counts, the city may come from the file's name."""
    fields = "city string, locality string, property_type string, " + ", ".join(f"{k} string" for k in rate_keys)
    x = _texts(spark, paths).select(F.col("city").alias("file_city"), F.posexplode(F.from_json("value", f"array<struct<{fields.replace(' string', ':string')}>>")).alias("pos", "r"))
    return x.select(F.coalesce(F.lower("r.city"), "file_city").alias("city"), "r.locality", "r.property_type", F.coalesce(*[positive(F.col(f"r.{k}")) for k in rate_keys]).alias("rate"), "pos").where("rate is not null and locality is not null")


def rates_ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of {locality: {kind: [low, high]}}: the middle of each range; flats before land for Residential, the larger of office and shop for Commercial."""
    x = _texts(spark, paths).select("city", F.explode(F.from_json("value", "map<string,map<string,array<double>>>")).alias("locality", "m"))
    mid = lambda like: F.array_max(F.transform(F.map_values(F.map_filter("m", lambda k, v: F.lower(k).rlike(like) & (F.size(v) >= 1))), lambda v: (v[0] + F.element_at(v, -1)) / 2))
    kinds = F.array(F.struct(F.lit("Residential").alias("property_type"), F.coalesce(mid("flat|apt"), mid("land|open")).alias("rate")), F.struct(F.lit("Commercial").alias("property_type"), mid("office|shop|commercial").alias("rate")))
    return x.select("city", "locality", F.inline(kinds)).where("rate > 0")


def rates_zones(spark: SparkSession, paths: str | list[str], names: tuple[str, ...] = ("Colony", "Zone")) -> DataFrame:
    """The same of [{"Zones": [{"Zone", "Rows": [{"Type Of Land", "Exterior", "Colony"}]}]}]: the largest residential rate of a zone, else its largest commercial one, under the zone's name and its colonies'."""
    row = "struct<`Type Of Land`:string,Exterior:string,Colony:string>"
    x = _texts(spark, paths).select("city", F.explode(F.from_json("value", f"array<struct<Zones:array<struct<Zone:string,Rows:array<{row}>>>>>")).alias("d")).select("city", F.explode("d.Zones").alias("z")).select("city", F.col("z.Zone").alias("zone"), F.explode("z.Rows").alias("r"))
    kind, rate = F.lower("r.`Type Of Land`"), positive(F.regexp_replace("r.Exterior", ",", ""))
    best = x.groupBy("city", "zone").agg(F.coalesce(F.max(F.when(kind.contains("resid"), rate)), F.max(F.when(kind.contains("comm"), rate))).alias("rate"), F.collect_set("r.Colony").alias("colonies"))
    alias = F.filter(F.array_union(F.array("zone"), F.flatten(F.transform("colonies", lambda c: F.transform(F.split(c, "[,;]"), lambda t: F.trim(t))))), lambda a: (F.length(a) > 2) & ~F.lower(a).isin("other", "others", "all", "remaining", "rest"))
    return best.where("rate is not null").select("city", F.explode(alias).alias("locality"), F.lit("Residential").alias("property_type"), "rate")


def with_order(shapes: list[DataFrame]) -> DataFrame:
    """Rates of all shapes in load order: ``seq`` orders by the place in ``shapes``, then by name, so that later files win."""
    out = None
    for i, s in enumerate(shapes):
        s = s.select("city", "locality", "property_type", "rate", F.lit(i).alias("__file"), (F.col("pos") if "pos" in s.columns else F.pmod(F.xxhash64("locality"), F.lit(1 << 40))).cast("long").alias("__pos"))
        out = s if out is None else out.unionByName(s)
    return out.select("city", "locality", "property_type", "rate", (F.col("__file").cast("long") * F.lit(1 << 44) + F.col("__pos")).alias("seq"))


def rates_under(spark: SparkSession, paths: str | list[str], at: str, city: str, rate_keys: tuple[str, ...]) -> DataFrame:
    """The same of records deep in a document (``at``: a JSON path such as ``$.rates.Town.land``): {locality, rate keys}; the first rate that is there counts, also under the name before a parenthesis."""
    fields = ",".join(["locality:string", *[f"{k}:string" for k in rate_keys]])
    x = spark.read.option("wholetext", True).text(paths).select(F.posexplode(F.from_json(F.get_json_object("value", at), f"array<struct<{fields}>>")).alias("pos", "r"))
    x = x.select("pos", F.trim("r.locality").alias("name"), F.coalesce(*[positive(F.col(f"r.{k}")) for k in rate_keys]).alias("rate")).where("rate is not null and name <> ''")
    names = F.array_distinct(F.filter(F.array(F.col("name"), F.trim(F.substring_index("name", "(", 1))), lambda n: n != ""))
    return x.select(F.lit(city).alias("city"), F.explode(names).alias("locality"), F.lit(None).cast("string").alias("property_type"), "rate", "pos")


def rates_with_zone(spark: SparkSession, paths: str | list[str], rate_key: str = "circle_rate_sqft") -> DataFrame:
    """The same of [{locality, property_type, zone, rate}]: each rate under its locality and, as a second key, under its zone."""
    x = _texts(spark, paths).select("city", F.posexplode(F.from_json("value", f"array<struct<locality:string,property_type:string,zone:string,{rate_key}:string>>")).alias("pos", "r"))
    keys = F.filter(F.array("r.locality", "r.zone"), lambda k: k.isNotNull() & (F.trim(k) != ""))
    return x.where("r.locality is not null").select("city", F.explode(keys).alias("locality"), F.coalesce("r.property_type", F.lit("Residential")).alias("property_type"), positive(F.col(f"r.{rate_key}")).alias("rate"), "pos").where("rate is not null")


def all_rates(loads: list[DataFrame]) -> DataFrame:
    """The rates of every file, as the shape's reader gives them, in load order (city files, then overrides, then generic ones): places with a rate for each kind and a default, as one table."""
    from plinth.operators.lookup import rate_table

    return rate_table(with_order(loads))


def road_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder whose names speak of roads or highways."""
    return [p for p in listed(spark, f"{folder}/*") if re.search(r"road|highway", p.rsplit("/", 1)[-1], re.I)]


def read_roads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """feature_id, ref, name, fclass, line of GeoJSON lines and multi-lines; empty geometry is dropped, ``highway`` stands in for a blank class."""
    props = "struct<ref:string,name:string,fclass:string,highway:string>"
    f = spark.read.option("wholetext", True).text(paths).select(F.explode(F.from_json("value", f"struct<features:array<struct<properties:{props},geometry:struct<type:string,coordinates:string>>>>").getField("features")).alias("f"))
    c = F.col("f.geometry.coordinates")
    lines = F.when(F.col("f.geometry.type") == "LineString", F.array(F.from_json(c, "array<array<double>>"))).when(F.col("f.geometry.type") == "MultiLineString", F.from_json(c, "array<array<array<double>>>"))
    x = f.select(F.col("f.properties").alias("p"), F.explode(lines).alias("line")).where("line is not null and size(line) >= 2")
    return x.select(F.xxhash64("p.ref", "p.name", F.to_json("line")).alias("feature_id"), "p.ref", "p.name", F.coalesce(F.nullif(F.trim("p.fclass"), F.lit("")), "p.highway").alias("fclass"), "line")


def read_stations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """latitude, longitude of a station file; rows without both are dropped."""
    df = spark.read.option("header", True).csv(paths)
    low = {c.lower(): c for c in df.columns}
    return df.select(number(F.col(low["latitude"])).alias("latitude"), number(F.col(low["longitude"])).alias("longitude")).dropna()


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """city, locality, date, value of one file per {city}/{locality}.csv, as one table."""
    df = spark.read.schema("date string, price_per_sqft string").option("header", True).option("recursiveFileLookup", True).csv(folder).withColumn("path", F.input_file_name())
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.csv$", i)
    return df.select(part(1).alias("city"), part(2).alias("locality"), F.try_to_date("date").alias("date"), positive(F.col("price_per_sqft")).alias("value")).where("date is not null and value is not null")


def read_forecast(spark: SparkSession, path: str, property_id: str | None = None, locality: str | None = None) -> DataFrame:
    """Forecast rows of one property or locality, by quarter: the conditions reach the parquet scan."""
    df = spark.read.parquet(path)
    if property_id is not None:
        df = df.where(F.col("property_id") == property_id)
    if locality is not None:
        df = df.where(F.col("locality") == locality)
    return df.orderBy("quarter")


def catalogue(gazetteer: DataFrame, rate_cities: DataFrame) -> DataFrame:
    """city_key, city: every city of both, the gazetteer's spelling first, in order."""
    a = gazetteer.select(F.lower("city").alias("city_key"), "city", F.lit(0).alias("rank"))
    b = rate_cities.select(F.lower("city").alias("city_key"), F.initcap("city").alias("city"), F.lit(1).alias("rank"))
    return a.unionByName(b).groupBy("city_key").agg(F.min_by("city", F.struct("rank", "city")).alias("city")).orderBy("city_key")
