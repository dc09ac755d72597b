"""The panel's counts over a stream of listing events, and absorption between snapshots as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows, distinct-enough users and value per key and window; rows later than ``late`` are dropped."""
    x = events.withWatermark(time, late)
    return x.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once while it is within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


STATE = T.StructType([T.StructField("snapshot", T.TimestampType()), T.StructField("ids", T.ArrayType(T.StringType()))])
ABSORBED = T.StructType([T.StructField("key", T.StringType()), T.StructField("snapshot", T.TimestampType()), T.StructField("supply", T.LongType()), T.StructField("absorbed", T.LongType())])


def absorption_stream(events: DataFrame) -> DataFrame:
    """key, snapshot, supply, absorbed: of each snapshot of a key, how many ids are gone at the key's next. ``events``: key, snapshot, property_id.

    The state of a key is its last snapshot's ids. A snapshot must arrive whole and in order, as a file per snapshot does; late ones are ignored.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches))
        last, ids = state.get if state.exists else (None, [])
        out = []
        for at, g in got.groupby("snapshot"):
            if last is not None and at <= last:
                continue
            now = sorted(set(g["property_id"].dropna()))
            if last is not None:
                out.append((key[0], last, len(ids), len(set(ids) - set(now))))
            last, ids = at, now
        state.update((last, list(ids)))
        yield pd.DataFrame(out, columns=["key", "snapshot", "supply", "absorbed"])

    return events.groupBy("key").applyInPandasWithState(step, ABSORBED, STATE, "append", "NoTimeout")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; starting again goes on where it ended."""
    stream.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
