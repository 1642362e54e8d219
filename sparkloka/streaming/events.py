"""Streams over event tables: windows, dedupe, decayed state and micro-batch sinks.

Event time without zone is read as UTC. Complete mode shows all windows; in append mode a window comes out once the
watermark has passed it. Late rows beyond the watermark are dropped in append mode only.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloka.runtime import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table's file as a stream, its event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 100).parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


class Collected(NamedTuple):
    """What a stream has brought so far: its rows, the rows set aside, and whether all input was read in time."""

    rows: DataFrame
    rejected: DataFrame
    finished: bool


def collect(df: DataFrame, mode: str, name: str | None = None, valid: Column | None = None, seconds: float | None = None) -> Collected:
    """Runs a streaming frame over all that is available, or for so many ``seconds``.

    Under a ``name`` the progress lies at a fixed place in the shared folder: the next run of that name goes on where the
    last one ended or broke off. Each batch has a folder of its own that is written whole, so a batch that is run again
    replaces its rows. Rows for which ``valid`` isn't true are set aside. Complete mode keeps the last batch alone."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sparkloka/streams/{name or uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        good = batch if valid is None else batch.filter(F.coalesce(valid, F.lit(False)))
        good.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")
        if valid is not None:
            batch.filter(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{at}/rejected/batch={number}")

    for part in ("rows", "rejected"):  # so that both can be read before any batch
        spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{at}/{part}/batch=-1")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
    finished = q.awaitTermination(seconds) if seconds is not None else (q.awaitTermination(), True)[1]
    if not finished:
        q.stop()
    back = lambda part: spark.read.schema(df.schema).parquet(f"{at}/{part}/batch=*")
    return Collected(back("rows"), back("rejected"), bool(finished))


def run(df: DataFrame, mode: str) -> DataFrame:
    """The rows of ``collect`` over all that is available, as a run of its own."""
    return collect(df, mode).rows


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def dedupe(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key: over the whole stream, whose state holds every key; or with ``late`` among rows that lie
    so close in event time, whose state is bounded."""
    if late is None:
        return events.dropDuplicates(keys).select(*keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys, "ts")


def decayed(events: DataFrame, as_of: str, half_life_days: float = 30.0) -> DataFrame:
    """Decayed weight by type at ``as_of``: sums of exp(-lambda * age), which add up in any order, so late rows count."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ts")) / 8.64e10
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life_days * age)), 4).alias("weight"))
