"""Contacts and windows from a stream of files; an extension, as the tools worked on finished files only.

State is kept under the shared checkpoint folder, so a query goes on where a lost one
stopped; results of a batch replace those of the same batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import shared


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over all that is there now and gives what it wrote; 'complete' keeps the last result only."""
    spark = stream.sparkSession
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{at}/out")
    return out.select(*stream.columns)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern also takes files that come later."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}*.parquet")


def distinct_contacts(mates: DataFrame) -> DataFrame:
    """Mates once each: duplicates within the stream's state go."""
    return mates.dropDuplicates(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def windows(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): tumbling windows of event time with a watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")
