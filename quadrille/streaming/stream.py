"""Graph queries over a stream of quads: patterns, filters and computed columns run unchanged; counts go by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.quads import SCHEMA, QuadsFrame


def read_quads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of quads in a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def continuous(spark: SparkSession, quads: DataFrame, sparql: str, **options) -> DataFrame:
    """The bindings of a query over streamed quads. Spark refuses what has no streaming plan, such as ORDER BY."""
    return Engine(spark, QuadsFrame(quads), warn=False).prepare(sparql, **options).dataframe()


def windowed_counts(bindings: DataFrame, time: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows by event-time window and ``keys``; rows later than ``late`` behind the newest are dropped."""
    timed = bindings.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    spans = F.window("_t", window, slide) if slide else F.window("_t", window)
    return timed.groupBy(spans.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def start(bindings: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes a stream to Parquet until all available input is processed; a restart goes on from ``checkpoint``."""
    return bindings.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
