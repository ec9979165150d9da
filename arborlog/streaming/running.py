"""The log as a stream: symbols kept up to date while operations arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_writes(ops: DataFrame) -> DataFrame:
    """The last operation of each symbol of each log in a table of operations."""
    w = Window.partitionBy("log_id", "symbol_id").orderBy(F.desc("ordinal"))
    return ops.where("symbol_id is not null").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def counts_by_window(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Operations by type and window of time, with a bound on lateness; for streams and tables alike."""
    rows = stream.withWatermark("created_at", late) if stream.isStreaming else stream
    return rows.groupBy(F.window("created_at", width), "op_type").agg(F.count("*").alias("operations"))


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Write arriving operations to a log at ``path``, partitioned by branch, once each; a replay reads it at any time."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("log_id").trigger(availableNow=True).start()
