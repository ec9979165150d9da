"""Row numbers over large partitions without one task for each: rank in a bucket, plus the buckets before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_positions(df: DataFrame, name: str, bucket: Column, order: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """df with column ``name``: 1, 2, ... in order of (bucket, order) inside each group of ``within``.

    bucket must not decrease along the order. Only one row for each bucket meets in the window that adds
    up the buckets; the rows themselves are numbered inside their bucket.
    """
    keys = within or []
    rows = df.withColumn("__bucket", bucket)
    sums = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(sums), F.lit(0))).drop("__n")
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)))
    return numbered.join(before, [*keys, "__bucket"]).withColumn(name, F.col("__before") + F.col("__rank")).drop("__bucket", "__rank", "__before")
