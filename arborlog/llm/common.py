"""Helpers shared by the operators: reading tables, cutting lineage, linking components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.operators.lineage import settled

#: A word, as a Java regular expression: a run of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Number of partitions that the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What an Arrow batch holds at most, in rows and in bytes; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents holds; long texts would fill memory otherwise.

    Spark has these bounds as settings of the session alone. All operators set the same values, and only where larger ones
    stand, so their order doesn't matter and a session with tighter bounds keeps them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = int(spark.conf.get(key).rstrip("b"))
        if have <= 0 or have > most:
            spark.conf.set(key, str(most))


def sliced(b: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes of text in column ``at``, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
        yield b.slice(i, j - i)
        i = j


def pinned(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage. Lost executors cannot lose the result."""
    return settled(df)


#: A table of at most so many rows, counted first, may be broadcast (below 8 MB at 80 bytes a row).
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already pinned) marked for broadcast if its counted rows allow it, else unchanged.

    Unmarked, the join shuffles both sides and adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def connected(links: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    links(a long, b long) -> (node long, root long), one row for each node that has a link to
    another node; root is the smallest node of the component. Alternates large-star and small-star
    steps until the edges are stars. Each step only takes minima by node, which combine before
    the shuffle, pins them, and joins them back: by broadcast if they are few, else by an inner join of two
    plain shuffles, of which adaptive execution splits a node with many links. No neighbour list is ever
    gathered. Null ends and loops are ignored; no links give no rows.
    """
    edges = pinned(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi > lo")  # greatest and least skip nulls, then both are equal
        .distinct()
    )
    seen = _digest(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = pinned(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large = both.join(if_small(least), "n").where("m > n and m > low").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()
        large = pinned(large)
        floor = pinned(large.groupBy("hi").agg(F.min("lo").alias("low")))
        step = large.join(if_small(floor), "hi").select("hi", "lo", "low")
        small = step.select("hi", F.col("low").alias("lo")).unionByName(step.where("lo > low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")))
        edges = pinned(small.distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
