"""Contiguous balanced shards from a global prefix sum of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlog.llm.common import if_small, pinned, slots

#: Equal to ``shard`` with 8 shards in DuckDB, which has no CRC32: the usual table of 256 remainders is made from its polynomial.
ORACLE_SQL = """
  with recursive step(i, turn, c) as (
    select i, 0, i::bigint from range(256) r(i)
    union all select i, turn + 1, xor(c >> 1, 3988292384 * (c & 1)) from step where turn < 8),
  crc as (select list(c order by i) as t from step where turn = 8),
  d as (select doc_id, (strlen(coalesce(text, '')) + 1)::bigint as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as b from documents),
  sums as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::bigint) as text_crc32 from d, crc),
  run as (select *, sum(size) over (order by doc_id nulls first, text_crc32 rows unbounded preceding) as ended, sum(size) over () as total, row_number() over (order by doc_id nulls first, text_crc32) as place from sums),
  cut as (select *, ((2 * ended - size) * 8 // (2 * total))::int as shard from run)
  select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, null::int as grown_shard from cut"""


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Cut all documents, in order of doc_id, into ``shards`` runs of nearly equal bytes.

    docs(doc_id, text, ...) -> (doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard null),
    one row for each input row. size is the text's UTF-8 bytes plus 1; slot counts from 0 in a shard.

    Rows are range-partitioned; each partition gives one total, the totals' running sum gives each
    partition its place, and a running sum inside the partition gives each row its own. A row
    belongs to the shard in which its middle byte falls, so shards differ from the equal target by half a
    document at either end. No row needs another partition's rows.

    Null text: size 1, checksum 0. Rows with one doc_id (null first) are put in order of checksum, then of
    their place in the input, which also spreads a doc_id that many rows share over partitions.
    Empty table: no rows. More shards than bytes: some shards stay empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("entry"))
    order = ["doc_id", "text_crc32", "entry"]
    placed = pinned(rows.repartitionByRange(slots(spark), *order).withColumn("part", F.spark_partition_id()))
    # one row for each partition
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = pinned(
        placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("bytes").over(parts), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("n_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    )
    run = Window.partitionBy("part").orderBy(*order)
    ended = F.col("bytes_before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = pinned(
        placed.join(if_small(totals), "part")
        .withColumn("ended", ended)
        .withColumn("place", F.col("n_before") + F.row_number().over(run) - 1)
        .select("doc_id", "size", "text_crc32", "place", F.expr(f"cast((2 * ended - size) * {shards} div (2 * all_bytes) as int)").alias("shard"))
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
