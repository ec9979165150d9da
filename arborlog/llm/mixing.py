"""Mixing sources to target weights, by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlog.llm.common import WORD, if_small, pinned

#: Bits of the hash, and bits that each level of histograms resolves.
BITS, LEVEL = 60, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ticket(doc_id: Column) -> Column:
    """A document's place in [0, 2**60), from its id alone: the first 15 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size long), a row for each source -> the same with target double.

    Sources by code point, null last, take the weights in turn. Weighted shares of ``share`` times
    all sizes stop at ``most`` times the source's size; what is left over goes to the others by
    weight until none is above. That is a common level: target = least(cap, weight * level). With
    sources by cap / weight, those before the first one under its cap are the capped ones.
    The windows here run over one row for each source, not over documents.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    return (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", F.col("source").isNull(), "source", "level"))).over(whole)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def _sized(docs: DataFrame) -> DataFrame:
    """The texts are read once; what follows works on a few numbers for each document."""
    return pinned(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), ticket(F.col("doc_id")).alias("h")))


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(s, source_size, target, copies, threshold), pinned, for each source s of sized(doc_id, source, size, h).

    A source takes each of its documents floor(target / source_size) times, and once more those whose
    hash is under the threshold. Thresholds come from nested histograms: words by source
    and leading hash bits; in the bucket where the running sum passes the budget, and only there, words by
    the next bits; until that bucket holds one hash, which is taken if that lands nearer the budget.
    Nothing is sorted, and the sums combine before each shuffle, so a source may hold any
    share of the rows. Hashes depend on doc_id alone: reruns agree.
    """
    goal = pinned(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    # open: the hash interval [low, low + 2**width) of each source in which its threshold lies; before: words under low
    open_, done = goal.select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before")), None
    width = BITS
    while width > 0:
        width -= LEVEL
        near = if_small(open_.withColumnRenamed("source", "s"))
        bucket = F.shiftright(F.col("h") - F.col("low"), width)
        bars = (
            sized.where("size > 0").join(near, F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("h") >= F.col("low")) & (bucket < (1 << LEVEL)))
            .groupBy("source", "rest", "low", "before", bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 1024 rows a source
        bars = bars.withColumn("under", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        edge = pinned(bars.where((F.col("under") <= F.col("rest")) & (F.col("under") + F.col("words") > F.col("rest"))))
        single = edge.where("h0 = h1").select("source", F.when(F.col("rest") - F.col("under") > F.col("under") + F.col("words") - F.col("rest"), F.col("h0") + 1).otherwise(F.col("h0")).alias("threshold"))
        done = single if done is None else done.unionByName(single)
        open_ = edge.where("h0 < h1").select("source", "rest", (F.col("low") + F.shiftleft(F.col("bucket"), width)).alias("low"), F.col("under").alias("before"))
        if open_.isEmpty():
            break
    # a source without an edge has its rest at or above all its words
    return pinned(
        goal.join(done.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", "copies", F.coalesce("threshold", F.when(F.col("rest") > 0, F.lit(1 << BITS)).otherwise(F.lit(0))).alias("threshold"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many words of each document a weighted mix of its sources takes, by ``thresholds``.

    docs(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, taken, copies),
    one row for each input row; other columns are ignored.

    Null text or no words: size 0, taken 0. Null source: a source of its own, the last. Null doc_id: one id.
    Rows with one doc_id share a hash and are taken or left together. Empty table: no rows.
    """
    sized = _sized(docs)
    cut = thresholds(sized, weights, share, most)
    copies = F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return sized.join(if_small(cut), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Texts aren't shuffled when the sources are few. Empty table: no rows."""
    cut = thresholds(_sized(docs), weights, share, most).select(F.col("s").alias("__s"), F.col("copies").alias("__copies"), F.col("threshold").alias("__threshold"))
    times = F.col("__copies").cast("int") + F.when(ticket(F.col("doc_id")) < F.col("__threshold"), 1).otherwise(0)
    return docs.join(if_small(cut), F.col("source").eqNullSafe(F.col("__s"))).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
s1 as (select *, cast([3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as double) as weight, source_size * 2.0::double as cap from s0),
s2 as (select *, cap / weight as fill from s1),
s3 as (select *, ((select sum(source_size) from s0)::double * 1.5::double
                  - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))
                 / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as level from s2),
s4 as (select *, coalesce(least(cap, weight * (select level from s3 where level < fill order by fill, source nulls last limit 1)), cap) as target from s3),
s5 as (select source, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as copies from s4),
run as (
  select d.doc_id, d.size, s.source_size, s.target, s.copies, s.target - s.copies * s.source_size as rest, d.size as own,
         sum(d.size) over (partition by d.source order by d.h rows between unbounded preceding and current row) as upto
  from sized d join s5 s on d.source is not distinct from s.source)
select doc_id, size, source_size, target,
       cast(size * (copies + case when upto <= rest or (upto - own < rest and rest - (upto - own) > upto - rest) then 1 else 0 end) as bigint) as taken
from run
"""
