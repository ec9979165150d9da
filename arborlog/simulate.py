"""Many agents that work at once and are merged one by one, as one job of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.functions import fnv1a64
from arborlog.operators.lineage import settled
from arborlog.operators.merge import BUCKET, conflicts
from arborlog.operators.ranks import dense_positions
from arborlog.operators.replay import Replay

BASE = [("file:orders", None, "file", "orders"), ("class:orders", "file:orders", "class", "Orders"), ("method:run", "class:orders", "method", "run")]
#: With clashes on, every so many agents an agent takes another's name.
CLASH = 11


def agent_log(spark: SparkSession, agents: int, clashes: bool) -> DataFrame:
    """(log_id, ordinal, ...) of each agent's own operations: it makes a method, and a call of it from the base method."""
    n = spark.range(agents).withColumnRenamed("id", "n")
    taken = F.when(F.lit(clashes) & (F.col("n") % CLASH == CLASH - 1), F.col("n") - 1).otherwise(F.col("n"))
    none = F.lit(None).cast("string")
    log = F.concat(F.lit("agent-"), "n")
    own = F.concat(F.lit("method:agent"), "n")
    made = n.select(log.alias("log_id"), F.lit(1).cast("long").alias("ordinal"), F.concat(log, F.lit(":1")).alias("op_id"), F.lit("CreateSymbol").alias("op_type"), own.alias("symbol_id"), F.lit("class:orders").alias("parent_id"), F.lit("method").alias("kind"), F.concat(F.lit("agent"), taken).alias("name"), none.alias("body"), F.lit("{}").alias("metadata"), none.alias("reference_id"), none.alias("from_symbol_id"), none.alias("to_symbol_id"))
    linked = n.select(log, F.lit(2).cast("long"), F.concat(log, F.lit(":2")), F.lit("CreateReference"), none, none, F.lit("calls"), none, none, none, F.concat(F.lit("call:agent"), "n"), own, F.lit("method:run"))
    return made.unionAll(linked)


def base_log(spark: SparkSession) -> DataFrame:
    rows = [("main", i, f"base:{i}", "CreateSymbol", s, p, k, n, None, "{}", None, None, None) for i, (s, p, k, n) in enumerate(BASE, 1)]
    return spark.createDataFrame(rows, "log_id string, ordinal long, op_id string, op_type string, symbol_id string, parent_id string, kind string, name string, body string, metadata string, reference_id string, from_symbol_id string, to_symbol_id string")


def simulate(spark: SparkSession, agents: int = 128, clashes: bool = False) -> dict:
    """Merge all agents in order of the FNV-1a hash of their name; an agent that conflicts with one merged before is left out.

    Conflicts of all pairs come from one join. Which agents are accepted depends on those before, so it is settled in rounds:
    an agent without an open earlier rival is accepted, and the rivals of the accepted are left out; each
    round settles at least the first open agent, and nearly all agents have no rival at all.
    """
    own = settled(agent_log(spark, agents, clashes))
    order = settled(own.select("log_id").distinct().withColumn("fnv", fnv1a64(F.col("log_id"))))
    order = settled(dense_positions(order, "turn", F.substring("fnv", 1, 2), ["fnv", "log_id"]).select("log_id", "turn"))
    turn = lambda name: order.select(F.col("log_id").alias(name), F.col("turn").alias(f"{name}_turn"))
    rivals = settled(conflicts(own, own).select("source_log", "target_log").distinct().join(turn("source_log"), "source_log").join(turn("target_log"), "target_log").where("target_log_turn < source_log_turn").select(F.col("source_log").alias("later"), F.col("target_log").alias("earlier")))
    open_, accepted = order.select("log_id"), None
    while True:
        blocked = rivals.join(open_.withColumnRenamed("log_id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("log_id")).distinct()
        taken = settled(open_.join(blocked, "log_id", "left_anti"))
        if taken.isEmpty():
            break
        accepted = taken if accepted is None else settled(accepted.unionAll(taken))
        beaten = rivals.join(taken.withColumnRenamed("log_id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("log_id")).distinct()
        open_ = settled(open_.join(taken, "log_id", "left_anti").join(beaten, "log_id", "left_anti"))
    safe = accepted.count()
    merged = own.join(accepted, "log_id", "left_semi").join(order, "log_id")
    merged = dense_positions(merged.withColumnRenamed("ordinal", "own"), "ordinal", F.floor(F.col("turn") / BUCKET), ["turn", "own"]).withColumn("ordinal", F.col("ordinal") + len(BASE)).drop("turn", "own").withColumn("log_id", F.lit("main"))
    final = settled(base_log(spark).unionByName(merged))
    replay = Replay(final)
    return {
        "agents": agents, "safe": safe, "conflicts": agents - safe, "operations": final.count(),
        "symbols": replay.symbols().count(), "references": replay.references().count(), "failures": replay.failures.count(),
    }
