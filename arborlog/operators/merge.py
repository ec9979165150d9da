"""Conflicts between concurrent logs, and merging a branch into its base."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlog.functions import uuid5
from arborlog.operators.lineage import settled
from arborlog.operators.ranks import dense_positions
from arborlog.operators.replay import Replay

#: Rows in a bucket of positions.
BUCKET = 1 << 14

REASONS = ("DUPLICATE_SYMBOL_ID", "DUPLICATE_REFERENCE_ID", "DUPLICATE_SYMBOL_NAME", "OVERLAPPING_SYMBOL_WRITE", "OVERLAPPING_REFERENCE_WRITE", "REFERENCE_TO_DELETED_SYMBOL")
#: Columns that name a pair of logs: which logs are held against each other.
_WRITES = "op_type in ('CreateSymbol', 'DeleteSymbol', 'UpdateSymbol', 'MoveSymbol')"


def _side(ops: DataFrame, side: str) -> DataFrame:
    keep = ["log_id", "op_id", "op_type", "symbol_id", "parent_id", "kind", "name", "reference_id", "from_symbol_id", "to_symbol_id"]
    return ops.select(*[F.col(c).alias(f"{side}_{c}") for c in keep])


def conflicts(source: DataFrame, target: DataFrame, pair: Column | None = None) -> DataFrame:
    """Conflicts between operations of source logs and target logs, each pair of operations by six rules.

    -> (source_log, target_log, reason, source_op, target_op, symbol_id, detail), distinct. pair: a condition on
    s_log_id and t_log_id; by default the logs differ. Each rule is an equi join on the id or key that both
    sides name, so pairs without a common id never meet.
    """
    s, t = _side(source, "s"), _side(target, "t")
    pair = F.col("s_log_id") != F.col("t_log_id") if pair is None else pair
    c = F.col
    created = lambda x: x.where(c([k for k in x.columns if k.endswith("op_type")][0]) == "CreateSymbol")
    linked = lambda x: x.where(c([k for k in x.columns if k.endswith("op_type")][0]) == "CreateReference")
    writes = lambda x, p: x.where(_WRITES.replace("op_type", f"{p}_op_type"))
    both = lambda a, b: ~((c("s_op_type") == a) & (c("t_op_type") == b))

    def rows(joined: DataFrame, reason: str, symbol: Column, detail: Column) -> DataFrame:
        return joined.where(pair).select(c("s_log_id").alias("source_log"), c("t_log_id").alias("target_log"), F.lit(reason).alias("reason"), c("s_op_id").alias("source_op"), c("t_op_id").alias("target_op"), symbol.cast("string").alias("symbol_id"), detail.alias("detail"))

    none = F.lit(None)
    place = F.when(c("s_parent_id").isNull(), F.lit("None")).otherwise(F.concat(F.lit("Some("), c("s_parent_id"), F.lit(")")))
    same_key = c("s_parent_id").eqNullSafe(c("t_parent_id")) & (c("s_kind") == c("t_kind")) & (c("s_name") == c("t_name"))
    ends = lambda x, p: linked(x).withColumn("end", F.explode(F.array_distinct(F.array(f"{p}_from_symbol_id", f"{p}_to_symbol_id"))))
    first_end = lambda x, p: x.withColumn("place", F.when(c("end") == c(f"{p}_from_symbol_id"), 0).otherwise(1))
    gone = lambda x, p: x.where(c(f"{p}_op_type") == "DeleteSymbol")
    gone_said = F.concat(F.lit("one branch references symbol "), c("end"), F.lit(" that the other branch deletes"))
    return (
        rows(created(s).join(created(t), c("s_symbol_id") == c("t_symbol_id")), REASONS[0], c("s_symbol_id"), F.concat(F.lit("both branches create symbol "), "s_symbol_id"))
        .unionAll(rows(linked(s).join(linked(t), c("s_reference_id") == c("t_reference_id")), REASONS[1], none, F.concat(F.lit("both branches create reference "), "s_reference_id")))
        .unionAll(rows(created(s).join(created(t), same_key), REASONS[2], c("s_symbol_id"), F.concat(F.lit("both branches create "), "s_kind", F.lit(" named "), "s_name", F.lit(" under "), place)))
        .unionAll(rows(writes(s, "s").join(writes(t, "t"), c("s_symbol_id") == c("t_symbol_id")).where(both("CreateSymbol", "CreateSymbol")), REASONS[3], c("s_symbol_id"), F.concat(F.lit("both branches write symbol "), "s_symbol_id")))
        .unionAll(rows(s.join(t, c("s_reference_id") == c("t_reference_id")).where(both("CreateReference", "CreateReference")), REASONS[4], none, F.concat(F.lit("both branches write reference "), "s_reference_id")))
        # a deleted id is one symbol, so a pair of operations meets once
        .unionAll(rows(first_end(ends(s, "s"), "s").join(gone(t, "t"), c("end") == c("t_symbol_id")), REASONS[5], c("end"), gone_said))
        .unionAll(rows(gone(s, "s").join(first_end(ends(t, "t"), "t"), c("end") == c("s_symbol_id")), REASONS[5], c("end"), gone_said))
        .distinct()
    )


def ranked(found: DataFrame) -> DataFrame:
    """Conflicts of each pair of logs in order of (reason, source operation, target operation, none first)."""
    w = Window.partitionBy("source_log", "target_log").orderBy("reason", "source_op", F.col("target_op").asc_nulls_first(), F.col("symbol_id").asc_nulls_first(), "detail")
    return found.withColumn("rank", F.row_number().over(w))


def outcomes(logs: DataFrame, found: DataFrame) -> DataFrame:
    """logs(source_log) -> (source_log, outcome, conflicts)."""
    counts = found.groupBy("source_log").agg(F.count("*").alias("n"))
    return logs.join(counts, "source_log", "left").select("source_log", F.when(F.col("n") > 0, "CONFLICT").otherwise("SAFE_MERGE").alias("outcome"), F.coalesce("n", F.lit(0)).alias("conflicts"))


def numbered(ops: DataFrame, after: int, order: str = "ordinal") -> DataFrame:
    """ops with ordinals that follow ``after`` without gaps, in their order, without one task for all of them."""
    turns = ops.withColumn("__turn", F.col(order)).drop("ordinal")
    return dense_positions(turns, "ordinal", F.floor(F.col("__turn") / BUCKET), ["__turn", "op_id"]).withColumn("ordinal", F.col("ordinal") + F.lit(after)).drop("__turn")


def appended(source: DataFrame, target_id: str, tail: int, changeset_id: str) -> DataFrame:
    """Copies of a branch's own operations (position) as the next ones of the target: new ids, given by changeset and place, and new positions."""
    rows = numbered(source, tail, "position").withColumn("position", F.col("ordinal")).drop("ordinal")
    return rows.withColumn("op_id", uuid5(F.concat(F.lit(f"merge:{changeset_id}:"), "position"))).withColumn("branch_id", F.lit(target_id)).withColumn("changeset_id", F.lit(changeset_id))


@dataclass
class MergeResult:
    """outcome: SAFE_MERGE or CONFLICT. appended: positions that the target got, empty after a conflict."""

    outcome: str
    conflicts: DataFrame
    appended: list[int]


def merge_branch(store, branch_id: str, created_by: str = "merge-engine") -> MergeResult:
    """Merge a branch of a store into its direct base.

    What the branch made since it forked is held against what its base got since then, first by pairs of operations, then by
    replay. Without a conflict, copies of its operations are appended to the base under a task and changeset of their own, if the base is
    still where it was; else ``Conflict`` is raised and the caller may try again.
    """
    from arborlog.operators import visible

    branch = store.one("branches", id=branch_id)
    if branch["base_branch_id"] is None:
        raise ValueError(f"branch {branch['name']} has no base; only supports direct merges")
    target = store.one("branches", id=branch["base_branch_id"])
    tail = store.tail(target["id"])
    ops, branches = store.operations(), store.table("branches")
    seen = settled(visible.visible_ops(ops, branches.where(F.col("repository_id") == branch["repository_id"])).where(F.col("log_id") == target["id"]))
    own = settled(ops.where(F.col("branch_id") == branch_id).withColumn("log_id", F.lit(branch_id)).withColumn("ordinal", F.col("position")))
    found = settled(analyze(seen, seen.where(F.col("ordinal") > branch["base_position"]), own))
    if not found.isEmpty():
        return MergeResult("CONFLICT", found, [])
    task = store.task(branch["repository_id"], f"merge {branch['name']} into {target['name']}")
    changeset = store.changeset(branch["repository_id"], task, target["id"], f"merge {branch['name']}", created_by)
    return MergeResult("SAFE_MERGE", found, store.append_table(target["id"], changeset, own, tail))


def synthetic(payloads: DataFrame, slice_id: str) -> DataFrame:
    """Operations that aren't appended yet, as records: ids from the slice and their place, so that reports can be made again."""
    space = str(uuid.uuid5(uuid.NAMESPACE_URL, slice_id))
    return payloads.withColumn("op_id", uuid5(F.concat(F.lit(f"{space}:"), F.col("ordinal").cast("string"))))


def analyze(visible: DataFrame, since_base: DataFrame, source: DataFrame) -> DataFrame:
    """Conflicts of one source log against one target: by pairs of operations, and if there are none, by replay.

    visible: the target's whole list (log_id, ordinal); since_base: its part after the fork; source: own operations. The
    replay of the target with the source behind it adds at most one row, for the first source operation that fails.
    """
    found = conflicts(source, since_base, F.lit(True))
    if not found.isEmpty():
        return found
    head = visible.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("h")).first()["h"]
    log = visible.drop("log_id").withColumn("log_id", F.lit("merge"))
    moved = numbered(source, head).withColumn("log_id", F.lit("merge"))
    columns = ["log_id", "ordinal", "op_id", "op_type", "symbol_id", "parent_id", "kind", "name", "body", "metadata", "reference_id", "from_symbol_id", "to_symbol_id"]
    failed = Replay(log.select(*columns).unionAll(moved.select(*columns))).failures.where(F.col("ordinal") > head)
    made = source.where("op_type = 'CreateSymbol'").select(F.col("op_id").alias("c_op"), F.col("symbol_id").alias("c_id"))
    return failed.join(made, F.col("op_id") == F.col("c_op"), "left").select(F.lit("source").alias("source_log"), F.lit("target").alias("target_log"), F.lit("VALIDATION_REJECTED").alias("reason"), F.col("op_id").alias("source_op"), F.lit(None).cast("string").alias("target_op"), F.col("c_id").alias("symbol_id"), F.col("reason").alias("detail"))
