"""Roll-ups of branches, operations and files; labels, summaries and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tails(branches: DataFrame, ops: DataFrame) -> DataFrame:
    """(branch_id, tail): the last position of each branch, 0 if it has none."""
    heads = ops.groupBy("branch_id").agg(F.max("position").alias("p"))
    return branches.select(F.col("id").alias("branch_id")).join(heads, "branch_id", "left").select("branch_id", F.coalesce("p", F.lit(0)).alias("tail"))


def append_positions(ops: DataFrame, tail: DataFrame, order: list[str]) -> DataFrame:
    """New operations with the positions that follow their branch's tail, without gaps."""
    nth = F.row_number().over(Window.partitionBy("branch_id").orderBy(*order))
    return ops.withColumn("nth", nth).join(tail, "branch_id", "left").withColumn("position", F.coalesce("tail", F.lit(0)) + F.col("nth")).drop("nth", "tail")


def branch_summary(branches: DataFrame, ops: DataFrame, main_symbols: DataFrame) -> DataFrame:
    """(branch_id, operations, created, methods, status): methods are the created methods' names in order.

    main: the root branch; empty: no own operations; merged: something was created, and all of it is in main; else ready.
    A branch with updates alone is never merged.
    """
    made = ops.where("op_type = 'CreateSymbol' and branch_id <> 'main'").join(main_symbols.select("symbol_id", F.lit(True).alias("in_main")).distinct(), "symbol_id", "left")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "method", F.struct("position", "name")))), lambda x: x["name"])
    by_branch = ops.groupBy("branch_id").agg(F.count("*").alias("operations"))
    creates = made.groupBy("branch_id").agg(F.count("*").alias("created"), F.bool_and(F.coalesce("in_main", F.lit(False))).alias("all_in_main"), F.array_join(names, ",").alias("methods"))
    rows = branches.select(F.col("id").alias("branch_id")).join(by_branch, "branch_id", "left").join(creates, "branch_id", "left")
    status = F.when(F.col("branch_id") == "main", "main").when(F.coalesce("operations", F.lit(0)) == 0, "empty").when(F.col("all_in_main"), "merged").otherwise("ready")
    return rows.select("branch_id", F.coalesce("operations", F.lit(0)).alias("operations"), F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("methods", F.lit("")).alias("methods"), status.alias("status"))


def metrics(summary: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """One row: branches, agents, merged, pending, operations, symbols, references."""
    s = summary.agg(
        F.count("*").alias("branches"),
        F.count_if(F.col("status") != "main").alias("agents"),
        F.count_if(F.col("status") == "merged").alias("merged"),
        F.count_if(F.col("status").isin("ready", "empty")).alias("pending"),
        F.sum("operations").alias("operations"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return s.crossJoin(one(symbols, "symbols")).crossJoin(one(references, "refs"))  # single rows


def breakdown(files: DataFrame) -> DataFrame:
    """(handler, files): files by handler, untagged if they have none."""
    return files.groupBy(F.coalesce("handler", F.lit("untagged")).alias("handler")).agg(F.count("*").alias("files"))


def next_number(names: DataFrame, prefix: str = "agent-") -> DataFrame:
    """One row: 1 + the largest number behind the prefix among names(name)."""
    n = F.expr(f"try_cast(regexp_extract(name, '^{prefix}([0-9]+)$', 1) as bigint)")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_number"))


def operation_view(ops: DataFrame, branches: DataFrame) -> DataFrame:
    """(op_id, branch_name, op_type, symbol_id, symbol_name, symbol_kind) of each operation."""
    create = F.col("op_type") == "CreateSymbol"
    names = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    return ops.select("op_id", "branch_id", "op_type", F.coalesce("symbol_id", "from_symbol_id", "reference_id").alias("symbol_id"), F.when(create | (F.col("op_type") == "UpdateSymbol"), F.col("name")).alias("symbol_name"), F.when(create | (F.col("op_type") == "CreateReference"), F.col("kind")).alias("symbol_kind")).join(names, "branch_id", "left").select("op_id", F.coalesce("branch_name", F.lit("unknown")).alias("branch_name"), "op_type", "symbol_id", "symbol_name", "symbol_kind")


def decision(op: str = "op_type") -> Column:
    """The audit label of an operation."""
    c = F.col(op)
    return (
        F.when(c == "CreateSymbol", "addedSymbol").when(c == "DeleteSymbol", "deletedSymbol").when(c == "MoveSymbol", "movedSymbol")
        .when((c == "UpdateSymbol") & F.col("name").isNotNull(), "renamedSymbol").when(c == "UpdateSymbol", "updatedSymbol")
        .when(c == "CreateReference", "addedReference").when(c == "DeleteReference", "deletedReference")
    )


def summary_text() -> Column:
    """One line that says what an operation does."""
    c = F.col("op_type")
    said = lambda verb, *parts: F.concat(F.lit(verb + " "), *parts)
    fields = F.array_join(F.filter(F.array(F.when(F.col("name").isNotNull(), "name"), F.when(F.col("body").isNotNull(), "body"), F.when(F.col("metadata").isNotNull(), "metadata")), lambda x: x.isNotNull()), ", ")
    return (
        F.when(c == "CreateSymbol", said("create", F.col("kind"), F.lit(" "), F.col("name")))
        .when(c == "DeleteSymbol", said("delete symbol", F.col("symbol_id")))
        .when(c == "UpdateSymbol", said("update symbol", F.col("symbol_id"), F.lit(" ("), fields, F.lit(")")))
        .when(c == "MoveSymbol", said("move symbol", F.col("symbol_id"), F.lit(" to "), F.coalesce("parent_id", F.lit("root"))))
        .when(c == "CreateReference", said("create reference", F.col("from_symbol_id"), F.lit(" "), F.col("kind"), F.lit(" "), F.col("to_symbol_id")))
        .when(c == "DeleteReference", said("delete reference", F.col("reference_id")))
    )


def touches(ops: DataFrame) -> DataFrame:
    """ops with a row for each symbol that an operation writes or links (symbol)."""
    return ops.withColumn("symbol", F.explode(F.array_distinct(F.filter(F.array("symbol_id", "from_symbol_id", "to_symbol_id"), lambda x: x.isNotNull()))))


def history(ops: DataFrame, most: int = 16) -> DataFrame:
    """(symbol, op_id, rank): the newest operations of each symbol over all branches, at most ``most``; newest first."""
    w = Window.partitionBy("symbol").orderBy(F.desc("created_at"), F.desc("branch_id"), F.desc("position"))
    return touches(ops).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("symbol", "op_id", "rank")


def newest(ops: DataFrame, most: int = 32) -> DataFrame:
    """(log_id, op_id, rank): the last operations of each visible list, newest first."""
    w = Window.partitionBy("log_id").orderBy(F.desc("ordinal"))
    return ops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("log_id", "op_id", "rank")


def provenance(ops: DataFrame, changesets: DataFrame, tasks: DataFrame) -> DataFrame:
    """(symbol_id, op_id, changeset_title, task_title) of the operations that created symbols."""
    c = changesets.select(F.col("id").alias("changeset_id"), "task_id", F.col("title").alias("changeset_title"))
    t = tasks.select(F.col("id").alias("task_id"), F.col("title").alias("task_title"))
    return ops.where("op_type = 'CreateSymbol'").select("symbol_id", "op_id", "changeset_id").join(c, "changeset_id", "left").join(t, "task_id", "left").select("symbol_id", "op_id", "changeset_title", "task_title")


def occurrence_names(rows: DataFrame, key: list[str], name: str, order: list[str], style: str = " ({n})") -> DataFrame:
    """rows with ``label``: the name, from its second occurrence among equal keys on with its number."""
    nth = F.row_number().over(Window.partitionBy(*key, name).orderBy(*order))
    before, after = style.split("{n}")
    return rows.withColumn("nth", nth).withColumn("label", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(before), F.col("nth").cast("string"), F.lit(after))))


def last_occurrence(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last one."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def import_stats(states: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: files of an ingest plan (path, state) by state, and operations of its plan of change (op_type) by kind."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    files = states.agg(F.count("*").alias("files"), *[n("state", x).alias(x) for x in ("unchanged", "changed", "added", "deleted")])
    ops = plan.agg(F.count("*").alias("operations"), n("op_type", "CreateSymbol").alias("symbols_created"), n("op_type", "UpdateSymbol").alias("symbols_updated"), n("op_type", "DeleteSymbol").alias("symbols_deleted"), F.count_if(F.col("op_type").isin("CreateReference", "DeleteReference")).alias("reference_changes"))
    return files.crossJoin(ops)  # single rows


def receiver_counts(methods: DataFrame) -> DataFrame:
    """methods(scope, receiver, name) -> how often each name is declared for a receiver; only those that are unique have a place of their own."""
    return methods.groupBy("scope", "receiver", "name").agg(F.count("*").alias("n")).withColumn("unique", F.col("n") == 1)


def related_by_name(neighbours: DataFrame) -> DataFrame:
    """Neighbours (asked, symbol_id, name) as a reader's list: by name, then id."""
    w = Window.partitionBy("asked").orderBy("name", "symbol_id")
    return neighbours.select("asked", "symbol_id", "name", F.row_number().over(w).alias("rank"))


def primary_history(ops: DataFrame) -> DataFrame:
    """(symbol, op_id, branch_id, rank): operations whose own symbol it is, the source of a reference for references, by branch and position."""
    rows = ops.withColumn("symbol", F.coalesce("symbol_id", "from_symbol_id")).where("symbol is not null")
    w = Window.partitionBy("symbol").orderBy("branch_id", "position")
    return rows.select("symbol", "op_id", "branch_id", F.row_number().over(w).alias("rank"))
