"""What a branch sees: its ancestors' operations up to each fork point, then its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.operators.lineage import settled
from arborlog.operators.ranks import dense_positions

#: Longest chain of forks.
MAX_FORKS = 1000


def fork_chain(branches: DataFrame) -> DataFrame:
    """(leaf, ancestor, cap, offset, depth): each branch's ancestors, itself first.

    An own operation of the ancestor is visible to the leaf iff offset + position <= cap (null: no bound),
    and then its ordinal is offset + position. A cycle of bases ends where it closes; a longer chain than MAX_FORKS is an error.
    """
    spark = branches.sparkSession
    # settled, as recursive queries that are laid over each other give wrong rows
    chain = spark.sql(
        f"""
        with recursive chain(leaf, ancestor, cap, offset, base, depth) max recursion level {MAX_FORKS} as (
          select id, id, cast(null as bigint), base_position, base_branch_id, 0 from {{branches}}
          union all
          select c.leaf, b.id, least(c.cap, c.offset), b.base_position, b.base_branch_id, c.depth + 1
          from chain c join {{branches}} b on b.id = c.base where b.id <> c.leaf
        )
        select leaf, ancestor, cap, offset, depth from chain
        """,
        branches=settled(branches.select("id", "base_branch_id", "base_position")),
    )
    return settled(chain)


def visible_ops(ops: DataFrame, branches: DataFrame, limit: int | None = None) -> DataFrame:
    """Each branch's visible list: ops with log_id (the branch that sees it) and ordinal.

    The chain has a row for each pair of branch and ancestor; ops meet it by an equi join on their branch.
    """
    chain = fork_chain(branches).withColumnRenamed("ancestor", "branch_id")
    seen = ops.join(chain, "branch_id").withColumn("ordinal", F.col("offset") + F.col("position"))
    seen = seen.where(F.col("cap").isNull() | (F.col("ordinal") <= F.col("cap")))
    if limit is not None:
        seen = seen.where(F.col("ordinal") <= limit)
    return seen.withColumnRenamed("leaf", "log_id").drop("cap", "offset", "depth")


def since_base(ops: DataFrame, branches: DataFrame) -> DataFrame:
    """Visible operations of each branch after the root branch's part: what its users did."""
    chain = fork_chain(branches.where("base_branch_id is not null")).withColumnRenamed("ancestor", "branch_id")
    seen = ops.join(chain, "branch_id").withColumn("ordinal", F.col("offset") + F.col("position"))
    return seen.where(F.col("cap").isNull() | (F.col("ordinal") <= F.col("cap"))).withColumnRenamed("leaf", "log_id").drop("cap", "offset", "depth")


def visible_counts(ops: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch_id, visible, own) without making the lists: heads are counted, then cut at the caps."""
    heads = ops.groupBy("branch_id").agg(F.max("position").alias("head"))
    chain = fork_chain(branches)
    seen = chain.join(heads, chain.ancestor == heads.branch_id, "left").withColumn("upto", F.least("cap", F.col("offset") + F.coalesce("head", F.lit(0))))
    return seen.groupBy(F.col("leaf").alias("branch_id")).agg(F.sum(F.greatest(F.lit(0), F.col("upto") - F.col("offset"))).alias("visible"), F.max(F.when(F.col("depth") == 0, F.coalesce("head", F.lit(0)))).alias("own"))


def fingerprint(ops: DataFrame) -> DataFrame:
    """(log_id, fingerprint): SHA-256 of id:position of a log's operations in order, joined by a bar."""
    return ops.groupBy("log_id").agg(F.sha2(F.expr("listagg(concat(op_id, ':', position), '|') within group (order by ordinal)"), 256).alias("fingerprint"))


def require_prefix(count: int, branch: str, wanted: int) -> None:
    if wanted < 0:
        raise ValueError("a position can't be negative")
    if count < wanted:
        raise ValueError(f"branch {branch} has {count} visible operations, not {wanted}")


def own_ops(ops: DataFrame, branch_id: str, limit: int | None = None) -> DataFrame:
    """A branch's own operations in order of position, all or the first ``limit``. A log partitioned by branch is read for this one alone."""
    rows = ops.where(F.col("branch_id") == branch_id).orderBy("position")
    return rows if limit is None else rows.limit(limit)


def repository_ops(ops: DataFrame) -> DataFrame:
    """All branches' operations in the order of the repository's listing, with their rank: by time, branch and position.

    Months are numbered apart and added up, so that no task ranks the whole log.
    """
    return dense_positions(ops, "rank", F.date_trunc("month", "created_at"), ["created_at", "branch_id", "position"])
