"""A log derived from the driver's tables: a main branch, a branch for each user, and forks of some of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.operators.ranks import dense_positions

#: Rows in a bucket of positions.
BUCKET = 1 << 14
MAIN_TABLES = ("region", "nation", "customer", "orders", "part", "lineitem")
_NONE = {"symbol_id": "string", "parent_id": "string", "kind": "string", "name": "string", "body": "string", "metadata": "string", "reference_id": "string", "from_symbol_id": "string", "to_symbol_id": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seed(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _json(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":"'), v, F.lit('"')) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def main_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, k1, k2, up, a, b, position): the rows of ``main_log`` by what they are made from, so that sorting and keeping them moves no ids.

    up: key of the parent; a, b: what goes into names, bodies and metadata.
    """
    t = lambda name: table(spark, sf_dir, name)

    def rows(df: DataFrame, stage: int, key: Column | str, up: str | None = None, a: str | None = None, b: str | None = None, key2: str | None = None) -> DataFrame:
        text = [(F.lit(None) if c is None else F.col(c)).cast("string").alias(n) for n, c in (("up", up), ("a", a), ("b", b))]
        return df.select(F.lit(stage).alias("stage"), (F.col(key) if isinstance(key, str) else key).cast("long").alias("k1"), (F.lit(0) if key2 is None else F.col(key2)).cast("long").alias("k2"), *text)

    parts = [
        rows(t("region"), 1, "r_regionkey", a="r_name"),
        rows(t("nation"), 2, "n_nationkey", "n_regionkey", "n_name"),
        rows(t("customer"), 3, "c_custkey", "c_nationkey", "c_name", "c_mktsegment"),
        rows(t("orders"), 4, "o_orderkey", "o_custkey", b="o_orderpriority"),
        rows(t("part").select("p_brand").distinct(), 5, F.conv(F.substring(F.md5(F.col("p_brand").cast("binary")), 1, 12), 16, 10), a="p_brand"),
        rows(t("part"), 6, "p_partkey", "p_brand", "p_name", "p_type"),
        rows(t("lineitem").select("l_orderkey", "l_partkey").distinct(), 7, "l_orderkey", key2="l_partkey"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    bucket = F.struct("stage", F.when(F.col("stage") == 5, 0).otherwise(F.floor(F.col("k1") / BUCKET)).alias("b"))
    return dense_positions(found, "position", bucket, ["k1", "k2"])


def main_ops(keys: DataFrame) -> DataFrame:
    """The operations that ``main_keys`` stand for."""
    empty, path, order, part = F.lit("{}"), F.concat(F.lit("region/"), "a"), _seed("order", "k1"), _seed("part", "k2")
    of = {
        1: {"symbol_id": _seed("region", "k1"), "kind": F.lit("file"), "name": path, "metadata": _json(handler=F.lit("region"), path=path)},
        2: {"symbol_id": _seed("nation", "k1"), "parent_id": _seed("region", "up"), "kind": F.lit("module"), "name": F.col("a"), "metadata": empty},
        3: {"symbol_id": _seed("customer", "k1"), "parent_id": _seed("nation", "up"), "kind": F.lit("class"), "name": F.col("a"), "metadata": _json(segment=F.col("b"))},
        4: {"symbol_id": order, "parent_id": _seed("customer", "up"), "kind": F.lit("method"), "name": F.concat(F.lit("o"), "k1"), "body": F.col("b"), "metadata": empty},
        5: {"symbol_id": _seed("brand", "a"), "kind": F.lit("file"), "name": F.col("a"), "metadata": empty},
        6: {"symbol_id": _seed("part", "k1"), "parent_id": _seed("brand", "up"), "kind": F.lit("function"), "name": F.concat("a", F.lit("#"), "k1"), "body": F.col("b"), "metadata": empty},
        7: {"reference_id": F.concat(F.lit("reference:"), order, F.lit(":"), part, F.lit(":calls")), "from_symbol_id": order, "to_symbol_id": part, "kind": F.lit("calls")},
    }

    def column(name: str, kind: str) -> Column:
        value = F.lit(None).cast(kind)
        for stage, columns in of.items():
            if name in columns:
                value = F.when(F.col("stage") == stage, columns[name]).otherwise(value)
        return value.cast(kind).alias(name)

    made = F.when(F.col("stage") == 7, "CreateReference").otherwise("CreateSymbol").alias("op_type")
    return keys.select(F.lit("main").alias("branch_id"), "position", F.concat(F.lit("main:"), "position").alias("op_id"), made, *[column(c, t) for c, t in _NONE.items()], F.lit("import").alias("changeset_id"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created_at"))


def main_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of branch main: a forest of regions, nations, customers and orders, one of brands and parts, and the calls between them."""
    return main_ops(main_keys(spark, sf_dir))


def targets(events: DataFrame) -> Column:
    """Number of customers that users work on: 4 of 5 of the users', as a scalar subquery would say it."""
    return F.floor(F.lit(0.8) * (F.max("user_id") + 1)).cast("long").alias("m")


def agent_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own operations of each user's branch, in order of time; some break integrity rules, as concurrent work does."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    placed = events.crossJoin(F.broadcast(events.agg(targets(events)))).withColumn("cu", F.col("user_id") % F.col("m"))  # one number
    placed = dense_positions(placed, "position", F.date_trunc("month", "ts"), ["ts", "event_id"], ["user_id"])
    mates = dense_positions(placed.where(F.col("event_type").isin("purchase", "error")), "nth", F.date_trunc("month", "ts"), ["ts", "event_id"], ["user_id", "event_type"])
    slot = F.concat(F.lit("slot:"), "cu", F.lit(":"), F.col("event_id") % 20, F.lit(":"), F.col("event_id") % 3)
    bought = mates.where("event_type = 'purchase'").select("user_id", "nth", F.col("ts").alias("bought_at"), slot.alias("bought"))
    undone = mates.where("event_type = 'error'").join(bought, ["user_id", "nth"]).where("bought_at < ts").select(F.col("event_id").alias("undo"), "bought")
    rows = placed.join(undone, F.col("event_id") == F.col("undo"), "left")
    kind, customer = F.col("event_type"), F.concat(F.lit("customer:"), "cu")
    link = (kind == "error") & F.col("undo").isNull()
    columns = {
        "symbol_id": F.when(kind == "purchase", slot).when(kind == "error", F.col("bought")).otherwise(customer),
        "parent_id": F.when(kind == "purchase", customer),
        "kind": F.when(kind == "purchase", "method").when(link, "calls"),
        "name": F.when(kind == "purchase", F.concat(F.lit("slot"), F.col("event_id") % 20)).when(kind == "signup", F.concat(F.lit("c"), "cu", F.lit("-u"), "user_id")),
        "body": F.when(kind == "click", F.col("props")),
        "metadata": F.when(kind == "purchase", "{}").when(kind == "view", F.col("props")),
        "reference_id": F.when(link, F.concat(F.lit("ref:"), "event_id")),
        "from_symbol_id": F.when(link, customer),
        "to_symbol_id": F.when(link, slot),
    }
    op_type = F.when(kind == "purchase", "CreateSymbol").when(link, "CreateReference").when(kind == "error", "DeleteSymbol").otherwise("UpdateSymbol")
    return rows.select(
        F.concat(F.lit("agent-"), "user_id").alias("branch_id"), "position", F.concat(F.lit("op:"), "event_id").alias("op_id"), op_type.alias("op_type"),
        *[columns[c].cast(t).alias(c) for c, t in _NONE.items()], F.concat(F.lit("cs-"), "user_id").alias("changeset_id"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main; a branch for each user from main's head; and for every tenth user a fork halfway through that user's branch.

    The size of main is counted from the tables, which Parquet footers mostly answer.
    """
    t = lambda name: table(spark, sf_dir, name)
    users = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp").alias("t"))
    sizes = [t(n).select(F.lit(1).alias("x")) for n in ("region", "nation", "customer", "orders", "part")]
    rows = sizes[0]
    for x in [*sizes[1:], t("part").select("p_brand").distinct().select(F.lit(1).alias("x")), t("lineitem").select("l_orderkey", "l_partkey").distinct().select(F.lit(1).alias("x"))]:
        rows = rows.unionAll(x)
    head = rows.agg(F.count("*").alias("head"))  # one row
    own = users.crossJoin(F.broadcast(head))
    started = F.lit("2020-01-01 00:00:00").cast("timestamp")
    main = head.select(F.lit("main").alias("id"), F.lit("repo").alias("repository_id"), F.lit("main").alias("name"), F.lit(None).cast("string").alias("base_branch_id"), F.lit(0).cast("long").alias("base_position"), started.alias("created_at"))
    agents = own.select(F.concat(F.lit("agent-"), "user_id").alias("id"), F.lit("repo"), F.concat(F.lit("agent-"), "user_id").alias("name"), F.lit("main"), F.col("head"), F.col("t"))
    forks = own.where("user_id % 10 = 0").select(F.concat(F.lit("fork-"), "user_id").alias("id"), F.lit("repo"), F.concat(F.lit("fork-"), "user_id").alias("name"), F.concat(F.lit("agent-"), "user_id"), F.col("head") + F.floor(F.col("n") / 2), F.col("t"))
    return main.unionAll(agents).unionAll(forks)


def fork_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own operations of the forks: each adds one note to the customer that its user works on."""
    events = table(spark, sf_dir, "events").select("user_id")
    users = events.distinct().crossJoin(F.broadcast(events.agg(targets(events)))).where("user_id % 10 = 0")
    made = {"symbol_id": F.concat(F.lit("note:"), "user_id"), "parent_id": F.concat(F.lit("customer:"), F.col("user_id") % F.col("m")), "kind": F.lit("method"), "name": F.concat(F.lit("note"), "user_id"), "metadata": F.lit("{}")}
    return users.select(
        F.concat(F.lit("fork-"), "user_id").alias("branch_id"), F.lit(1).cast("long").alias("position"), F.concat(F.lit("fork-op:"), "user_id").alias("op_id"), F.lit("CreateSymbol").alias("op_type"),
        *[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in _NONE.items()], F.concat(F.lit("cs-f"), "user_id").alias("changeset_id"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_log(spark, sf_dir).unionAll(agent_ops(spark, sf_dir)).unionAll(fork_ops(spark, sf_dir))
