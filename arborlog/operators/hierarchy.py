"""The containment forest: ancestors, files, paths, subtrees, orders of deletion.

All climbs go by doubling: after k rounds a pointer spans up to 2**k steps, so a tree of depth d takes log2(d) joins of the whole
table, whatever its shape, and each round is settled before the next one reads it. A parent that isn't there ends a climb;
parents that form a cycle are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlog.operators.lineage import settled, stored


def _bounded(rounds: int, symbols: DataFrame) -> None:
    """No chain of n symbols is longer than n steps, so a pointer that is still open beyond that runs in a circle."""
    if rounds >= 4 and 2 ** (rounds - 1) > symbols.count():
        raise ValueError("the parents of the symbols form a cycle")


def _linked(rows: DataFrame) -> DataFrame:
    """(id, up): those of rows(symbol_id, parent_id) with a parent that is there."""
    ids = rows.select(F.col("symbol_id").alias("up"))
    return rows.where("parent_id is not null").select(F.col("symbol_id").alias("id"), F.col("parent_id").alias("up")).join(ids, "up", "left_semi")


def climbed(symbols: DataFrame, stop: Column, part: Column | None = None, sep: str = "/") -> DataFrame:
    """(symbol_id, end_id, depth, stopped[, path]): the first symbol at or above each one for which ``stop`` holds, else its root.

    stopped: does ``stop`` hold there? depth: steps up to it. part: a string of each symbol; path has them from the end down to the
    symbol, joined by ``sep``.
    """
    extra = [] if part is None else ["path"]
    up = F.col("parent_id")
    rows = settled(symbols.select("symbol_id", "parent_id", F.coalesce(stop, F.lit(False)).alias("stopped"), *([] if part is None else [part.alias("path")])))
    parents = rows.select(F.col("symbol_id").alias("p_id"))
    now = settled(
        rows.join(parents, up == F.col("p_id"), "left").select(
            "symbol_id",
            F.when(~F.col("stopped") & F.col("p_id").isNotNull(), up).otherwise(F.col("symbol_id")).alias("end_id"),
            F.when(~F.col("stopped") & F.col("p_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
            "stopped",
            (~F.col("stopped") & F.col("p_id").isNotNull()).alias("open"),
            *extra,
        )
    )
    rounds = 0
    while not (todo := now.where("open")).isEmpty():
        rounds += 1
        _bounded(rounds, rows)
        there = now.select(*[F.col(c).alias(f"t_{c}") for c in now.columns])
        path = [] if part is None else [F.concat("t_path", F.lit(sep), "path").alias("path")]
        # the path of an open pointer ends below the symbol that it points to
        on = todo.join(there, F.col("end_id") == F.col("t_symbol_id")).select("symbol_id", F.col("t_end_id").alias("end_id"), (F.col("depth") + F.col("t_depth")).alias("depth"), F.col("t_stopped").alias("stopped"), F.col("t_open").alias("open"), *path)
        now = settled(now.where("not open").unionAll(on))
    return now.select("symbol_id", "end_id", "depth", "stopped", *extra)


def closure(links: DataFrame, carry: dict[str, tuple] | None = None) -> DataFrame:
    """links(id, up, ...), at most one for each id -> (id, up, depth, ...): all pairs of an id and what is above it, without itself.

    carry: columns of the links to combine along the way: name -> function of the upper and the lower part.
    """
    carry = carry or {}
    first = settled(links.select("id", "up", F.lit(1).cast("long").alias("depth"), *carry))
    pairs, jump, rounds = first, first, 0
    while not jump.isEmpty():
        rounds += 1
        _bounded(rounds, first)
        far = lambda x: x.select(*[F.col(c).alias(f"t_{c}") for c in x.columns])

        def over(x):
            columns = ["id", F.col("t_up").alias("up"), (F.col("depth") + F.col("t_depth")).alias("depth"), *[f(F.col(f"t_{c}"), F.col(c)).alias(c) for c, f in carry.items()]]
            return jump.join(far(x), F.col("up") == F.col("t_id")).select(*columns)  # noqa: B023

        pairs, jump = settled(pairs.unionAll(over(pairs))), settled(over(jump))
    return pairs


def ancestors(symbols: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(symbol_id, ancestor_id, depth): each symbol, or each of ``of``, with itself and all above it.

    All symbols: by doubling. Given ones: step by step from those alone, so that few of them cost little.
    """
    if of is None:
        rows = settled(symbols.select("symbol_id", "parent_id"))
        own = rows.select("symbol_id", F.col("symbol_id").alias("ancestor_id"), F.lit(0).cast("long").alias("depth"))
        return own.unionAll(closure(_linked(rows)).select("id", "up", "depth"))
    tree = settled(symbols.select(F.col("symbol_id").alias("p_id"), F.col("parent_id").alias("p_up")))
    level = settled(of.select("symbol_id", F.col("symbol_id").alias("ancestor_id"), F.col("parent_id").alias("next"), F.lit(0).cast("long").alias("depth")))
    found, rounds = level, 0
    while True:
        rounds += 1
        if rounds % 1024 == 0 and rounds > tree.count():
            raise ValueError("the parents of the symbols form a cycle")
        level = settled(level.join(tree, F.col("next") == F.col("p_id")).select("symbol_id", F.col("p_id").alias("ancestor_id"), F.col("p_up").alias("next"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return found.select("symbol_id", "ancestor_id", "depth")
        found = found.unionAll(level)


def nearest_file(symbols: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(symbol_id, file_id): the nearest symbol of kind file, itself included; symbols that are in no file give no row."""
    if of is None:
        return climbed(symbols, F.col("kind") == "file").where("stopped").select("symbol_id", F.col("end_id").alias("file_id"))
    files = symbols.where("kind = 'file'").select(F.col("symbol_id").alias("ancestor_id"))
    return ancestors(symbols, of).join(files, "ancestor_id").groupBy("symbol_id").agg(F.min_by("ancestor_id", "depth").alias("file_id"))


def root_ancestor(symbols: DataFrame) -> DataFrame:
    """(symbol_id, root_id, depth): the last symbol above."""
    return climbed(symbols, F.lit(False)).select("symbol_id", F.col("end_id").alias("root_id"), "depth")


def symbol_path(symbols: DataFrame, sep: str = "/") -> DataFrame:
    """(symbol_id, path): the names from the root to the symbol."""
    return climbed(symbols, F.lit(False), F.col("name"), sep).select("symbol_id", "path")


def breadcrumb(symbols: DataFrame, of: DataFrame) -> DataFrame:
    """(symbol_id, ancestor_id, name, kind, place): the way from the root (place 0) down to each symbol of ``of``, itself the last."""
    names = symbols.select(F.col("symbol_id").alias("ancestor_id"), "name", "kind")
    steps = ancestors(symbols, of)
    last = Window.partitionBy("symbol_id")
    return steps.withColumn("place", F.max("depth").over(last) - F.col("depth")).join(names, "ancestor_id").select("symbol_id", "ancestor_id", "name", "kind", "place")


def subtree_sizes(symbols: DataFrame) -> DataFrame:
    """(symbol_id, size): symbols in each subtree, its root included."""
    return _subtree_sums(symbols.select("symbol_id", "parent_id", F.lit(1).cast("long").alias("n")))


def _subtree_sums(weights: DataFrame) -> DataFrame:
    """weights(symbol_id, parent_id, n) -> (symbol_id, size): the sum of n over each subtree.

    After k rounds a symbol knows what is fewer than 2**k steps below; what is further down, up to twice as far, is what the symbols
    exactly 2**k below it know.
    """
    rows = settled(weights)
    jump, size, rounds = settled(_linked(rows)), rows.select(F.col("symbol_id").alias("id"), "n"), 0
    while not jump.isEmpty():
        rounds += 1
        _bounded(rounds, rows)
        more = jump.join(size, "id").groupBy("up").agg(F.sum("n").alias("more"))
        size = settled(size.join(more, F.col("id") == F.col("up"), "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        far = jump.select(F.col("id").alias("t_id"), F.col("up").alias("t_up"))
        jump = settled(jump.join(far, F.col("up") == F.col("t_id")).select("id", F.col("t_up").alias("up")))
    return size.select(F.col("id").alias("symbol_id"), F.col("n").alias("size"))


def inside(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(symbol_id, root_id, depth): symbols in the subtrees of roots(symbol_id), each with the nearest root at or above it."""
    mark = symbols.join(roots.select(F.col("symbol_id").alias("r_id")).distinct(), F.col("symbol_id") == F.col("r_id"), "left")
    return climbed(mark, F.col("r_id").isNotNull()).where("stopped").select("symbol_id", F.col("end_id").alias("root_id"), "depth")


def subtree(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(symbol_id) -> (root_id, symbol_id, depth) of all symbols below and the roots themselves; below several roots: a row for each."""
    near = settled(inside(symbols, roots))
    # roots below other roots: the way up from their parent
    heads = near.where("depth = 0").select("symbol_id").join(symbols.select("symbol_id", "parent_id"), "symbol_id")
    above = near.select(F.col("symbol_id").alias("parent_id"), F.col("root_id").alias("up"), (F.col("depth") + 1).alias("steps"))
    chain = closure(heads.join(above, "parent_id").select(F.col("symbol_id").alias("id"), "up", "steps"), {"steps": lambda a, b: a + b})
    more = near.join(chain.select(F.col("id").alias("root_id"), "up", "steps"), "root_id").select(F.col("up").alias("root_id"), "symbol_id", (F.col("depth") + F.col("steps")).alias("depth"))
    return near.select("root_id", "symbol_id", "depth").unionAll(more)


def _chain_sums(links: DataFrame) -> DataFrame:
    """links(id, up, n), at most one for each id -> (id, total): the sum of n from each id up to the last one with a link."""
    now, rounds = settled(links.select("id", "up", F.col("n").alias("total"), F.lit(True).alias("open"))), 0
    while not (todo := now.where("open")).isEmpty():
        rounds += 1
        _bounded(rounds, now)
        far = now.select(*[F.col(c).alias(f"t_{c}") for c in now.columns])
        on = todo.join(far, F.col("up") == F.col("t_id"), "left").select("id", F.coalesce("t_up", "up").alias("up"), (F.col("total") + F.coalesce("t_total", F.lit(0))).alias("total"), F.coalesce("t_open", F.lit(False)).alias("open"))
        now = settled(now.where("not open").unionAll(on))
    return now.select("id", "total")


def placed(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, symbol_id, depth, rank, size): symbols in the subtrees of roots(symbol_id); below several roots: a row for each.

    rank: place in pre-order, siblings by (ordinal, kind, name, id); size: of the symbol's own subtree. A rank is that of the parent, plus
    one, plus the sizes of earlier siblings. Only roots and symbols with children, often few, are climbed and kept; the others are
    placed beside their siblings, by one exchange. ``symbols`` is read a few times, so it should be a stored table.
    """
    rows = symbols.select("symbol_id", "parent_id", "ordinal", "kind", "name")
    marks = rows.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")).select(F.col("parent_id").alias("i_id"), "n", F.lit(False).alias("root"))
    marks = marks.unionAll(roots.select("symbol_id", F.lit(0).cast("long"), F.lit(True))).groupBy("i_id").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    inner = stored(rows.select("symbol_id", "parent_id").join(marks, F.col("symbol_id") == F.col("i_id")).drop("i_id"))
    pairs = stored(subtree(inner, inner.where("root").select("symbol_id")))
    within = stored(inner.join(pairs.select("symbol_id").distinct(), "symbol_id", "left_semi"))
    under = stored(pairs.where("depth > 0").select(F.col("symbol_id").alias("u_id")).distinct())
    flat = under.isEmpty()
    below = rows.where("parent_id is not null")
    if flat:
        sizes = within.select("symbol_id", (F.col("n") + 1).alias("size"))
        below = below.withColumn("size", F.lit(1).cast("long"))
    else:
        counted = within.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("m")).withColumnRenamed("parent_id", "c_id")
        own = within.join(counted, F.col("symbol_id") == F.col("c_id"), "left").select("symbol_id", "parent_id", (F.col("n") - F.coalesce("m", F.lit(0)) + 1).alias("n"))
        sizes = stored(_subtree_sums(own))
        below = below.join(sizes, "symbol_id", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    earlier = Window.partitionBy("parent_id").orderBy("ordinal", "kind", "name", "symbol_id").rowsBetween(Window.unboundedPreceding, -1)
    below = below.join(within.select(F.col("symbol_id").alias("parent_id")), "parent_id", "left_semi").withColumn("after", F.coalesce(F.sum("size").over(earlier), F.lit(0)) + 1)
    at = pairs.withColumn("rank", F.lit(1).cast("long"))
    if not flat:
        totals = stored(_chain_sums(below.join(under, F.col("symbol_id") == F.col("u_id"), "left_semi").select(F.col("symbol_id").alias("id"), F.col("parent_id").alias("up"), F.col("after").alias("n"))))
        of = lambda name: totals.select(F.col("id").alias(f"{name}_t"), F.col("total").alias(name))
        ranked = pairs.join(of("low"), F.col("symbol_id") == F.col("low_t"), "left").join(of("high"), F.col("root_id") == F.col("high_t"), "left")
        at = stored(ranked.select("root_id", "symbol_id", "depth", (F.coalesce("low", F.lit(0)) - F.coalesce("high", F.lit(0)) + 1).alias("rank")))
    heads = at.where("depth = 0").join(sizes, "symbol_id").select("root_id", "symbol_id", "depth", "rank", "size")
    over = at.select("root_id", F.col("symbol_id").alias("parent_id"), F.col("depth").alias("p_depth"), F.col("rank").alias("p_rank"))
    return heads.unionAll(below.join(over, "parent_id").select("root_id", "symbol_id", (F.col("p_depth") + 1).alias("depth"), (F.col("p_rank") + F.col("after")).alias("rank"), "size"))


def pre_order(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, symbol_id, depth, rank): parents before children, siblings by (ordinal, kind, name, id)."""
    return placed(symbols, roots).select("root_id", "symbol_id", "depth", F.col("rank").cast("int").alias("rank"))


def delete_order(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, symbol_id, rank): post-order, children in order before their parent.

    What comes before a symbol in pre-order but not in post-order are its ancestors, and the other way round its descendants.
    """
    return placed(symbols, roots).select("root_id", "symbol_id", (F.col("rank") + F.col("size") - 1 - F.col("depth")).cast("int").alias("rank"))


def subgraph(symbols: DataFrame, references: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(symbol_id): symbols whose root is one of them, and references with both ends among those."""
    within = settled(root_ancestor(symbols).join(files.select(F.col("symbol_id").alias("root_id")), "root_id", "left_semi").select("symbol_id"))
    kept = symbols.join(within, "symbol_id", "left_semi")
    ids = within.select(F.col("symbol_id").alias("s"))
    links = references.join(ids, F.col("from_symbol_id") == F.col("s"), "left_semi").join(ids, F.col("to_symbol_id") == F.col("s"), "left_semi")
    return kept, links
