"""Queries on a state: symbols(symbol_id, parent_id, kind, name, body, metadata, ordinal), references(reference_id, from_symbol_id, to_symbol_id, kind, ordinal).

Each takes a table of what is asked for, so that one point query and a query for all symbols are the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlog.functions import metadata_string
from arborlog.operators.ranks import dense_positions


def _ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def find_symbol(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """names(asked): symbols with exactly that name, ranked by (ordinal, id)."""
    return _ranked(symbols.join(names, F.col("name") == F.col("asked")), ["asked"], ["ordinal", "symbol_id"]).select("asked", "symbol_id", "kind", "ordinal", "rank")


def resolve(symbols: DataFrame, name: str) -> str:
    """Id of the first symbol of that name."""
    row = symbols.where(F.col("name") == name).orderBy("ordinal", "symbol_id").select("symbol_id").first()
    if row is None:
        raise LookupError(f"symbol {name} not found")
    return row["symbol_id"]


def children_of(symbols: DataFrame, parents: DataFrame) -> DataFrame:
    """parents(asked): their children, ranked by (ordinal, kind, name, id)."""
    return _ranked(symbols.join(parents, F.col("parent_id") == F.col("asked")), ["asked"], ["ordinal", "kind", "name", "symbol_id"]).select("asked", "symbol_id", "kind", "name", "rank")


def root_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without a parent, ranked by (ordinal, kind, name, id), without one window over all of them."""
    roots = symbols.where("parent_id is null").select("symbol_id", "kind", "name", "ordinal")
    return dense_positions(roots, "rank", F.floor(F.col("ordinal") / (1 << 14)), ["ordinal", "kind", "name", "symbol_id"]).select("symbol_id", "kind", "name", "rank")


def find_references(references: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(asked): references at either end, ranked by (ordinal, id). Two equi joins; a loop counts once."""
    at_from = references.join(ids, F.col("from_symbol_id") == F.col("asked"))
    at_to = references.where("not from_symbol_id <=> to_symbol_id").join(ids, F.col("to_symbol_id") == F.col("asked"))
    return _ranked(at_from.unionAll(at_to), ["asked"], ["ordinal", "reference_id"]).select("asked", "reference_id", "from_symbol_id", "to_symbol_id", "rank")


def _neighbours(symbols: DataFrame, references: DataFrame, ids: DataFrame, own: str, other: str, kind: str | None) -> DataFrame:
    refs = references if kind is None else references.where(F.col("kind") == kind)
    pairs = refs.select(F.col(own).alias("own"), F.col(other).alias("other")).join(ids, F.col("own") == F.col("asked")).select("asked", "other").distinct()
    found = pairs.join(symbols.select("symbol_id", "name", "ordinal"), F.col("other") == F.col("symbol_id"))
    return _ranked(found, ["asked"], ["ordinal", "symbol_id"]).select("asked", "symbol_id", "name", "rank")


def find_callers(symbols: DataFrame, references: DataFrame, ids: DataFrame, kind: str = "calls") -> DataFrame:
    return _neighbours(symbols, references, ids, "to_symbol_id", "from_symbol_id", kind)


def find_callees(symbols: DataFrame, references: DataFrame, ids: DataFrame, kind: str = "calls") -> DataFrame:
    return _neighbours(symbols, references, ids, "from_symbol_id", "to_symbol_id", kind)


def find_dependencies(symbols: DataFrame, references: DataFrame, ids: DataFrame) -> DataFrame:
    return _neighbours(symbols, references, ids, "from_symbol_id", "to_symbol_id", None)


def find_dependents(symbols: DataFrame, references: DataFrame, ids: DataFrame) -> DataFrame:
    return _neighbours(symbols, references, ids, "to_symbol_id", "from_symbol_id", None)


def file_symbols(symbols: DataFrame) -> DataFrame:
    """Root symbols of kind file, with the path of their metadata or else their name."""
    return symbols.where("parent_id is null and kind = 'file'").select("symbol_id", F.coalesce(metadata_string(F.col("metadata"), "path"), F.col("name")).alias("path"), "metadata")


def selected_symbol(symbols: DataFrame, wanted: str | None) -> DataFrame:
    """The wanted symbol if it is live, else the first root symbol: at most one row."""
    live = symbols.withColumn("pick", F.when(F.col("symbol_id") == F.lit(wanted), 0).when(F.col("parent_id").isNull(), 1))
    return live.where("pick is not null").orderBy("pick", "ordinal", "kind", "name", "symbol_id").limit(1).drop("pick")
