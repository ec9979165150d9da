"""From edited files back to a plan of operations: read the files again, then compare with the state that they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.handlers.router import import_files, render_files
from arborlog.operators import diff


def _state(symbols: DataFrame) -> DataFrame:
    """Symbols of files as a state; their place in the file is their order, which puts parents first."""
    return symbols.select("symbol_id", "parent_id", "kind", "name", "body", "metadata", F.col("seq").alias("ordinal"))


def recover_files(symbols: DataFrame, references: DataFrame, edited: DataFrame, relink: bool = True, all_references: bool = True) -> DataFrame:
    """The plan (phase, seq, op_type, ...) that edits of files stand for.

    symbols, references: the state as ``import_files`` gives it; edited(path, content): the edited files, each whole. Files that
    aren't among them stay as they are, an edited path that the state lacks is a new file, and an empty text is an empty file.
    relink: the other files are rendered and read once more, so that names and links across files resolve; without it only the
    edited files are read, and references between them and others count as unchanged.
    """
    edited = edited.select("path", "content")
    paths = edited.select("path").distinct()
    if relink:
        others = symbols.join(paths, "path", "left_anti")
        read, links = import_files(render_files(others).unionByName(edited))
    else:
        read, links = import_files(edited)
        own = symbols.join(paths, "path", "left_semi").select("symbol_id")
        ends = [references.join(own, F.col(end) == F.col("symbol_id"), "left_anti") for end in ("from_symbol_id", "to_symbol_id")]
        links = links.unionByName(ends[0].unionByName(ends[1]).select(*links.columns).distinct()).distinct()
    files = lambda rows: rows.join(paths, "path", "left_semi").where("seq = 0").select(F.col("symbol_id").alias("file_id"))
    return diff.recover(_state(symbols), references, _state(read), links, scope=files(symbols), create_scope=files(read), all_references=all_references)
