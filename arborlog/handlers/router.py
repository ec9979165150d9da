"""The registry: which handler reads a file, and import, rendering and checks of file tables in Spark."""

from __future__ import annotations

import json
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlog.handlers.base import Handler, Symbol, Unparseable
from arborlog.handlers.code import CSharp, Elixir, Go, Rust, TypeScript
from arborlog.handlers.data import Blob, Json, Toml, Yaml
from arborlog.handlers.markdown import Markdown
from arborlog.handlers.python import Python

#: In order; the first that claims a file reads it, and blob claims all.
HANDLERS: list[Handler] = [TypeScript(), Go(), Rust(), Python(), CSharp(), Elixir(), Json(), Markdown(), Toml(), Yaml(), Blob()]
_BY_NAME = {h.name: h for h in HANDLERS}

SYMBOLS = "path string, handler string, seq long, symbol_id string, parent_id string, kind string, name string, body string, metadata string, error string"
_CALLS = "source string, path string, name string, how string"


def handler_of(path: Column) -> Column:
    """Name of the handler that claims a path, as an expression."""
    out = F.when(F.lit(False), "")
    for h in HANDLERS:
        if h.suffixes:
            out = out.when(F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in h.suffixes) + ")$") & ~F.lower(path).rlike(r"(\.d\.ts|_test\.go)$"), h.name)
    return out.otherwise("blob")


def _read(path: str, content: str, strict: bool) -> tuple[Handler, list[Symbol], list, str | None]:
    handler = next(h for h in HANDLERS if h.claims(path))
    try:
        symbols, calls = handler.shred(path, content)
    except Unparseable as e:
        if strict:
            raise
        handler = _BY_NAME["blob"]
        symbols, calls = handler.shred(path, content)
        return handler, symbols, calls, str(e)
    return handler, symbols, calls, None


def import_files(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """files(path, content) -> symbols (SYMBOLS) and references(reference_id, from_symbol_id, to_symbol_id, kind).

    Each file is read alone; one that its handler can't parse becomes a blob with the error, or with ``strict`` fails the
    import. Names that are used are resolved by joins over all files' symbols, by rules that ask for unique names.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                handler, symbols, calls, error = _read(path, content or "", strict)
                by_source = defaultdict(list)
                for c in calls:
                    by_source[c.source].append([c.name, c.how])
                for i, s in enumerate(symbols):
                    used = json.dumps(by_source[s.id]) if s.id in by_source else None
                    rows.append((path, handler.name, i, s.id, s.parent, s.kind, s.name, s.body, json.dumps(s.metadata, sort_keys=True, ensure_ascii=False), error if i == 0 else None, used))
            yield pd.DataFrame(rows, columns=["path", "handler", "seq", "symbol_id", "parent_id", "kind", "name", "body", "metadata", "error", "uses"])

    read = files.select("path", "content").mapInPandas(run, SYMBOLS + ", uses string")
    return read.drop("uses"), _resolved(read)


def _resolved(read: DataFrame) -> DataFrame:
    uses = read.where("uses is not null").select(F.col("symbol_id").alias("source"), F.col("parent_id").alias("home"), F.explode(F.from_json("uses", "array<array<string>>")).alias("u")).select("source", "home", F.col("u")[0].alias("called"), F.col("u")[1].alias("how")).distinct()
    code = read.where("kind in ('function', 'method', 'class')").select("symbol_id", "parent_id", "kind", "name")
    unique = code.groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("target")).where("n = 1")
    calls = F.lit("calls").alias("kind")
    local = uses.where("how = 'local'").join(code.where("kind = 'method'"), (F.col("home") == F.col("parent_id")) & (F.col("called") == F.col("name"))).select("source", F.col("symbol_id").alias("target"), calls)
    by = lambda how, kind: uses.where(F.col("how") == how).join(unique.where(F.col("kind") == kind).drop("kind"), F.col("called") == F.col("name")).select("source", "target", calls)
    anchors = read.where("kind in ('file', 'section')").select(
        F.when(F.col("kind") == "file", F.col("path")).otherwise(F.concat("path", F.lit("#"), F.get_json_object("metadata", "$.anchor"))).alias("place"), F.struct("seq", "symbol_id").alias("s")
    ).groupBy("place").agg(F.min("s").alias("s"))
    links = uses.where("how in ('links-to', 'embeds')").join(anchors, F.col("called") == F.col("place")).select("source", F.col("s.symbol_id").alias("target"), F.col("how").alias("kind"))
    found = local.unionAll(by("bare", "function")).unionAll(by("member", "method")).unionAll(links).where("source <> target").distinct()
    from arborlog.functions import stable_id

    seed = F.concat(F.lit("reference:"), "source", F.lit(":"), "target", F.lit(":"), "kind")
    return found.select(stable_id("", seed).alias("reference_id"), F.col("source").alias("from_symbol_id"), F.col("target").alias("to_symbol_id"), "kind")


def render_files(symbols: DataFrame) -> DataFrame:
    """symbols (SYMBOLS: path, handler, seq, ...) -> (path, content).

    A file's symbols are gathered by an aggregate in the JVM, as a file is bounded; blobs are put out there as well, and the other
    handlers render many files a batch.
    """
    part = F.struct("seq", "symbol_id", "parent_id", "kind", "name", "body", "metadata")
    blobs = symbols.where("handler = 'blob' and seq = 0").select("path", F.coalesce("body", F.lit("")).alias("content"))
    files = symbols.where("handler <> 'blob'").groupBy("path", "handler").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def run(batches):
        for b in batches:
            out = []
            for handler, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = [Symbol(p["symbol_id"], p["parent_id"], p["kind"], p["name"], p["body"], json.loads(p["metadata"] or "{}")) for p in parts]
                out.append(_BY_NAME[handler].render(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "content"])

    return blobs.unionAll(files.mapInArrow(run, "path string, content string"))


def slice_files(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """The rendered files (path, content) that hold any of roots(symbol_id); unknown ids are left out, and each file comes once."""
    paths = symbols.join(roots.select("symbol_id").distinct(), "symbol_id", "left_semi").select("path").distinct()
    return render_files(symbols.join(paths, "path", "left_semi"))


def validate_files(files: DataFrame) -> DataFrame:
    """(path, ok, error) by each file's handler: JSON, TOML and YAML are parsed, Python is compiled, other files pass."""

    def run(batches):
        for pdf in batches:
            errors = [next(h for h in HANDLERS if h.claims(p)).check(p, c or "") for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "ok": [e is None for e in errors], "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, error string")


def as_operations(symbols: DataFrame, references: DataFrame, log_id: str = "import") -> DataFrame:
    """Operations that create the symbols, file by file, then the references, with ordinals from 1."""
    none = F.lit(None).cast("string")
    made = symbols.select(F.lit(1).alias("stage"), F.col("path").alias("a"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("b"), F.lit("CreateSymbol").alias("op_type"), "symbol_id", "parent_id", "kind", "name", "body", "metadata", none.alias("reference_id"), none.alias("from_symbol_id"), none.alias("to_symbol_id"))
    linked = references.select(F.lit(2), F.col("reference_id"), F.lit(""), F.lit("CreateReference"), none, none, "kind", none, none, none, "reference_id", "from_symbol_id", "to_symbol_id")
    from arborlog.operators.ranks import dense_positions

    rows = dense_positions(made.unionAll(linked), "ordinal", F.struct("stage", F.substring("a", 1, 8).alias("p")), ["a", "b"])
    return rows.select(F.lit(log_id).alias("log_id"), "ordinal", F.concat(F.lit(f"{log_id}:"), "ordinal").alias("op_id"), "op_type", "symbol_id", "parent_id", "kind", "name", "body", "metadata", "reference_id", "from_symbol_id", "to_symbol_id")
