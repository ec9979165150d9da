"""Plans of change: from a base state to a desired one, from a file tree to the next, between two versions of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlog.functions import sha256_hex
from arborlog.operators import hierarchy
from arborlog.operators.lineage import settled

IMPORTER_VERSION = "source-snapshot-v1"
PHASES = {"DeleteReference": 1, "DeleteSymbol": 2, "UpdateSymbol": 3, "CreateSymbol": 4, "CreateReference": 5}
_COLUMNS = ["symbol_id", "parent_id", "kind", "name", "body", "metadata", "reference_id", "from_symbol_id", "to_symbol_id"]


def _plan(df: DataFrame, op_type: str, order, **columns) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(PHASES[op_type]).alias("phase"), order.alias("seq"), F.lit(op_type).alias("op_type"), *[columns.get(c, none).cast("string").alias(c) for c in _COLUMNS])


def changed_fields(base: DataFrame, desired: DataFrame) -> DataFrame:
    """Symbols in both whose name, body or metadata differ, with the fields to write (null: unchanged).

    A body can't be written to null, so such a change is left out, and a symbol with no other isn't updated.
    """
    b = base.select("symbol_id", F.col("name").alias("b_name"), F.col("body").alias("b_body"), F.col("metadata").alias("b_metadata"))
    d = desired.select("symbol_id", "name", "body", "metadata")
    differs = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.col(c))
    return d.join(b, "symbol_id").select("symbol_id", differs("name").alias("name"), differs("body").alias("body"), differs("metadata").alias("metadata")).where("name is not null or body is not null or metadata is not null")


def recover(base: DataFrame, base_refs: DataFrame, desired: DataFrame, desired_refs: DataFrame, scope: DataFrame | None = None, create_scope: DataFrame | None = None, all_references: bool = True) -> DataFrame:
    """The ordered plan (phase, seq, op_type, ...) that turns base into desired.

    scope(file_id): files to look at; by default all files. Symbols below them that desired lacks
    go with their subtrees, children first; those in both are updated; symbols new in desired are created in its order, if
    create_scope(file_id) is given only below those files. References go if desired lacks them and an end was
    deleted or their source changed; desired ones that base lacks are made, all or only from changed symbols.
    seq orders a phase; deletions go from the deepest level up, so that each symbol goes after its children.
    """
    base, desired = settled(base), settled(desired)
    files = base.where("parent_id is null and kind = 'file'").select("symbol_id") if scope is None else scope.select(F.col("file_id").alias("symbol_id")).distinct()
    target = settled(hierarchy.inside(base, files).select("symbol_id"))
    missing = settled(target.join(desired.select("symbol_id"), "symbol_id", "left_anti"))
    gone = settled(hierarchy.inside(base, missing).select("symbol_id"))
    depth = hierarchy.root_ancestor(base).join(gone, "symbol_id", "left_semi").select("symbol_id", "depth")
    updates = settled(changed_fields(base.join(target, "symbol_id", "left_semi"), desired))
    creates = desired.join(base.select("symbol_id"), "symbol_id", "left_anti")
    if create_scope is not None:
        within = hierarchy.nearest_file(desired).join(create_scope.select("file_id").distinct(), "file_id", "left_semi").select("symbol_id")
        creates = creates.join(within, "symbol_id", "left_semi")
    creates = settled(creates)
    changed = gone.unionAll(updates.select("symbol_id")).unionAll(creates.select("symbol_id"))
    lost = base_refs.join(desired_refs.select("reference_id"), "reference_id", "left_anti")
    at = lambda ids, end: F.col(end) == ids
    c, g = changed.select(F.col("symbol_id").alias("x")), gone.select(F.col("symbol_id").alias("x"))
    unlinked = lost.join(c, at(F.col("x"), "from_symbol_id"), "left_semi").unionAll(lost.join(g, at(F.col("x"), "to_symbol_id"), "left_semi")).select("reference_id").distinct()
    linked = desired_refs.join(base_refs.select("reference_id"), "reference_id", "left_anti")
    if not all_references:
        linked = linked.join(c, at(F.col("x"), "from_symbol_id"), "left_semi")
    col, born = F.col, base.select("symbol_id", F.col("ordinal").alias("born"))
    last = F.lit(1 << 40)
    out = [
        _plan(unlinked, "DeleteReference", col("reference_id"), reference_id=col("reference_id")),
        _plan(depth.join(born, "symbol_id"), "DeleteSymbol", F.concat(F.lpad((last - col("depth")).cast("string"), 20, "0"), F.lit("/"), F.lpad(col("born").cast("string"), 20, "0"), F.lit("/"), col("symbol_id")), symbol_id=col("symbol_id")),
        _plan(updates, "UpdateSymbol", col("symbol_id"), symbol_id=col("symbol_id"), name=col("name"), body=col("body"), metadata=col("metadata")),
        _plan(creates, "CreateSymbol", F.lpad(col("ordinal").cast("string"), 20, "0"), symbol_id=col("symbol_id"), parent_id=col("parent_id"), kind=col("kind"), name=col("name"), body=col("body"), metadata=col("metadata")),
        _plan(linked, "CreateReference", col("reference_id"), reference_id=col("reference_id"), from_symbol_id=col("from_symbol_id"), to_symbol_id=col("to_symbol_id"), kind=col("kind")),
    ]
    plan = out[0]
    for x in out[1:]:
        plan = plan.unionAll(x)
    return plan


def ingest_plan(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """files(path, content) against snapshots(path, content_hash, importer_version) -> (path, state): unchanged, changed, added, deleted."""
    now = files.select("path", sha256_hex(F.col("content")).alias("hash"))
    then = snapshots.select("path", "content_hash", "importer_version")
    same = (F.col("hash") == F.col("content_hash")) & (F.col("importer_version") == IMPORTER_VERSION)
    state = F.when(F.col("hash").isNull(), "deleted").when(F.col("content_hash").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return now.join(then, "path", "full_outer").select("path", state.alias("state"))


def import_mode(n_ops: int, n_snapshots: int, reset: bool) -> str:
    """full or incremental; a branch with operations but no snapshots is refused unless it is reset."""
    if reset or n_ops == 0:
        return "full"
    if n_snapshots == 0:
        raise ValueError("the branch has operations but no source snapshots; reset it to import again")
    return "incremental"


def roundtrip_buckets(source: DataFrame, rendered: DataFrame) -> DataFrame:
    """source and rendered (path, content) -> (path, bucket): clean, reformatted, dropped, added."""
    s, r = source.select("path", F.col("content").alias("s")), rendered.select("path", F.col("content").alias("r"))
    bucket = F.when(F.col("r").isNull(), "dropped").when(F.col("s").isNull(), "added").when(F.col("s") == F.col("r"), "clean").otherwise("reformatted")
    return s.join(r, "path", "full_outer").select("path", bucket.alias("bucket"))


def blob_diff(original: DataFrame, modified: DataFrame) -> DataFrame:
    """(path, content) before and after -> (path, op_type) of those that differ."""
    a, b = original.select("path", F.col("content").alias("a")), modified.select("path", F.col("content").alias("b"))
    op = F.when(F.col("a").isNull(), "CreateSymbol").when(F.col("b").isNull(), "DeleteSymbol").when(F.col("a") != F.col("b"), "UpdateSymbol")
    return a.join(b, "path", "full_outer").select("path", op.alias("op_type")).where("op_type is not null")


def changed_paths(base: DataFrame, head: DataFrame, since: DataFrame) -> DataFrame:
    """(path) of the files, in the state at base or at head, of symbols that operations since then name."""
    touched = since.select(F.explode(F.array("symbol_id", "parent_id", "from_symbol_id", "to_symbol_id")).alias("symbol_id")).where("symbol_id is not null").distinct()

    def paths(state: DataFrame) -> DataFrame:
        files = hierarchy.nearest_file(state, state.join(touched, "symbol_id", "left_semi")).select(F.col("file_id").alias("symbol_id")).distinct()
        return state.join(files, "symbol_id", "left_semi").select(F.coalesce(F.get_json_object("metadata", "$.path"), F.col("name")).alias("path"))

    return paths(base).unionAll(paths(head)).distinct()


def delete_files(symbols: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """The plan (phase, seq, op_type, ...) that takes files(symbol_id) out: references at any of their symbols, then the symbols, children first.

    References go in order of (ordinal, id), symbols from the deepest level up, so that each goes after its children.
    """
    gone = settled(hierarchy.inside(symbols, files).select("symbol_id", "depth"))
    ids = gone.select(F.col("symbol_id").alias("x"))
    cut = references.join(ids, F.col("from_symbol_id") == F.col("x"), "left_semi").unionAll(references.join(ids, F.col("to_symbol_id") == F.col("x"), "left_semi")).select("reference_id", "ordinal").distinct()
    born = gone.join(symbols.select("symbol_id", "ordinal"), "symbol_id")
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    links = _plan(cut, "DeleteReference", F.concat(number(F.col("ordinal")), F.lit("/"), F.col("reference_id")), reference_id=F.col("reference_id"))
    deepest_first = F.concat(number(F.lit(1 << 40) - F.col("depth")), F.lit("/"), number(F.col("ordinal")), F.lit("/"), F.col("symbol_id"))
    return links.unionAll(_plan(born, "DeleteSymbol", deepest_first, symbol_id=F.col("symbol_id")))


def landing(touched: DataFrame, rendered: DataFrame) -> DataFrame:
    """touched(path) and rendered(path, content) -> (path, action, content): write what is rendered, delete touched paths that aren't."""
    return touched.select("path").distinct().join(rendered.select("path", "content"), "path", "left").select("path", F.when(F.col("content").isNull(), "delete").otherwise("write").alias("action"), "content")


def merged_plans(*plans: DataFrame) -> DataFrame:
    """Plans in turn -> one: deletions of references, then of symbols (each only once), then the rest in turn."""
    rows = plans[0].withColumn("turn", F.lit(0))
    for i, p in enumerate(plans[1:], start=1):
        rows = rows.unionAll(p.withColumn("turn", F.lit(i)))
    deletes = F.col("op_type").isin("DeleteReference", "DeleteSymbol")
    key = F.when(deletes, F.coalesce("reference_id", "symbol_id")).otherwise(F.concat_ws("|", "turn", "phase", "seq"))
    nth = F.row_number().over(Window.partitionBy("op_type", key).orderBy("turn", "phase", "seq"))
    block = F.when(F.col("op_type") == "DeleteReference", 1).when(F.col("op_type") == "DeleteSymbol", 2).otherwise(3)
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth").withColumn("block", block)
