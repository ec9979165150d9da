"""Schemas of the persisted tables and of the wide operation row."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def struct(ddl: str) -> T.StructType:
    """A struct of "name type" pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


OP_TYPES = ("CreateSymbol", "DeleteSymbol", "UpdateSymbol", "MoveSymbol", "CreateReference", "DeleteReference")

#: One operation of a log; columns that its type doesn't use are null.
OPERATION = struct(
    "log_id string, ordinal long, op_id string, op_type string, symbol_id string, parent_id string, kind string, "
    "name string, body string, metadata string, reference_id string, from_symbol_id string, to_symbol_id string"
)
OPERATION_COLUMNS = OPERATION.fieldNames()

#: The persisted tables.
TABLES: dict[str, T.StructType] = {
    name: struct(ddl)
    for name, ddl in {
        "repositories": "id string, name string, created_at timestamp",
        "branches": "id string, repository_id string, name string, base_branch_id string, base_position long, created_at timestamp",
        "tasks": "id string, repository_id string, title string, created_at timestamp",
        "changesets": "id string, repository_id string, task_id string, branch_id string, title string, created_by string, created_at timestamp",
        "operations": "id string, repository_id string, branch_id string, changeset_id string, position long, op_type string, payload string, created_at timestamp",
        "attachments": "id string, repository_id string, entity_type string, entity_id string, attachment_type string, payload string, created_at timestamp",
        "slices": "id string, repository_id string, branch_id string, base_position long, root_symbols array<string>, created_at timestamp",
        "source_file_snapshots": "branch_id string, path string, repository_id string, content_hash string, byte_len long, handler string, file_symbol_id string, last_import_position long, importer_version string, updated_at timestamp",
    }.items()
}

#: JSON payload of an operation: internally tagged, camelCase fields.
PAYLOAD = struct(
    "type string, symbolId string, parentId string, kind string, name string, body string, metadata string, "
    "newParentId string, referenceId string, fromSymbolId string, toSymbolId string"
)
