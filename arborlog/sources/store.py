"""Tables of a repository as Parquet below one folder, with guarded appends of operations.

Spark has no transactions over plain files, so one driver writes a store at a time: a lock in the driver puts
its appends in turn, and each append checks the tail that it was planned on. Every write is one Parquet
folder of its own, so readers see all of a batch or nothing of it.
"""

from __future__ import annotations

import datetime
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.schema import PAYLOAD, TABLES

_lock = threading.RLock()


class Conflict(RuntimeError):
    """The branch moved on since the append was planned."""


class Store:
    """Tables under ``root``, any path that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- tables

    def table(self, name: str) -> DataFrame:
        """All rows of a table; empty if nothing was written. Tables are partitioned by write, operations and snapshots also by branch."""
        path = next((p for p in (name, f"{name}.old") if self._fs(p).exists(self._path(p))), None)
        if path is None:
            return self.spark.createDataFrame([], TABLES[name])
        path = f"{self.root}/{path}"
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", False).parquet(path).select(*TABLES[name].fieldNames())

    def _append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, TABLES[name])
        parts = ["branch_id"] if name in ("operations", "source_file_snapshots") else []
        df.select(*TABLES[name].fieldNames()).write.mode("append").partitionBy(*parts).parquet(f"{self.root}/{name}")

    @staticmethod
    def _now() -> datetime.datetime:
        return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)

    # --- point lookups

    def one(self, name: str, /, **key) -> dict:
        """The row with these values; an error if there is none."""
        df = self.table(name)
        for k, v in key.items():
            df = df.where(F.col(k) == v)
        row = df.first()
        if row is None:
            raise LookupError(f"{name} {', '.join(map(str, key.values()))} does not exist")
        return row.asDict()

    def find(self, name: str, /, **key) -> dict | None:
        try:
            return self.one(name, **key)
        except LookupError:
            return None

    # --- writing

    def repository(self, name: str) -> dict:
        """Get or create."""
        with _lock:
            if (row := self.find("repositories", name=name)) is None:
                self._append("repositories", [(str(uuid.uuid4()), name, self._now())])
                row = self.one("repositories", name=name)
            return row

    def main(self, repository_id: str) -> dict:
        return self.branch(repository_id, "main")

    def branch(self, repository_id: str, name: str, base: str | None = None) -> dict:
        """Get or create. A new branch forks at the end of its base; the fork point of an existing one never changes."""
        with _lock:
            if (row := self.find("branches", repository_id=repository_id, name=name)) is None:
                at = 0 if base is None else self.length(base)
                self._append("branches", [(str(uuid.uuid4()), repository_id, name, base, at, self._now())])
                row = self.one("branches", repository_id=repository_id, name=name)
            return row

    def task(self, repository_id: str, title: str) -> str:
        i = str(uuid.uuid4())
        self._append("tasks", [(i, repository_id, title, self._now())])
        return i

    def changeset(self, repository_id: str, task_id: str, branch_id: str, title: str, created_by: str = "human") -> str:
        i = str(uuid.uuid4())
        self._append("changesets", [(i, repository_id, task_id, branch_id, title, created_by, self._now())])
        return i

    def attach(self, repository_id: str, entity_type: str, entity_id: str, kind: str, payload: dict) -> str:
        i = str(uuid.uuid4())
        self._append("attachments", [(i, repository_id, entity_type, entity_id, kind, json.dumps(payload, sort_keys=True), self._now())])
        return i

    def slice(self, repository_id: str, branch_id: str, roots: list[str], base_position: int | None = None) -> str:
        if self.one("branches", id=branch_id)["repository_id"] != repository_id:
            raise ValueError("the branch belongs to another repository")
        at = self.length(branch_id) if base_position is None else base_position
        if at < 0:
            raise ValueError("a position can't be negative")
        i = str(uuid.uuid4())
        self._append("slices", [(i, repository_id, branch_id, at, roots, self._now())])
        return i

    def tail(self, branch_id: str) -> int:
        """Last own position of a branch."""
        return self.table("operations").where(F.col("branch_id") == branch_id).agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]

    def length(self, branch_id: str) -> int:
        """Number of operations that a branch sees."""
        return self.one("branches", id=branch_id)["base_position"] + self.tail(branch_id)

    def append(self, branch_id: str, changeset_id: str, payloads: list[dict], expected: int | None = None) -> list[int]:
        """Append operations in turn at the next positions, without gaps, as one write. expected: the tail that the caller knows."""
        if not payloads:
            return []
        with _lock:
            branch, tail = self.one("branches", id=branch_id), self.tail(branch_id)
            if expected is not None and expected != tail:
                raise Conflict(f"branch {branch_id} advanced from position {expected} to {tail}; retry merge")
            now = self._now()
            rows = [(str(uuid.uuid4()), branch["repository_id"], branch_id, changeset_id, tail + i, p["type"], json.dumps(p, sort_keys=True), now) for i, p in enumerate(payloads, 1)]
            self._append("operations", rows)
            return [r[4] for r in rows]

    def append_table(self, branch_id: str, changeset_id: str, ops: DataFrame, expected: int | None = None) -> list[int]:
        """Append a table of operations (position, op_type, wide columns) in order of position, as one write, whatever its size."""
        from arborlog.operators.merge import appended

        with _lock:
            branch, tail = self.one("branches", id=branch_id), self.tail(branch_id)
            if expected is not None and expected != tail:
                raise Conflict(f"branch {branch_id} advanced from position {expected} to {tail}; retry merge")
            move = F.col("op_type") == "MoveSymbol"
            payload = F.to_json(F.struct(
                F.col("op_type").alias("type"), F.col("symbol_id").alias("symbolId"), F.when(~move, F.col("parent_id")).alias("parentId"), "kind", "name", "body", "metadata",
                F.when(move, F.col("parent_id")).alias("newParentId"), F.col("reference_id").alias("referenceId"), F.col("from_symbol_id").alias("fromSymbolId"), F.col("to_symbol_id").alias("toSymbolId"),
            ))
            rows = appended(ops, branch_id, tail, changeset_id).withColumn("payload", payload)
            rows = rows.select(F.col("op_id").alias("id"), F.lit(branch["repository_id"]).alias("repository_id"), "branch_id", "changeset_id", "position", "op_type", "payload", F.lit(self._now()).alias("created_at"))
            self._append("operations", rows)
            return list(range(tail + 1, self.tail(branch_id) + 1))

    def replace_snapshots(self, branch_id: str, rows: DataFrame) -> None:
        """A branch's snapshots become these rows; other branches' stay."""
        df = rows.withColumn("branch_id", F.lit(branch_id)).select(*TABLES["source_file_snapshots"].fieldNames())
        with _lock:
            if df.isEmpty():
                self._drop(f"source_file_snapshots/branch_id={branch_id}")
            else:
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch_id").parquet(f"{self.root}/source_file_snapshots")

    def delete_repository(self, repository_id: str) -> None:
        """The repository and all its rows go: each table is rewritten without them, beside the old one, then put in its place.

        The old table is moved aside first and dropped last; ``table`` reads the one that is whole if a crash comes between.
        """
        with _lock:
            for name in TABLES:
                own = "id" if name == "repositories" else "repository_id"
                rest, new = self.table(name).where(F.col(own) != repository_id), f"{name}.new"
                if rest.isEmpty():
                    self._drop(name)
                    continue
                parts = ["branch_id"] if name in ("operations", "source_file_snapshots") else []
                rest.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{new}")
                self._drop(f"{name}.old")
                self._fs(name).rename(self._path(name), self._path(f"{name}.old"))
                self._fs(new).rename(self._path(new), self._path(name))
                self._drop(f"{name}.old")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _drop(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    # --- reading logs

    def operations(self) -> DataFrame:
        """Operations with their payload as columns; a row whose payload can't be read fails the query."""
        p = F.from_json("payload", PAYLOAD, {"mode": "FAILFAST"})
        ops = self.table("operations").withColumn("p", p)
        return ops.select(
            "branch_id", "position", F.col("id").alias("op_id"), "op_type", F.col("p.symbolId").alias("symbol_id"),
            F.when(F.col("op_type") == "MoveSymbol", F.col("p.newParentId")).otherwise(F.col("p.parentId")).alias("parent_id"), F.col("p.kind").alias("kind"), F.col("p.name").alias("name"),
            F.col("p.body").alias("body"), F.col("p.metadata").alias("metadata"), F.col("p.referenceId").alias("reference_id"),
            F.col("p.fromSymbolId").alias("from_symbol_id"), F.col("p.toSymbolId").alias("to_symbol_id"), "changeset_id", "created_at",
        )
