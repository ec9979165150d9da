"""States kept as Parquet, so that questions about a log don't replay it each time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlog.operators.lineage import shared_folder

State = tuple[DataFrame, DataFrame]


class StateCache:
    """Symbols and references of a branch, by the number and the fingerprint of the operations that made them.

    A state that was asked for with the same key is read, any other is made and written. It stands in its folder under a name that the
    key alone gives, and counts once Spark has marked it as whole, so a writer that dies leaves nothing that is read. Ids are
    sorted inside the files: a question about few ids skips what it doesn't need.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_folder(spark)}/states").rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def place(self, branch: str, count: int, fingerprint: str) -> str:
        return f"{self.folder}/{hashlib.sha256(f'{branch}|{count}|{fingerprint}'.encode()).hexdigest()}"

    def get(self, branch: str, count: int, fingerprint: str, make: Callable[[], State]) -> tuple[DataFrame, DataFrame, str]:
        """(symbols, references, HIT or MISS)."""
        at, status = self._filled(branch, count, fingerprint, make, ("symbols", "references"))
        return self.spark.read.parquet(f"{at}/symbols"), self.spark.read.parquet(f"{at}/references"), status

    def symbols(self, branch: str, count: int, fingerprint: str, make: Callable[[], State]) -> DataFrame:
        """The symbols alone; where they aren't there yet, references aren't written with them."""
        return self.spark.read.parquet(f"{self._filled(branch, count, fingerprint, make, ('symbols',))[0]}/symbols")

    def _filled(self, branch: str, count: int, fingerprint: str, make: Callable[[], State], names: tuple[str, ...]) -> tuple[str, str]:
        at = self.place(branch, count, fingerprint)
        lacking = [name for name in names if not self._exists(f"{at}/{name}/_SUCCESS")]
        if lacking:
            made = dict(zip(("symbols", "references"), make()))
            for name in lacking:
                made[name].sortWithinPartitions(f"{name[:-1]}_id").write.mode("overwrite").parquet(f"{at}/{name}")
        return at, "MISS" if lacking else "HIT"


def files_fingerprint(spark: SparkSession, paths: list[str]) -> tuple[int, str]:
    """(number of files, SHA-256 over their names, sizes and times) of files or folders."""
    jvm, found = spark._jvm, []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        it = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while it.hasNext():
            s = it.next()
            found.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    return len(found), hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
