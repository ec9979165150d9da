"""Cutting lineage, so that long plans stay small and lost executors lose nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that checkpoints go to: the one that ``spark.checkpoint.dir`` names.

    Where nothing names one, a temporary folder is taken if driver and executors are one process, else this fails: a folder of one
    machine would be out of the others' sight.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder as compressed Parquet, with its lineage cut: for large tables, as checkpoints aren't compressed.

    The files of its shuffles go as soon as it is written, and the table itself when the driver ends.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    at, was = f"{shared_folder(spark)}/stored/{uuid.uuid4().hex}", spark.conf.get(key, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(at)
