"""A repository: named DataFrames. State changes return a new one; a saved version is never overwritten."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import schema


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset in a local session (tests, bench), an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = at.get() if at.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back. The table stays, as results read it until they are saved themselves."""
    path = f"{shared_folder(df.sparkSession)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Repository:
    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in schema.TABLES:
            raise AttributeError(name)
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], schema.schema(name))

    def replace(self, **tables: DataFrame) -> Repository:
        return Repository(self.spark, {**self.tables, **tables})

    @classmethod
    def empty(cls, spark: SparkSession) -> Repository:
        return cls(spark)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self, path: str) -> list[int]:
        """Versions that were written to their end."""
        fs, where = self._fs(path)
        if not fs.exists(where):
            return []
        new = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(new(f"{path}/{n}/_DONE")))

    def save(self, path: str) -> int:
        """Write all tables as the next version; its marker is written last, so readers never see half a version."""
        version = max(self.versions(path), default=0) + 1
        for name, df in self.tables.items():
            writer = df.write
            if name == "snapshot_file":
                writer = writer.partitionBy("snapshot_id")
            writer.parquet(f"{path}/v{version}/{name}")
        fs, _ = self._fs(path)
        fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}/_DONE")).close()
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Repository:
        empty = cls(spark)
        version = version or max(empty.versions(path))
        fs, _ = empty._fs(path)
        new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return cls(spark, {n: spark.read.schema(schema.schema(n)).parquet(f"{path}/v{version}/{n}") for n in schema.TABLES if fs.exists(new(f"{path}/v{version}/{n}"))})
