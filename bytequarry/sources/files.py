"""Byte sources: folders, JDBC databases, container files and their headers."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEADER_SIZE

MAGIC = b"BYTEQRY1"
_HEAD = struct.Struct("<8sHHQqq24x")  # 60 bytes, then the CRC32 of them


def folder(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Every file below a folder: path, mtime, size, content and its hash. A file is one row, so none may have 2 GiB or more;
    with `most`, a larger one is an error as well. None is left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.col("content")
    if most is not None:
        content = F.when(F.col("length") <= most, content).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path")).cast("binary"))
    return f.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), content.alias("content")).withColumn("file_hash", F.sha2("content", 256))


def with_metadata(files: DataFrame) -> DataFrame:
    """files with mode, uid, gid and whether all of it is known: of local files that the executors see; unknown (null) elsewhere."""
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("struct<mode: bigint, uid: bigint, gid: bigint>")
    def stat(paths: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import os
        import stat as st
        import urllib.parse

        for x in paths:
            rows = []
            for p in x:
                local = urllib.parse.unquote(urllib.parse.urlparse(p).path) if p.startswith("file:") else p
                try:
                    s = os.stat(local)
                    rows.append((st.S_IMODE(s.st_mode), s.st_uid, s.st_gid))
                except OSError:
                    rows.append((None, None, None))
            yield pd.DataFrame(rows, columns=["mode", "uid", "gid"], dtype="Int64")

    made = files.withColumn("_stat", stat("path")).select(*files.columns, "_stat.*")
    return made.withColumn("is_metadata_complete", F.col("mode").isNotNull() & F.col("uid").isNotNull() & F.col("gid").isNotNull())


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def open_repository(spark: SparkSession, kind: str, path: str = ""):
    from ..repository import Repository

    if kind == "simulated":
        return Repository.empty(spark)
    if kind in ("local", "remote"):
        return Repository.load(spark, path)
    raise ValueError(f"unknown storage {kind}")


def header(version: int, most: int, created: int) -> bytes:
    body = _HEAD.pack(MAGIC, version, HEADER_SIZE, most, created, 0)
    return body + struct.pack("<I", zlib.crc32(body))


def container_listing(spark: SparkSession, path: str) -> DataFrame:
    """filename, size and hash of the container files in a folder, as `container_file` has them."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_headers(containers: DataFrame) -> DataFrame:
    """path and whether its header is valid: magic, length and checksum, without reading Python. content: the file."""
    h = F.substring("content", 1, HEADER_SIZE)
    crc = F.substring("content", 61, 4)
    told = F.conv(F.hex(F.concat(*[F.substring(crc, k, 1) for k in (4, 3, 2, 1)])), 16, 10).cast("long")
    whole, legacy = (F.crc32(F.substring("content", 1, n)) == told for n in (60, 52))  # older headers leave the last 8 bytes out
    ok = (F.length(h) == HEADER_SIZE) & (F.substring("content", 1, 8) == F.lit(MAGIC)) & (whole | legacy)
    return containers.select("path", F.coalesce(ok, F.lit(False)).alias("valid"))


def read_at(containers: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: path, block_offset, stored_size; the payload of each."""
    return wanted.join(containers.select("path", "content"), "path").select("path", "block_offset", F.substring(F.col("content"), F.col("block_offset").cast("int") + 1, F.col("stored_size").cast("int")).alias("payload"))
