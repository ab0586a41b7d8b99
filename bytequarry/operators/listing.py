"""Listing and search: one row per physical path of a completed logical file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..repository import Repository
from ..schema import COMPLETED

MOST_ROWS = 10_000


def page(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """A given limit holds even if it is 0; at most MOST_ROWS."""
    if limit is not None and not 0 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError("limit must be 0 to 10000 and offset at least 0")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def files(repo: Repository, names: tuple[str, ...] = (), least: int | None = None, most: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """names: substrings of the path that all must occur, in any case; % and _ in them act as wildcards."""
    lf = repo.logical_file.where(F.col("status") == COMPLETED).select(F.col("id"), "original_name", "total_size", "file_hash", "ref_count", "chunker_version")
    if least is not None:
        lf = lf.where(F.col("total_size") >= least)
    if most is not None:
        lf = lf.where(F.col("total_size") <= most)
    pf = repo.physical_file
    for n in names:
        pf = pf.where(F.lower("path").like(f"%{n.lower()}%"))
    out = pf.join(lf, F.col("logical_file_id") == F.col("id")).select("id", "path", "total_size", "file_hash", "ref_count", "chunker_version")
    return page(out.orderBy("path"), limit, offset)


def inspect(repo: Repository) -> DataFrame:
    """Chunks and mean chunk size of every logical file."""
    sizes = repo.file_chunk.join(repo.chunk.select(F.col("id").alias("chunk_id"), "size"), "chunk_id")
    own = sizes.groupBy("logical_file_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("size").alias("mean"))
    return repo.logical_file.join(own, F.col("id") == F.col("logical_file_id"), "left").select("id", "status", "total_size", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_chunk_size"))
