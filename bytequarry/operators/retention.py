"""Which logical files are retained, and by what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..repository import Repository


def current_roots(repo: Repository) -> DataFrame:
    return repo.physical_file.where("logical_file_id > 0").select("logical_file_id").distinct()


def snapshot_roots(repo: Repository) -> DataFrame:
    """Ids without a logical file stay in the set."""
    return repo.snapshot_file.where("logical_file_id > 0").select("logical_file_id").distinct()


def classified(repo: Repository) -> DataFrame:
    """logical_file_id and class: current, snapshot or shared."""
    both = current_roots(repo).withColumn("c", F.lit(1)).join(snapshot_roots(repo).withColumn("s", F.lit(1)), "logical_file_id", "full")
    return both.select("logical_file_id", F.when(F.col("s").isNull(), "current").when(F.col("c").isNull(), "snapshot").otherwise("shared").alias("class"))


def retained(repo: Repository) -> DataFrame:
    return current_roots(repo).union(snapshot_roots(repo)).distinct()


def report(repo: Repository) -> DataFrame:
    """Counts on the snapshot side include ids without a logical file; bytes and the current-only count don't."""
    sized = classified(repo).join(repo.logical_file.select("id", "total_size"), F.col("logical_file_id") == F.col("id"), "left")
    k, known = F.col("class"), F.col("id").isNotNull()
    size = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("total_size"))), F.lit(0)).alias(name)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return sized.agg(n((k == "current") & known, "current_only_files"), size(k == "current", "current_only_bytes"), n(k != "current", "referenced_files"), size(k != "current", "referenced_bytes"), n(k == "snapshot", "snapshot_only_files"), size(k == "snapshot", "snapshot_only_bytes"), n(k == "shared", "shared_files"), size(k == "shared", "shared_bytes"))


def is_referenced(repo: Repository, logical_file_id: int) -> bool:
    return not repo.snapshot_file.where(F.col("logical_file_id") == logical_file_id).isEmpty()
