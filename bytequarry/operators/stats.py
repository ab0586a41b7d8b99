"""Repository statistics; each report reads a table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, version_bucket
from ..repository import Repository
from ..schema import COMPLETED, PROCESSING, ABORTED


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _sum(value: str, condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(value if condition is None else F.when(condition, F.col(value))), F.lit(0)).cast("long")


def live() -> Column:
    return (F.col("live_ref_count") > 0) | (F.col("pin_count") > 0)


def files_by_status(repo: Repository) -> DataFrame:
    s = F.col("status")
    cols = [F.count(F.lit(1)).alias("files"), _sum("total_size").alias("bytes")]
    for name, state in (("completed", COMPLETED), ("processing", PROCESSING), ("aborted", ABORTED)):
        cols += [_n(s == state).alias(f"{name}_files"), _sum("total_size", s == state).alias(f"{name}_bytes")]
    return repo.logical_file.agg(*cols)


def containers(repo: Repository) -> DataFrame:
    q = F.col("quarantine")
    return repo.container.agg(F.count(F.lit(1)).alias("containers"), _sum("current_size").alias("bytes"), _n(~q).alias("healthy"), _sum("current_size", ~q).alias("healthy_bytes"), _n(q).alias("quarantined"), _sum("current_size", q).alias("quarantined_bytes"))


def placed(repo: Repository) -> DataFrame:
    return repo.blocks.join(repo.chunk.select(F.col("id").alias("chunk_id"), "status", "live_ref_count", "pin_count"), "chunk_id")


def live_dead(repo: Repository) -> DataFrame:
    """Live and dead block bytes, dedup and fragmentation. The dedup ratio compares stored with completed bytes and can be
    negative; the fragmentation's denominator leaves out quarantined containers, its numerator doesn't."""
    one = placed(repo).agg(_sum("stored_size", live()).alias("live_bytes"), _sum("stored_size", ~live()).alias("dead_bytes"))
    two = repo.logical_file.agg(_sum("total_size", F.col("status") == COMPLETED).alias("completed_bytes"))
    three = repo.container.agg(_sum("current_size", ~F.col("quarantine")).alias("healthy_bytes"))
    dedup = F.when(F.col("completed_bytes") > 0, (1 - F.col("live_bytes").cast("double") / F.col("completed_bytes").cast("double")) * 100).otherwise(0.0)
    return one.crossJoin(two).crossJoin(three).select("live_bytes", "dead_bytes", F.round(dedup, 6).alias("dedup_percent"), F.round(ratio(F.col("dead_bytes"), F.col("healthy_bytes"), 100.0), 6).alias("fragmentation_percent"))


def retries(repo: Repository) -> DataFrame:
    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.lit(kind).alias("kind"), _sum("retry_count").alias("total"), F.round(F.coalesce(F.avg("retry_count"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.max("retry_count"), F.lit(0)).cast("long").alias("most"))

    return of(repo.logical_file, "file").unionByName(of(repo.chunk, "chunk"))


def chunks_by_status(repo: Repository) -> DataFrame:
    return repo.chunk.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"), _sum("size").alias("bytes"))


def dedup_signal(repo: Repository) -> DataFrame:
    both = repo.file_chunk.agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("chunk_id").alias("distinct_chunks"))
    return both.withColumn("estimated_dedup", F.round(F.when(F.col("refs") > 0, (1 - F.col("distinct_chunks") / F.col("refs")) * 100).otherwise(0.0), 6))


def chunks_by_version(repo: Repository) -> DataFrame:
    return repo.chunk.groupBy(version_bucket(F.col("chunker_version")).alias("version")).agg(F.count(F.lit(1)).alias("chunks"), _sum("size").alias("bytes"))


def files_by_version(repo: Repository) -> DataFrame:
    return repo.logical_file.groupBy(version_bucket(F.col("chunker_version")).alias("version")).agg(F.count(F.lit(1)).alias("files"))


def mixed_versions(repo: Repository) -> DataFrame:
    v = chunks_by_version(repo).select("version").union(files_by_version(repo).select("version")).where("version <> 'unknown'")
    return v.agg(F.countDistinct("version").alias("versions")).withColumn("mixed", F.col("versions") > 1)


def per_container(repo: Repository) -> DataFrame:
    own = placed(repo).groupBy("container_id").agg(_sum("stored_size", live()).alias("live_bytes"), _sum("stored_size", ~live()).alias("dead_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = repo.container.join(own, F.col("id") == F.col("container_id"), "left").select("id", "quarantine", "current_size", zero("live_bytes"), zero("dead_bytes"))
    return out.withColumn("live_percent", F.round(ratio(F.col("live_bytes"), F.col("live_bytes") + F.col("dead_bytes"), 100.0), 6))


def simulate(repo: Repository) -> DataFrame:
    """What a store would come to."""
    lf = repo.logical_file.where(F.col("status") == COMPLETED)
    one = lf.agg(F.count(F.lit(1)).alias("files"), _sum("total_size").alias("logical_bytes"))
    two = repo.blocks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("container_id").alias("containers"), _sum("stored_size").alias("physical_bytes"))
    dedup = F.when(F.col("logical_bytes") > 0, (1 - F.col("physical_bytes") / F.col("logical_bytes")) * 100).otherwise(0.0)
    return one.crossJoin(two).withColumn("dedup_percent", F.round(dedup, 6))


def as_json(report: DataFrame) -> DataFrame:
    """A report's rows as lines of JSON, nulls included."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
