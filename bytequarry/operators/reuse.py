"""Which stored files and chunks may stand for new ones: structure, contents, and the gate between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..repository import Repository
from ..schema import COMPLETED, HEADER_SIZE
from . import audits, maintenance, restore

#: When contents are read before a file is reused.
OFF, SUSPICIOUS, ALWAYS = "off", "suspicious", "always"


def mode_of(value: str | None) -> str:
    """A mode by its name; the default for an empty or unknown one."""
    name = (value or "").strip().lower()
    return name if name in (OFF, SUSPICIOUS, ALWAYS) else SUSPICIOUS


def chunk_summary(repo: Repository) -> DataFrame:
    """Of every completed chunk: block rows, those with a container, and those in a quarantined one."""
    k = repo.container.select(F.col("id").alias("container_id"), F.lit(1).alias("held"), F.col("quarantine").cast("int").alias("q"))
    b = repo.blocks.select("chunk_id", "container_id").join(k, "container_id", "left")
    own = b.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("block_rows"), F.count("held").alias("container_rows"), F.coalesce(F.sum("q"), F.lit(0)).alias("quarantined_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return audits._chunks(repo).where(F.col("status") == COMPLETED).join(own, "chunk_id", "left").select("chunk_id", zero("block_rows"), zero("container_rows"), zero("quarantined_rows"))


def chunk_verdicts(repo: Repository) -> DataFrame:
    """Whether each completed chunk can be reused: ok, or the first of block_rows, container_missing, container_size,
    stored_size, before_header, past_container, file_missing and past_file. A quarantined container is no obstacle."""
    k = repo.container.select(F.col("id").alias("container_id"), "filename", "current_size", "max_size").join(repo.container_file.select("filename", F.col("size").alias("on_disk")), "filename", "left")
    one = repo.blocks.select("chunk_id", "container_id", "block_offset", "stored_size").join(k, "container_id")
    rows = chunk_summary(repo).join(one, "chunk_id", "left")
    end = F.col("block_offset") + F.col("stored_size")
    verdict = (
        F.when(F.col("block_rows") != 1, "block_rows")
        .when(F.col("container_rows") != 1, "container_missing")
        .when((F.col("max_size") > 0) & (F.col("current_size") > F.col("max_size")), "container_size")
        .when(F.col("stored_size") <= 0, "stored_size")
        .when(F.col("block_offset") < HEADER_SIZE, "before_header")
        .when(end > F.col("current_size"), "past_container")
        .when(F.col("on_disk").isNull(), "file_missing")
        .when(F.col("on_disk") < end, "past_file")
        .otherwise("ok")
    )
    return rows.select("chunk_id", verdict.alias("verdict")).distinct()


def file_containers(repo: Repository) -> DataFrame:
    """logical_file_id, container_id and filename: the containers that each file needs, and whether the file of each is there."""
    k = repo.container.select(F.col("id").alias("container_id"), "filename", "quarantine").join(repo.container_file.select("filename", F.lit(True).alias("there")), "filename", "left")
    rows = repo.file_chunk.join(repo.blocks.select("chunk_id", "container_id"), "chunk_id").select("logical_file_id", "container_id").distinct()
    return rows.join(k, "container_id").withColumn("there", F.coalesce("there", F.lit(False)))


def structure(repo: Repository) -> DataFrame:
    """logical_file_id and verdict of every completed file: ok, or the first of no_chunks, chunk_order, chunk_status,
    block_missing, container_missing and file_missing."""
    gone = file_containers(repo).where("NOT there").select("logical_file_id").distinct().withColumn("gone", F.lit(1))
    rows = audits._files(repo).where(F.col("status") == COMPLETED).select("logical_file_id", "total_size").join(maintenance.reuse_graph(repo), "logical_file_id", "left").join(gone, "logical_file_id", "left")
    verdict = (
        F.when(F.col("broken_orders").isNull() & (F.col("total_size") > 0), "no_chunks")
        .when(F.col("broken_orders") > 0, "chunk_order")
        .when(F.col("invalid_chunks") > 0, "chunk_status")
        .when(F.col("missing_blocks") > 0, "block_missing")
        .when(F.col("missing_containers") > 0, "container_missing")
        .when(F.col("gone") == 1, "file_missing")
        .otherwise("ok")
    )
    return rows.select("logical_file_id", verdict.alias("verdict"))


def suspects(repo: Repository) -> DataFrame:
    """The files with a sign of trouble: they or a chunk of theirs were tried again, or a container may still change."""
    moving = repo.container.where("NOT sealed OR sealing").select(F.col("id").alias("container_id"))
    one = repo.logical_file.where("retry_count > 0").select(F.col("id").alias("logical_file_id"))
    two = repo.file_chunk.join(repo.chunk.where("retry_count > 0").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("logical_file_id")
    three = repo.file_chunk.join(repo.blocks.join(moving, "container_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi").select("logical_file_id")
    return one.unionByName(two).unionByName(three).distinct()


def gate(repo: Repository, mode: str = SUSPICIOUS, key: bytes | None = None) -> DataFrame:
    """logical_file_id, verdict and read of every completed file: whether it may be reused. First its structure; a file with a
    quarantined container passes then; of the others those that the mode asks for are read, decoded and hashed."""
    shape = structure(repo)
    held = file_containers(repo).where("quarantine").select("logical_file_id").distinct().withColumn("q", F.lit(1))
    rows = shape.join(held, "logical_file_id", "left")
    if mode == OFF:
        return rows.select("logical_file_id", "verdict", F.lit(False).alias("read"))
    wanted = rows.where("verdict = 'ok' AND q IS NULL").select("logical_file_id")
    if mode == SUSPICIOUS:
        wanted = wanted.join(suspects(repo), "logical_file_id", "left_semi")
    got = restore.restored(repo, wanted, key).select("logical_file_id", F.when((F.col("verdict") == "ok") & (F.col("bad") == 0) & (F.col("breaks") == 0), "ok").otherwise("content").alias("content"))
    rows = rows.join(got, "logical_file_id", "left")
    return rows.select("logical_file_id", F.when(F.col("verdict") == "ok", F.coalesce("content", F.lit("ok"))).otherwise(F.col("verdict")).alias("verdict"), F.col("content").isNotNull().alias("read"))
