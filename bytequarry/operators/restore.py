"""Restore and deep verification: from recipes through blocks and payloads to contents, every step checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..repository import Repository
from ..schema import AES, COMPLETED, HEADER_SIZE, PLAIN
from . import audits, ingest

#: Fixed value: the hash of an empty file.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def recipe(repo: Repository) -> DataFrame:
    """Every reference of a file to a chunk, its block and its container, by order; one row for each block of the chunk."""
    c = repo.chunk.select(F.col("id").alias("chunk_id"), "chunk_hash", F.col("status").alias("chunk_status"))
    b = repo.blocks.select(F.col("id").alias("block_id"), "chunk_id", "codec", "plaintext_size", "stored_size", "nonce", "container_id", "block_offset")
    k = repo.container.select(F.col("id").alias("container_id"), "filename", "quarantine", "current_size")
    return repo.file_chunk.join(c, "chunk_id").join(b, "chunk_id").join(k, "container_id", "left")


def opened(rows: DataFrame, repo: Repository, key: bytes | None) -> DataFrame:
    """rows (with block_id, codec, nonce, stored_size, plaintext_size and chunk_hash) and the data of each block, or null and
    its fault: payload_missing, stored_size, codec, decode, plaintext_size or chunk_hash, the first that holds."""
    rows = rows.join(repo.block_payload, "block_id", "left")
    known = F.col("codec").isin(PLAIN, AES)
    plain = F.when(F.col("codec") == PLAIN, F.col("payload"))
    if key is not None:
        plain = codecs.decoded(F.col("nonce"), F.col("payload"), F.col("codec"), key)
    rows = rows.withColumn("data", F.when(known, plain))
    fault = (
        F.when(F.col("payload").isNull(), "payload_missing")
        .when(F.length("payload") != F.col("stored_size"), "stored_size")
        .when(~known, "codec")
        .when(F.col("data").isNull(), "decode")
        .when(F.length("data") != F.col("plaintext_size"), "plaintext_size")
        .when(F.sha2("data", 256) != F.col("chunk_hash"), "chunk_hash")
    )
    rows = rows.withColumn("fault", fault).drop("payload")
    return rows.withColumn("data", F.when(F.col("fault").isNull(), F.col("data")))


def blocks_deep(repo: Repository, key: bytes | None = None) -> DataFrame:
    """Findings of blocks of completed chunks in healthy containers, read, decoded and hashed."""
    c = repo.chunk.where(F.col("status") == COMPLETED).select(F.col("id").alias("chunk_id"), "chunk_hash")
    held = repo.container.where("NOT quarantine").select(F.col("id").alias("container_id"))
    b = repo.blocks.withColumnRenamed("id", "block_id").join(c, "chunk_id").join(held, "container_id")
    bad = opened(b, repo, key).where("fault IS NOT NULL")
    return audits._found(bad, "block_content", F.col("block_id"), F.col("fault"))


def containers_deep(repo: Repository) -> DataFrame:
    """The healthy containers that hold completed chunks, and how many there are, for progress."""
    c = repo.chunk.where(F.col("status") == COMPLETED).select(F.col("id").alias("chunk_id"))
    held = repo.blocks.join(c, "chunk_id", "left_semi").select(F.col("container_id").alias("id")).distinct()
    rows = repo.container.where("NOT quarantine").join(held, "id", "left_semi").select("id", "filename", "current_size")
    return rows.crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


def restored(repo: Repository, ids: DataFrame | None = None, key: bytes | None = None) -> DataFrame:
    """logical_file_id, content, verdict and the numbers of chunks that were lost (`bad`) and of breaks in the order.

    ids: logical_file_id of the files wanted, all by default. Bad chunks are left out; breaks are counted. A file is `ok` only if
    what is left has its hash and size: else `status`, `no_chunks`, `size` or `hash`."""
    files = audits._files(repo).select("logical_file_id", "status", "total_size", "file_hash")
    parts = recipe(repo).join(files.where(F.col("status") == COMPLETED).select("logical_file_id"), "logical_file_id", "left_semi")
    if ids is not None:
        files, parts = files.join(ids, "logical_file_id", "left_semi"), parts.join(ids, "logical_file_id", "left_semi")
    w = Window.partitionBy("logical_file_id").orderBy("chunk_order")
    parts = opened(parts.withColumn("want", F.row_number().over(w) - 1), repo, key)
    n = lambda c: F.count(F.when(F.expr(c), 1))
    made = parts.groupBy("logical_file_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk_order)").alias("content"), n("fault IS NOT NULL").alias("bad"), n("want <> chunk_order").alias("breaks"), n("data IS NOT NULL").alias("good"))
    out = files.join(made, "logical_file_id", "left").withColumn("content", F.when((F.col("status") == COMPLETED) & (F.coalesce("good", F.lit(0)) == 0) & (F.col("file_hash") == EMPTY_HASH), F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.col("content")))
    verdict = F.when(F.col("status") != COMPLETED, "status").when(F.col("content").isNull(), "no_chunks").when(F.length("content") != F.col("total_size"), "size").when(F.sha2("content", 256) != F.col("file_hash"), "hash").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("logical_file_id", F.when(verdict == "ok", F.col("content")).alias("content"), verdict.alias("verdict"), zero("bad"), zero("breaks"))


def files_full(repo: Repository) -> DataFrame:
    """Every file's first failure at the full level: what `audits.file_verdicts` finds, then quarantined containers, sizes and
    bounds of blocks."""
    rows = recipe(repo).join(repo.container_file.select("filename", F.col("size").alias("on_disk")), "filename", "left")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    end = "block_offset + stored_size"
    own = rows.groupBy("logical_file_id").agg(n("quarantine").alias("q"), n("on_disk IS NULL").alias("missing"), n("on_disk <> current_size").alias("size"), n(f"stored_size <= 0 OR block_offset < {HEADER_SIZE} OR {end} > current_size OR {end} > on_disk").alias("bounds"))
    f = audits.file_verdicts(repo).join(own, F.col("id") == F.col("logical_file_id"), "left")
    later = F.when(F.col("q") > 0, "quarantined").when(F.col("missing") > 0, "container_missing").when(F.col("size") > 0, "container_size").when(F.col("bounds") > 0, "block_bounds").otherwise("ok")
    return f.select("id", F.when(F.col("verdict") == "ok", later).otherwise(F.col("verdict")).alias("verdict"))


def files_deep(repo: Repository, key: bytes | None = None) -> DataFrame:
    """Every file's first failure at the deep level: decoded and hashed chunk by chunk, and as a whole."""
    full = files_full(repo).withColumnRenamed("id", "logical_file_id")
    out = full.join(restored(repo, full.where("verdict = 'ok'").select("logical_file_id"), key).select("logical_file_id", F.col("verdict").alias("deep"), "bad"), "logical_file_id", "left")
    return out.select(F.col("logical_file_id").alias("id"), F.when(F.col("verdict") != "ok", F.col("verdict")).when(F.col("bad") > 0, "chunk_content").otherwise(F.col("deep")).alias("verdict"))


def restore(repo: Repository, plan: DataFrame, key: bytes | None = None, overwrite: bool = False) -> DataFrame:
    """Write the files of a plan (logical_file_id, output) whose content is whole, each to a temporary name and then renamed; the
    verdict of every row. Two rows with one output are an error, as is an existing output unless it may be overwritten."""
    if not plan.groupBy("output").count().where("count > 1").isEmpty():
        raise ValueError("several files would be restored to one output")
    made = plan.join(restored(repo, plan.select("logical_file_id"), key), "logical_file_id")
    return ingest.write_files(made, overwrite)
