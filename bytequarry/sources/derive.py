"""A repository derived from the `documents` table by fixed rules, defects included, so that every query has something to find.

The same rules in SQL are in plans/oracle.py.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import codecs
from ..repository import Repository, shared_folder

SLICE = 512
#: Repositories that this process has opened, by their folder; a few handles, no data.
_loaded: dict[str, Repository] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", "text", "source", "lang", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size"), F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def _mtime(doc_id):
    return F.when(doc_id % 13 != 0, F.lit(1_700_000_000) + doc_id * 3600).cast("long")


def logical_files(docs: DataFrame) -> DataFrame:
    g = docs.groupBy("file_hash", F.col("size").alias("total_size")).agg((F.min("doc_id") + 1).alias("id"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("id") % 41 == 0, S.ABORTED).when(F.col("id") % 43 == 0, S.PROCESSING).otherwise(S.COMPLETED)
    version = F.when(F.col("id") % 97 == 0, "bad version").when(F.col("id") % 2 == 0, S.V2).otherwise(S.V1)
    return g.select("id", F.concat((F.col("id") - 1).cast("string"), F.lit(".txt")).alias("original_name"), "total_size", "file_hash", F.when(F.col("id") % 167 == 0, -1).otherwise(F.col("n") + F.when(F.col("id") % 53 == 0, 1).otherwise(0)).alias("ref_count"), version.alias("chunker_version"), status.alias("status"), (F.col("id") % 3).cast("int").alias("retry_count"))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the id of their logical file."""
    ids = docs.groupBy("file_hash", "size").agg((F.min("doc_id") + 1).alias("logical_file_id"))
    return docs.join(ids, ["file_hash", "size"])


def physical_files(docs: DataFrame) -> DataFrame:
    orphan = F.when(F.col("doc_id") % 199 == 198, F.col("logical_file_id") + 10_000_000_000).otherwise(F.col("logical_file_id"))
    return keyed(docs).select("path", orphan.alias("logical_file_id"), F.lit(420).cast("long").alias("mode"), _mtime(F.col("doc_id")).alias("mtime"), F.lit(1000).cast("long").alias("uid"), F.lit(1000).cast("long").alias("gid"), (F.col("doc_id") % 5 != 0).alias("is_metadata_complete"))


def slices(docs: DataFrame, data: bool = False) -> DataFrame:
    """logical_file_id, chunk_order, chunk_hash, size (and the bytes): each distinct text in slices of SLICE characters."""
    one = keyed(docs).where(F.col("doc_id") + 1 == F.col("logical_file_id"))
    n = F.ceil(F.length("text") / SLICE).cast("int")
    rows = one.where(F.length("text") > 0).select("logical_file_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    part = F.substring("text", F.col("k") * SLICE + 1, F.lit(SLICE))
    out = rows.select("logical_file_id", F.col("k").cast("long").alias("chunk_order"), F.sha2(part, 256).alias("chunk_hash"), F.octet_length(part).cast("long").alias("size"), F.to_binary(part, F.lit("utf-8")).alias("data"))
    return out if data else out.drop("data")


KEY = bytes(range(32))


def with_payloads(repo: Repository, docs: DataFrame) -> Repository:
    """The repository with the blocks' bytes and nonces, damage included: a payload is missing, cut, changed, or has another
    block's nonce, by the block's id. Like `repository`, for queries that read contents."""
    body = slices(docs, True).groupBy("chunk_hash", "size").agg(F.min(F.col("logical_file_id") * 1_000_000 + F.col("chunk_order")).alias("id"), F.min_by("data", F.col("logical_file_id") * 1_000_000 + F.col("chunk_order")).alias("data"))
    b = repo.blocks.drop("nonce").join(body.select("id", "data"), "id")
    aes = codecs.encoded(F.col("data"), S.AES, KEY)
    b = b.withColumn("e", F.when(F.col("codec") == S.AES, aes).otherwise(codecs.encoded(F.col("data"), S.PLAIN)))
    i, nonce, payload = F.col("id"), F.col("e.nonce"), F.col("e.payload")
    changed = F.concat(F.when(F.substring(payload, 1, 1) == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.substring(payload, 2, 1 << 30))
    damaged = F.when(i % 107 == 0, None).when(i % 109 == 0, F.substring(payload, 1, F.length(payload) - 1)).when(i % 83 == 0, changed).otherwise(payload)
    other = F.when((i % 113 == 0) & nonce.isNotNull(), F.unhex(F.lit("00" * 12))).otherwise(nonce)
    rows = b.select(*S.schema("blocks").names[:6], other.alias("nonce"), "container_id", "block_offset", damaged.alias("payload"))
    return repo.replace(blocks=rows.drop("payload"), block_payload=rows.where("payload IS NOT NULL").select(F.col("id").alias("block_id"), "payload"))


def saved(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Repository]) -> Repository:
    """A repository that is made and saved once in an application, and read by whoever asks after that."""
    mark = hashlib.sha256(f"{sf_dir}|{name}".encode()).hexdigest()[:16]
    where = f"{shared_folder(spark)}/derived/{spark.sparkContext.applicationId}/{mark}"
    if where not in _loaded:
        if not Repository.empty(spark).versions(where):
            make().save(where)
        if len(_loaded) > 8:
            _loaded.clear()
        _loaded[where] = Repository.load(spark, where)
    return _loaded[where]


def repository(spark: SparkSession, sf_dir: str) -> Repository:
    docs = documents(spark, sf_dir)
    pieces = slices(docs)
    known = pieces.groupBy("chunk_hash", "size").agg(F.min(F.col("logical_file_id") * 1_000_000 + F.col("chunk_order")).alias("id"), F.count(F.lit(1)).alias("refs"))
    i = F.col("id")
    chunk = known.select("id", "chunk_hash", "size", F.when(i % 71 == 0, S.ABORTED).when(i % 73 == 0, S.PROCESSING).otherwise(S.COMPLETED).alias("status"), (F.col("refs") + F.when(i % 67 == 0, 1).otherwise(0) - F.when(i % 79 == 0, F.col("refs")).otherwise(0)).alias("live_ref_count"), F.when(i % 89 == 0, 1).otherwise(0).cast("long").alias("pin_count"), (i % 4).cast("int").alias("retry_count"), F.when(i % 401 == 0, "").when(i % 97 == 0, "bad version").when(i % 2 == 0, S.V2).otherwise(S.V1).alias("chunker_version"))
    gap = F.when((F.col("logical_file_id") % 61 == 0) & (F.col("chunk_order") >= 1), 1).otherwise(0)
    file_chunk = pieces.join(known.select("chunk_hash", "size", F.col("id").alias("chunk_id")), ["chunk_hash", "size"]).where(F.col("logical_file_id") % 103 != 0).select("logical_file_id", "chunk_id", (F.col("chunk_order") + gap).alias("chunk_order"))
    stored = F.col("size") + F.when(i % 3 == 0, S.AES_OVERHEAD).otherwise(0)
    b = chunk.where(i % 101 != 0).select("id", "size", stored.alias("stored_size"), F.floor(i / 25_000_000).cast("long").alias("container_id"))
    order = Window.partitionBy("container_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("block_offset", F.lit(S.HEADER_SIZE) + F.coalesce(F.sum("stored_size").over(order), F.lit(0)) + F.when(i % 211 == 0, 7).otherwise(0))
    blocks = b.select("id", F.col("id").alias("chunk_id"), F.when(i % 3 == 0, S.AES).otherwise(S.PLAIN).alias("codec"), F.lit(1).alias("format_version"), F.col("size").alias("plaintext_size"), "stored_size", F.lit(None).cast("binary").alias("nonce"), "container_id", "block_offset")
    sealed = i % 4 != 0
    held = b.groupBy(F.col("container_id").alias("id")).agg(F.sum("stored_size").alias("bytes"))
    container = held.select("id", F.concat(F.lit("container_"), i.cast("string"), F.lit(".bin")).alias("filename"), sealed.alias("sealed"), (~sealed & (i % 8 == 0)).alias("sealing"), F.when(sealed & (i % 17 != 0), F.sha2(F.concat(F.lit("c"), i.cast("string")), 256)).alias("container_hash"), (i % 11 == 0).alias("quarantine"), (F.lit(S.HEADER_SIZE) + F.col("bytes") + F.when(i % 13 == 0, 5).otherwise(0)).cast("long").alias("current_size"), F.lit(S.DEFAULT_CONTAINER_MAX).cast("long").alias("max_size"))
    files = container.where(i % 19 != 0).select("filename", (F.col("current_size") + F.when(i % 7 == 0, 3).otherwise(0) - F.when(i % 29 == 0, 9).otherwise(0)).alias("size"), F.sha2(F.concat(F.lit("c"), F.when(i % 5 == 0, i + 1).otherwise(i).cast("string")), 256).alias("sha256"))
    orphan = spark.createDataFrame([("container_x.bin", 128, None)], S.schema("container_file"))
    snapshot = spark.createDataFrame([("day1", 1_700_000_000, "full", "first day", None), ("day2", 1_700_086_400, "full", None, "day1"), ("part1", 1_700_090_000, "partial", "Source one", "day2"), ("lost", 1_700_095_000, "partial", "first lost", "gone"), ("odd", 1_700_099_000, "full", None, "part1"), ("gap", 1_700_099_500, "full", None, "never")], S.schema("snapshot"))
    k = keyed(docs).withColumn("key", F.regexp_replace("path", "^/+", ""))
    paths = k.select((F.col("doc_id") + 1).alias("id"), F.col("key").alias("path"))
    row = lambda name, file, df: df.select(F.lit(name).alias("snapshot_id"), (F.col("doc_id") + 1).alias("path_id"), file.alias("logical_file_id"), F.when(F.col("doc_id") % 17 != 0, F.col("size")).alias("size"), F.lit(420).cast("long").alias("mode"), _mtime(F.col("doc_id")).alias("mtime"))
    own = F.col("logical_file_id")
    other = F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") > 0), F.coalesce("before_id", own)).otherwise(own)
    before = k.select((F.col("doc_id") + 1).alias("doc_id"), F.col("logical_file_id").alias("before_id"))
    dangling = F.when(F.col("doc_id") % 251 == 250, F.lit(9_999_999_999)).otherwise(own)
    snapshot_file = row("day1", dangling, k.where("doc_id % 10 <> 0")).unionByName(row("day2", other, k.join(before, "doc_id", "left").where("doc_id % 7 <> 0"))).unionByName(row("part1", own, k.where("source = 'src1'"))).unionByName(row("odd", own, k.where("source IN ('src1', 'src2')")))
    # defects: rows twice, paths that aren't in the dictionary, and two files at one path once it is normalized
    lost = row("lost", own, k.where("doc_id % 20 = 7")).unionByName(row("lost", own, k.where("doc_id % 60 = 7")))
    stray = row("lost", own, k.where("doc_id % 40 = 9")).withColumn("path_id", F.col("path_id") + 1_000_000_000)
    twin = row("lost", own + 1, k.where("doc_id % 40 = 7")).withColumn("path_id", F.col("path_id") + 2_000_000_000)
    snapshot_file = snapshot_file.unionByName(lost).unionByName(stray).unionByName(twin)
    paths = paths.unionByName(k.where("doc_id % 40 = 7").select((F.col("doc_id") + 2_000_000_001).alias("id"), F.concat(F.lit("./"), "key").alias("path")))
    return Repository(spark, {"physical_file": physical_files(docs), "logical_file": logical_files(docs), "chunk": chunk, "file_chunk": file_chunk, "blocks": blocks, "container": container, "container_file": files.unionByName(orphan), "snapshot": snapshot, "snapshot_path": paths, "snapshot_file": snapshot_file, "repository_config": spark.createDataFrame([("default_chunker", S.V2)], S.schema("repository_config"))})
