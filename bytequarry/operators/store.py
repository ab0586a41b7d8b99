"""The store path: files are claimed, split, packed and linked, and the result is a new repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cdc import Profile
from ..functions.numbering import largest, numbered
from ..repository import Repository, settled
from ..schema import AES, COMPLETED, DEFAULT_CONTAINER_MAX, schema
from ..sources.files import header
from . import ingest, maintenance, reuse


def open_container(repo: Repository, most: int = DEFAULT_CONTAINER_MAX) -> tuple[int, int] | None:
    """The container that the next payload goes to, and how far it is filled: the open, healthy one with the least id and room."""
    row = repo.container.where("NOT sealed AND NOT sealing AND NOT quarantine").where(F.col("current_size") < most).select("id", "current_size").orderBy("id").head()
    return (row["id"], row["current_size"]) if row else None


def claimed(repo: Repository, files: DataFrame, mode: str, key: bytes | None) -> DataFrame:
    """Distinct (file_hash, size) of files with the id that stands for each, and its state: reused, rebuilt (there, but aborted or
    refused by the gate) or new."""
    own = files.groupBy("file_hash", "size").agg(F.min("path").alias("first_path"))
    there = repo.logical_file.select("file_hash", F.col("total_size").alias("size"), "id", "status")
    there = there.groupBy("file_hash", "size").agg(F.min_by("id", F.struct(F.col("status") != COMPLETED, "id")).alias("id"))
    fine = reuse.gate(repo, mode, key).where("verdict = 'ok'").select(F.col("logical_file_id").alias("id"), F.lit(True).alias("fine"))
    rows = own.join(there, ["file_hash", "size"], "left").join(fine, "id", "left")
    old = rows.where("id IS NOT NULL").withColumn("state", F.when(F.col("fine"), "reused").otherwise("rebuilt"))
    new = numbered(rows.where("id IS NULL").drop("id"), ["file_hash", "size"], largest(repo.logical_file)).withColumn("state", F.lit("new"))
    return old.unionByName(new, allowMissingColumns=True).select("file_hash", "size", "id", "first_path", "state")


def store(repo: Repository, files: DataFrame, profile: Profile, codec: str = AES, key: bytes | None = None, mode: str = reuse.SUSPICIOUS, replace: bool = False, writers: int = 16, most: int = DEFAULT_CONTAINER_MAX, created: int = 0) -> Repository:
    """The repository with files: path, content, and optionally mode, mtime, uid and gid.

    A content that is there and passes the reuse gate isn't split again; one that doesn't pass, or was aborted, is rebuilt under
    its id, once. The same holds for chunks. New payloads are packed by `writers` writers; the first of them goes on with the open
    container. A path of another file is a conflict unless it may be replaced; several contents for one path are an error.
    The steps (claims, pieces, chunks, places, blocks) are tables in the shared folder that the result reads until it is saved."""
    for c, kind in (("mode", "long"), ("mtime", "long"), ("uid", "long"), ("gid", "long")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    files = files.select("path", F.coalesce("content", F.to_binary(F.lit(""), F.lit("utf-8"))).alias("content"), "mode", "mtime", "uid", "gid")
    files = files.withColumn("file_hash", F.sha2("content", 256)).withColumn("size", F.length("content").cast("long"))
    names = files.groupBy("path").agg(F.countDistinct("file_hash", "size").alias("n"))
    if not names.where("n > 1").isEmpty():
        raise ValueError("several contents for one path")
    files = files.dropDuplicates(["path"])
    claims = settled(claimed(repo, files, mode, key), "claims")

    # split what isn't reused: one body of each content
    body = files.select("path", "content", F.col("file_hash").alias("h"), F.col("size").alias("s"))
    todo = claims.where("state <> 'reused'").select(F.col("id").alias("logical_file_id"), "first_path", "file_hash", "size")
    bodies = body.join(todo, (F.col("path") == F.col("first_path")) & (F.col("h") == F.col("file_hash")) & (F.col("s") == F.col("size"))).select("logical_file_id", "content")
    split = bodies.withColumn("c", F.explode(ingest.chunked(F.col("content"), profile)))
    pieces = settled(split.select("logical_file_id", "c.chunk_order", "c.chunk_hash", "c.size", F.substring("content", (F.col("c.offset") + 1).cast("int"), F.col("c.size").cast("int")).alias("data")), "pieces")

    # claim chunks
    own = pieces.groupBy("chunk_hash", "size").agg(F.min_by("data", "logical_file_id").alias("data"))
    fine = reuse.chunk_verdicts(repo).where("verdict = 'ok'").select(F.col("chunk_id").alias("id"), F.lit(True).alias("fine"))
    there = repo.chunk.groupBy("chunk_hash", "size").agg(F.min_by("id", F.struct(F.col("status") != COMPLETED, "id")).alias("id"))
    rows = own.join(there, ["chunk_hash", "size"], "left").join(fine, "id", "left")
    new = numbered(rows.where("id IS NULL").drop("id"), ["chunk_hash", "size"], largest(repo.chunk))
    chunks = rows.where("id IS NOT NULL").withColumn("rebuilt", F.coalesce(~F.col("fine"), F.lit(True))).unionByName(new.withColumn("rebuilt", F.lit(True)), allowMissingColumns=True)
    chunks = settled(chunks.withColumn("is_new", F.col("id") > largest(repo.chunk)), "chunks")
    made = chunks.where("rebuilt")

    # encode and pack
    coded = made.withColumn("e", ingest.codecs.encoded(F.col("data"), codec, key)).select("id", "size", "e.nonce", "e.payload", F.length("e.payload").cast("long").alias("stored_size"), F.pmod(F.xxhash64("id"), F.lit(writers)).alias("writer"))
    begun = open_container(repo, most)
    overhead = ingest.stored_overhead(codec)  # the layout depends on sizes alone, not on the random nonces
    places = settled(ingest.packed(made.select("id", F.pmod(F.xxhash64("id"), F.lit(writers)).alias("writer"), (F.col("size") + overhead).alias("stored")), "writer", "id", "stored", most, {0: begun[1]} if begun else None), "places")
    used = {r["writer"]: r["n"] for r in places.groupBy("writer").agg(F.max("container_no").alias("n")).collect()}  # a row for each writer
    first, numbers = largest(repo.container) + 1, []
    for w, n in sorted(used.items()):
        for k in range(n + 1):
            if w == 0 and k == 0 and begun:
                numbers.append((w, k, begun[0], False))
            else:
                numbers.append((w, k, first, True))
                first += 1
    table = repo.spark.createDataFrame(numbers, "writer long, container_no long, container_id long, fresh boolean")
    placed = places.join(F.broadcast(table), ["writer", "container_no"]).select("id", "container_id", "block_offset", F.col("stored").alias("end_size"), "writer", "container_no")
    blocks = coded.drop("writer").join(placed, "id").select((F.col("id") + largest(repo.blocks)).alias("id"), F.col("id").alias("chunk_id"), F.lit(codec).alias("codec"), F.lit(1).alias("format_version"), F.col("size").alias("plaintext_size"), "stored_size", "nonce", "container_id", "block_offset", "payload")
    blocks = settled(blocks, "blocks")
    return _linked(repo, files, claims, pieces, chunks, blocks, placed, table, used, profile, replace, most, created)


def _linked(repo, files, claims, pieces, chunks, blocks, placed, table, used, profile, replace, most, created) -> Repository:
    """The new tables: links, counters and mappings of what was stored."""
    again = chunks.where("rebuilt AND NOT is_new").select(F.col("id").alias("chunk_id"))
    links = pieces.join(chunks.select("chunk_hash", "size", F.col("id").alias("chunk_id")), ["chunk_hash", "size"]).select("logical_file_id", "chunk_id", "chunk_order")
    rebuilt = claims.where("state = 'rebuilt'").select(F.col("id").alias("logical_file_id"))
    stale = repo.file_chunk.join(rebuilt, "logical_file_id", "left_semi")
    moved = links.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("more")).join(stale.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("less")), "chunk_id", "full")
    old = repo.chunk.join(moved, F.col("id") == F.col("chunk_id"), "left").drop("chunk_id").join(again.select(F.col("chunk_id").alias("id"), F.lit(True).alias("again")), "id", "left")
    old = old.withColumns({
        "live_ref_count": F.greatest(F.col("live_ref_count") - F.coalesce("less", F.lit(0)), F.lit(0)) + F.coalesce("more", F.lit(0)),
        "status": F.when(F.col("again"), COMPLETED).otherwise(F.col("status")),
        "retry_count": (F.col("retry_count") + F.when(F.col("again"), 1).otherwise(0)).cast("int"),
    })
    refs = links.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("live_ref_count"))
    fresh = chunks.where("is_new").join(refs, "id").select("id", "chunk_hash", "size", F.lit(COMPLETED).alias("status"), "live_ref_count", F.lit(0).cast("long").alias("pin_count"), F.lit(0).alias("retry_count"), F.lit(profile.version).alias("chunker_version"))
    names = list(schema("chunk").names)

    ends = placed.groupBy("container_id").agg(F.max(F.col("block_offset") + F.col("end_size")).alias("end"))
    last = [(w, n) for w, n in used.items()]
    open_ones = repo.spark.createDataFrame(last, "writer long, container_no long").withColumn("open", F.lit(True))
    state = ends.join(F.broadcast(table.join(open_ones, ["writer", "container_no"], "left")), "container_id")
    parts = blocks.select("container_id", "block_offset", "payload").unionByName(repo.blocks.join(repo.block_payload.withColumnRenamed("block_id", "id"), "id").select("container_id", "block_offset", "payload").join(ends.select("container_id"), "container_id", "left_semi"))
    whole = parts.groupBy("container_id").agg(F.sha2(F.concat(F.unhex(F.lit(header(1, most, created).hex())), F.expr("listagg(payload) WITHIN GROUP (ORDER BY block_offset)")), 256).alias("sha256"))
    state = state.join(whole, "container_id").withColumn("filename", F.concat(F.lit("container_"), F.col("container_id").cast("string"), F.lit(".bin")))
    sealed = ~F.coalesce("open", F.lit(False))
    containers = state.where("fresh").select(F.col("container_id").alias("id"), "filename", sealed.alias("sealed"), F.lit(False).alias("sealing"), F.when(sealed, F.col("sha256")).alias("container_hash"), F.lit(False).alias("quarantine"), F.col("end").alias("current_size"), F.lit(most).cast("long").alias("max_size"))
    grown = state.where("NOT fresh").select(F.col("container_id").alias("id"), "end", F.col("sha256").alias("now"), sealed.alias("full"))
    kept = repo.container.join(grown, "id", "left").withColumns({"current_size": F.coalesce("end", "current_size"), "sealed": F.coalesce("full", "sealed"), "container_hash": F.when(F.col("full"), F.col("now")).otherwise(F.col("container_hash"))})
    # the open container of before keeps its file's name
    on_disk = state.where("fresh").select("filename", F.col("end").alias("size"), "sha256").unionByName(repo.container.select("id", "filename").join(grown, "id").select("filename", F.col("end").alias("size"), F.col("now").alias("sha256")))
    disk = repo.container_file.join(on_disk.select("filename"), "filename", "left_anti").unionByName(on_disk)

    gone = repo.blocks.join(again, "chunk_id", "left_semi").select("id")
    path_of = claims.select("file_hash", "size", F.col("id").alias("logical_file_id"))
    wanted = files.join(path_of, ["file_hash", "size"]).select("path", "logical_file_id", "mode", "mtime", "uid", "gid", (F.col("mode").isNotNull() & F.col("mtime").isNotNull() & F.col("uid").isNotNull() & F.col("gid").isNotNull()).alias("is_metadata_complete"))
    before = repo.logical_file.join(claims.where("state = 'rebuilt'").select("id", F.lit(True).alias("redone")), "id", "left")
    before = before.withColumns({"status": F.when(F.col("redone"), COMPLETED).otherwise(F.col("status")), "chunker_version": F.when(F.col("redone"), profile.version).otherwise(F.col("chunker_version"))}).select(*repo.logical_file.columns)
    added = claims.where("state = 'new'").select("id", F.element_at(F.split("first_path", "/"), -1).alias("original_name"), F.col("size").alias("total_size"), "file_hash", F.lit(0).cast("long").alias("ref_count"), F.lit(profile.version).alias("chunker_version"), F.lit(COMPLETED).alias("status"), F.lit(0).alias("retry_count"))
    payloads = repo.block_payload.join(gone.withColumnRenamed("id", "block_id"), "block_id", "left_anti").unionByName(blocks.select(F.col("id").alias("block_id"), "payload"))
    out = repo.replace(
        logical_file=before.unionByName(added),
        chunk=old.select(*names).unionByName(fresh),
        file_chunk=repo.file_chunk.join(rebuilt, "logical_file_id", "left_anti").unionByName(links.select(*repo.file_chunk.columns)),
        blocks=repo.blocks.join(again, "chunk_id", "left_anti").select(*schema("blocks").names).unionByName(blocks.drop("payload")),
        block_payload=payloads,
        container=kept.select(*schema("container").names).unionByName(containers),
        container_file=disk,
    )
    return maintenance.map_paths(out, wanted, replace)


def container_bytes(repo: Repository, most: int = DEFAULT_CONTAINER_MAX, created: int = 0) -> DataFrame:
    """filename and content of every container, from its header and payloads in order; a container is one row of at most its
    own size. What lies before the first block, and gaps, are not filled."""
    parts = repo.blocks.join(repo.block_payload.withColumnRenamed("block_id", "id"), "id")
    body = parts.groupBy(F.col("container_id").alias("id")).agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY block_offset)").alias("body"))
    head = F.unhex(F.lit(header(1, most, created).hex()))
    return repo.container.join(body, "id").select("filename", F.concat(head, F.col("body")).alias("content"))


def unfinished(repo: Repository) -> DataFrame:
    """Completed files with bytes whose recipe isn't whole: no rows, or more or fewer than its last order tells."""
    f = repo.logical_file.where((F.col("status") == COMPLETED) & (F.col("total_size") > 0)).select(F.col("id").alias("logical_file_id"))
    return f.join(maintenance.finalizable(repo).where("complete"), "logical_file_id", "left_anti")
