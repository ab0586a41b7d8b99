"""Garbage collection, recovery, repair and removal: reports, and state changes that return a new repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.cdc import Registry
from ..functions.numbering import largest, numbered
from ..repository import Repository
from ..schema import ABORTED, COMPLETED, HEADER_SIZE, PROCESSING
from . import audits, retention, stats


def _liveness(repo: Repository) -> DataFrame:
    """container_id, its blocks, and whether one of them is live or belongs to a retained file."""
    kept = repo.file_chunk.join(retention.retained(repo), "logical_file_id", "left_semi").select("chunk_id").distinct().withColumn("kept", F.lit(1))
    b = stats.placed(repo).join(kept, "chunk_id", "left")
    return b.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"), F.max(stats.live().cast("int")).alias("live"), F.max("kept").alias("kept"))


def gc_candidates(repo: Repository) -> DataFrame:
    """id, sealed and verdict of each healthy container: eligible, live or retained. An empty sealed one is eligible, an
    empty active one isn't."""
    c = repo.container.where("NOT quarantine").join(_liveness(repo), F.col("id") == F.col("container_id"), "left")
    verdict = F.when(F.coalesce("live", F.lit(0)) == 1, "live").when(F.coalesce("kept", F.lit(0)) == 1, "retained").when(~F.col("sealed") & F.col("n").isNull(), "empty").otherwise("eligible")
    return c.select("id", "sealed", verdict.alias("verdict"))


def gc_report(repo: Repository) -> DataFrame:
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return gc_candidates(repo).agg(n("sealed AND verdict = 'eligible'").alias("eligible"), n("sealed AND verdict = 'retained'").alias("retained"), n("verdict = 'live'").alias("live"), n("NOT sealed AND verdict = 'eligible'").alias("dead_active"))


def gate(repo: Repository) -> None:
    """Collection is refused while the physical graph is broken, a dry run too."""
    row = audits.physical_graph(repo).head()
    if row["code"]:
        raise scalars.InvariantError(scalars.GC_REFUSED, f"the physical graph is broken ({row['code']}); repair it first")


def dry_run(repo: Repository) -> DataFrame:
    """What `collect` would do, behind the same gate."""
    gate(repo)
    return gc_report(repo)


def collect(repo: Repository, audit: bool = True) -> Repository:
    """The repository without the eligible containers, their blocks and dead chunks. Refused if the physical graph is broken."""
    if audit:
        gate(repo)
    gone = gc_candidates(repo).where("verdict = 'eligible'").select(F.col("id").alias("container_id"))
    dead = repo.blocks.join(gone, "container_id", "left_semi").select(F.col("chunk_id").alias("id"))
    files = repo.container.join(gone.withColumnRenamed("container_id", "id"), "id", "left_semi").select("filename")
    lost = repo.blocks.join(gone, "container_id", "left_semi").select(F.col("id").alias("block_id"))
    return repo.replace(container=repo.container.join(gone.withColumnRenamed("container_id", "id"), "id", "left_anti"), blocks=repo.blocks.join(gone, "container_id", "left_anti"), chunk=repo.chunk.join(dead, "id", "left_anti"), container_file=repo.container_file.join(files, "filename", "left_anti"), block_payload=repo.block_payload.join(lost, "block_id", "left_anti"))


def repair_report(repo: Repository) -> DataFrame:
    f = audits._counted(audits._files(repo), repo.physical_file, "logical_file_id", "n")
    one = f.agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(F.col("n") != F.col("ref_count"), 1)).alias("updated"))
    return one.crossJoin(audits.orphan_physical(repo).agg(F.count(F.lit(1)).alias("orphans")))


def repair(repo: Repository) -> Repository:
    """Reference counts from the physical rows; refused while some have no file."""
    if not audits.orphan_physical(repo).isEmpty():
        raise scalars.InvariantError(scalars.REPAIR_REFUSED, "physical rows without a logical file")
    f = audits._counted(audits._files(repo), repo.physical_file, "logical_file_id", "n").withColumn("ref_count", F.col("n")).withColumnRenamed("logical_file_id", "id")
    return repo.replace(logical_file=f.select(*repo.logical_file.columns))


def recounted(repo: Repository) -> Repository:
    """Chunks' reference counts from the recipes."""
    c = audits._counted(audits._chunks(repo), repo.file_chunk, "chunk_id", "n").withColumn("live_ref_count", F.col("n")).withColumnRenamed("chunk_id", "id")
    return repo.replace(chunk=c.select(*repo.chunk.columns))


def abort_processing(repo: Repository) -> Repository:
    done = F.when(F.col("status") == PROCESSING, ABORTED).otherwise(F.col("status"))
    return repo.replace(logical_file=repo.logical_file.withColumn("status", done), chunk=repo.chunk.withColumn("status", done))


def abort_report(repo: Repository) -> DataFrame:
    n = lambda df, name: df.where(F.col("status") == PROCESSING).agg(F.count(F.lit(1)).alias(name))
    return n(repo.logical_file, "aborted_files").crossJoin(n(repo.chunk, "aborted_chunks"))


#: Why an active container is quarantined.
PAST_EOF, GHOST, BLOCK_PAST_EOF = "db_current_size_past_eof", "physical_size_past_db_current_size", "completed_block_past_eof"
NOT_AT_HEADER, GAPS, TRAILING = "first_block_not_at_header", "non_contiguous_block_offsets", "trailing_unreferenced_bytes"


def tail_reasons(repo: Repository) -> DataFrame:
    """Why active containers are corrupt, in order of priority. Of the blocks only those of completed chunks count."""
    w = Window.partitionBy("container_id").orderBy("block_offset", "id")
    done = repo.blocks.join(audits._chunks(repo).where(F.col("status") == COMPLETED).select("chunk_id"), "chunk_id", "left_semi")
    b = done.withColumn("before", F.lag(F.col("block_offset") + F.col("stored_size")).over(w))
    end = F.col("block_offset") + F.col("stored_size")
    g = b.groupBy("container_id").agg(F.min("block_offset").alias("first"), F.max(end).alias("end"), F.max(((F.col("block_offset") < 0) | (F.col("stored_size") <= 0)).cast("int")).alias("invalid"), F.max((F.col("before").isNotNull() & (F.col("before") != F.col("block_offset"))).cast("int")).alias("gap"))
    c = repo.container.where("NOT sealed AND NOT sealing AND NOT quarantine").join(repo.container_file.select("filename", F.col("size").alias("disk")), "filename").join(g, F.col("id") == F.col("container_id"), "left")
    reason = (
        F.when(F.col("current_size") > F.col("disk"), PAST_EOF)
        .when(F.col("disk") > F.col("current_size"), GHOST)
        .when((F.col("end") > F.col("disk")) | (F.col("invalid") == 1), BLOCK_PAST_EOF)
        .when(F.col("first") != HEADER_SIZE, NOT_AT_HEADER)
        .when(F.col("gap") == 1, GAPS)
        .when(F.coalesce("end", F.lit(HEADER_SIZE)) < F.col("current_size"), TRAILING)
    )
    return c.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def sealing_verdicts(repo: Repository) -> DataFrame:
    """Of containers that were being sealed when work broke off, sealed or quarantined ones left out."""
    c = repo.container.where("sealing AND NOT sealed AND NOT quarantine").join(repo.container_file.select("filename", F.col("size").alias("disk")), "filename", "left")
    return c.select("id", F.when(F.col("disk").isNull() | (F.col("disk") != F.col("current_size")), "quarantine").otherwise("seal").alias("verdict"))


def seal(repo: Repository, container_id: int) -> Repository:
    """One container sealed with the hash of its file; refused if their sizes differ or there is no file."""
    row = repo.container.where(F.col("id") == container_id).join(repo.container_file.select("filename", F.col("size").alias("disk"), "sha256"), "filename", "left").head()
    if row is None or row["disk"] is None or row["disk"] != row["current_size"]:
        raise ValueError("no such container" if row is None else "no file" if row["disk"] is None else "ghost bytes" if row["disk"] > row["current_size"] else "truncated")
    own = F.col("id") == container_id
    return repo.replace(container=repo.container.withColumns({"sealed": F.col("sealed") | own, "sealing": F.col("sealing") & ~own, "container_hash": F.when(own, row["sha256"]).otherwise(F.col("container_hash"))}))


def quarantine(repo: Repository, container_id: int) -> Repository:
    """One container quarantined, its sizes those of its file if there is one."""
    own = F.col("id") == container_id
    disk = repo.container_file.select("filename", F.col("size").alias("disk"))
    c = repo.container.join(disk, "filename", "left").withColumns({"quarantine": F.col("quarantine") | own, "sealing": F.col("sealing") & ~own, "current_size": F.when(own, F.coalesce("disk", "current_size")).otherwise(F.col("current_size")), "max_size": F.when(own, F.coalesce("disk", "max_size")).otherwise(F.col("max_size"))})
    return repo.replace(container=c.select(*repo.container.columns))


def missing_files(repo: Repository) -> DataFrame:
    return repo.container.where("NOT quarantine").join(repo.container_file, "filename", "left_anti").select("id", "filename")


def orphan_files(repo: Repository) -> DataFrame:
    return repo.container_file.join(repo.container, "filename", "left_anti").select("filename", "size")


def recover(repo: Repository) -> Repository:
    """All recovery steps: abort, clear stale markers, seal or quarantine, register files without a row as quarantined. What is
    quarantined gets the size of its file, if there is one, also if it was quarantined before."""
    repo = abort_processing(repo)
    bad = missing_files(repo).select("id").unionByName(tail_reasons(repo).select("id")).unionByName(sealing_verdicts(repo).where("verdict = 'quarantine'").select("id")).distinct().withColumn("bad", F.lit(True))
    fine = sealing_verdicts(repo).where("verdict = 'seal'").select("id", F.lit(True).alias("fine"))
    files = repo.container_file.select("filename", F.col("sha256"), F.col("size").alias("disk"))
    c = repo.container.join(bad, "id", "left").join(fine, "id", "left").join(files, "filename", "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    c = c.withColumn("quarantine", F.col("quarantine") | yes("bad"))
    c = c.withColumns({"sealed": F.col("sealed") | yes("fine"), "container_hash": F.when(yes("fine"), F.col("sha256")).otherwise(F.col("container_hash")), "sealing": F.lit(False)})
    for size in ("current_size", "max_size"):
        c = c.withColumn(size, F.when(F.col("quarantine"), F.coalesce("disk", size)).otherwise(F.col(size)))
    extra = numbered(orphan_files(repo), ["filename"], largest(repo.container)).select("id", "filename", F.lit(False).alias("sealed"), F.lit(False).alias("sealing"), F.lit(None).cast("string").alias("container_hash"), F.lit(True).alias("quarantine"), F.col("size").alias("current_size"), F.col("size").alias("max_size"))
    return repo.replace(container=c.select(*repo.container.columns).unionByName(extra))


def recovery_report(repo: Repository, skipped_folders: int = 0) -> DataFrame:
    """The counters of a recovery. skipped_folders: entries of the containers' folder that aren't files, as the listing tells."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = abort_report(repo)
    for df, name in ((sealing_verdicts(repo).where("verdict = 'seal'"), "sealed"), (sealing_verdicts(repo).where("verdict = 'quarantine'"), "sealing_quarantined"), (missing_files(repo), "missing"), (tail_reasons(repo), "corrupt_tails"), (orphan_files(repo), "orphan_files"), (repo.container.where("NOT quarantine"), "checked_containers"), (repo.container_file, "checked_files")):
        out = out.crossJoin(n(df, name))
    return out.withColumn("skipped_folders", F.lit(skipped_folders).cast("long"))


def removal_plan(repo: Repository) -> DataFrame:
    """What removing each logical file by id would do."""
    kept = retention.snapshot_roots(repo).withColumnRenamed("logical_file_id", "id").withColumn("kept", F.lit(1))
    refs = repo.file_chunk.groupBy(F.col("logical_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    f = repo.logical_file.join(kept, "id", "left").join(refs, "id", "left")
    verdict = F.when(F.col("status") == PROCESSING, "refused_processing").when(F.col("kept").isNotNull(), "refused_retained").otherwise("remove")
    return f.select("id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("chunk_refs"))


def _unlinked(repo: Repository, logical_file_id: int, suspicious: bool = False) -> Repository:
    """Without the links of a file; each takes one off its chunk's count, which doesn't go below zero. Other counts, wrong ones
    too, stay as they are, for the audits to find."""
    own = repo.file_chunk.where(F.col("logical_file_id") == logical_file_id).groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    c = repo.chunk.join(own, "id", "left").withColumn("live_ref_count", F.when(F.col("links").isNull(), F.col("live_ref_count")).otherwise(F.greatest(F.col("live_ref_count") - F.col("links"), F.least("live_ref_count", F.lit(0)))))
    if suspicious:
        c = c.withColumn("retry_count", (F.col("retry_count") + F.when(F.col("links").isNull(), 0).otherwise(1)).cast("int"))
    return repo.replace(chunk=c.select(*repo.chunk.columns), file_chunk=repo.file_chunk.where(F.col("logical_file_id") != logical_file_id))


def _moved(repo: Repository, moves: DataFrame) -> DataFrame:
    """Logical files with their reference counts moved by `moves` (id, by); an error if a count would go below zero."""
    f = repo.logical_file.join(moves.groupBy("id").agg(F.sum("by").alias("by")), "id", "left").withColumn("by", F.coalesce("by", F.lit(0)))
    new = F.col("ref_count") + F.col("by")
    safe = F.when((F.col("by") < 0) & (new < 0), F.raise_error(F.concat(F.lit(f"{scalars.PHYSICAL_NEGATIVE}: logical file "), F.col("id").cast("string"))).cast("long")).otherwise(new)
    return f.withColumn("ref_count", safe).select(*repo.logical_file.columns)


def remove(repo: Repository, logical_file_id: int) -> Repository:
    plan = removal_plan(repo).where(F.col("id") == logical_file_id).head()
    if plan is None:
        raise ValueError("no such file")
    if plan["verdict"] == "refused_retained":
        raise Retained()
    if plan["verdict"] != "remove":
        raise ValueError(plan["verdict"])
    keep = lambda df, c: df.where(F.col(c) != logical_file_id)
    repo = _unlinked(repo, logical_file_id)
    return repo.replace(logical_file=keep(repo.logical_file, "id"), physical_file=keep(repo.physical_file, "logical_file_id"))


class Retained(scalars.InvariantError, ValueError):
    def __init__(self):
        super().__init__(scalars.RETAINED, "refused_retained")


def unmap(repo: Repository, path: str) -> Repository:
    """Remove one path; refused if a snapshot retains its file, or if its count is zero already."""
    row = repo.physical_file.where(F.col("path") == path).head()
    if row is None:
        raise ValueError("no such path")
    if retention.is_referenced(repo, row["logical_file_id"]):
        raise Retained()
    file = repo.logical_file.where(F.col("id") == row["logical_file_id"]).select("ref_count").head()
    if file is not None and file["ref_count"] < 1:
        raise scalars.InvariantError(scalars.PHYSICAL_NEGATIVE, "the count would go below zero")
    moves = repo.spark.createDataFrame([(row["logical_file_id"], -1)], "id long, by long")
    return repo.replace(physical_file=repo.physical_file.where(F.col("path") != path), logical_file=_moved(repo, moves))


def map_path(repo: Repository, path: str, logical_file_id: int, replace: bool = False, mode: int | None = None, mtime: int | None = None) -> Repository:
    """Insert or refresh a path's row; another file's path is a conflict unless it may be replaced."""
    row = repo.spark.createDataFrame([(path, logical_file_id, mode, mtime, None, None, mode is not None)], repo.physical_file.schema)
    return map_paths(repo, row, replace)


def map_paths(repo: Repository, rows: DataFrame, replace: bool = False) -> Repository:
    """The same for many rows of physical_file, their paths distinct. The counts of the files that win and lose a path move by one
    for each, and no other."""
    old = repo.physical_file.select("path", F.col("logical_file_id").alias("old_id"))
    both = rows.select("path", F.col("logical_file_id").alias("new_id")).join(old, "path", "left")
    taken = both.where("old_id <> new_id")
    if not replace and (row := taken.select("path").head()) is not None:
        raise ValueError(f"conflict: {row['path']} belongs to another file")
    gained = both.where("old_id IS NULL OR old_id <> new_id").select(F.col("new_id").alias("id"), F.lit(1).alias("by"))
    moves = gained.unionByName(taken.select(F.col("old_id").alias("id"), F.lit(-1).alias("by")))
    kept = repo.physical_file.join(rows.select("path"), "path", "left_anti").select(*repo.physical_file.columns)
    return repo.replace(physical_file=kept.unionByName(rows.select(*repo.physical_file.columns)), logical_file=_moved(repo, moves))


def reset_file(repo: Repository, logical_file_id: int, suspicious: bool = False) -> Repository:
    """A completed (or aborted) file back to the start of a store: aborted, without links. suspicious: its chunks get a retry
    more, as after a refused reuse. A file being stored stays as it is."""
    row = repo.logical_file.where(F.col("id") == logical_file_id).select("status").head()
    if row is None:
        raise ValueError("no such file")
    if row["status"] == PROCESSING:
        return repo
    f = repo.logical_file.withColumn("status", F.when(F.col("id") == logical_file_id, ABORTED).otherwise(F.col("status")))
    return _unlinked(repo.replace(logical_file=f), logical_file_id, suspicious)


def finalizable(repo: Repository) -> DataFrame:
    """Files whose recipe is whole: as many rows as the last order tells."""
    g = repo.file_chunk.groupBy("logical_file_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_order").alias("last"))
    return g.select("logical_file_id", "n", (F.col("last") == F.col("n") - 1).alias("complete"))


def configure(repo: Repository, key: str, value: str) -> Repository:
    if not key.strip() or not value.strip():
        raise ValueError("key and value must not be empty")
    if key == "default_chunker":
        Registry().get(value)
    row = repo.spark.createDataFrame([(key, value)], repo.repository_config.schema)
    return repo.replace(repository_config=repo.repository_config.where(F.col("key") != key).unionByName(row))


def reuse_graph(repo: Repository) -> DataFrame:
    """Per file: broken orders, invalid chunks, missing blocks and containers. Quarantined containers are fine here."""
    w = Window.partitionBy("logical_file_id").orderBy("chunk_order")
    rows = repo.file_chunk.withColumn("want", F.row_number().over(w) - 1).join(audits._chunks(repo).select("chunk_id", "status"), "chunk_id", "left").join(repo.blocks.select("chunk_id", "container_id"), "chunk_id", "left").join(repo.container.select(F.col("id").alias("container_id"), F.lit(1).alias("held")), "container_id", "left")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return rows.groupBy("logical_file_id").agg(n("want <> chunk_order").alias("broken_orders"), n(f"status IS NULL OR status <> '{COMPLETED}'").alias("invalid_chunks"), n("container_id IS NULL").alias("missing_blocks"), n("container_id IS NOT NULL AND held IS NULL").alias("missing_containers"))


def suspicion(repo: Repository) -> DataFrame:
    """Per file: retried chunks, and containers that may still change."""
    rows = repo.file_chunk.join(audits._chunks(repo).select("chunk_id", "retry_count"), "chunk_id", "left").join(repo.blocks.select("chunk_id", "container_id"), "chunk_id", "left").join(repo.container.select(F.col("id").alias("container_id"), "sealed"), "container_id", "left")
    return rows.groupBy("logical_file_id").agg(F.countDistinct(F.when(F.col("retry_count") > 0, F.col("chunk_id"))).alias("retried_chunks"), F.countDistinct(F.when(~F.col("sealed"), F.col("container_id"))).alias("mutable_containers"))
