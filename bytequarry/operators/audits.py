"""Integrity audits. Each returns its findings (check, severity, entity_id, detail); none of them is a clean bill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..repository import Repository
from ..schema import COMPLETED, HEADER_SIZE, schema


def _found(df: DataFrame, check: str, entity: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit("error").alias("severity"), entity.cast("string").alias("entity_id"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def _files(repo: Repository) -> DataFrame:
    return repo.logical_file.withColumnRenamed("id", "logical_file_id")


def _chunks(repo: Repository) -> DataFrame:
    return repo.chunk.withColumnRenamed("id", "chunk_id")


def _counted(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    return left.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def block_cardinality(repo: Repository) -> DataFrame:
    c = _counted(_chunks(repo).where(F.col("status") == COMPLETED), repo.blocks, "chunk_id", "n").where("n <> 1")
    return _found(c, "block_cardinality", F.col("chunk_id"), F.col("n"))


def chunk_refcount(repo: Repository) -> DataFrame:
    """live_ref_count counts references; a file may refer to a chunk several times."""
    c = _counted(_chunks(repo), repo.file_chunk, "chunk_id", "n").where("n <> live_ref_count")
    return _found(c, "chunk_refcount", F.col("chunk_id"), F.concat_ws("/", "live_ref_count", "n"))


def orphan_chunks(repo: Repository) -> DataFrame:
    return _found(_chunks(repo).where("live_ref_count > 0").join(repo.file_chunk, "chunk_id", "left_anti"), "orphan_chunk", F.col("chunk_id"))


def pinned_status(repo: Repository) -> DataFrame:
    return _found(repo.chunk.where((F.col("pin_count") > 0) & (F.col("status") != COMPLETED)), "pinned_status", F.col("id"), F.col("status"))


def pinned_blocks(repo: Repository) -> DataFrame:
    c = _counted(_chunks(repo).where("pin_count > 0"), repo.blocks, "chunk_id", "n").where("n <> 1")
    return _found(c, "pinned_blocks", F.col("chunk_id"), F.col("n"))


def empty_versions(repo: Repository) -> DataFrame:
    one = _found(repo.logical_file.where(F.trim("chunker_version") == ""), "empty_version_file", F.col("id"))
    return one.unionByName(_found(repo.chunk.where(F.trim("chunker_version") == ""), "empty_version_chunk", F.col("id")))


def orphan_physical(repo: Repository) -> DataFrame:
    return _found(repo.physical_file.join(_files(repo), "logical_file_id", "left_anti"), "orphan_physical", F.col("path"), F.col("logical_file_id"))


def refcount(repo: Repository) -> DataFrame:
    f = _counted(_files(repo), repo.physical_file, "logical_file_id", "n").where("n <> ref_count")
    return _found(f, "refcount", F.col("logical_file_id"), F.concat_ws("/", "ref_count", "n"))


def negative_refcount(repo: Repository) -> DataFrame:
    return _found(repo.logical_file.where("ref_count < 0"), "negative_refcount", F.col("id"), F.col("ref_count"))


def snapshot_duplicates(repo: Repository) -> DataFrame:
    d = repo.snapshot_file.groupBy("snapshot_id", "path_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(d, "snapshot_duplicate", F.concat_ws("/", "snapshot_id", "path_id"), F.col("n"))


def snapshot_paths(repo: Repository) -> DataFrame:
    p = repo.snapshot_path.select(F.col("id").alias("path_id"))
    return _found(repo.snapshot_file.join(p, "path_id", "left_anti"), "snapshot_path", F.concat_ws("/", "snapshot_id", "path_id"))


def snapshot_logical(repo: Repository) -> DataFrame:
    gone = repo.snapshot_file.join(_files(repo), "logical_file_id", "left_anti").join(repo.snapshot_path.withColumnRenamed("id", "path_id"), "path_id", "left")
    return _found(gone, "snapshot_logical", F.concat_ws("/", "snapshot_id", "path_id"), F.coalesce("path", F.lit("")))


def snapshot_lifecycle(repo: Repository) -> DataFrame:
    bad = _files(repo).where((F.col("status") != COMPLETED) | (F.col("ref_count") < 0)).join(repo.snapshot_file, "logical_file_id", "left_semi")
    return _found(bad, "snapshot_lifecycle", F.col("logical_file_id"), F.col("status"))


def retained_without_chunks(repo: Repository) -> DataFrame:
    f = _files(repo).where("total_size > 0").join(repo.snapshot_file, "logical_file_id", "left_semi").join(repo.file_chunk, "logical_file_id", "left_anti")
    return _found(f, "retained_without_chunks", F.col("logical_file_id"))


def files_without_chunks(repo: Repository) -> DataFrame:
    f = _files(repo).where((F.col("total_size") > 0) & (F.col("status") == COMPLETED)).join(repo.file_chunk, "logical_file_id", "left_anti")
    return _found(f, "file_without_chunks", F.col("logical_file_id"))


def chunk_order(repo: Repository) -> DataFrame:
    w = Window.partitionBy("logical_file_id").orderBy("chunk_order")
    f = repo.file_chunk.withColumn("want", F.row_number().over(w) - 1).where("want <> chunk_order")
    return _found(f.groupBy("logical_file_id").agg(F.count(F.lit(1)).alias("n")), "chunk_order", F.col("logical_file_id"), F.col("n"))


def block_status(repo: Repository) -> DataFrame:
    """Completed chunks without a block, and blocks of chunks that aren't completed."""
    c = _chunks(repo)
    one = _found(c.where(F.col("status") == COMPLETED).join(repo.blocks, "chunk_id", "left_anti"), "completed_without_block", F.col("chunk_id"))
    return one.unionByName(_found(c.where(F.col("status") != COMPLETED).join(repo.blocks, "chunk_id", "left_semi"), "block_of_incomplete", F.col("chunk_id"), F.col("status")))


def sealed_incomplete(repo: Repository) -> DataFrame:
    b = repo.blocks.join(_chunks(repo).where(F.col("status") != COMPLETED).select("chunk_id"), "chunk_id", "left_semi").select("container_id").distinct()
    return _found(repo.container.where("sealed").join(b, F.col("id") == F.col("container_id"), "left_semi"), "sealed_incomplete", F.col("id"))


def contiguity(repo: Repository) -> DataFrame:
    """Each block begins where the one before ended, the first one after the header. Invalid rows don't move the end."""
    w = Window.partitionBy("container_id").orderBy("block_offset", "id")
    valid = (F.col("stored_size") > 0) & (F.col("block_offset") >= 0)
    end = F.when(valid, F.col("block_offset") + F.col("stored_size"))
    want = F.coalesce(F.last(end, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(HEADER_SIZE))
    b = repo.blocks.withColumn("want", want).where(F.col("want") != F.col("block_offset"))
    return _found(b, "contiguity", F.col("id"), F.concat_ws("/", "want", "block_offset"))


def trailing(repo: Repository) -> DataFrame:
    last = repo.blocks.groupBy("container_id").agg(F.max(F.col("block_offset") + F.col("stored_size")).alias("end"))
    c = repo.container.join(last, F.col("id") == F.col("container_id")).where("current_size > end")
    return _found(c, "trailing_bytes", F.col("id"), F.col("current_size") - F.col("end"))


def container_files(repo: Repository) -> DataFrame:
    c = repo.container.join(repo.container_file.select("filename", F.col("size").alias("on_disk")), "filename", "left")
    gap = F.when(F.col("on_disk").isNull(), "missing").when(F.col("on_disk") > F.col("current_size"), "ghost_bytes").when(F.col("on_disk") < F.col("current_size"), "truncated")
    return _found(c.withColumn("gap", gap).where("gap IS NOT NULL"), "container_file", F.col("id"), F.col("gap"))


def sealed_hash(repo: Repository) -> DataFrame:
    c = repo.container.where("sealed").join(repo.container_file.select("filename", "sha256"), "filename")
    bad = F.when(F.col("container_hash").isNull(), "no_hash").when(F.col("container_hash") != F.col("sha256"), "differs")
    return _found(c.withColumn("bad", bad).where("bad IS NOT NULL"), "sealed_hash", F.col("id"), F.col("bad"))


def file_verdicts(repo: Repository) -> DataFrame:
    """Every file's first failure at the standard level, or ok."""
    w = Window.partitionBy("logical_file_id").orderBy("chunk_order")
    rows = repo.file_chunk.withColumn("want", F.row_number().over(w) - 1).join(_chunks(repo).select("chunk_id", F.col("status").alias("chunk_status")), "chunk_id", "left").join(repo.blocks.select("chunk_id", F.lit(1).alias("block")).distinct(), "chunk_id", "left")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    own = rows.groupBy("logical_file_id").agg(F.count(F.lit(1)).alias("chunks"), n("want <> chunk_order").alias("order"), n(f"chunk_status IS NULL OR chunk_status <> '{COMPLETED}'").alias("state"), n("block IS NULL").alias("block"))
    f = _files(repo).join(own, "logical_file_id", "left")
    verdict = F.when(F.col("status") != COMPLETED, "status").when(F.trim("chunker_version") == "", "version").when((F.col("total_size") > 0) & F.col("chunks").isNull(), "no_chunks").when(F.col("order") > 0, "chunk_order").when(F.col("state") > 0, "chunk_status").when(F.col("block") > 0, "block_missing").otherwise("ok")
    return f.select(F.col("logical_file_id").alias("id"), verdict.alias("verdict"))


def physical_graph(repo: Repository) -> DataFrame:
    """One row: orphans, mismatched and negative counts, and the code of the broken invariant: that of the only kind there is,
    or the general one; null if all is well."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(orphan_physical(repo), "orphans").crossJoin(n(refcount(repo), "mismatches")).crossJoin(n(negative_refcount(repo), "negatives"))
    kinds = sum(((F.col(c) > 0).cast("int") for c in row.columns), F.lit(0))
    code = F.when(kinds > 1, scalars.PHYSICAL).when(F.col("orphans") > 0, scalars.PHYSICAL_ORPHAN).when(F.col("mismatches") > 0, scalars.PHYSICAL_COUNT).when(F.col("negatives") > 0, scalars.PHYSICAL_NEGATIVE)
    return row.withColumn("code", code)


def shown(findings: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` findings of each check by entity, and how many the check has."""
    total = findings.groupBy("check").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("check").orderBy("entity_id", "detail"))
    return findings.withColumn("place", place).where(F.col("place") <= most).join(F.broadcast(total), "check")


STANDARD: tuple[Callable[[Repository], DataFrame], ...] = (block_cardinality, chunk_refcount, orphan_chunks, pinned_status, pinned_blocks, empty_versions, snapshot_duplicates, snapshot_paths, snapshot_logical, snapshot_lifecycle, retained_without_chunks, orphan_physical, refcount, negative_refcount, files_without_chunks, chunk_order)
FULL = (*STANDARD, container_files, sealed_hash, block_status, contiguity, sealed_incomplete)
DEEP = (*FULL, trailing)
LEVELS = {"standard": STANDARD, "full": FULL, "deep": DEEP}


def verify(repo: Repository, level: str = "standard", key: bytes | None = None) -> DataFrame:
    """All findings of a level with the place of their check. The deep level reads the blocks if the repository has payloads."""
    out = None
    for k, audit in enumerate(LEVELS[level]):
        df = audit(repo).withColumn("step", F.lit(k).cast("long"))
        out = df if out is None else out.unionByName(df)
    if level == "deep" and "block_payload" in repo.tables:
        from .restore import blocks_deep

        out = out.unionByName(blocks_deep(repo, key).withColumn("step", F.lit(len(DEEP)).cast("long")))
    return out


def summary(repo: Repository, level: str = "full", shown: int = 50) -> DataFrame:
    """Findings per check and how many of them are shown."""
    return verify(repo, level).groupBy("step", "check").agg(F.count(F.lit(1)).alias("findings")).withColumn("shown", F.least("findings", F.lit(shown).cast("long")))


def doctor(repo: Repository, level: str = "standard") -> DataFrame:
    """One row: status, findings, and the first check that failed."""
    v = verify(repo, level).agg(F.count(F.lit(1)).alias("findings"), F.min(F.struct("step", "check")).alias("first"))
    return v.select(F.when(F.col("findings") > 0, "error").otherwise("ok").alias("status"), "findings", F.coalesce("first.check", F.lit("")).alias("first_check"))


def examined(repo: Repository, level: str = "standard", key: bytes | None = None) -> dict[str, object]:
    """Recovery, schema and verification, one after another; a failure ends it. What recovery did, the phases' states, the
    findings by check, and the repository after recovery."""
    from . import maintenance

    out: dict[str, object] = {"recovery": maintenance.recovery_report(repo).head().asDict(), "recovery_status": "ok", "schema_status": "skipped", "verify_status": "skipped"}
    out["repository"] = repo = maintenance.recover(repo)
    wrong = [n for n, df in repo.tables.items() if [f.name for f in df.schema] != schema(n).names]
    out["schema_status"] = "error" if wrong else "ok"
    if wrong:
        return out | {"wrong_tables": sorted(wrong)}
    found = {r["check"]: r["n"] for r in verify(repo, level, key).groupBy("check").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each check
    out |= {"findings": found, "verify_status": "error" if found else "ok"}
    return out if found else out | {"physical": physical_graph(repo).head().asDict()}
