"""The engine's queries over the derived repository, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cdc, scalars
from ..operators import audits, batch, ingest, listing, maintenance, restore, retention, reuse, snapshots, stats, store
from ..repository import Repository
from ..schema import V1, V2
from ..sources import derive
from .oracle import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def derived(spark: SparkSession, sf_dir: str) -> Repository:
    """The derived repository, made once in an application."""
    return derive.saved(spark, sf_dir, "derived", lambda: derive.repository(spark, sf_dir))


def add(name: str, make: Callable[[Repository], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(derived(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = BASE + sql


def add_raw(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql is not None:
        ORACLE_SQL[name] = sql


FILES = "SELECT l.id, p.path, total_size, file_hash, ref_count, chunker_version FROM physical_file p JOIN logical_file l ON p.logical_file_id = l.id WHERE status = 'COMPLETED'"
BUCKET = "CASE WHEN regexp_matches(trim(chunker_version), '^v[0-9]+(-[a-z0-9]+)+$') THEN trim(chunker_version) ELSE 'unknown' END"
add("list_files", listing.files, FILES)
add("list_page", lambda r: listing.files(r, limit=20, offset=10), FILES + " ORDER BY path LIMIT 20 OFFSET 10")
add("list_limit_zero", lambda r: listing.files(r, limit=0), FILES + " LIMIT 0")
add("search_name_size", lambda r: listing.files(r, ("SRC1", "/en/"), 100, 5000, 50), FILES + " AND lower(path) LIKE '%src1%' AND lower(path) LIKE '%/en/%' AND total_size BETWEEN 100 AND 5000 ORDER BY path LIMIT 50")
add("inspect_file", listing.inspect, "SELECT l.id, l.status, total_size, coalesce(n, 0) AS n_chunks, round(coalesce(m, 0), 6) AS mean_chunk_size FROM logical_file l LEFT JOIN (SELECT logical_file_id, count(*) AS n, avg(size) AS m FROM file_chunk f JOIN chunk c ON c.id = f.chunk_id GROUP BY 1) x ON x.logical_file_id = l.id")

add("stats_files_by_status", stats.files_by_status, "SELECT count(*) AS files, CAST(sum(total_size) AS BIGINT) AS bytes, " + ", ".join(f"count(*) FILTER (status = '{s.upper()}') AS {s}_files, CAST(coalesce(sum(total_size) FILTER (status = '{s.upper()}'), 0) AS BIGINT) AS {s}_bytes" for s in ("completed", "processing", "aborted")) + " FROM logical_file")
add("stats_containers", stats.containers, "SELECT count(*) AS containers, CAST(coalesce(sum(current_size), 0) AS BIGINT) AS bytes, count(*) FILTER (NOT quarantine) AS healthy, CAST(coalesce(sum(current_size) FILTER (NOT quarantine), 0) AS BIGINT) AS healthy_bytes, count(*) FILTER (quarantine) AS quarantined, CAST(coalesce(sum(current_size) FILTER (quarantine), 0) AS BIGINT) AS quarantined_bytes FROM container")
add("stats_live_dead", stats.live_dead, ", a AS (SELECT coalesce(sum(stored_size) FILTER (live), 0) AS l, coalesce(sum(stored_size) FILTER (NOT live), 0) AS d FROM placed), f AS (SELECT coalesce(sum(total_size), 0) AS t FROM logical_file WHERE status = 'COMPLETED'), h AS (SELECT coalesce(sum(current_size), 0) AS t FROM container WHERE NOT quarantine) SELECT CAST(l AS BIGINT) AS live_bytes, CAST(d AS BIGINT) AS dead_bytes, round(CASE WHEN f.t > 0 THEN (1 - CAST(l AS DOUBLE) / CAST(f.t AS DOUBLE)) * 100 ELSE 0 END, 6) AS dedup_percent, round(CASE WHEN h.t > 0 THEN CAST(d AS DOUBLE) / CAST(h.t AS DOUBLE) * 100 ELSE 0 END, 6) AS fragmentation_percent FROM a, f, h")
RETRY = "SELECT '{0}' AS kind, CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS total, round(coalesce(avg(retry_count), 0), 6) AS mean, CAST(coalesce(max(retry_count), 0) AS BIGINT) AS most FROM {1}"
add("stats_retries", stats.retries, RETRY.format("file", "logical_file") + " UNION ALL " + RETRY.format("chunk", "chunk"))
add("stats_chunk_status", stats.chunks_by_status, "SELECT status, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM chunk GROUP BY status")
add("stats_dedup_signal", stats.dedup_signal, "SELECT count(*) AS refs, count(DISTINCT chunk_id) AS distinct_chunks, round(CASE WHEN count(*) > 0 THEN (1 - count(DISTINCT chunk_id) / count(*)) * 100 ELSE 0 END, 6) AS estimated_dedup FROM file_chunk")
add("stats_chunks_by_version", stats.chunks_by_version, f"SELECT {BUCKET} AS version, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM chunk GROUP BY 1")
add("stats_files_by_version", stats.files_by_version, f"SELECT {BUCKET} AS version, count(*) AS files FROM logical_file GROUP BY 1")
add("stats_mixed_versions", stats.mixed_versions, f", v AS (SELECT {BUCKET} AS v FROM chunk UNION SELECT {BUCKET} FROM logical_file) SELECT count(*) AS versions, count(*) > 1 AS mixed FROM v WHERE v <> 'unknown'")
add("stats_per_container", stats.per_container, "SELECT c.id, quarantine, CAST(current_size AS BIGINT) AS current_size, CAST(coalesce(l, 0) AS BIGINT) AS live_bytes, CAST(coalesce(d, 0) AS BIGINT) AS dead_bytes, round(CASE WHEN coalesce(l, 0) + coalesce(d, 0) > 0 THEN CAST(coalesce(l, 0) AS DOUBLE) / CAST(coalesce(l, 0) + coalesce(d, 0) AS DOUBLE) * 100 ELSE 0 END, 6) AS live_percent FROM container c LEFT JOIN (SELECT container_id, sum(stored_size) FILTER (live) AS l, sum(stored_size) FILTER (NOT live) AS d FROM placed GROUP BY 1) x ON x.container_id = c.id")
add("simulate_store", stats.simulate, ", a AS (SELECT count(*) AS files, coalesce(sum(total_size), 0) AS lb FROM logical_file WHERE status = 'COMPLETED'), b AS (SELECT count(*) AS chunks, count(DISTINCT container_id) AS containers, coalesce(sum(stored_size), 0) AS pb FROM blocks) SELECT files, CAST(lb AS BIGINT) AS logical_bytes, chunks, containers, CAST(pb AS BIGINT) AS physical_bytes, round(CASE WHEN lb > 0 THEN (1 - CAST(pb AS DOUBLE) / CAST(lb AS DOUBLE)) * 100 ELSE 0 END, 6) AS dedup_percent FROM a, b")

CLASSES = ", cur AS (SELECT DISTINCT logical_file_id AS i FROM physical_file WHERE logical_file_id > 0), sn AS (SELECT DISTINCT logical_file_id AS i FROM snapshot_file WHERE logical_file_id > 0), cl AS (SELECT coalesce(cur.i, sn.i) AS logical_file_id, CASE WHEN sn.i IS NULL THEN 'current' WHEN cur.i IS NULL THEN 'snapshot' ELSE 'shared' END AS class FROM cur FULL JOIN sn ON cur.i = sn.i) "
add("retention_classification", retention.classified, CLASSES + "SELECT * FROM cl")
add("retained_union", retention.retained, "SELECT logical_file_id FROM retained WHERE logical_file_id > 0")
_size = lambda c, n: f"CAST(coalesce(sum(total_size) FILTER ({c}), 0) AS BIGINT) AS {n}"
add("retention_stats", retention.report, CLASSES + f"SELECT count(*) FILTER (class = 'current' AND id IS NOT NULL) AS current_only_files, {_size("class = 'current'", 'current_only_bytes')}, count(*) FILTER (class <> 'current') AS referenced_files, {_size("class <> 'current'", 'referenced_bytes')}, count(*) FILTER (class = 'snapshot') AS snapshot_only_files, {_size("class = 'snapshot'", 'snapshot_only_bytes')}, count(*) FILTER (class = 'shared') AS shared_files, {_size("class = 'shared'", 'shared_bytes')} FROM cl LEFT JOIN logical_file l ON l.id = cl.logical_file_id")

SHOW = "SELECT path, logical_file_id, size, mode, mtime FROM (SELECT path, f.* FROM snapshot_file f JOIN snapshot_path p ON p.id = f.path_id) WHERE snapshot_id = '{}'"
add("snapshot_list", lambda r: snapshots.listed(r, label="FIRST", since=1_700_000_000), "SELECT * FROM snapshot WHERE lower(label) LIKE '%first%' AND created_at >= 1700000000")
add("snapshot_list_newest", lambda r: snapshots.listed(r, limit=2), "SELECT * FROM snapshot ORDER BY created_at DESC, id DESC LIMIT 2")
add("snapshot_show_prefix", lambda r: snapshots.show(r, "day1", snapshots.SnapshotQuery(prefixes=("data/src1/", "data/src2/en/"))), SHOW.format("day1") + " AND (starts_with(path, 'data/src1/') OR starts_with(path, 'data/src2/en/'))")
add("snapshot_show_glob", lambda r: snapshots.show(r, "day2", snapshots.SnapshotQuery(glob="data/src?/[d-e]*/1*.txt")), SHOW.format("day2") + " AND regexp_full_match(path, 'data/src[^/]/[d-e][^/]*/1[^/]*\\.txt')")
add("snapshot_show_regex", lambda r: snapshots.show(r, "day1", snapshots.SnapshotQuery(regex="src1[0-5]/(?P<l>fr|es)/.*7")), SHOW.format("day1") + " AND regexp_matches(path, 'src1[0-5]/(fr|es)/.*7')")
add("snapshot_show_size_mtime", lambda r: snapshots.show(r, "day1", snapshots.SnapshotQuery(least_size=500, most_size=3000, after=1_700_360_000)), SHOW.format("day1") + " AND (size IS NULL OR size BETWEEN 500 AND 3000) AND (mtime IS NULL OR mtime >= 1700360000)")
add("snapshot_stats_global", snapshots.totals, "SELECT (SELECT count(*) FROM snapshot) AS snapshots, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM snapshot_file")
add("snapshot_stats_lineage", snapshots.lineage, ", x AS (SELECT s.*, o.type AS parent_type, (SELECT count(*) FROM snapshot_file f WHERE f.snapshot_id = s.id) AS n, (SELECT coalesce(sum(size), 0) FROM snapshot_file f WHERE f.snapshot_id = s.id) AS b, (SELECT count(*) FROM snapshot_file c JOIN snapshot_file p ON p.path_id = c.path_id AND p.logical_file_id = c.logical_file_id WHERE c.snapshot_id = s.id AND p.snapshot_id = s.parent_id) AS r FROM snapshot s LEFT JOIN snapshot o ON o.id = s.parent_id), y AS (SELECT *, CASE WHEN parent_id IS NULL THEN 'no_parent' WHEN type <> 'full' THEN 'lineage_skipped' WHEN parent_type IS NULL THEN 'parent_missing' WHEN parent_type <> 'full' THEN 'lineage_skipped' ELSE 'lineage_computed' END AS lineage FROM x) SELECT id, n AS files, CAST(b AS BIGINT) AS bytes, lineage, CASE WHEN lineage = 'lineage_computed' THEN r END AS reused, CASE WHEN n = 0 THEN 0.0 WHEN lineage = 'lineage_computed' THEN round(CAST(r AS DOUBLE) / n, 6) END AS reuse_ratio FROM y")
#: Trees in SQL: a node's place follows from the (created_at, id) of all nodes from its root down to it.
TREE = """, k AS (SELECT id, parent_id, lpad(CAST(created_at AS VARCHAR), 20, '0') || ':' || id AS mark FROM snapshot), l0 AS (SELECT id, 0 AS depth, [mark] AS way FROM k WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM k)), l1 AS (SELECT k.id, 1 AS depth, list_append(way, mark) AS way FROM k JOIN l0 ON l0.id = k.parent_id), l2 AS (SELECT k.id, 2 AS depth, list_append(way, mark) AS way FROM k JOIN l1 ON l1.id = k.parent_id), l3 AS (SELECT k.id, 3 AS depth, list_append(way, mark) AS way FROM k JOIN l2 ON l2.id = k.parent_id), a AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) SELECT id, depth, row_number() OVER (ORDER BY way) - 1 AS place FROM a"""
DIFF = ", b AS (SELECT * FROM entries WHERE snapshot_id = 'day1'), t AS (SELECT * FROM entries WHERE snapshot_id = 'day2'), df AS (SELECT coalesce(b.path, t.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'removed' WHEN b.logical_file_id <> t.logical_file_id THEN 'modified' END AS change, b.logical_file_id AS base_file, t.logical_file_id AS target_file, CASE WHEN t.path IS NULL THEN b.size ELSE t.size END AS size FROM b FULL JOIN t ON b.path = t.path) "
add("snapshot_diff_entries", lambda r: snapshots.diff(r, "day1", "day2"), DIFF + "SELECT path, change, base_file, target_file FROM df WHERE change IS NOT NULL")
add("snapshot_diff_filtered", lambda r: snapshots.diff(r, "day1", "day2", snapshots.SnapshotQuery(prefixes=("data/src3/",), least_size=800), "removed"), DIFF + "SELECT path, change, base_file, target_file FROM df WHERE change = 'removed' AND starts_with(path, 'data/src3/') AND (size IS NULL OR size >= 800)")
add("snapshot_diff_summary", lambda r: snapshots.diff_summary(r, "day1", "day2"), DIFF + "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM df")
add("snapshot_conflicts", lambda r: snapshots.conflicts(r, "lost"), ", e AS (SELECT regexp_replace(path, '^(\\./)+', '') AS path, logical_file_id FROM entries WHERE snapshot_id = 'lost') SELECT path, count(DISTINCT logical_file_id) AS files FROM e GROUP BY path HAVING count(DISTINCT logical_file_id) > 1")
add("snapshot_delete_preview", lambda r: snapshots.delete_preview(r, "day1"), ", o AS (SELECT count(*) AS total, count(*) FILTER (NOT EXISTS (SELECT 1 FROM snapshot_file x WHERE x.path_id = f.path_id AND x.logical_file_id = f.logical_file_id AND x.snapshot_id <> 'day1')) AS u FROM snapshot_file f WHERE snapshot_id = 'day1') SELECT total, u AS unique_files, total - u AS shared_files, (SELECT string_agg(id, ',' ORDER BY id) FROM snapshot WHERE parent_id = 'day1') AS children FROM o")
add("snapshot_lineage_tree", snapshots.tree, TREE)
add("snapshot_diff_counts", lambda r: snapshots.diff_counts(r, "day1", "day2", snapshots.SnapshotQuery(prefixes=("data/src3/",)), "added"), DIFF + "SELECT count(*) FILTER (change = 'added' AND starts_with(path, 'data/src3/')) AS matched, count(change) AS total FROM df")
add("snapshot_path_ids", lambda r: snapshots.path_ids(r, r.snapshot_path.where("id % 5 = 0").select(F.concat(F.lit("./"), F.when(F.col("id") % 10 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".none")))).alias("path"))), ", w AS (SELECT DISTINCT regexp_replace(CASE WHEN id % 10 = 0 THEN path ELSE path || '.none' END, '^(\\./)+', '') AS path FROM snapshot_path WHERE id % 5 = 0) SELECT w.path, p.id FROM w LEFT JOIN snapshot_path p USING (path)")
add("snapshot_create_partial", lambda r: snapshots.entries(snapshots.create(r, "new", 1_700_100_000, ("data/src4/de/", "data/src5/")), "new").select("path", "logical_file_id", "size"), "SELECT ltrim(p.path, '/') AS path, p.logical_file_id, l.total_size AS size FROM physical_file p JOIN logical_file l ON l.id = p.logical_file_id WHERE starts_with(p.path, '/data/src4/de/') OR starts_with(p.path, '/data/src5/')")
add("snapshot_after_delete", lambda r: snapshots.delete(r, "day1").snapshot, "SELECT id, created_at, type, label, CASE WHEN parent_id <> 'day1' THEN parent_id END AS parent_id FROM snapshot WHERE id <> 'day1'")
add("snapshot_restore_plan", lambda r: snapshots.restore_plan(r, "part1", "prefix", "/out/"), "SELECT path, logical_file_id, '/out/' || path AS output, false AS collision FROM entries WHERE snapshot_id = 'part1'")

_f = lambda check, entity, detail, rest: f"SELECT '{check}' AS \"check\", 'error' AS severity, CAST({entity} AS VARCHAR) AS entity_id, CAST({detail} AS VARCHAR) AS detail FROM {rest}"
N_BLOCKS, N_REFS = "(SELECT count(*) FROM blocks b WHERE b.chunk_id = c.id)", "(SELECT count(*) FROM file_chunk f WHERE f.chunk_id = c.id)"
N_PHYS = "(SELECT count(*) FROM physical_file p WHERE p.logical_file_id = l.id)"
AUDITS = {
    "block_cardinality": _f("block_cardinality", "c.id", N_BLOCKS, f"chunk c WHERE status = 'COMPLETED' AND {N_BLOCKS} <> 1"),
    "chunk_refcount": _f("chunk_refcount", "c.id", f"CAST(live_ref_count AS VARCHAR) || '/' || CAST({N_REFS} AS VARCHAR)", f"chunk c WHERE live_ref_count <> {N_REFS}"),
    "orphan_chunks": _f("orphan_chunk", "id", "''", "chunk c WHERE live_ref_count > 0 AND NOT EXISTS (SELECT 1 FROM file_chunk f WHERE f.chunk_id = c.id)"),
    "pinned_status": _f("pinned_status", "id", "status", "chunk WHERE pin_count > 0 AND status <> 'COMPLETED'"),
    "pinned_blocks": _f("pinned_blocks", "c.id", N_BLOCKS, f"chunk c WHERE pin_count > 0 AND {N_BLOCKS} <> 1"),
    "empty_versions": _f("empty_version_file", "id", "''", "logical_file WHERE trim(chunker_version) = ''") + " UNION ALL " + _f("empty_version_chunk", "id", "''", "chunk WHERE trim(chunker_version) = ''"),
    "orphan_physical": _f("orphan_physical", "path", "logical_file_id", "physical_file p WHERE NOT EXISTS (SELECT 1 FROM logical_file l WHERE l.id = p.logical_file_id)"),
    "refcount": _f("refcount", "l.id", f"CAST(ref_count AS VARCHAR) || '/' || CAST({N_PHYS} AS VARCHAR)", f"logical_file l WHERE ref_count <> {N_PHYS}"),
    "negative_refcount": _f("negative_refcount", "id", "ref_count", "logical_file WHERE ref_count < 0"),
    "snapshot_duplicates": _f("snapshot_duplicate", "snapshot_id || '/' || CAST(path_id AS VARCHAR)", "count(*)", "snapshot_file GROUP BY snapshot_id, path_id HAVING count(*) > 1"),
    "snapshot_paths": _f("snapshot_path", "snapshot_id || '/' || CAST(path_id AS VARCHAR)", "''", "snapshot_file f WHERE NOT EXISTS (SELECT 1 FROM snapshot_path p WHERE p.id = f.path_id)"),
    "snapshot_logical": _f("snapshot_logical", "snapshot_id || '/' || CAST(path_id AS VARCHAR)", "coalesce(path, '')", "snapshot_file f LEFT JOIN snapshot_path p ON p.id = f.path_id WHERE NOT EXISTS (SELECT 1 FROM logical_file l WHERE l.id = f.logical_file_id)"),
    "snapshot_lifecycle": _f("snapshot_lifecycle", "id", "status", "logical_file l WHERE (status <> 'COMPLETED' OR ref_count < 0) AND EXISTS (SELECT 1 FROM snapshot_file f WHERE f.logical_file_id = l.id)"),
    "retained_without_chunks": _f("retained_without_chunks", "id", "''", "logical_file l WHERE total_size > 0 AND EXISTS (SELECT 1 FROM snapshot_file f WHERE f.logical_file_id = l.id) AND NOT EXISTS (SELECT 1 FROM file_chunk f WHERE f.logical_file_id = l.id)"),
    "files_without_chunks": _f("file_without_chunks", "id", "''", "logical_file l WHERE total_size > 0 AND status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM file_chunk f WHERE f.logical_file_id = l.id)"),
    "chunk_order": _f("chunk_order", "logical_file_id", "count(*)", "(SELECT *, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk) WHERE want <> chunk_order GROUP BY logical_file_id"),
    "container_files": _f("container_file", "id", "CASE WHEN d.size IS NULL THEN 'missing' WHEN d.size > current_size THEN 'ghost_bytes' ELSE 'truncated' END", "container c LEFT JOIN container_file d USING (filename) WHERE d.size IS NULL OR d.size <> current_size"),
    "sealed_hash": _f("sealed_hash", "id", "CASE WHEN container_hash IS NULL THEN 'no_hash' ELSE 'differs' END", "container c JOIN container_file d USING (filename) WHERE sealed AND (container_hash IS NULL OR container_hash <> sha256)"),
    "block_status": _f("completed_without_block", "id", "''", "chunk c WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.chunk_id = c.id)") + " UNION ALL " + _f("block_of_incomplete", "id", "status", "chunk c WHERE status <> 'COMPLETED' AND EXISTS (SELECT 1 FROM blocks b WHERE b.chunk_id = c.id)"),
    "contiguity": _f("contiguity", "id", "CAST(want AS VARCHAR) || '/' || CAST(block_offset AS VARCHAR)", "(SELECT id, CAST(block_offset AS BIGINT) AS block_offset, CAST(coalesce(lag(block_offset + stored_size) OVER (PARTITION BY container_id ORDER BY block_offset, id), 64) AS BIGINT) AS want FROM blocks) WHERE want <> block_offset"),
    "sealed_incomplete": _f("sealed_incomplete", "id", "''", "container k WHERE sealed AND EXISTS (SELECT 1 FROM blocks b JOIN chunk c ON c.id = b.chunk_id WHERE b.container_id = k.id AND c.status <> 'COMPLETED')"),
    "trailing": _f("trailing_bytes", "id", "CAST(current_size - e AS BIGINT)", "container c JOIN (SELECT container_id, max(block_offset + stored_size) AS e FROM blocks GROUP BY 1) x ON x.container_id = c.id WHERE current_size > e"),
}
for _name, _sql in AUDITS.items():
    add(f"audit_{_name}", getattr(audits, _name), _sql)
_all = lambda names: " UNION ALL ".join(f"SELECT *, {k} AS step FROM ({AUDITS[n]}) AS a{k}" for k, n in enumerate(names))
STANDARD = [f.__name__ for f in audits.STANDARD]
add("verify_system", lambda r: audits.verify(r, "standard"), f", v AS ({_all(STANDARD)}) SELECT * FROM v")
add("verify_summary", lambda r: audits.summary(r, "deep"), f", v AS ({_all([f.__name__ for f in audits.DEEP])}) SELECT step, \"check\", count(*) AS findings, least(count(*), 50) AS shown FROM v GROUP BY step, \"check\"")
add("doctor_report", audits.doctor, f", v AS ({_all(STANDARD)}) SELECT CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS findings, coalesce(arg_min(\"check\", step), '') AS first_check FROM v")
add("file_verdicts", audits.file_verdicts, ", r AS (SELECT f.logical_file_id, count(*) AS n, count(*) FILTER (want <> chunk_order) AS o, count(*) FILTER (c.status IS NULL OR c.status <> 'COMPLETED') AS s, count(*) FILTER (b.chunk_id IS NULL) AS m FROM (SELECT *, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk) f LEFT JOIN chunk c ON c.id = f.chunk_id LEFT JOIN blocks b ON b.chunk_id = f.chunk_id GROUP BY 1) SELECT l.id, CASE WHEN status <> 'COMPLETED' THEN 'status' WHEN trim(chunker_version) = '' THEN 'version' WHEN total_size > 0 AND n IS NULL THEN 'no_chunks' WHEN o > 0 THEN 'chunk_order' WHEN s > 0 THEN 'chunk_status' WHEN m > 0 THEN 'block_missing' ELSE 'ok' END AS verdict FROM logical_file l LEFT JOIN r ON r.logical_file_id = l.id")

GC = ", kp AS (SELECT DISTINCT chunk_id FROM file_chunk WHERE logical_file_id IN (SELECT logical_file_id FROM retained)), lv AS (SELECT container_id, count(*) AS n, bool_or(live) AS live, bool_or(kp.chunk_id IS NOT NULL) AS kept FROM placed LEFT JOIN kp USING (chunk_id) GROUP BY 1), g AS (SELECT c.id, sealed, CASE WHEN coalesce(live, false) THEN 'live' WHEN coalesce(kept, false) THEN 'retained' WHEN NOT sealed AND n IS NULL THEN 'empty' ELSE 'eligible' END AS verdict FROM container c LEFT JOIN lv ON lv.container_id = c.id WHERE NOT quarantine) "
add("gc_eligible_containers", maintenance.gc_candidates, GC + "SELECT * FROM g")
add("gc_report", maintenance.gc_report, GC + "SELECT count(*) FILTER (sealed AND verdict = 'eligible') AS eligible, count(*) FILTER (sealed AND verdict = 'retained') AS retained, count(*) FILTER (verdict = 'live') AS live, count(*) FILTER (NOT sealed AND verdict = 'eligible') AS dead_active FROM g")
add("gc_collect", lambda r: maintenance.collect(r, audit=False).blocks.select("id", "container_id"), GC + "SELECT id, container_id FROM blocks WHERE container_id NOT IN (SELECT id FROM g WHERE verdict = 'eligible')")
add("repair_report", maintenance.repair_report, f"SELECT count(*) AS scanned, count(*) FILTER (ref_count <> {N_PHYS}) AS updated, (SELECT count(*) FROM physical_file p WHERE p.logical_file_id NOT IN (SELECT id FROM logical_file)) AS orphans FROM logical_file l")
add("repair_refcounts", lambda r: maintenance.repair(r.replace(physical_file=r.physical_file.join(r.logical_file.select(F.col("id").alias("logical_file_id")), "logical_file_id", "left_semi"))).logical_file.select("id", "ref_count"), f"SELECT id, {N_PHYS} AS ref_count FROM logical_file l")
add("chunk_recount", lambda r: maintenance.recounted(r).chunk.select("id", "live_ref_count"), f"SELECT id, {N_REFS} AS live_ref_count FROM chunk c")
add("recovery_abort_processing", maintenance.abort_report, "SELECT (SELECT count(*) FROM logical_file WHERE status = 'PROCESSING') AS aborted_files, (SELECT count(*) FROM chunk WHERE status = 'PROCESSING') AS aborted_chunks")
add("recovery_sealing", maintenance.sealing_verdicts, "SELECT id, CASE WHEN d.size IS NULL OR d.size <> current_size THEN 'quarantine' ELSE 'seal' END AS verdict FROM container LEFT JOIN container_file d USING (filename) WHERE sealing AND NOT sealed AND NOT quarantine")
add("recovery_missing_files", maintenance.missing_files, "SELECT id, filename FROM container WHERE NOT quarantine AND filename NOT IN (SELECT filename FROM container_file)")
add("recovery_orphan_files", maintenance.orphan_files, "SELECT filename, CAST(size AS BIGINT) AS size FROM container_file WHERE filename NOT IN (SELECT filename FROM container)")
TAIL = ", dn AS (SELECT b.* FROM blocks b JOIN chunk c ON c.id = b.chunk_id WHERE c.status = 'COMPLETED'), gp AS (SELECT container_id, min(block_offset) AS f, max(block_offset + stored_size) AS e, bool_or(before IS NOT NULL AND before <> block_offset) AS gap FROM (SELECT *, lag(block_offset + stored_size) OVER (PARTITION BY container_id ORDER BY block_offset, id) AS before FROM dn) GROUP BY 1), tl AS (SELECT id, CASE WHEN current_size > d.size THEN 'db_current_size_past_eof' WHEN d.size > current_size THEN 'physical_size_past_db_current_size' WHEN e > d.size THEN 'completed_block_past_eof' WHEN f <> 64 THEN 'first_block_not_at_header' WHEN gap THEN 'non_contiguous_block_offsets' WHEN coalesce(e, 64) < current_size THEN 'trailing_unreferenced_bytes' END AS reason FROM container c JOIN container_file d USING (filename) LEFT JOIN gp ON gp.container_id = c.id WHERE NOT sealed AND NOT sealing AND NOT quarantine) "
add("recovery_tail_reasons", maintenance.tail_reasons, TAIL + "SELECT * FROM tl WHERE reason IS NOT NULL")
add("recovery_quarantine", lambda r: maintenance.recover(r).container.where("quarantine").select("filename"), TAIL + "SELECT filename FROM container c LEFT JOIN container_file d USING (filename) WHERE quarantine OR d.filename IS NULL OR (sealing AND NOT sealed AND d.size <> current_size) OR id IN (SELECT id FROM tl WHERE reason IS NOT NULL) UNION SELECT filename FROM container_file WHERE filename NOT IN (SELECT filename FROM container)")
add("recovery_report", maintenance.recovery_report, TAIL + ", s AS (SELECT d.size IS NULL OR d.size <> current_size AS bad FROM container LEFT JOIN container_file d USING (filename) WHERE sealing AND NOT sealed AND NOT quarantine) SELECT (SELECT count(*) FROM logical_file WHERE status = 'PROCESSING') AS aborted_files, (SELECT count(*) FROM chunk WHERE status = 'PROCESSING') AS aborted_chunks, (SELECT count(*) FROM s WHERE NOT bad) AS sealed, (SELECT count(*) FROM s WHERE bad) AS sealing_quarantined, (SELECT count(*) FROM container WHERE NOT quarantine AND filename NOT IN (SELECT filename FROM container_file)) AS missing, (SELECT count(*) FROM tl WHERE reason IS NOT NULL) AS corrupt_tails, (SELECT count(*) FROM container_file WHERE filename NOT IN (SELECT filename FROM container)) AS orphan_files, (SELECT count(*) FROM container WHERE NOT quarantine) AS checked_containers, (SELECT count(*) FROM container_file) AS checked_files, 0 AS skipped_folders")
add("recovery_sizes", lambda r: maintenance.recover(r).container.select("id", "quarantine", "sealed", "current_size"), TAIL + ", x AS (SELECT c.id, c.sealed, c.sealing, c.current_size, d.size AS disk, quarantine OR d.filename IS NULL OR (sealing AND NOT sealed AND d.size <> current_size) OR c.id IN (SELECT id FROM tl WHERE reason IS NOT NULL) AS q FROM container c LEFT JOIN container_file d USING (filename)) SELECT id, q AS quarantine, sealed OR (sealing AND NOT q) AS sealed, CAST(CASE WHEN q THEN coalesce(disk, current_size) ELSE current_size END AS BIGINT) AS current_size FROM x UNION ALL SELECT (SELECT max(id) FROM container) + row_number() OVER (ORDER BY filename), true, false, CAST(size AS BIGINT) FROM container_file WHERE filename NOT IN (SELECT filename FROM container)")
add("remove_plan", maintenance.removal_plan, "SELECT id, CASE WHEN status = 'PROCESSING' THEN 'refused_processing' WHEN id IN (SELECT logical_file_id FROM snapshot_file) THEN 'refused_retained' ELSE 'remove' END AS verdict, (SELECT count(*) FROM file_chunk f WHERE f.logical_file_id = l.id) AS chunk_refs FROM logical_file l")
add("finalize_check", maintenance.finalizable, "SELECT logical_file_id, count(*) AS n, max(chunk_order) = count(*) - 1 AS complete FROM file_chunk GROUP BY 1")
add("reuse_graph_summary", maintenance.reuse_graph, "SELECT f.logical_file_id, count(*) FILTER (want <> chunk_order) AS broken_orders, count(*) FILTER (c.status IS NULL OR c.status <> 'COMPLETED') AS invalid_chunks, count(*) FILTER (b.chunk_id IS NULL) AS missing_blocks, count(*) FILTER (b.chunk_id IS NOT NULL AND k.id IS NULL) AS missing_containers FROM (SELECT *, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk) f LEFT JOIN chunk c ON c.id = f.chunk_id LEFT JOIN blocks b ON b.chunk_id = f.chunk_id LEFT JOIN container k ON k.id = b.container_id GROUP BY 1")
add("reuse_suspicion_summary", maintenance.suspicion, "SELECT f.logical_file_id, count(DISTINCT CASE WHEN c.retry_count > 0 THEN c.id END) AS retried_chunks, count(DISTINCT CASE WHEN NOT k.sealed THEN k.id END) AS mutable_containers FROM file_chunk f LEFT JOIN chunk c ON c.id = f.chunk_id LEFT JOIN blocks b ON b.chunk_id = f.chunk_id LEFT JOIN container k ON k.id = b.container_id GROUP BY 1")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "file_hash", F.to_binary("text", F.lit("utf-8")).alias("content"))


def _cdc(version: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ingest.file_chunks(_bodies(spark, sf_dir), cdc.SCALED[version])


def _dedup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive.documents(spark, sf_dir)
    return ingest.dedup(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "doc_id", "file_hash", "size")


def _dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derive.slices(derive.documents(spark, sf_dir))
    return ingest.dedup(p.where("logical_file_id % 3 <> 0"), p.where("logical_file_id % 3 = 0"), "logical_file_id", "chunk_hash", "size")


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir)
    shifted = b.withColumn("content", F.concat(F.to_binary(F.lit("a prefix that moves all offsets. " * 8), F.lit("utf-8")), "content"))
    rows = None
    for v in (V1, V2):
        one = ingest.compared(ingest.file_chunks(b, cdc.SCALED[v]), ingest.file_chunks(shifted, cdc.SCALED[v]), f"shift {v}")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive.documents(spark, sf_dir).withColumn("writer", F.pmod("doc_id", F.lit(16)))
    return ingest.packed(d, "writer", "doc_id", "size", 65_536)


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, replay, and compare with the files' hashes."""
    d = derive.documents(spark, sf_dir)
    n = F.greatest(F.ceil(F.length("text") / derive.SLICE).cast("int"), F.lit(1))
    rows = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_order")).select("doc_id", "chunk_order", F.to_binary(F.substring("text", F.col("chunk_order") * derive.SLICE + 1, F.lit(derive.SLICE)), F.lit("utf-8")).alias("data"))
    rows = rows.withColumn("chunk_hash", F.sha2("data", 256))
    payloads = rows.groupBy("chunk_hash").agg(F.first("data").alias("data"))
    out = ingest.replayed(rows.select(F.col("doc_id").alias("file_id"), "chunk_order", "chunk_hash"), payloads)
    return out.join(d.select(F.col("doc_id").alias("file_id"), F.col("file_hash").alias("wanted")), "file_id").select("file_id", "file_hash", (F.col("file_hash") == F.col("wanted")).alias("whole"), "missing", "corrupt", "breaks")


def _encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import codecs

    key = bytes(range(32))
    d = _bodies(spark, sf_dir).withColumn("e", codecs.encoded(F.col("content"), "aes-gcm", key))
    back = codecs.decoded(F.col("e.nonce"), F.col("e.payload"), F.lit("aes-gcm"), key)
    return d.select("file_id", F.sha2(back, 256).alias("file_hash"), (F.length("e.payload") - F.length("content")).cast("long").alias("overhead"))


add_raw("chunk_cdc_v1", _cdc(V1))
add_raw("chunk_cdc_v2", _cdc(V2))
add_raw("chunk_summary", lambda s, d: ingest.chunk_summary(_cdc(V2)(s, d), ["file_id"]).select("file_id", "total"), "SELECT doc_id AS file_id, CAST(strlen(text) AS BIGINT) AS total FROM documents WHERE text <> ''")
add_raw("chunk_coverage", lambda s, d: ingest.coverage(_cdc(V1)(s, d)).unionByName(ingest.coverage(_cdc(V2)(s, d))), "SELECT doc_id AS file_id, doc_id AS chunk_order, '' AS problem FROM documents WHERE false")
add_raw("chunk_reuse_compare", _compare)
add_raw("dedup_files", _dedup_files, "WITH d AS (SELECT doc_id, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size FROM documents) SELECT file_hash, size, min(doc_id) AS first, count(*) AS refs, bool_or((file_hash, size) IN (SELECT (file_hash, size) FROM d WHERE doc_id % 2 = 0)) AS reused FROM d WHERE doc_id % 2 = 1 GROUP BY file_hash, size")
add_raw("dedup_chunks", _dedup_chunks, BASE + "SELECT chunk_hash, size, min(logical_file_id) AS first, count(*) AS refs, bool_or((chunk_hash, size) IN (SELECT (chunk_hash, size) FROM pieces WHERE logical_file_id % 3 = 0)) AS reused FROM pieces WHERE logical_file_id % 3 <> 0 GROUP BY chunk_hash, size")
PACKING = """
WITH RECURSIVE d AS (SELECT doc_id, doc_id % 16 AS writer, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS k FROM documents),
p AS (
  SELECT writer, doc_id, size, k, CAST(0 AS BIGINT) AS container_no, CAST(64 AS BIGINT) AS block_offset FROM d WHERE k = 1
  UNION ALL
  SELECT d.writer, d.doc_id, d.size, d.k, CASE WHEN n.turn THEN n.container_no + 1 ELSE n.container_no END, CASE WHEN n.turn THEN 64 ELSE n.at END
  FROM (SELECT p.writer, p.k, p.container_no, p.block_offset + p.size AS at, p.block_offset + p.size > 64 AND (p.block_offset + p.size + x.size > 65536 OR p.block_offset + p.size >= 65536) AS turn FROM p JOIN d x ON x.writer = p.writer AND x.k = p.k + 1) n
  JOIN d ON d.writer = n.writer AND d.k = n.k + 1
)
SELECT writer, doc_id, size, container_no, block_offset FROM p
"""
add_raw("container_packing", _packing, PACKING)
add_raw("restore_roundtrip", _roundtrip, "SELECT doc_id AS file_id, sha256(text) AS file_hash, true AS whole, 0 AS missing, 0 AS corrupt, 0 AS breaks FROM documents")
add_raw("encrypt_roundtrip", _encrypted, "SELECT doc_id AS file_id, sha256(text) AS file_hash, 16 AS overhead FROM documents")

RAW = ["3", " 7 ", "3", "x", "0", "-1", "42", "99999999"]
_raw = "(VALUES " + ", ".join(f"({k}, '{x.strip()}')" for k, x in enumerate(RAW)) + ") AS v(place, raw)"
BATCH = f", r AS (SELECT place, raw, CASE WHEN try_cast(trim(raw) AS BIGINT) > 0 THEN try_cast(trim(raw) AS BIGINT) END AS id FROM {_raw}), bp AS (SELECT place, raw, id, CASE WHEN id IS NULL THEN 'failed' WHEN row_number() OVER (PARTITION BY id ORDER BY place) > 1 THEN 'skipped' ELSE 'planned' END AS state FROM r) "
add("batch_prepare", lambda r: batch.prepared(batch.targets(r.spark, RAW)), BATCH + "SELECT * FROM bp")
add("batch_remove_plan", lambda r: batch.remove_dry_run(r, batch.targets(r.spark, RAW)), BATCH + "SELECT place, raw, bp.id, CASE WHEN state <> 'planned' THEN state WHEN l.status IS NULL OR l.status = 'PROCESSING' THEN 'failed' ELSE 'planned' END AS state FROM bp LEFT JOIN logical_file l ON l.id = bp.id")
PATHS = ["/data/a.txt", " /data/a.txt ", "/data/b.txt", "/data/b.txt"]
add("batch_paths", lambda r: batch.prepared_paths(batch.targets(r.spark, PATHS)), "SELECT place, raw, raw AS path, CASE WHEN row_number() OVER (PARTITION BY raw ORDER BY place) > 1 THEN 'skipped' ELSE 'planned' END AS state FROM (VALUES " + ", ".join(f"({k}, '{x.strip()}')" for k, x in enumerate(PATHS)) + ") AS v(place, raw)")
add("batch_report", lambda r: batch.summary(batch.restore_dry_run(r, batch.targets(r.spark, RAW))), "SELECT 8 AS total, 0 AS success, 4 + n AS failed, 1 AS skipped, 3 - n AS planned, CASE WHEN n < 3 THEN 'partial_failure' ELSE 'error' END AS status FROM (SELECT 3 - count(*) AS n FROM logical_file WHERE id IN (3, 7, 42) AND status = 'COMPLETED')")


# what reads contents: blocks of the derived repository, some of them damaged by their ids
def _with_payloads(spark: SparkSession, sf_dir: str) -> Repository:
    return derive.saved(spark, sf_dir, "payloads", lambda: derive.with_payloads(derived(spark, sf_dir), derive.documents(spark, sf_dir)))


def add_contents(name: str, make: Callable[[Repository], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(_with_payloads(spark, sf_dir))
    ORACLE_SQL[name] = BASE + sql


#: The first fault of each block, after the rules of derive.with_payloads; with a wrong key every AES block fails.
_faults = lambda key: f", fb AS (SELECT b.id, b.chunk_id, b.container_id, CASE WHEN b.id % 107 = 0 THEN 'payload_missing' WHEN b.id % 109 = 0 THEN 'stored_size' WHEN codec = 'aes-gcm' AND (b.id % 83 = 0 OR b.id % 113 = 0 OR {key}) THEN 'decode' WHEN b.id % 83 = 0 THEN 'chunk_hash' END AS fault FROM blocks b) "
FAULTS = _faults("false")
FOUND = "SELECT 'block_content' AS \"check\", 'error' AS severity, CAST(f.id AS VARCHAR) AS entity_id, fault AS detail FROM fb f JOIN chunk c ON c.id = f.chunk_id JOIN container k ON k.id = f.container_id WHERE fault IS NOT NULL AND c.status = 'COMPLETED' AND NOT quarantine"
add_contents("verify_blocks", lambda r: restore.blocks_deep(r, derive.KEY), FAULTS + FOUND)
add_contents("verify_blocks_wrong_key", lambda r: restore.blocks_deep(r, bytes(32)), _faults("true") + FOUND)
add_contents("verify_containers_deep", restore.containers_deep, ", x AS (SELECT id, filename, CAST(current_size AS BIGINT) AS current_size FROM container k WHERE NOT quarantine AND EXISTS (SELECT 1 FROM blocks b JOIN chunk c ON c.id = b.chunk_id WHERE b.container_id = k.id AND c.status = 'COMPLETED')) SELECT *, count(*) OVER () AS total FROM x")
RESTORED = FAULTS + ", rp AS (SELECT logical_file_id, count(*) FILTER (fault IS NOT NULL) AS bad, count(*) FILTER (fault IS NULL) AS good, count(*) FILTER (want <> chunk_order) AS breaks, coalesce(sum(size) FILTER (fault IS NULL), 0) AS len FROM (SELECT f.*, fb.fault, c.size, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk f JOIN chunk c ON c.id = f.chunk_id JOIN fb ON fb.chunk_id = f.chunk_id) GROUP BY 1), rs AS (SELECT l.id AS logical_file_id, file_hash, status, CASE WHEN status <> 'COMPLETED' THEN 'status' WHEN coalesce(good, 0) = 0 AND total_size > 0 THEN 'no_chunks' WHEN coalesce(len, 0) <> total_size THEN 'size' ELSE 'ok' END AS verdict, CASE WHEN status = 'COMPLETED' THEN coalesce(bad, 0) ELSE 0 END AS bad, CASE WHEN status = 'COMPLETED' THEN coalesce(breaks, 0) ELSE 0 END AS breaks FROM logical_file l LEFT JOIN rp ON rp.logical_file_id = l.id) "
add_contents("restore_files", lambda r: restore.restored(r, key=derive.KEY).select("logical_file_id", F.sha2("content", 256).alias("content_sha256"), "verdict", "bad", "breaks"), RESTORED + "SELECT logical_file_id, CASE WHEN verdict = 'ok' THEN file_hash END AS content_sha256, verdict, bad, breaks FROM rs")
FILE_FULL = ", r AS (SELECT f.logical_file_id, count(*) AS n, count(*) FILTER (want <> chunk_order) AS o, count(*) FILTER (c.status IS NULL OR c.status <> 'COMPLETED') AS s, count(*) FILTER (b.chunk_id IS NULL) AS m, count(*) FILTER (k.quarantine) AS q, count(*) FILTER (b.chunk_id IS NOT NULL AND d.size IS NULL) AS g, count(*) FILTER (d.size <> k.current_size) AS z, count(*) FILTER (b.stored_size <= 0 OR b.block_offset < 64 OR b.block_offset + b.stored_size > k.current_size OR b.block_offset + b.stored_size > d.size) AS x FROM (SELECT *, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk) f LEFT JOIN chunk c ON c.id = f.chunk_id LEFT JOIN blocks b ON b.chunk_id = f.chunk_id LEFT JOIN container k ON k.id = b.container_id LEFT JOIN container_file d USING (filename) GROUP BY 1), ff AS (SELECT l.id, CASE WHEN status <> 'COMPLETED' THEN 'status' WHEN trim(chunker_version) = '' THEN 'version' WHEN total_size > 0 AND n IS NULL THEN 'no_chunks' WHEN o > 0 THEN 'chunk_order' WHEN s > 0 THEN 'chunk_status' WHEN m > 0 THEN 'block_missing' WHEN q > 0 THEN 'quarantined' WHEN g > 0 THEN 'container_missing' WHEN z > 0 THEN 'container_size' WHEN x > 0 THEN 'block_bounds' ELSE 'ok' END AS verdict FROM logical_file l LEFT JOIN r ON r.logical_file_id = l.id) "
add("file_verdicts_full", restore.files_full, FILE_FULL + "SELECT * FROM ff")
add_contents("file_verdicts_deep", lambda r: restore.files_deep(r, derive.KEY), FILE_FULL + RESTORED + "SELECT id, CASE WHEN ff.verdict <> 'ok' THEN ff.verdict WHEN bad > 0 THEN 'chunk_content' ELSE rs.verdict END AS verdict FROM ff JOIN rs ON rs.logical_file_id = ff.id")

# the reuse gate
add("reuse_chunk_summary", reuse.chunk_summary, "SELECT c.id AS chunk_id, count(b.id) AS block_rows, count(k.id) AS container_rows, CAST(count(*) FILTER (quarantine) AS BIGINT) AS quarantined_rows FROM chunk c LEFT JOIN blocks b ON b.chunk_id = c.id LEFT JOIN container k ON k.id = b.container_id WHERE c.status = 'COMPLETED' GROUP BY 1")
add("reuse_chunk_verdicts", reuse.chunk_verdicts, "SELECT c.id AS chunk_id, CASE WHEN b.id IS NULL THEN 'block_rows' WHEN k.id IS NULL THEN 'container_missing' WHEN current_size > 67108864 THEN 'container_size' WHEN stored_size <= 0 THEN 'stored_size' WHEN block_offset < 64 THEN 'before_header' WHEN block_offset + stored_size > current_size THEN 'past_container' WHEN d.size IS NULL THEN 'file_missing' WHEN d.size < block_offset + stored_size THEN 'past_file' ELSE 'ok' END AS verdict FROM chunk c LEFT JOIN blocks b ON b.chunk_id = c.id LEFT JOIN container k ON k.id = b.container_id LEFT JOIN container_file d USING (filename) WHERE c.status = 'COMPLETED'")
add("reuse_file_containers", lambda r: reuse.file_containers(r).select("logical_file_id", "container_id", "there"), "SELECT DISTINCT f.logical_file_id, b.container_id, d.filename IS NOT NULL AS there FROM file_chunk f JOIN blocks b ON b.chunk_id = f.chunk_id JOIN container k ON k.id = b.container_id LEFT JOIN container_file d USING (filename)")
SHAPE = ", sh AS (SELECT l.id AS logical_file_id, CASE WHEN n IS NULL AND total_size > 0 THEN 'no_chunks' WHEN o > 0 THEN 'chunk_order' WHEN s > 0 THEN 'chunk_status' WHEN m > 0 THEN 'block_missing' WHEN kk > 0 THEN 'container_missing' WHEN g > 0 THEN 'file_missing' ELSE 'ok' END AS verdict, q, sus OR retry_count > 0 AS sus FROM logical_file l LEFT JOIN (SELECT f.logical_file_id, count(*) AS n, count(*) FILTER (want <> chunk_order) AS o, count(*) FILTER (c.status IS NULL OR c.status <> 'COMPLETED') AS s, count(*) FILTER (b.chunk_id IS NULL) AS m, count(*) FILTER (b.chunk_id IS NOT NULL AND k.id IS NULL) AS kk, count(*) FILTER (k.id IS NOT NULL AND d.filename IS NULL) AS g, count(*) FILTER (k.quarantine) AS q, bool_or(c.retry_count > 0 OR coalesce(NOT k.sealed OR k.sealing, false)) AS sus FROM (SELECT *, row_number() OVER (PARTITION BY logical_file_id ORDER BY chunk_order) - 1 AS want FROM file_chunk) f LEFT JOIN chunk c ON c.id = f.chunk_id LEFT JOIN blocks b ON b.chunk_id = f.chunk_id LEFT JOIN container k ON k.id = b.container_id LEFT JOIN container_file d USING (filename) GROUP BY 1) r ON r.logical_file_id = l.id WHERE l.status = 'COMPLETED') "
add("reuse_structure", reuse.structure, SHAPE + "SELECT logical_file_id, verdict FROM sh")
for _mode, _read in ((reuse.OFF, "false"), (reuse.SUSPICIOUS, "coalesce(sus, false)"), (reuse.ALWAYS, "true")):
    add_contents(f"reuse_gate_{_mode}", lambda r, _mode=_mode: reuse.gate(r, _mode, derive.KEY), SHAPE + RESTORED + f", gt AS (SELECT sh.*, sh.verdict = 'ok' AND coalesce(q, 0) = 0 AND {_read} AS read, rs.verdict AS got, bad, breaks FROM sh JOIN rs USING (logical_file_id)) SELECT logical_file_id, CASE WHEN verdict <> 'ok' THEN verdict WHEN read AND (got <> 'ok' OR bad > 0 OR breaks > 0) THEN 'content' ELSE 'ok' END AS verdict, read FROM gt")
add("physical_graph", audits.physical_graph, f", o AS (SELECT (SELECT count(*) FROM physical_file p WHERE p.logical_file_id NOT IN (SELECT id FROM logical_file)) AS orphans, (SELECT count(*) FROM logical_file l WHERE ref_count <> {N_PHYS}) AS mismatches, (SELECT count(*) FROM logical_file WHERE ref_count < 0) AS negatives) SELECT *, CASE WHEN (orphans > 0)::INT + (mismatches > 0)::INT + (negatives > 0)::INT > 1 THEN 'PHYSICAL_GRAPH_INTEGRITY' WHEN orphans > 0 THEN 'PHYSICAL_GRAPH_ORPHAN' WHEN mismatches > 0 THEN 'PHYSICAL_GRAPH_REFCOUNT_MISMATCH' WHEN negatives > 0 THEN 'PHYSICAL_GRAPH_NEGATIVE_REFCOUNT' END AS code FROM o")
add("findings_shown", lambda r: audits.shown(audits.refcount(r).unionByName(audits.snapshot_logical(r)), 10).drop("severity"), f", v AS ({AUDITS['refcount']} UNION ALL {AUDITS['snapshot_logical']}), w AS (SELECT \"check\", entity_id, detail, row_number() OVER (PARTITION BY \"check\" ORDER BY entity_id, detail) AS place, count(*) OVER (PARTITION BY \"check\") AS total FROM v) SELECT * FROM w WHERE place <= 10")
add("version_states", lambda r: r.chunk.select("id", scalars.version_state(F.col("chunker_version"), (V1,)).alias("state")), "SELECT id, CASE WHEN trim(chunker_version) = '' THEN 'empty' WHEN NOT regexp_matches(trim(chunker_version), '^v[0-9]+(-[a-z0-9]+)+$') THEN 'malformed' WHEN trim(chunker_version) <> 'v1-simple-rolling' THEN 'unknown' ELSE 'known' END AS state FROM chunk")
add("report_json", lambda r: stats.as_json(stats.chunks_by_status(r)), "SELECT '{\"status\":\"' || status || '\",\"chunks\":' || CAST(count(*) AS VARCHAR) || ',\"bytes\":' || CAST(CAST(sum(size) AS BIGINT) AS VARCHAR) || '}' AS line FROM chunk GROUP BY status")
add("report_text", lambda r: r.container.select("id", scalars.thousands(F.col("current_size")).alias("size")), "SELECT id, format('{:,}', CAST(current_size AS BIGINT)) AS size FROM container")


# the store path: documents as files, split by the scaled chunker
def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.documents(spark, sf_dir).select("path", F.to_binary("text", F.lit("utf-8")).alias("content"), F.lit(420).cast("long").alias("mode"))


def _stored(spark: SparkSession, sf_dir: str) -> Repository:
    first = lambda: store.store(Repository.empty(spark), _inputs(spark, sf_dir), cdc.SCALED[V2], "aes-gcm", derive.KEY, most=262_144)
    return derive.saved(spark, sf_dir, "stored", first)


def _again(spark: SparkSession, sf_dir: str) -> Repository:
    """All documents once more, and of every tenth one with an ending of its own at a further path."""
    more = derive.documents(spark, sf_dir).where("doc_id % 10 = 3").select(F.concat(F.lit("/more"), "path").alias("path"), F.to_binary(F.concat("text", F.lit(" the end")), F.lit("utf-8")).alias("content"), F.lit(None).cast("long").alias("mode"))
    second = lambda: store.store(_stored(spark, sf_dir), _inputs(spark, sf_dir).unionByName(more), cdc.SCALED[V2], "aes-gcm", derive.KEY, mode="always", most=262_144)
    return derive.saved(spark, sf_dir, "again", second)


def _files_of(make: Callable[[SparkSession, str], Repository]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: make(s, d).logical_file.select("file_hash", "total_size", "ref_count", "status", "chunker_version")


def _sound(make: Callable[[SparkSession, str], Repository]) -> Callable[[SparkSession, str], DataFrame]:
    """Whether a stored repository passes all audits to the deepest, and its files are restored as they were."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = make(spark, sf_dir)
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        out = n(audits.verify(r, "deep", derive.KEY), "findings").crossJoin(n(store.unfinished(r), "unfinished"))
        got = restore.restored(r, key=derive.KEY)
        return out.crossJoin(got.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("verdict") == "ok", 1)).alias("whole")))

    return run


INPUT = "WITH f AS (SELECT sha256(text) AS h, CAST(strlen(text) AS BIGINT) AS s FROM documents), m AS (SELECT sha256(text || ' the end') AS h, CAST(strlen(text || ' the end') AS BIGINT) AS s FROM documents WHERE doc_id % 10 = 3), a AS (SELECT * FROM f UNION ALL SELECT * FROM m) "
add_raw("store_documents", _files_of(_stored), INPUT + "SELECT h AS file_hash, s AS total_size, count(*) AS ref_count, 'COMPLETED' AS status, 'v2-fastcdc' AS chunker_version FROM f GROUP BY h, s")
add_raw("store_again", _files_of(_again), INPUT + "SELECT h AS file_hash, s AS total_size, count(*) AS ref_count, 'COMPLETED' AS status, 'v2-fastcdc' AS chunker_version FROM a GROUP BY h, s")
add_raw("store_paths", lambda s, d: _again(s, d).physical_file.select("path", "mode", "is_metadata_complete"), "WITH p AS (SELECT doc_id, '/data/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents) SELECT path, 420 AS mode, false AS is_metadata_complete FROM p UNION ALL SELECT '/more' || path, NULL, false FROM p WHERE doc_id % 10 = 3")
add_raw("store_sound", _sound(_stored), INPUT + "SELECT 0 AS findings, 0 AS unfinished, count(DISTINCT (h, s)) AS files, count(DISTINCT (h, s)) AS whole FROM f")
add_raw("store_again_sound", _sound(_again), INPUT + "SELECT 0 AS findings, 0 AS unfinished, count(DISTINCT (h, s)) AS files, count(DISTINCT (h, s)) AS whole FROM a")
add_raw("store_bytes", lambda s, d: _stored(s, d).file_chunk.join(_stored(s, d).chunk.select(F.col("id").alias("chunk_id"), "size"), "chunk_id").join(_stored(s, d).logical_file.select(F.col("id").alias("logical_file_id"), "file_hash"), "logical_file_id").groupBy("file_hash").agg(F.sum("size").alias("bytes")), INPUT + "SELECT h AS file_hash, any_value(s) AS bytes FROM f WHERE s > 0 GROUP BY h")


def _faulty_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with their offsets, some left out and some moved back by a byte."""
    p = derive.slices(derive.documents(spark, sf_dir))
    w = Window.partitionBy("logical_file_id").orderBy("chunk_order").rowsBetween(Window.unboundedPreceding, -1)
    c = p.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))
    c = c.where("NOT (logical_file_id % 7 = 0 AND chunk_order = 1)").withColumn("offset", F.col("offset") - F.when((F.col("logical_file_id") % 11 == 0) & (F.col("chunk_order") == 1), 1).otherwise(0))
    return ingest.coverage(c, "logical_file_id")


add_raw("chunk_coverage_faults", _faulty_coverage, BASE + "SELECT logical_file_id, chunk_order, CASE WHEN logical_file_id % 7 = 0 THEN 'gap' ELSE 'overlap' END AS problem FROM pieces WHERE (logical_file_id % 7 = 0 AND chunk_order > 1) OR (logical_file_id % 7 <> 0 AND logical_file_id % 11 = 0 AND chunk_order = 1)")
