"""The derived repository in SQL for DuckDB: the rules of sources/derive.py once more."""

BASE = """
WITH docs AS (SELECT doc_id, text, source, lang, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size, '/data/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents),
lk AS (SELECT file_hash, size, min(doc_id) + 1 AS logical_file_id, count(*) AS n FROM docs GROUP BY file_hash, size),
keyed AS (SELECT d.*, lk.logical_file_id FROM docs d JOIN lk USING (file_hash, size)),
logical_file AS (SELECT logical_file_id AS id, CAST(logical_file_id - 1 AS VARCHAR) || '.txt' AS original_name, size AS total_size, file_hash, CASE WHEN logical_file_id % 167 = 0 THEN -1 ELSE n + CASE WHEN logical_file_id % 53 = 0 THEN 1 ELSE 0 END END AS ref_count,
  CASE WHEN logical_file_id % 97 = 0 THEN 'bad version' WHEN logical_file_id % 2 = 0 THEN 'v2-fastcdc' ELSE 'v1-simple-rolling' END AS chunker_version,
  CASE WHEN logical_file_id % 41 = 0 THEN 'ABORTED' WHEN logical_file_id % 43 = 0 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, logical_file_id % 3 AS retry_count FROM lk),
physical_file AS (SELECT path, CASE WHEN doc_id % 199 = 198 THEN logical_file_id + 10000000000 ELSE logical_file_id END AS logical_file_id, 420 AS mode, CASE WHEN doc_id % 13 <> 0 THEN 1700000000 + doc_id * 3600 END AS mtime FROM keyed),
one AS (SELECT logical_file_id, text, unnest(range(CAST(ceil(length(text) / 512.0) AS BIGINT))) AS k FROM keyed WHERE doc_id + 1 = logical_file_id AND length(text) > 0),
pieces AS (SELECT logical_file_id, k AS chunk_order, sha256(substr(text, k * 512 + 1, 512)) AS chunk_hash, CAST(strlen(substr(text, k * 512 + 1, 512)) AS BIGINT) AS size FROM one),
known AS (SELECT chunk_hash, size, min(logical_file_id * 1000000 + chunk_order) AS id, count(*) AS refs FROM pieces GROUP BY chunk_hash, size),
chunk AS (SELECT id, chunk_hash, size, CASE WHEN id % 71 = 0 THEN 'ABORTED' WHEN id % 73 = 0 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, refs + CASE WHEN id % 67 = 0 THEN 1 ELSE 0 END - CASE WHEN id % 79 = 0 THEN refs ELSE 0 END AS live_ref_count,
  CASE WHEN id % 89 = 0 THEN 1 ELSE 0 END AS pin_count, id % 4 AS retry_count, CASE WHEN id % 401 = 0 THEN '' WHEN id % 97 = 0 THEN 'bad version' WHEN id % 2 = 0 THEN 'v2-fastcdc' ELSE 'v1-simple-rolling' END AS chunker_version FROM known),
file_chunk AS (SELECT logical_file_id, known.id AS chunk_id, chunk_order + CASE WHEN logical_file_id % 61 = 0 AND chunk_order >= 1 THEN 1 ELSE 0 END AS chunk_order FROM pieces JOIN known USING (chunk_hash, size) WHERE logical_file_id % 103 <> 0),
b0 AS (SELECT id, size, size + CASE WHEN id % 3 = 0 THEN 16 ELSE 0 END AS stored_size, id // 25000000 AS container_id FROM chunk WHERE id % 101 <> 0),
blocks AS (SELECT id, id AS chunk_id, CASE WHEN id % 3 = 0 THEN 'aes-gcm' ELSE 'plain' END AS codec, size AS plaintext_size, stored_size, container_id,
  64 + coalesce(sum(stored_size) OVER (PARTITION BY container_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN id % 211 = 0 THEN 7 ELSE 0 END AS block_offset FROM b0),
container AS (SELECT container_id AS id, 'container_' || CAST(container_id AS VARCHAR) || '.bin' AS filename, container_id % 4 <> 0 AS sealed, container_id % 8 = 0 AS sealing,
  CASE WHEN container_id % 4 <> 0 AND container_id % 17 <> 0 THEN sha256('c' || CAST(container_id AS VARCHAR)) END AS container_hash, container_id % 11 = 0 AS quarantine, 64 + sum(stored_size) + CASE WHEN container_id % 13 = 0 THEN 5 ELSE 0 END AS current_size FROM b0 GROUP BY container_id),
container_file AS (SELECT filename, current_size + CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END - CASE WHEN id % 29 = 0 THEN 9 ELSE 0 END AS size, sha256('c' || CAST(CASE WHEN id % 5 = 0 THEN id + 1 ELSE id END AS VARCHAR)) AS sha256 FROM container WHERE id % 19 <> 0 UNION ALL SELECT 'container_x.bin', 128, NULL),
snapshot AS (SELECT * FROM (VALUES ('day1', 1700000000, 'full', 'first day', NULL), ('day2', 1700086400, 'full', NULL, 'day1'), ('part1', 1700090000, 'partial', 'Source one', 'day2'), ('lost', 1700095000, 'partial', 'first lost', 'gone'), ('odd', 1700099000, 'full', NULL, 'part1'), ('gap', 1700099500, 'full', NULL, 'never')) AS s(id, created_at, type, label, parent_id)),
snapshot_path AS (SELECT doc_id + 1 AS id, ltrim(path, '/') AS path FROM keyed UNION ALL SELECT doc_id + 2000000001, './' || ltrim(path, '/') FROM keyed WHERE doc_id % 40 = 7),
prev AS (SELECT doc_id + 1 AS doc_id, logical_file_id AS before_id FROM keyed),
sf0 AS (
  SELECT 'day1' AS snapshot_id, doc_id, 0 AS far, CASE WHEN doc_id % 251 = 250 THEN 9999999999 ELSE logical_file_id END AS logical_file_id, size FROM keyed WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'day2', k.doc_id, 0, CASE WHEN k.doc_id % 11 = 0 AND k.doc_id > 0 THEN coalesce(before_id, logical_file_id) ELSE logical_file_id END, size FROM keyed k LEFT JOIN prev ON prev.doc_id = k.doc_id WHERE k.doc_id % 7 <> 0
  UNION ALL SELECT 'part1', doc_id, 0, logical_file_id, size FROM keyed WHERE source = 'src1'
  UNION ALL SELECT 'odd', doc_id, 0, logical_file_id, size FROM keyed WHERE source IN ('src1', 'src2')
  UNION ALL SELECT 'lost', doc_id, 0, logical_file_id, size FROM keyed WHERE doc_id % 20 = 7
  UNION ALL SELECT 'lost', doc_id, 0, logical_file_id, size FROM keyed WHERE doc_id % 60 = 7
  UNION ALL SELECT 'lost', doc_id, 1000000000, logical_file_id, size FROM keyed WHERE doc_id % 40 = 9
  UNION ALL SELECT 'lost', doc_id, 2000000000, logical_file_id + 1, size FROM keyed WHERE doc_id % 40 = 7),
snapshot_file AS (SELECT snapshot_id, doc_id + 1 + far AS path_id, logical_file_id, CASE WHEN doc_id % 17 <> 0 THEN size END AS size, 420 AS mode, CASE WHEN doc_id % 13 <> 0 THEN 1700000000 + doc_id * 3600 END AS mtime FROM sf0),
placed AS (SELECT b.*, c.status, c.live_ref_count, c.pin_count, (c.live_ref_count > 0 OR c.pin_count > 0) AS live FROM blocks b JOIN chunk c ON c.id = b.chunk_id),
retained AS (SELECT logical_file_id FROM physical_file UNION SELECT logical_file_id FROM snapshot_file),
entries AS (SELECT snapshot_id, path, logical_file_id, f.size, f.mtime FROM snapshot_file f JOIN snapshot_path p ON p.id = f.path_id)
"""
