"""Schemas of the repository's tables and their fixed values."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: States, codecs, chunker versions, container header.
PROCESSING, COMPLETED, ABORTED = "PROCESSING", "COMPLETED", "ABORTED"
PLAIN, AES = "plain", "aes-gcm"
V1, V2 = "v1-simple-rolling", "v2-fastcdc"
VERSION_PATTERN = r"^v[0-9]+(?:-[a-z0-9]+)+$"
HEADER_SIZE, DEFAULT_CONTAINER_MAX = 64, 64 << 20
AES_OVERHEAD = 16

#: Tables and columns, whose names must match.
TABLES = {
    "container": "id long, filename string, sealed boolean, sealing boolean, container_hash string, quarantine boolean, current_size long, max_size long",
    "chunk": "id long, chunk_hash string, size long, status string, live_ref_count long, pin_count long, retry_count int, chunker_version string",
    "logical_file": "id long, original_name string, total_size long, file_hash string, ref_count long, chunker_version string, status string, retry_count int",
    "physical_file": "path string, logical_file_id long, mode long, mtime long, uid long, gid long, is_metadata_complete boolean",
    "file_chunk": "logical_file_id long, chunk_id long, chunk_order long",
    "blocks": "id long, chunk_id long, codec string, format_version int, plaintext_size long, stored_size long, nonce binary, container_id long, block_offset long",
    "snapshot": "id string, created_at long, type string, label string, parent_id string",
    "snapshot_path": "id long, path string",
    "snapshot_file": "snapshot_id string, path_id long, logical_file_id long, size long, mode long, mtime long",
    "repository_config": "key string, value string",
    "container_file": "filename string, size long, sha256 string",
    "block_payload": "block_id long, payload binary",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
