"""The store path on a few files: conflicts, rebuilding, restoring to disk."""

import pytest
from pyspark.sql import functions as F

from bytequarry.functions.cdc import SCALED
from bytequarry.operators import maintenance, restore, store
from bytequarry.repository import Repository
from bytequarry.schema import V2

KEY = bytes(range(32))


def test_store_and_restore(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    one, two = bytes(range(256)) * 9, b"other content"
    first = store.store(Repository.empty(spark), files([("/d/a", one), ("/d/b", one), ("/d/c", two), ("/d/empty", b"")]), SCALED[V2], "aes-gcm", KEY)
    repo_at = str(tmp_path / "repo")
    first.save(repo_at)
    repo = Repository.load(spark, repo_at)
    assert sorted(r.ref_count for r in repo.logical_file.collect()) == [1, 1, 2]
    with pytest.raises(ValueError):
        store.store(repo, files([("/d/a", two)]), SCALED[V2], "aes-gcm", KEY)
    ids = {r.path: r.logical_file_id for r in repo.physical_file.collect()}
    again = store.store(maintenance.reset_file(repo, ids["/d/a"]), files([("/d/a", one)]), SCALED[V2], "aes-gcm", KEY)
    got = {r.logical_file_id: (r.verdict, bytes(r.content)) for r in restore.restored(again, key=KEY).collect()}
    assert got == {ids["/d/a"]: ("ok", one), ids["/d/c"]: ("ok", two), ids["/d/empty"]: ("ok", b"")}
    assert {r.verdict for r in restore.restored(repo, key=bytes(32)).collect()} == {"no_chunks", "ok"}  # the empty file needs no key
    plan = repo.physical_file.select("logical_file_id", F.concat(F.lit(f"{tmp_path}/out"), "path").alias("output"))
    assert {r.verdict for r in restore.restore(repo, plan, KEY).collect()} == {"ok"}
    assert (tmp_path / "out/d/b").read_bytes() == one and (tmp_path / "out/d/empty").read_bytes() == b""
    assert {r.verdict for r in restore.restore(repo, plan, KEY).collect()} == {"exists"}
