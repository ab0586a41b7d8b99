"""State changes on small repositories made by hand."""

import pytest

from bytequarry.operators import listing, maintenance, retention, snapshots
from bytequarry.repository import Repository
from bytequarry.schema import V2, schema


@pytest.fixture(scope="module")
def repo(spark):
    t = lambda n, rows: spark.createDataFrame(rows, schema(n))
    f = lambda i, size, refs, state="COMPLETED": (i, f"f{i}", size, f"h{i}", refs, V2, state, 0)
    p = lambda path, i: (path, i, None, None, None, None, False)
    return Repository(spark, {
        "logical_file": t("logical_file", [f(1, 11, 1), f(2, 22, 0), f(3, 33, 1), f(4, 44, 0)]),
        "physical_file": t("physical_file", [p("/d/a.txt", 1), p("/d/c.txt", 3)]),
        "snapshot": t("snapshot", [("s1", 1, "full", None, None), ("s2", 2, "full", "x", "s1")]),
        "snapshot_path": t("snapshot_path", [(1, "d/b.txt"), (2, "d/c.txt"), (3, "d/lost.txt")]),
        "snapshot_file": t("snapshot_file", [("s1", 1, 2, 22, None, None), ("s1", 2, 3, 33, None, None), ("s2", 3, 9999, None, None, None)]),
    })


def test_retention(repo):
    r = retention.report(repo).head()
    assert (r.current_only_files, r.current_only_bytes) == (1, 11)
    assert (r.referenced_files, r.referenced_bytes, r.snapshot_only_files, r.snapshot_only_bytes, r.shared_files, r.shared_bytes) == (3, 55, 2, 22, 1, 33)


def test_null_sizes_pass_ranges(repo):
    q = snapshots.SnapshotQuery(least_size=1_000)
    assert [r.path for r in snapshots.show(repo, "s2", q).collect()] == ["d/lost.txt"]
    with pytest.raises(ValueError):
        snapshots.SnapshotQuery(least_size=2, most_size=1)


def test_limits(repo):
    assert listing.files(repo, limit=0).count() == 0 and snapshots.listed(repo, limit=0).count() == 2
    with pytest.raises(ValueError):
        listing.files(repo, limit=10_001)


def test_snapshot_create_and_delete(repo):
    with pytest.raises(ValueError):  # a partial snapshot has no parent
        snapshots.create(repo, "s3", 3, ("d/c.txt",), parent="s1")
    new = snapshots.create(snapshots.create(repo, "s3", 3, ("./d//c.txt", "d/c.txt")), "s5", 5, parent="s1")
    assert [(r.path, r.logical_file_id) for r in snapshots.show(new, "s3").collect()] == [("d/c.txt", 3)]
    with pytest.raises(ValueError):
        snapshots.create(repo, "s4", 4, ("d/none.txt",))
    assert snapshots.create(repo, "s4", 4, ("none/",)).snapshot_file.count() == 3
    with pytest.raises(ValueError):
        snapshots.create(repo, "s1", 4)
    less = snapshots.delete(new, "s1")
    assert {r.id: r.parent_id for r in less.snapshot.collect()} == {"s2": None, "s3": None, "s5": None}
    assert sorted(r.id for r in new.snapshot_path.collect()) == [1, 2, 3, 4]  # new paths are numbered after the largest id


def test_removal(repo):
    with pytest.raises(ValueError):
        maintenance.remove(repo, 2)
    gone = maintenance.remove(repo, 1)
    assert gone.physical_file.count() == 1 and gone.logical_file.count() == 3
    with pytest.raises(ValueError):
        maintenance.unmap(repo, "/d/c.txt")
    assert maintenance.unmap(repo, "/d/a.txt").logical_file.where("id = 1").head().ref_count == 0
    with pytest.raises(ValueError):
        maintenance.map_path(repo, "/d/a.txt", 4)
    moved = maintenance.map_path(repo, "/d/a.txt", 4, replace=True).logical_file
    assert {r.id: r.ref_count for r in moved.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_save_and_load(repo, spark, tmp_path):
    where = str(tmp_path / "repo")
    assert repo.save(where) == 1 and maintenance.configure(repo, "k", "v").save(where) == 2
    assert Repository.load(spark, where).repository_config.count() == 1
    assert Repository.load(spark, where, 1).snapshot_file.count() == 3


def test_stream(spark, small, tmp_path):
    import shutil

    from bytequarry.functions.cdc import SCALED
    from bytequarry.streaming.ingest import document_stream, store_chunks

    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        shutil.copy(f"{small}/documents.parquet", tmp_path / "in" / f"{n}.parquet")
    q = store_chunks(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), SCALED[V2])
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() > 0
