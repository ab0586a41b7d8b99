"""Chunking, packing, replay, codecs, paths and globs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytequarry.functions import cdc, codecs, scalars
from bytequarry.operators import ingest
from bytequarry.schema import V1, V2
from bytequarry.sources import files

BODIES = [b"", b"a", bytes(100), b"\xff" * 5000, bytes(range(256)) * 20, random.Random(7).randbytes(20_000)]


@pytest.mark.parametrize("version", [V1, V2])
@pytest.mark.parametrize("body", BODIES)
def test_cuts_equal_the_definition(version, body):
    p = cdc.SCALED[version]
    ends = cdc.cuts(body, p)
    assert ends == cdc.cuts_by_bytes(body, p)
    assert not body or ends[-1] == len(body)
    assert all(p.least <= e - s <= p.most for s, e in list(zip([0, *ends], ends, strict=False))[:-1])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([V1, V2]))
def test_cuts_of_any_bytes(body, version):
    assert cdc.cuts(body, cdc.SCALED[version]) == cdc.cuts_by_bytes(body, cdc.SCALED[version])


@pytest.mark.parametrize("version", [V1, V2])
def test_published_sizes(version):
    body = random.Random(1).randbytes(3_000_000)
    assert cdc.cuts(body, cdc.PROFILES[version]) == cdc.cuts_by_bytes(body, cdc.PROFILES[version])


def test_constant_run_is_cut_at_the_most():
    n = cdc.PROFILES[V1].most
    assert cdc.cuts(b"\xff" * (2 * n + 123), cdc.PROFILES[V1]) == [n, 2 * n, 2 * n + 123]


def test_registry():
    r = cdc.Registry()
    assert r.get().version == V1 and r.get(configured=V2).version == V2 and r.get(V1, V2).version == V1
    with pytest.raises(ValueError):
        r.get("v9-none")
    with pytest.raises(ValueError):
        r.register(cdc.PROFILES[V1])


def test_packing_is_next_fit(spark):
    rng = random.Random(3)
    rows = [(k % 3, k, rng.randint(1, 400)) for k in range(300)]
    got = {(r.g, r.o): (r.container_no, r.block_offset) for r in ingest.packed(spark.createDataFrame(rows, "g long, o long, s long"), "g", "o", "s", 1000).collect()}
    state = {}
    for g, o, s in rows:
        n, at = state.get(g, (0, 64))
        if at > 64 and at + s > 1000:
            n, at = n + 1, 64
        assert got[g, o] == (n, at)
        state[g] = (n, at + s)


def test_replay_finds_damage(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()
    recipes = spark.createDataFrame([(1, 0, h(b"ab")), (1, 1, h(b"cd")), (2, 0, h(b"ab")), (2, 2, h(b"zz")), (3, 0, h(b"no"))], "file_id long, chunk_order long, chunk_hash string")
    payloads = spark.createDataFrame([(h(b"ab"), bytearray(b"ab")), (h(b"cd"), bytearray(b"cd")), (h(b"zz"), bytearray(b"xx"))], "chunk_hash string, data binary")
    got = {r.file_id: (r.file_hash == h(b"abcd"), r.missing, r.corrupt, r.breaks) for r in ingest.replayed(recipes, payloads).collect()}
    assert got == {1: (True, 0, 0, 0), 2: (False, 0, 1, 1), 3: (False, 1, 0, 0)}


def test_reuse_is_a_multiset(spark):
    c = lambda x: spark.createDataFrame([(k, 1) for k in x], "chunk_hash string, size long")
    r = ingest.reuse(c("aab"), c("abc")).head()
    assert (r.base_chunks, r.reused, r.reuse_percent) == (3, 2, 66.666667)


def test_encryption_detects_changes(spark):
    key = bytes(32)
    df = spark.createDataFrame([(bytearray(b"hello"),)], "b binary").withColumn("e", codecs.encoded(F.col("b"), "aes-gcm", key))
    r = df.select(F.length("e.nonce").alias("n"), F.length("e.payload").alias("p"), codecs.decoded(F.col("e.nonce"), F.col("e.payload"), F.lit("aes-gcm"), key).alias("ok"), codecs.decoded(F.col("e.nonce"), F.concat(F.col("e.payload"), F.to_binary(F.lit("x"), F.lit("utf-8"))), F.lit("aes-gcm"), key).alias("bad")).head()
    assert (r.n, r.p, bytes(r.ok), r.bad) == (12, 21, b"hello", None)
    with pytest.raises(ValueError):
        codecs.load_key("00")


def test_paths_and_globs(spark):
    rows = [("./a//b", "a/b"), ("a\\b", "a/b"), ("/a", None), (" a", None), ("", None), ("././x", "x"), ("a/../b", "a/../b")]
    df = spark.createDataFrame(rows, "p string, want string").withColumn("got", scalars.normalized_path(F.col("p")))
    assert [(r.p, r.got) for r in df.collect()] == rows
    for pattern, path, want in (("a/*.txt", "a/b.txt", True), ("a/*.txt", "a/b/c.txt", False), ("?[a-c]", "xb", True), ("[^a]", "a", False), ("\\*", "*", True), ("a", "ab", False)):
        assert spark.range(1).select(scalars.matches_glob(F.lit(path), pattern)).head()[0] is want, pattern
    for bad in ("[", "a\\"):
        with pytest.raises(ValueError):
            scalars.glob_regex(bad)
    with pytest.raises(ValueError):
        scalars.safe_regex("(?=a)")


def test_headers_and_reads(spark, tmp_path):
    good = files.header(1, 1000, 5)
    (tmp_path / "a.bin").write_bytes(good + b"payload")
    (tmp_path / "b.bin").write_bytes(good[:20] + b"x" + good[21:] + b"payload")
    f = files.folder(spark, str(tmp_path))
    assert {r.path[-5:]: r.valid for r in files.read_headers(f).collect()} == {"a.bin": True, "b.bin": False}
    path = f.where("path LIKE '%a.bin'").head().path
    assert bytes(files.read_at(f, spark.createDataFrame([(path, 64, 7)], "path string, block_offset long, stored_size long")).head().payload) == b"payload"
