"""From bytes to chunks, containers and back: dedup, next-fit packing, recipe replay, reuse comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, datasets
from ..functions.cdc import PROFILES, Profile, chunked
from ..repository import settled
from ..schema import AES_OVERHEAD, DEFAULT_CONTAINER_MAX, HEADER_SIZE, PLAIN, V1, V2


def file_chunks(files: DataFrame, profile: Profile, key: str = "file_id", content: str = "content") -> DataFrame:
    """key, chunk_order, offset, size and chunk_hash of every chunk; none for an empty file."""
    return files.select(key, F.explode(chunked(F.col(content), profile)).alias("c")).select(key, "c.*")


def dedup(rows: DataFrame, known: DataFrame, order: str, content_hash: str, size: str) -> DataFrame:
    """Distinct (hash, size) of rows: the first row's id, the number of references, and whether it is known already."""
    g = rows.groupBy(content_hash, size).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("refs"))
    there = known.select(content_hash, size).distinct().withColumn("reused", F.lit(True))
    return g.join(there, [content_hash, size], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def packed(blocks: DataFrame, group: str, order: str, size: str, most: int = DEFAULT_CONTAINER_MAX, begun: dict[int, int] | None = None) -> DataFrame:
    """Next-fit: group, order, size, container_no and block_offset. A group is one writer; its rows stream through one task
    in order, so take as many groups as there are writers. A payload too large for a container has one of its own. begun:
    where the first container of a group is filled up to already."""
    begun = begun or {}
    rows = blocks.select(F.col(group).cast("long").alias("g"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, at = None, 0, HEADER_SIZE
        for f in frames:
            numbers, offsets = [], []
            for g, s in zip(f["g"], f["s"], strict=True):
                if g != now:
                    now, number, at = g, 0, begun.get(g, HEADER_SIZE)
                if at > HEADER_SIZE and (at + s > most or at >= most):
                    number, at = number + 1, HEADER_SIZE
                numbers.append(number)
                offsets.append(at)
                at += s
            yield f.assign(container_no=numbers, block_offset=offsets)

    made = rows.repartition("g").sortWithinPartitions("g", "o").mapInPandas(run, "g long, o long, s long, container_no long, block_offset long")
    return made.select(F.col("g").alias(group), F.col("o").alias(order), F.col("s").alias(size), "container_no", "block_offset")


def replayed(recipes: DataFrame, payloads: DataFrame) -> DataFrame:
    """recipes: file_id, chunk_order, chunk_hash; payloads: chunk_hash, data. file_id, content, file_hash, and the numbers of
    missing chunks, of chunks that don't match their hash, and of breaks in the order. Bad chunks are left out."""
    w = Window.partitionBy("file_id").orderBy("chunk_order")
    rows = recipes.withColumn("want", F.row_number().over(w) - 1).join(payloads, "chunk_hash", "left")
    ok = F.col("data").isNotNull() & (F.sha2("data", 256) == F.col("chunk_hash"))
    rows = rows.withColumn("good", F.when(ok, F.col("data")))
    n = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("file_id").agg(F.expr("listagg(good) WITHIN GROUP (ORDER BY chunk_order)").alias("content"), n(F.col("data").isNull()).alias("missing"), n(F.col("data").isNotNull() & F.col("good").isNull()).alias("corrupt"), n(F.col("want") != F.col("chunk_order")).alias("breaks"))
    return out.withColumn("file_hash", F.sha2(F.coalesce("content", F.to_binary(F.lit(""), F.lit("utf-8"))), 256))


def stored(chunks: DataFrame, codec: str, key: bytes | None = None) -> DataFrame:
    """chunk_hash and data to nonce, payload and stored_size."""
    e = chunks.withColumn("e", codecs.encoded(F.col("data"), codec, key))
    return e.select("chunk_hash", F.lit(codec).alias("codec"), "e.nonce", "e.payload", F.length("e.payload").alias("stored_size"))


def stored_overhead(codec: str) -> int:
    """Bytes that a codec adds to a chunk."""
    return 0 if codecs.parse(codec) == PLAIN else AES_OVERHEAD


def chunk_summary(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("total"), F.round(F.avg("size"), 6).alias("mean_size"))


def coverage(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """Chunks that don't begin where those before end: gap or overlap."""
    w = Window.partitionBy(key).orderBy("chunk_order").rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.withColumn("want", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return c.where("offset <> want").select(key, "chunk_order", F.when(F.col("offset") > F.col("want"), "gap").otherwise("overlap").alias("problem"))


def reuse(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Chunks of the base and how many of them the variant has too, as multisets of (hash, size); the share of the base."""
    k = ["chunk_hash", "size"]
    b, v = base.groupBy(*k).agg(F.count(F.lit(1)).alias("b")), variant.groupBy(*k).agg(F.count(F.lit(1)).alias("v"))
    both = b.join(v, k, "left").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("base_chunks"), F.coalesce(F.sum(F.least("b", F.coalesce("v", F.lit(0)))), F.lit(0)).alias("reused"))
    return both.withColumn("reuse_percent", F.round(F.when(F.col("base_chunks") > 0, F.col("reused") / F.col("base_chunks") * 100).otherwise(0.0), 6))


def count_delta(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Chunks of both and their difference; an error unless both are splits of as many bytes."""
    one = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias(f"{p}_bytes"))
    row = one(base, "base").crossJoin(one(variant, "variant"))
    same = F.col("base_bytes") == F.col("variant_bytes")
    return row.select("base_chunks", "variant_chunks", F.when(same, F.col("variant_chunks") - F.col("base_chunks")).otherwise(F.raise_error(F.lit("the inputs differ in size"))).alias("delta"))


def compared(base: DataFrame, variant: DataFrame, name: str, versions: tuple[str, str] | None = None) -> DataFrame:
    """One report row; the shift metric is set for variants with 'shift' in their name only. versions: the chunkers of both,
    which must be the same."""
    if versions is not None and versions[0] != versions[1]:
        raise ValueError(f"reuse compares one version's chunks, not {versions[0]} with {versions[1]}")
    n = variant.agg(F.count(F.lit(1)).alias("variant_chunks"))
    r = reuse(base, variant).crossJoin(n)
    return r.select(F.lit(name).alias("variant"), "base_chunks", "variant_chunks", (F.col("variant_chunks") - F.col("base_chunks")).alias("delta"), "reuse_percent", (F.col("reuse_percent") if "shift" in name else F.lit(None).cast("double")).alias("boundary_stability"))


def winners(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows: metric, version, value. The better version of each metric; a difference below 1e-4 is a tie."""
    at = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    out = rows.groupBy("metric").agg(at(a).alias("first"), at(b).alias("second")).withColumn("delta", F.col("second") - F.col("first"))
    return out.withColumn("winner", F.when(F.abs("delta") < 1e-4, "tie").when(F.col("delta") > 0, b).otherwise(a))


def benchmark(spark, size: int = datasets.BYTES) -> DataFrame:
    """metric, first, second, delta and winner: the reuse of both chunkers after an edit and after a shift."""
    rows = None
    for metric, (base, variant) in datasets.pairs(size).items():
        for version, profile in PROFILES.items():
            own = [file_chunks(spark.createDataFrame([(0, x)], "file_id long, content binary"), profile) for x in (base, variant)]
            one = reuse(*own).select(F.lit(metric).alias("metric"), F.lit(version).alias("version"), F.col("reuse_percent").alias("value"))
            rows = one if rows is None else rows.unionByName(one)
    return winners(rows, V1, V2)


def write_files(contents: DataFrame, overwrite: bool = True) -> DataFrame:
    """Write the content of each row whose verdict is ok to its output, a path that executors share or an address that Arrow's
    file systems know: a temporary name beside it first, then a rename. All columns but the content, the verdict of
    outputs that exist already being `exists`. A task that is tried again writes the same files."""
    columns = [c for c in contents.columns if c != "content"]
    schema = contents.select(*columns).schema

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import pyarrow.fs as fs

        for f in frames:
            verdicts = list(f["verdict"])
            for k, (content, output, verdict) in enumerate(zip(f["content"], f["output"], verdicts, strict=True)):
                if verdict != "ok":
                    continue
                store, path = fs.FileSystem.from_uri(output if "://" in output else f"file://{os.path.abspath(output)}")
                if not overwrite and store.get_file_info(path).type != fs.FileType.NotFound:
                    verdicts[k] = "exists"
                    continue
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{os.getpid()}.part"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content or b""))
                store.move(part, path)
            yield f.drop(columns="content").assign(verdict=verdicts)[columns]

    return settled(contents.mapInPandas(put, schema), "written")
