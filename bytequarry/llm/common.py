"""Shared helpers: table access, shared scratch space, and streaming text blocks through Arrow."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from, at most; a documented bound, the same at every size.
MOST_LABELLED = 6_000
#: Rows of ids that go to every executor at most, unless an operator has a bound of its own.
MOST_BROADCAST = 1_000_000
#: Text is handled in blocks of about so many characters, which bounds the memory of a Python worker.
BLOCK_CHARS = 2_000_000
#: Bytes of a batch between the JVM and a worker, about (a longer text makes a batch of its own): both hold one or two for each
#: task, beside the memory of the work, and Spark's own bound is 64 MB or 10,000 rows.
BATCH_BYTES = 3_800_000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A worker serves one operator after another; the memory of the last one, by its name.
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Called where an operator starts to fill a lookup table of the worker: those of other operators are emptied."""
    if owner not in _held:
        for other in [*_held]:
            _held.pop(other)()
        _held[owner] = clear


@contextlib.contextmanager
def steady() -> Iterator[None]:
    """No garbage collection within: lookup tables hold no cycles, and walking them again and again costs more than the work."""
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what is free to the system: the pools of a worker would keep it, for as long as the worker lives, beside what its
    next operator needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, or of the bound that the session sets, with free memory given
    back after each. The bound is read when the result is computed, so it stays set in the session."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests, bench)
    gets a temporary one; a cluster has no folder that could be guessed, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/bytequarry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. The table stays there, as
    the result is read lazily; tables that only a step in between needs belong in a Scratch."""
    path = scratch_path(df.sparkSession, label)
    for kept in _gathering:
        kept.paths.append(path)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are deleted at the end of the block. Nothing that is read later may depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        return _written(df, self.paths[-1])

    def drop(self, count: int | None = None) -> None:
        """Delete the oldest `count` tables, or all."""
        gone = self.paths[:count]
        del self.paths[:count]
        for p in gone:
            drop_path(self.spark, p)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


#: Blocks whose materialized tables are noted, to be deleted at their end.
_gathering: list[Scratch] = []


@contextlib.contextmanager
def gathered(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are materialized within the block are deleted at its end: for a caller that has written the result by then."""
    with Scratch(spark) as scratch:
        _gathering.append(scratch)
        try:
            yield scratch
        finally:
            _gathering.remove(scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(column: Column) -> Column:
    """The column, computed once: as the optimizer holds it for random, it doesn't copy it into filters and later columns."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model may learn from. A row without an id does, as if its id were empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the incoming batches with at most about `chars` bytes each, a null text read as empty.

    A single longer text makes a slice of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for k, n in enumerate([*sizes, None]):
            if n is None or size and size + n > chars:
                if k > start:
                    yield batch.slice(start, k - start), [x or "" for x in column.slice(start, k - start).to_pylist()]
                start, size = k, 0
            size += n or 0


def map_blocks(df: DataFrame, schema: str, work: Callable[[list[str]], dict[str, object]], keep: str = "doc_id", text: str = "text", kept_type: str = "long", chars: int = BLOCK_CHARS) -> DataFrame:
    """Apply `work` to blocks of whole texts; its columns follow the kept one. `schema` lists the added columns in order."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady():
            for batch, texts in blocks(batches, text, chars):
                got = work(texts)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(keep)), *(x if isinstance(x := got[n], pa.Array) else pa.array(x) for n in names)], names=[keep, *names])

    return mapped(df.select(keep, text), run, f"`{keep}` {kept_type}, {schema}")


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, most: int = MOST_LABELLED) -> tuple[DataFrame, dict[int, int]]:
    """Whole texts of at most `most` labelled documents outside the held-out fold, half of each class if there are so many,
    chosen by the hash of their id; and how many labelled documents each class has. Rows without a label or an id don't
    count, nor do documents with conflicting labels; of several texts with one id the least is taken."""
    mine = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mine = mine.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    counts = {r["label"]: r["count"] for r in mine.groupBy("label").count().collect()}
    quota = {k: min(n, max(most // 2, most - counts.get(1 - k, 0))) for k, n in counts.items()}
    picked = None
    for k, n in sorted(quota.items()):
        part = mine.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if picked is None:
        return docs.limit(0).withColumn("label", F.lit(0)), counts
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts  # at most `most` ids and labels
