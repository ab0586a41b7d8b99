"""Near-duplicate detection with min-max hashing.

A document's set holds its distinct shingles. Under each of 2 * BANDS permutations both the minimum and the maximum are kept,
so the signature has twice as many values as hash evaluations; four values, of two permutations, make a band. Documents
with equal sets are one class from the start. In each bucket, every class is compared with the bucket's smallest id on
the full sets, which joins most of a group of copies without pairs among its members. Jaccard distance is a metric: with the
distances to the bucket's centre known, many remaining pairs of a bucket can't be links. More fall by a bound on what two
sets can share: of the centre's shingles those that neither lacks, and of the others those that a further member has too.
What is left, and isn't connected yet, is compared as well. A pair at the threshold shares no band with probability below
1e-6.

What the bound leaves of a large bucket is compared in tiles of TILE members each, so no task holds more than two tiles.
Tables in between are deleted at the end; the classes of all documents stay, as the result reads them.

Defined cases: a document with fewer words than a shingle has its whole sequence as the only shingle; one without words (null
and empty texts too) is linked with nothing; a row without id is linked with nothing and stays; repeated rows share their
id's verdict, and rows of one id with different texts are one node with the links of either; an empty table has no rows.
`keep_one` keeps further columns, whatever their names; `groups` leaves them out. The shingles of a very long text take
about 30 bytes of memory per word.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS = 32
PERMUTATIONS = 2 * BANDS
#: Rows of (id, id) that go to every executor; larger tables are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Members of a centre compared in one task.
GROUP_ROWS = 256
#: Words whose hashes a worker remembers.
MOST_WORDS = 200_000
#: Cells, by hash, in which what a set lacks of its centre is noted.
CELLS = 256
#: Members of a tile.
TILE = 1_000
#: From so many members on, a bucket's centre is compared with those of another size too, for the bound.
MANY = 16

_known: dict[str, int] = {}
_LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
_NOT_ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def constants() -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(hashlib.shake_128(b"min-max").digest(16 * PERMUTATIONS), "<u8")
    return raw[:PERMUTATIONS] | np.uint64(1), raw[PERMUTATIONS:]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words(text: str) -> list[str]:
    if text.isascii():
        return text.lower().split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in _NOT_ASCII_SPACE.split(text.lower()) if w]
    return [w for w in _NOT_ASCII_SPACE.split(text.translate(_LOWER)) if w]


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes (uint64) of the text's shingles."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    common.hold("neardup", _known.clear)
    get = _known.get
    codes = [get(w) for w in found]
    if None in codes:
        if len(_known) > MOST_WORDS:
            _known.clear()
        for k, w in enumerate(found):
            if codes[k] is None:
                codes[k] = _known[w] = int.from_bytes(hashlib.blake2b(w.encode(errors="surrogatepass"), digest_size=8).digest(), "little")
    w = np.array(codes, np.uint64)
    if len(w) < size:
        size = len(w)
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The band keys (int64) of each non-empty set."""
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    h = np.concatenate(sets)
    a, b = constants()
    low, high = np.empty((PERMUTATIONS, len(sets)), np.uint64), np.empty((PERMUTATIONS, len(sets)), np.uint64)
    for k in range(PERMUTATIONS):
        x = h * a[k] + b[k]
        low[k], high[k] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    out = np.empty((len(sets), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(sets), k, np.uint64)
        for v in (low[2 * k], high[2 * k], low[2 * k + 1], high[2 * k + 1]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + v)
        out[:, k] = key
    return out.view(np.int64)


def signatures(df: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set) and the band keys."""

    def work(texts: list[str]) -> dict[str, object]:
        sets = [shingles(x, size) for x in texts]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys: list[list[int]] = [[] for _ in texts]
        for k, row in zip(full, bands([sets[k] for k in full]).tolist() if full else [], strict=True):
            keys[k] = row
        marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() for s in sets]
        return {"n_shingles": [len(s) for s in sets], "set_a": [m[0] for m in marks], "set_b": [m[1] for m in marks], "bands": pa.array(keys, pa.list_(pa.int64()))}

    return common.map_blocks(df, "n_shingles long, set_a long, set_b long, bands array<long>", work, doc_id, text)


def against(centre: np.ndarray, found: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """Of two sorted sets: the size of the intersection, which of CELLS cells hold a shingle that only the centre has (as
    bits of longs), and the shingles that only the other has (32 bits of each)."""
    if not len(centre):
        return 0, [0] * (CELLS // 64), found.astype(np.uint32).view(np.int32)
    place = np.minimum(np.searchsorted(centre, found), len(centre) - 1)
    hit = centre[place] == found
    lacking = np.ones(len(centre), bool)
    lacking[place[hit]] = False
    cells = np.zeros(CELLS, np.uint8)
    cells[(centre[lacking] % np.uint64(CELLS)).astype(np.int64)] = 1
    return int(hit.sum()), np.packbits(cells).view("<i8").tolist(), found[~hit].astype(np.uint32).view(np.int32)


def compared(pairs: DataFrame, df: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """pairs (a, b) with the sizes of intersection and union of the full sets, and what differs: a, b, both, either, gone, more.

    The texts of a's partners meet the text of a in groups of at most about GROUP_ROWS, so no a makes a large task.
    """
    few = pairs.count() <= MOST_BROADCAST
    # only an a with more partners than a group needs salts: a share of the pairs, and never dealt by a
    large = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("groups")).where("groups > 1")
    salted = pairs.join(common.few(large), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).alias("salt"))
    wanted = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).unionByName(salted.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")).distinct())
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        group, centres = None, []  # the centre's rows come first; an id may have several texts
        for batch, texts in common.blocks(batches):
            out = []
            for b, a, salt, role, x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "a", "salt", "role")), texts, strict=True):
                found = shingles(x, size)
                if role == 0:
                    if group != (a, salt):
                        group, centres = (a, salt), []
                    if not any(np.array_equal(found, c) for c in centres):
                        centres.append(found)
                elif group == (a, salt):
                    rows = []
                    for mine in centres:
                        both, gone, more = against(mine, found)
                        rows.append((a, b, both, len(mine) + len(found) - both, gone, more))
                    out.append(max(rows, key=lambda r: r[2] / max(1, r[3])))
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["a", "b", "both", "either", "gone", "more"])

    return common.mapped(rows.select("doc_id", "a", "salt", "role", "text"), run, "a long, b long, both long, either long, gone array<long>, more array<int>")


def shareable(members: DataFrame, first: DataFrame) -> DataFrame:
    """centre, id, base (the centre's shingles that it has), extra (its others that a further member of the centre has, at
    least that many) and gone, of the members (centre, id) that were compared with their centre."""
    own = members.join(first.withColumnsRenamed({"a": "centre", "b": "id"}), ["centre", "id"]).select("centre", "id", "both", "gone", "more")
    others = own.select("centre", "id", F.explode("more").alias("token"))
    twice = others.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "token")
    extra = others.join(twice, ["centre", "token"]).groupBy("centre", "id").agg(F.count(F.lit(1)).alias("extra"))
    return own.drop("more").join(extra, ["centre", "id"], "left").select("centre", "id", F.col("both").alias("base"), F.coalesce("extra", F.lit(0)).alias("extra"), "gone")


def components(links: DataFrame, scratch: common.Scratch, rounds: int = 1_000) -> DataFrame:
    """node and root (the smallest node reachable) of every node with a link; links: a, b. Alternates large and small stars
    until nothing changes, which takes about the logarithm of the longest path; raises an error if it takes `rounds`."""
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = scratch.table(large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).head())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def tiled(left: DataFrame, tile: int = TILE) -> DataFrame:
    """left with its key made narrower: the members of a key are dealt into tiles of about `tile`, and each member goes to
    every pair of tiles (t, u), t <= u, that its own is one of. Two members of a key meet in exactly one of these pairs;
    `side` tells the tile (0: t, 1: u)."""
    large = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    dealt = left.join(common.few(large), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("t"), F.greatest("tile", o).alias("u"), (F.col("tile") > o).cast("int").alias("side")))
    return dealt.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("tiles", "tile", "cell")


def groups(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df; linked are sets with 100 * both >= percent * either."""
    signed = common.materialize(signatures(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), size), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.materialize(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"), F.min("n_shingles").alias("n")), "classes")
    with common.Scratch(df.sparkSession) as scratch:
        roots = linked_roots(classes, df, size, percent, doc_id, text, scratch)
        verdicts = classes.join(roots, classes["id"] == roots["node"], "left").select("set_a", "set_b", F.coalesce("root", "id").alias("root"), "id", "copies").where("copies > 1 OR root <> id").select("set_a", "set_b", "root")
        verdicts = common.materialize(verdicts, "verdicts")
    out = signed.withColumn("linkable", F.expr("n_shingles > 0 AND doc_id IS NOT NULL")).join(common.few(verdicts, MOST_BROADCAST), ["set_a", "set_b"], "left")
    component = F.when(F.col("linkable"), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def linked_roots(classes: DataFrame, df: DataFrame, size: int, percent: int, doc_id: str, text: str, scratch: common.Scratch) -> DataFrame:
    """node and root of the classes that are linked with others; classes: id, n and bands."""

    def near_in_size(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    slots = common.settled(F.col("bands"))
    keys = classes.select("id", "n", slots.alias("bands")).select("id", "n", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("m"), F.min_by("n", "id").alias("centre_n")).where("m > 1").select("key", "centre", "centre_n", (F.col("m") >= MANY).alias("many"))
    buckets = scratch.table(keys.join(centres, "key"), "buckets")
    at_centre = F.col("id") == F.col("centre")
    stars = buckets.where(~at_centre & (F.col("many") | near_in_size("n", "centre_n"))).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    first = scratch.table(compared(scratch.table(stars, "pairs"), df, size, doc_id, text), "compared")
    linked = (100 * F.col("both") >= percent * F.col("either")).alias("linked")
    roots = scratch.table(components(first.where(linked).select("a", "b"), scratch), "roots")
    # what the distances to each bucket's centre leave open
    known = first.select(F.col("a").alias("centre"), F.col("b").alias("id"), (1 - F.col("both") / F.col("either")).alias("d"))
    own = common.few(roots.select(F.col("node").alias("id"), "root"), MOST_BROADCAST)
    main = common.few(roots.select(F.col("node").alias("centre"), F.col("root").alias("main")), MOST_BROADCAST)
    rows = buckets.join(known, ["centre", "id"], "left").join(own, "id", "left").join(main, "centre", "left").withColumns({"root": F.coalesce("root", "id"), "main": F.coalesce("main", "centre"), "alone": F.col("d").isNull() & ~at_centre})
    by_size = 1 - F.least("n", "centre_n") / F.greatest("n", "centre_n")
    rows = rows.withColumns({"low": F.when(at_centre, 0.0).otherwise(F.coalesce("d", by_size)), "high": F.when(at_centre, 0.0).otherwise(F.coalesce("d", F.lit(1.0)))})
    rows = scratch.table(rows.select("key", "id", "n", "root", "main", "low", "high", "centre", "centre_n", "alone"), "open")
    reach = 1 - percent / 100 + 1e-9
    other = F.col("root") != F.col("main")
    others = rows.groupBy("key").agg(F.min(F.when(other, F.col("low"))).alias("nearest"), F.max("alone").alias("some_alone")).where("nearest IS NOT NULL")
    left = rows.join(others, "key").where(other | (F.col("nearest") - F.col("high") <= reach)).drop("main", "nearest", "alone")
    left = scratch.table(left, "left")
    bounds = shareable(left.select("centre", "id").distinct(), first)
    left = left.join(bounds, ["centre", "id"], "left").withColumn("base", F.coalesce("base", F.least("n", "centre_n")))
    # `extra` counts what members share that were compared with the centre; beside others it is no bound
    left = left.withColumn("extra", F.when(at_centre, 0).when(F.col("some_alone") | F.col("extra").isNull(), F.col("n") - F.when(F.col("extra").isNull(), 0).otherwise(F.col("base"))).otherwise(F.col("extra"))).drop("some_alone")
    left = left.withColumns({f"gone{k}": F.coalesce(F.get("gone", F.lit(k)), F.lit(0).cast("long")) for k in range(CELLS // 64)}).drop("gone", "centre")
    left = scratch.table(left.where(100 * (F.col("base") + F.col("extra")) >= percent * F.col("n")), "left")  # else nothing of its size is near enough
    cells = tiled(left)
    on = ("key", "t", "u", "centre_n")
    x, y = (cells.select(*on, *(F.col(c).alias(f"{side}_{c}") for c in cells.columns if c not in on)) for side in "ab")
    y = y.drop("centre_n")
    lacking = sum((F.bit_count(F.col(f"a_gone{k}").bitwiseOR(F.col(f"b_gone{k}"))) for k in range(CELLS // 64)), F.lit(0))
    most = F.least("a_base", "b_base", F.col("centre_n") - lacking) + F.least("a_extra", "b_extra")
    once = F.when(F.col("t") == F.col("u"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_side") < F.col("b_side"))
    possible = once & (F.col("a_root") != F.col("b_root")) & (F.col("a_low") - F.col("b_high") <= reach) & (F.col("b_low") - F.col("a_high") <= reach) & near_in_size("a_n", "b_n") & ((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
    rest = x.join(y, ["key", "t", "u"]).where(possible).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    rest = scratch.table(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        second = scratch.table(compared(rest, df, size, doc_id, text).where(linked).select("a", "b"), "compared")
        if not second.isEmpty():
            roots = scratch.table(components(second.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))), scratch), "roots")
    return roots


def keep_one(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the documents that have a near duplicate with a smaller id in their group, its columns as they were."""
    own = common.fresh(df, "gone")
    gone = common.materialize(groups(df, size, percent, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(own)), "copies")
    return df.join(common.few(gone, MOST_BROADCAST), df[doc_id] == gone[own], "left_anti").select(*df.columns)


def op7_near_dedup(spark, sf_dir):
    return groups(common.table(spark, sf_dir, "documents"), size=2)
