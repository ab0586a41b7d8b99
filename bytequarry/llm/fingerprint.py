"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs.

A paragraph (a line that isn't empty) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs doesn't matter, and a paragraph is
inserted or deleted by adding or subtracting its vector. The vector has two parts:

* 32 lanes of 64 bits from SHAKE-128, modulo 2**64: equal sums mean equal multisets.
* 256 lanes of 32 bits, modulo 2**32, a sketch of the windows of 12 bytes that begin at the paragraph's words, each adding
  +1 or -1 to one lane. The cosine of two such sums estimates how much two documents share, also where a paragraph was cut.
  Words end at any white space. In one of more than 12 bytes (or a text without spaces) further windows begin at places
  that its bytes define, at most 8 bytes apart, so the windows cover all of it.

As vectors add up, a text of more than PIECE bytes is handled paragraph by paragraph; a single paragraph of that size takes
about 40 bytes of memory per byte.

Defined cases: a null text counts as empty; an empty text has the zero vector, which is like another empty one (1) and unlike
all others (0); a null id sorts below all ids; rows with the same id are ordered by the hash of their text, then the text, so
an id that many rows share is dealt into several parts; a single row is its own next one; an empty table has no rows;
further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDE, LANES = 32, 256
SIZE, APART, SEED = 12, 8, 4  # bytes of a window, between places in a long word at most, and that decide on a place
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: White space beyond ASCII, as in str.isspace().
WIDE_SPACES = [chr(k).encode() for k in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
LEADS = np.isin(np.arange(256), [x[0] for x in WIDE_SPACES])
WIDE_CODES = np.array([int.from_bytes(x, "little") for x in WIDE_SPACES], np.uint64)
MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
#: Bytes of text that are turned into vectors at once, but for longer paragraphs.
PIECE = 8_000_000
#: Parts into which the ids are cut: a few thousand rows each, at least and at most so many.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 2_000, 256, 400_000


def gaps(b: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = SPACES[b]
    lead = np.flatnonzero(LEADS[b])
    for n in (2, 3):
        for k in range(n):
            out[lead[np.isin(view[lead] & MASK[n], WIDE_CODES)] + k] = True
    return out


def inner_places(start: np.ndarray, end: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Places within the runs of more than SIZE bytes: the least hash of each APART places in a row (all, if they tie)."""
    long = end - start > SIZE
    start, n = start[long], (end - start)[long] - SEED + 1
    if not len(start):
        return start
    run = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(run)) + np.repeat(start - (np.cumsum(n) - n), n)
    h = (view[at] & MASK[SEED]) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)
    m = len(h) - APART + 1
    least = np.where(run[:m] == run[APART - 1 :], np.min([h[k : k + m] for k in range(APART)], axis=0), -1)
    most = np.full(len(h), -1, np.int64)
    for k in range(APART):
        np.maximum(most[k : k + m], least, out=most[k : k + m])
    return at[(most == h) & (at > start[run])]


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's vector: uint64 (n, WIDE) and int32 (n, LANES)."""
    if len(texts) == 1 and len(texts[0]) > PIECE and "\n" in texts[0]:
        return in_pieces(texts[0])
    n = len(texts)
    wide, like = np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.int32)
    raw = [x.encode(errors="surrogatepass") for x in texts]
    digests, owner = [], []
    for k, x in enumerate(raw):
        got = [hashlib.shake_128(p).digest(8 * WIDE) for p in x.split(b"\n") if p]
        digests += got
        owner += [k] * len(got)
    if not digests:
        return wide, like
    who = np.array(owner)
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    wide[who[first]] = np.add.reduceat(np.frombuffer(b"".join(digests), "<u8").reshape(-1, WIDE), first, axis=0)
    body = b"\n".join(raw) + b"\n" + bytes(16)
    b = np.frombuffer(body, np.uint8)[: len(body) - 16]
    newline = np.flatnonzero(b == 10)
    view = np.ndarray((len(body) - 8,), "<u8", body, 0, (1,))
    gap = gaps(b, view)
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    start = np.sort(np.concatenate((start, inner_places(start, end, view))))
    left = newline[np.searchsorted(newline, start)] - start
    a = view[start] & MASK[np.minimum(left, 8)]
    c = view[start + 8] & MASK[np.clip(left - 8, 0, 4)]
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (c + np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
    lane = (h & np.uint64(LANES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(8)) & np.uint64(1)).astype(float)
    sums = np.bincount(doc * LANES + lane, weights=sign, minlength=n * LANES).reshape(n, LANES)
    return wide, sums.astype(np.int64).astype(np.int32)


def in_pieces(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The vector of one long text: the sum of those of groups of its paragraphs."""
    wide, like = np.zeros((1, WIDE), np.uint64), np.zeros((1, LANES), np.int32)
    start = 0
    while start < len(text):
        end = text.rfind("\n", start, start + PIECE)
        if end <= start and (end := text.find("\n", start + PIECE)) < 0:
            end = len(text)
        w, v = fingerprints([text[start:end].strip("\n")])
        wide, like, start = wide + w, like + v, end + 1
    return wide, like


def pack(wide: np.ndarray, like: np.ndarray) -> list[str]:
    return [base64.b64encode(w.astype("<u8").tobytes() + v.astype("<i4").tobytes()).decode() for w, v in zip(wide, like, strict=True)]


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<i4")


def changed(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs come and go, without the document."""
    wide, like = (x.copy() for x in unpack(fingerprint))
    for texts, sign in ((list(inserted), 1), (list(deleted), -1)):
        w, v = fingerprints(texts)
        wide = wide + w.sum(0, dtype=np.uint64) if sign > 0 else wide - w.sum(0, dtype=np.uint64)
        like = like + (sign * v.sum(0)).astype(np.int32)
    return pack(wide[None], like[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1: 1 where the fingerprints are equal, else the cosine of the sketches."""
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    x, y = a[1].astype(float), b[1].astype(float)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.where(same, 1.0, np.clip((x * y).sum(1) / np.where(size > 0, size, 1), 0, 1))


def fingerprint(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every document."""
    return common.map_blocks(df, "fingerprint string", lambda texts: {"fingerprint": pack(*fingerprints(texts))}, doc_id, text)


def parted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text (null as empty), ord (the id, a null one below all), mark (a hash of the text, by which rows of one id are
    ordered) and part: ranges of (ord, mark), ascending, cut at the quantiles of ord. An id that spans several quantiles is
    cut by mark."""
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias("ord"), F.xxhash64("text").alias("mark"))
    ids = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("ord"))
    n = min(MOST_PARTS, max(LEAST_PARTS, ids.count() // PART_ROWS))
    limits = ids.agg(F.percentile_approx("ord", [k / n for k in range(1, n)], 4 * n).alias("q")).head()["q"] or []
    limits = np.array(limits, np.int64)

    @F.pandas_udf("int")
    def part_of(ord, mark):
        import pandas as pd

        return pd.Series(parts_of(limits, ord.to_numpy(), mark.to_numpy()))

    return base.withColumn("part", part_of("ord", "mark"))


def parts_of(limits: np.ndarray, ord: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The part of each row; limits ascend, and a value that occurs r times among them has its rows cut into r parts."""
    low, high = np.searchsorted(limits, ord, side="left"), np.searchsorted(limits, ord, side="right")
    share = np.minimum((mark.astype(float) + 2.0**63) / 2.0**64, np.nextafter(1, 0))
    return np.where(high - low > 1, low + 1 + (share * (high - low)).astype(np.int64), high).astype(np.int32)


def in_parts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows by part of the ids, descending in each, and after each part's rows a copy of the row that follows them
    (`tail`). No task holds more than a few parts."""
    spark = df.sparkSession
    rows = parted(df, doc_id, text)
    ends = sorted(tuple(r) for r in rows.groupBy("part").agg(F.max(F.struct("ord", "mark")).alias("end")).select("part", "end.*").collect())  # at most MOST_PARTS rows
    follow = [(part, *ends[k - 1][1:]) for k, (part, *_) in enumerate(ends)]
    heads = F.broadcast(spark.createDataFrame([e[1:] for e in ends], "ord long, mark long"))
    texts = rows.select("ord", "mark", "text").join(heads, ["ord", "mark"]).groupBy("ord", "mark").agg(F.max("text").alias("text"))
    tails = texts.join(F.broadcast(spark.createDataFrame(follow, "part int, ord long, mark long")), ["ord", "mark"]).select(F.lit(None).cast("long").alias("doc_id"), "text", "ord", "mark", "part", F.lit(True).alias("tail"))
    return rows.withColumn("tail", F.lit(False)).unionByName(tails).repartition("part").sortWithinPartitions("part", "tail", F.desc("ord"), F.desc("mark"), F.desc("text"))


def edit_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's."""

    def work(group: list[tuple[int | None, str, str]], own: tuple[np.ndarray, np.ndarray], nxt: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for _, x, y in group]
        made = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in group], pa.int64()),
                pa.array([len(g[1]) for g in group], pa.int64()),
                pa.array([hashlib.sha256(e.encode(errors="surrogatepass")).hexdigest() for e in edited]),
                pa.array(pack(*own)),
                pa.array(pack(*made)),
                pa.array(likeness(own, made)),
                pa.array(likeness(own, nxt)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        carried: list = []  # the last row, until the one after it is here: id, text, part, tail, and its vectors
        for batch, texts in common.blocks(batches, "text", 1_000_000):
            ids, parts, tails = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "part", "tail"))
            rows = [*(c[:4] for c in carried), *zip(ids, texts, parts, tails, strict=True)]
            wide, like = fingerprints(texts)
            if carried:
                wide, like = np.vstack((carried[0][4], wide)), np.vstack((carried[0][5], like))
            at = [k for k in range(len(rows) - 1) if not rows[k][3] and rows[k][2] == rows[k + 1][2]]
            if at:
                k = np.array(at)
                yield work([(rows[i][0], rows[i][1], rows[i + 1][1]) for i in at], (wide[k], like[k]), (wide[k + 1], like[k + 1]))
            carried = [(*rows[-1], wide[-1:], like[-1:])]

    return in_parts(df, doc_id, text).select("doc_id", "text", "part", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark, sf_dir):
    return edit_digests(common.table(spark, sf_dir, "documents"))
