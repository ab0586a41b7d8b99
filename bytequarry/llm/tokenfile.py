"""Token ids in binary files: Simple-8b words with escapes and per-block offsets.

Documents are dealt by ascending id into parts, and a part's rows are encoded in order and written as blocks of many
documents. A block (little-endian) is:

    magic "S8B1", u32 documents, u32 ids, u32 words, u32 escapes,
    i64 document ids, u32 ids per document (the block's offsets), u64 words, u32 escapes

A word's upper 4 bits select how many ids of how many bits its lower 60 bits hold. An id that is all ones in its width
stands for the next escape; ids of 2**20 - 1 and more are always escapes. A block is decoded selector by selector with array
operations, as the selectors alone give every word's place.

The files are a Parquet table (part, first, payload), so that any store Spark knows can hold them. Token ids come from
the tokenizers library, which encodes each distinct chunk between spaces once and remembers it.

Defined cases: a null text counts as empty and has the end id only; rows with the same id are ordered by the hash of their
text, then the text; an empty table has no blocks; a null id sorts first and is written as the smallest long, and read back
as null; further columns are left out. A very long text is encoded as a whole, which takes about 30 bytes of memory per byte.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"S8B1"
#: Ids per word and bits per id, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)
TOO_LARGE = (1 << 20) - 1
#: Of each id below TOO_LARGE, the bits for which it isn't all ones; 0 for TOO_LARGE, as an escape fits in any width.
WIDTHS = np.append(np.repeat(np.arange(1, 21, dtype=np.uint8), [1, *(1 << k for k in range(1, 20))]), np.uint8(0))
NO_ID = -(2**63)
BLOCK_IDS = 262_144
BLOCK_CHARS = 4_000_000
#: Chunks remembered by a worker, if its last block has no more; those unused for longest go first.
MOST_WORDS = 400_000
#: Chunks are encoded in strings of so many.
JOINED = 500
#: Chunks that are encoded by themselves: no white space but one line feed in front.
PLAIN = re.compile(r"\n?\S+").fullmatch
#: Marks that end a word's pre-token and are one pre-token together; an apostrophe may begin a contraction.
MARKS = '.,;:!?"()[]{}<>#$%&*+-/=@^_|~'


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and escapes (uint32) of ids (uint32)."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    large = ids >= TOO_LARGE
    value = ids.astype(np.uint64)
    need = WIDTHS[np.minimum(ids, TOO_LARGE)]
    padded = np.concatenate((need, np.zeros(max(COUNTS), np.uint8)))
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    top, width = padded, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        k, bits = COUNTS[s], BITS[s]
        while width < k:
            step = min(width, k - width)
            top = np.maximum(top[:-step], top[step:])
            width += step
        fits = top[:n] <= bits
        if not fits.any():
            break
        choice[fits] = s
    counts = np.array(COUNTS)[choice].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += counts[i]
    start = np.array(at)
    chosen = choice[start]
    words = np.zeros(len(start), np.uint64)
    value = np.concatenate((value, np.zeros(max(COUNTS), np.uint64)))
    escape = np.concatenate((large, np.zeros(max(COUNTS), bool)))
    for s in np.unique(chosen).tolist():
        k, bits = COUNTS[s], BITS[s]
        mine = np.flatnonzero(chosen == s)
        cell = start[mine][:, None] + np.arange(k)
        v = np.where(escape[cell], np.uint64((1 << bits) - 1), value[cell])
        words[mine] = np.bitwise_or.reduce(v << (np.arange(k, dtype=np.uint64) * np.uint64(bits)), axis=1) | np.uint64(s << 60)
    return words, ids[large].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint32) of words and escapes."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen] if len(words) else np.empty(0, np.int64)
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    escaped = np.zeros(len(out), bool)
    for s in np.unique(chosen).tolist():
        k, bits = COUNTS[s], BITS[s]
        mine = np.flatnonzero(chosen == s)
        ones = np.uint64((1 << bits) - 1)
        v = (words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(bits))) & ones
        cell = start[mine][:, None] + np.arange(k)
        out[cell] = v
        escaped[cell] = v == ones
    out = out[:n]
    out[escaped[:n]] = escapes
    return out


def write_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(escapes)], "<u4")
    return b"".join((MAGIC, head.tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()))


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, words, escapes = np.frombuffer(payload, "<u4", 4, 4).tolist()
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u4", docs, at := at + 8 * docs)
    w = np.frombuffer(payload, "<u8", words, at := at + 4 * docs)
    return doc_ids, lengths, unpack(w, np.frombuffer(payload, "<u4", escapes, at + 8 * words), n)


class ByteBPE:
    """Ids of whole texts by the tokenizers library, each distinct word between single spaces encoded once.

    Between a character that isn't white space, one space or line feed, and another such character, the library's
    pre-tokens always end; so chunks can be encoded by themselves. Of letters followed by marks both are pre-tokens, so
    'word', 'word,' and 'word."' share the word's ids. The library gets many chunks in one string, as a call or a result for
    each costs more than the chunk: only a chunk's first token begins with the space (or is the line feed) before it, which
    tells where its ids begin. Texts with other white space go to the library whole.

    Chunks and their ids are remembered as Arrow arrays, those of the last block first: a block's chunks are looked up all at
    once, and only the new ones become Python strings.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        space, feed = (self._library([c])[0] for c in (" ", "\n"))
        self.feed = feed
        names = {i: t for t, i in vocabulary.items()}
        self.begins = {c: np.zeros(max(names) + 1, bool) for c in " \n"}
        for c, mark in ((" ", space), ("\n", feed)):
            if len(mark) == 4 and (own := names[int.from_bytes(mark, "little")]):
                self.begins[c][[i for i, t in names.items() if t.startswith(own)]] = True
        #: Chunks and their ids; null where a text with such a chunk has to be encoded whole.
        self.known, self.coded = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.marks: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array("I", e.ids).tobytes() for e in fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> pa.Array:
        """The ids of each word with `before` in front of it, the words being free of white space."""
        out = [pa.array([], pa.large_binary())]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for own, ids in zip(groups, self._library([before + before.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.begins[before][np.frombuffer(ids, "<u4")]) * 4
            if len(at) == len(own) and not at[0]:
                out.append(pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.append(at, len(ids))), pa.py_buffer(ids)]))
            else:  # a vocabulary whose tokens don't tell
                out.append(pa.array(self._library([before + w for w in own]), pa.large_binary()))
        return pa.concat_arrays(out)

    def learn(self, chunks: list[str]) -> pa.Array:
        """The ids of a space and the chunk, or of a chunk that begins with a line feed; null for other white space."""
        words: dict[str, list[str]] = {" ": [], "\n": []}
        places: dict[str, list[int]] = {" ": [], "\n": []}
        for k, c in enumerate(chunks):
            if c.isalpha() or PLAIN(c):
                before = "\n" if c[0] == "\n" else " "
                words[before].append(c[1:] if before == "\n" else c)
                places[before].append(k)
        at = np.full(len(chunks), -1, np.int64)
        at[places[" "] + places["\n"]] = np.arange(len(places[" "]) + len(places["\n"]))
        return pa.concat_arrays([self._joined(own, before) for before, own in words.items()]).take(pa.array(at, mask=at < 0))

    def _ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks; null where a text with such a chunk has to be encoded whole."""
        place = pc.index_in(chunks, value_set=self.known)
        new = place.is_null()
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.known) + np.arange(len(fresh))
        ids = pa.concat_arrays([self.coded, self.learn(chunks.filter(new).to_pylist())]).take(pa.array(at))
        unused = np.ones(len(self.known) + len(fresh), bool)
        unused[at] = False
        rest = np.flatnonzero(unused)[: max(0, MOST_WORDS - len(chunks))]
        self.known, self.coded = pa.concat_arrays([chunks, self.known.take(rest)]), pa.concat_arrays([ids, self.coded.take(rest)])
        return ids

    def _parted(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks, those of letters and marks from both parts; null as _ids has it."""
        words = pc.utf8_rtrim(chunks, characters=MARKS)
        lettered = pc.utf8_is_alpha(pc.utf8_ltrim(words, characters="\n")).to_numpy(zero_copy_only=False)
        _, ends, body = chunks.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(chunks) + 1]
        cut = np.where(lettered, ends[:-1] + pc.binary_length(words).to_numpy(), ends[1:])
        both = pa.Array.from_buffers(pa.large_string(), 2 * len(chunks), [None, pa.py_buffer(np.append(np.stack((ends[:-1], cut), axis=1).ravel(), ends[-1])), body])
        words, marks = (both.take(pa.array(np.arange(k, len(both), 2))).dictionary_encode() for k in (0, 1))
        if len(self.marks) > MOST_WORDS // 10:
            self.marks.clear()
        ends = marks.dictionary.to_pylist()
        new = [m for m in ends if m not in self.marks]
        self.marks.update(zip(new, self._library(new), strict=True))
        marks = pa.array([self.marks[m] for m in ends], pa.large_binary()).take(marks.indices)
        return pc.binary_join_element_wise(self._ids(words.dictionary).take(words.indices), marks, pa.scalar(b"", pa.large_binary()))

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text. Each distinct chunk of the block is looked up once."""
        if not texts:
            return []
        whole = np.array([any(s in x for s in self.special) for x in texts])
        led = pa.array([("\n" + x).replace("\n", " \n") for x in texts], pa.large_string())
        rows = pc.split_pattern(led, " ")  # the first of each row is empty, as the text begins with " \n" now
        offsets = rows.offsets.to_numpy()
        coded = rows.values.dictionary_encode()
        made = self._parted(coded.dictionary).take(coded.indices)
        unknown = made.is_null().to_numpy(zero_copy_only=False).copy()
        unknown[offsets[:-1]] = False
        whole |= np.logical_or.reduceat(unknown, offsets[:-1])
        _, ends, body = made.buffers()
        ends = np.frombuffer(ends, np.int64)[offsets].tolist()
        body, skip = memoryview(body or b""), len(self.feed)
        out = [bytes(body[s + skip : e]) if x else b"" for x, s, e in zip(texts, ends, ends[1:], strict=False)]
        whole = np.flatnonzero(whole & np.array([bool(x) for x in texts])).tolist()
        for k, x in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = x
        return out


_encoders: dict[str, ByteBPE] = {}


def byte_encoder(path: str) -> ByteBPE:
    common.hold("tokenfile", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(df: DataFrame, to: str, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the whole texts of df and write their ids, each document followed by end_id, in ascending order of doc_id."""
    from .fingerprint import parted

    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, first, held, ids, lengths = None, 0, 0, [], []
        body: list[bytes] = []

        def block():
            made = write_block(ids, lengths, np.frombuffer(b"".join(body), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([made], pa.binary())], names=["part", "first", "n_ids", "payload"])

        with common.steady():
            for batch, texts in common.blocks(batches, "text", BLOCK_CHARS):
                orders, parts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ord", "part"))
                for o, p, x in zip(orders, parts, byte_encoder(path).encode_block(texts), strict=True):
                    if held and (p != part or held >= BLOCK_IDS):
                        yield block()
                        first, held, ids, lengths, body = first + held, 0, [], [], []
                    if p != part:
                        part, first = p, 0
                    ids.append(o)
                    lengths.append(len(x) // 4 + 1)
                    body += (x, end)
                    held += lengths[-1]
            if held:
                yield block()

    rows = parted(df, doc_id, text).repartition("part").sortWithinPartitions("part", "ord", "mark", "text").select("ord", "part", "text")
    rows.mapInArrow(run, "part int, first long, n_ids long, payload binary").write.option("compression", "zstd").parquet(to)


def read(spark, at: str) -> DataFrame:
    """doc_id, start and ids of every document in the files."""
    return _decoded(spark, at, "ids array<int>", lambda ids: ids.view(np.int32).tolist(), pa.list_(pa.int32()))


def _decoded(spark, at: str, column: str, value, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.parquet(at)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part: bounded, see fingerprint.MOST_PARTS
    before, sums = 0, {}
    for r in totals:
        sums[r["part"]] = before
        before += r["n"]

    def run(batches):
        for batch in batches:
            for part, first, payload in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "first", "payload")), strict=True):
                doc_ids, lengths, ids = read_block(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == NO_ID else d for d in doc_ids.tolist()], pa.int64()), pa.array(starts + (sums[part] + first), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array([value(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return blocks.select("part", "first", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def digests(spark, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    return _decoded(spark, at, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def op4_token_ids(spark, sf_dir):
    to = common.scratch_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents"), to)
    return digests(spark, to)
