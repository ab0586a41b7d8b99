"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a block are laid out as one linked sequence of symbols. An index maps every adjacent pair to all its
positions. A heap holds the ranks that occur; the lowest is applied to all its positions at once, which unlinks the
right-hand symbols and adds the new pairs to the lists of their own ranks. As words are independent and the lowest
rank of all words is the lowest of each word that holds it, this equals merging word by word. Where a merge could make
a pair of a lower rank than its own (a symbol that several merges produce), only the leftmost position of each word is
merged before the heap is asked again, so that case is exact as well.

Each distinct word of a block is looked up once, by a dictionary encoding, and those that occurred before aren't merged
again. Decoding takes the ids of whole texts and spells each.

Defined cases: a null text counts as empty; an empty text has no tokens and the digests of the empty string; the strings of
special tokens become those tokens; lone surrogates can't occur in Spark; repeated rows get the same result; a row without
id is kept; an empty table has no rows; further columns are left out, whatever their names. A very long text is encoded as
a whole, which takes about 40 bytes of memory per byte.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common

#: Words remembered by a worker, in two generations; those not used since the younger one began go first.
MOST_WORDS = 300_000


#: Marks that are neither letters, digits, white space nor an apostrophe: at a chunk's end they are one pre-token.
MARKS = '.,;:!?"()[]{}<>#$%&*+-/=@^_|~'
#: White space for Python's split() but not for the library.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of a word-level BPE file of the tokenizers library (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.name = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name |= {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = self.n = max(self.name) + 1
        self.rank: dict[int, int] = {}
        made = np.full(len(merges), -1, np.int64)
        for r, (a, b) in enumerate(merges):
            self.rank[self.vocab[a] * n + self.vocab[b]] = r
            made[r] = self.vocab[a + b]
        self.left = np.array([self.vocab[a] for a, _ in merges])
        self.right = np.array([self.vocab[b] for _, b in merges])
        self.made = made
        first = np.full(n, len(merges))
        for side in (self.left, self.right):
            np.minimum.at(first, side, np.arange(len(merges)))
        #: Ranks after which a lower rank may come up.
        self.falls = first[made] < np.arange(len(merges))
        codes = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab.get(c, -1) for c in alphabet])
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in alphabet])
        self.split = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Of each id, its decimal digits and its token.
        self.digits = pa.array([str(i) for i in range(n)])
        self.spelled = pa.array([self.name.get(i) for i in range(n)], pa.string())
        #: Of each word, its ids as int32.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (b >= 0), self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, given as the UTF-8 bytes of a pre-token."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        total = len(raw)
        ends = np.cumsum(size)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        nxt, prv = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions."""
            at = at[nxt[at] >= 0]
            r = self.ranks_of(sym[at], sym[nxt[at]])
            ok = r >= 0
            r, at = r[ok], at[ok]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, at = r[order], at[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)

        add(np.arange(total, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, c = self.left[r], self.right[r], self.made[r]
            follow = nxt[at]
            at = at[(sym[at] == a) & (follow >= 0) & (sym[follow] == b)]
            if not len(at):
                continue
            if self.falls[r] or a == b:
                at = np.unique(at)
                one = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                if not one.all():
                    index[r] = [at[~one]]
                    heapq.heappush(heap, r)
                    at = at[one]
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            sym[at] = c
            sym[gone] = -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            add(np.concatenate((at, before[before >= 0])))
        live = sym != -1
        ids, owner = sym[live].tolist(), word[live]
        stop = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [ids[s:e] for s, e in zip([0, *stop], stop, strict=False)]

    @staticmethod
    def normalized(text: str) -> str:
        """NFC and lower case of each character by itself, so that a sigma at a word's end is no exception."""
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a normalized chunk without white space."""
        core = chunk.rstrip(MARKS)
        if core.isalpha():
            return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
        return self.split.findall(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks of text without white space that aren't known yet."""
        if not chunks:
            return
        parts = list(map(self.pieces, self.normalized(" ".join(chunks)).split(" ")))
        words = list(set(chain.from_iterable(parts)))
        coded = {w: array("i", ids).tobytes() for w, ids in zip(words, self.merge([w.encode() for w in words]), strict=True)}
        self.known.update((x, coded[p[0]] if len(p) == 1 else b"".join([coded[w] for w in p])) for x, p in zip(chunks, parts, strict=True))

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.known) > MOST_WORDS // 2:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for c in chunks:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                elif c in self.special:
                    known[c] = array("i", [self.special[c]]).tobytes()
                else:
                    new.append(c)
        self.learn(new)
        return [known[c] for c in chunks]

    def _split(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.special):
            row = [[p] if p in self.special else regex.split(r"\s+", p) for p in self.cut.split(text)]
            return [c for p in row for c in p if c]
        if any(c in text for c in NOT_SPACE):
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (int32), and where each text's begin, with the end of the last."""
        rows = list(map(self._split, texts))
        coded = pa.array(list(chain.from_iterable(rows)), pa.large_string()).dictionary_encode()
        ids = pa.array(self._lookup(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, ends, body = ids.buffers()
        starts = np.frombuffer(ends, np.int64)[np.cumsum([0, *map(len, rows)])] // 4 if len(ids) else np.zeros(len(texts) + 1, np.int64)
        return np.frombuffer(body, np.int32)[: int(starts[-1])] if body else np.empty(0, np.int32), starts

    def _joined(self, names: pa.Array, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The names of each text's ids, joined by spaces; ids without a name are left out."""
        got = names.take(pa.array(ids))
        if got.null_count:
            there = got.is_valid().to_numpy(zero_copy_only=False)
            starts, got = np.concatenate(([0], np.cumsum(there)))[starts], got.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), got), " ").to_pylist()

    def decode_block(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """As the library decodes without a decoder: the tokens joined by spaces."""
        return self._joined(self.spelled, ids, starts)

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids; unknown ids are left out."""
        known = np.array([i for i in ids if 0 <= i < self.n], np.int32)
        return self.decode_block(known, np.array([0, len(known)]))[0]

    def encode_block(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text: tokens, decimal ids joined by a space, and the text decoded from the ids, both in bytes."""
        ids, starts = self.ids_of(texts)
        told, decoded = self._joined(self.digits, ids, starts), self.decode_block(ids, starts)
        return [(n, x.encode(), y.encode()) for n, x, y in zip(np.diff(starts).tolist(), told, decoded, strict=True)]


_encoders: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    common.hold("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordBPE(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each whole document."""
    path = path or default_path()

    def work(texts: list[str]) -> dict[str, object]:
        ids, starts = encoder(path).ids_of(texts)
        return {"ids": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), "decoded": encoder(path).decode_block(ids, starts)}

    return common.map_blocks(df, "ids array<int>, decoded string", work, doc_id, text)


def encode_digests(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    path = path or default_path()

    def work(texts: list[str]) -> dict[str, object]:
        rows = encoder(path).encode_block(texts)
        return {"n_tokens": [n for n, _, _ in rows], "ids_sha256": [hashlib.sha256(x).hexdigest() for _, x, _ in rows], "decoded_sha256": [hashlib.sha256(x).hexdigest() for _, _, x in rows]}

    return common.map_blocks(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", work, doc_id, text)


def op2_bpe(spark, sf_dir):
    return encode_digests(common.table(spark, sf_dir, "documents"))
