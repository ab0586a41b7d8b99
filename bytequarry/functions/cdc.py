"""Content-defined chunking, both algorithms, vectorised.

The hash shifts left once per byte and nothing moves to lower bits, so its low k bits depend on the last k bytes only and
are computed for all places at once; only the walk over the candidate cuts is sequential.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import V1, V2

CHUNKS = "array<struct<chunk_order: bigint, offset: bigint, size: bigint, chunk_hash: string>>"


@dataclass(frozen=True)
class Profile:
    """Sizes and mask bits. loose_bits is None for the simple algorithm."""

    version: str
    least: int
    middle: int
    most: int
    bits: int
    loose_bits: int | None = None


#: The two published profiles; the scaled ones keep their proportions for small texts.
PROFILES = {V1: Profile(V1, 512 << 10, 0, 2 << 20, 18), V2: Profile(V2, 32 << 10, 64 << 10, 128 << 10, 16, 15)}
SCALED = {V1: Profile(V1, 256, 0, 1024, 9), V2: Profile(V2, 256, 512, 1024, 9, 8)}


def gear() -> np.ndarray:
    """256 values of SplitMix64 from its golden-ratio seed, low 32 bits."""
    out, x, mask = [], 0x9E3779B97F4A7C15, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


GEAR = gear()


def _hashes(data: np.ndarray, bits: int, geared: bool) -> np.ndarray:
    """The low `bits` bits of the rolling hash after each byte, as if it had run for `bits` bytes at least."""
    b = data.astype(np.uint32)
    g = GEAR[data] if geared else None
    h = np.zeros(len(data), np.uint32)
    for back in range(bits - 1, -1, -1):  # from the oldest byte that still matters
        if back >= len(data):
            continue
        shifted = np.zeros_like(h)
        shifted[back:] = b[: len(b) - back]
        new = (h << np.uint32(1)) + shifted
        if geared:
            s = np.zeros_like(h)
            s[back:] = g[: len(g) - back]
            new ^= s
        h = new
    return h & np.uint32((1 << bits) - 1)


def cuts(data: bytes, p: Profile) -> list[int]:
    """The ends of the chunks."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = _hashes(raw, p.bits, p.loose_bits is not None)
    strict = np.flatnonzero(h == 0) + 1
    loose = strict if p.loose_bits is None else np.flatnonzero((h & np.uint32((1 << p.loose_bits) - 1)) == 0) + 1
    out, at = [], 0

    def first(marks: np.ndarray, low: int, high: int) -> int | None:
        k = np.searchsorted(marks, low)
        return int(marks[k]) if k < len(marks) and marks[k] <= high else None

    while at < n:
        if p.loose_bits is None:
            end = first(strict, at + p.least, at + p.most)
        else:
            end = first(strict, at + p.least, at + p.middle - 1) or first(loose, at + p.middle, at + p.most)
        at = min(end or at + p.most, n)
        out.append(at)
    return out


def cuts_by_bytes(data: bytes, p: Profile) -> list[int]:
    """The definition, byte by byte; for tests."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + b) & 0xFFFFFFFF
        if p.loose_bits is not None:
            h ^= int(GEAR[b])
        size = i + 1 - start
        bits = p.bits if p.loose_bits is None or size < p.middle else p.loose_bits
        if size >= p.most or size >= p.least and h & ((1 << bits) - 1) == 0:
            out.append(i + 1)
            start, h = i + 1, 0
    return out if start == len(data) else [*out, len(data)]


def chunks_of(data: bytes, p: Profile) -> list[dict[str, object]]:
    ends = cuts(data, p)
    return [{"chunk_order": k, "offset": s, "size": e - s, "chunk_hash": hashlib.sha256(data[s:e]).hexdigest()} for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False))]


def chunked(content: Column, profile: Profile) -> Column:
    """An array of the chunks of a binary column; empty for an empty or null body."""

    @F.pandas_udf(CHUNKS)
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(b or b"", profile) for b in bodies])

    return run(content)


class Registry:
    """Chunkers by version; a version can't be registered twice."""

    def __init__(self, profiles: dict[str, Profile] | None = None, default: str = V1):
        self.profiles = dict(PROFILES if profiles is None else profiles)
        self.default = default

    def register(self, p: Profile) -> None:
        if p.version in self.profiles:
            raise ValueError(f"{p.version} is registered already")
        self.profiles[p.version] = p

    def get(self, version: str | None = None, configured: str | None = None) -> Profile:
        """The override, else the configured version, else the default."""
        wanted = version or configured or self.default
        if wanted not in self.profiles:
            raise ValueError(f"unknown chunker version {wanted}")
        return self.profiles[wanted]
