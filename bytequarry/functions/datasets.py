"""Inputs of the chunker comparison: random bytes, structured logs, edits in place and a shift."""

from __future__ import annotations

import numpy as np

#: Sizes and places of the published comparison.
SEED, BYTES, EDIT, PREFIX = 1337, 8 << 20, 4096, 43_008
LEVELS, SERVICES, REGIONS = ("INFO", "WARN", "DEBUG", "ERROR"), ("ingest", "verify", "snapshot", "restore"), ("us-east", "eu-west", "ap-south")


def random_bytes(seed: int = SEED, size: int = BYTES) -> bytes:
    """Little-endian 64-bit words of NumPy's PCG64; the published generator's stream can't be reproduced without its tables."""
    words = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, -(-max(0, size) // 8), np.uint64)
    return words.astype("<u8").tobytes()[: max(0, size)]


def logs(seed: int, records: int) -> bytes:
    """Lines like a service's log, with a record number and a random checksum each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    service, region, check = rng.integers(0, 4, records), rng.integers(0, 3, records), rng.integers(0, 1 << 32, records)
    line = "ts=2026-04-25T{:02d}:{:02d}:{:02d}Z level={} service={} region={} shard={:03d} msg=record-{:06d} checksum={:08x}\n"
    return "".join(line.format(i // 3600 % 24, i // 60 % 60, i % 60, LEVELS[i % 4], SERVICES[(i + int(service[i])) % 4], REGIONS[(i + int(region[i])) % 3], i % 128, i, int(check[i])) for i in range(records)).encode()


def edited(data: bytes, places: tuple[int, ...], width: int = EDIT) -> bytes:
    """data with a window of `width` bytes overwritten at each place that lies in it."""
    out = bytearray(data)
    for k, at in enumerate(places):
        if 0 <= at < len(out):
            new = random_bytes(k + 1, width)[: len(out) - at]
            out[at : at + len(new)] = new
    return bytes(out)


def shifted(data: bytes, prefix: bytes) -> bytes:
    return prefix + data


def pairs(size: int = BYTES) -> dict[str, tuple[bytes, bytes]]:
    """The base and its variant for each metric."""
    base, step = random_bytes(SEED, size), size // 5
    prefix = (b"prefix-block-" * (PREFIX // 13 + 1))[: min(PREFIX, size)]
    return {"reuse-after-small-edit": (base, edited(base, tuple(step * k for k in range(1, 5)))), "reuse-after-shift": (base, shifted(base, prefix))}
