"""Block codecs: plain, and AES-256-GCM with the nonce apart."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AES, PLAIN


def load_key(text: str | None = None, variable: str = "BYTEQUARRY_KEY") -> bytes:
    """32 bytes in hex, from the argument or the environment."""
    key = bytes.fromhex(text or os.environ[variable])
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return key


def generate_key() -> str:
    return os.urandom(32).hex()


def parse(name: str | None) -> str:
    name = (name or AES).strip().lower()
    if name not in (PLAIN, AES):
        raise ValueError(f"unknown codec {name}")
    return name


def encoded(body: Column, codec: str, key: bytes | None = None) -> Column:
    """struct(nonce, payload); the payload is the ciphertext and its tag. The nonce follows from the key and the body: a task
    that runs again makes the same bytes, and two bodies don't share a nonce."""
    if parse(codec) == PLAIN:
        return F.struct(F.lit(None).cast("binary").alias("nonce"), body.alias("payload"))
    if key is None:
        raise ValueError("this codec needs a key")
    secret = F.unhex(F.lit(key.hex()))
    nonce = F.substring(F.unhex(F.sha2(F.concat(secret, F.unhex(F.sha2(body, 256))), 256)), 1, 12)
    made = F.aes_encrypt(body, secret, F.lit("GCM"), F.lit("DEFAULT"), nonce)
    return F.transform(F.array(made), lambda x: F.struct(F.substring(x, 1, 12).alias("nonce"), F.substring(x, 13, (1 << 31) - 1).alias("payload")))[0]


def decoded(nonce: Column, payload: Column, codec: Column, key: bytes) -> Column:
    """The body, or null where the payload isn't authentic."""
    return F.when(codec == PLAIN, payload).otherwise(F.try_aes_decrypt(F.concat(nonce, payload), F.unhex(F.lit(key.hex())), F.lit("GCM")))
