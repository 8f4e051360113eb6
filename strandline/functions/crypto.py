"""Hashes, checksums and ciphers of columns; AES in counter mode over streams of bytes for files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def sha256(c: Column) -> Column:
    """Standard SHA-256, lower-case hex."""
    return F.sha2(c, 256)


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def encrypt_block(c: Column, key: Column) -> Column:
    """AES on whole blocks (ECB with padding)."""
    return F.aes_encrypt(c.cast("binary"), key, F.lit("ECB"), F.lit("PKCS"))


def decrypt_block(c: Column, key: Column) -> Column:
    return F.aes_decrypt(c, key, F.lit("ECB"), F.lit("PKCS"))


def encrypt(c: Column, key: Column) -> Column:
    """Authenticated counter mode (GCM), the successor of plain counter mode for columns at rest."""
    return F.aes_encrypt(c.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"))


def counter_blocks(nonce: int, first: Column, blocks: Column) -> Column:
    """Counter blocks of 16 bytes (nonce, then the block number), for a seekable key stream."""
    one = lambda i: F.concat(F.lit(nonce.to_bytes(8, "big")), F.unhex(F.lpad(F.hex((first + i).cast("bigint")), 16, "0")))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), one)


def key_stream(key: Column, nonce: int, first: Column, blocks: Column) -> Column:
    """AES counter-mode key stream of ``blocks`` blocks from block ``first``; seeking is choosing ``first``."""
    cipher = lambda block: F.substring(F.hex(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS"))), 1, 32)
    return F.unhex(F.array_join(F.transform(counter_blocks(nonce, first, blocks), cipher), ""))


@F.pandas_udf(T.BinaryType())
def xor_bytes(data: pd.Series, stream: pd.Series) -> pd.Series:
    """Bytes of both combined (Arrow batches; Spark has no such function on binaries); the stream may be longer."""
    mixed = lambda a, b: (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8, len(a))).tobytes() if a is not None else None
    return pd.Series([mixed(a, b) for a, b in zip(data, stream, strict=True)])


def counter_mode(c: Column, key: Column, nonce: int, first: Column | None = None) -> Column:
    """AES in counter mode from block ``first`` (0); the same call encrypts and decrypts, and any block can be the first."""
    data = c.cast("binary")
    blocks = F.greatest(F.ceil(F.length(data) / 16).cast("bigint"), F.lit(1).cast("bigint"))
    return xor_bytes(data, key_stream(key, nonce, F.lit(0).cast("bigint") if first is None else first, blocks))
