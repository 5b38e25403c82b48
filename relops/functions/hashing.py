"""Digests of columns and files, CRC-32C, base64 forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the reflected Castagnoli polynomial.
CRC32C_POLYNOMIAL = 0x82F63B78
_BLOCK = 512


def content_digest(content: Column, algorithm: str = "md5") -> Column:
    """Hex digest of a string or binary column: md5, sha256 or sha512."""

    if algorithm == "md5":
        return F.md5(content)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"unsupported digest: {algorithm}")


def file_digests(spark: SparkSession, path: str | list[str], algorithm: str = "md5") -> DataFrame:
    """Path, length and digest of every file below ``path`` (files up to 2 GiB)."""

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", content_digest(F.col("content"), algorithm).alias("digest"))


def hex_to_base64(text: Column) -> Column:
    return F.base64(F.unhex(text))


def decode_base64url(text: Column) -> Column:
    """Bytes of URL-safe base64 text; an empty payload is an error."""

    # Replaced as bytes, where translate looks up each character.
    decoded = F.unbase64(F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")))
    return F.when(F.length(text) == 0, F.raise_error(F.lit("empty payload")).cast("binary")).otherwise(decoded)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1)
    return table


_TABLE = _crc_table()


def _step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (crc >> 8) ^ _TABLE[(crc ^ byte) & 0xFF]


def _crc32c_rows(values: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: one numpy step per byte position inside a block.

    Rows are cut into blocks of equal length, aligned to the end so only a row's first block is short. All
    blocks advance together from a zero register; a row's blocks are then joined by moving the register past
    the bytes of the next block, which is linear and so a lookup per register byte.
    """

    lengths = np.array([len(v) for v in values], dtype=np.int64)
    blocks = np.maximum(1, -(-lengths // _BLOCK))
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    data = np.zeros((int(blocks.sum()), _BLOCK), dtype=np.uint8)
    flat = data.reshape(-1)
    for value, start, count in zip(values, first, blocks):
        end = (start + count) * _BLOCK
        flat[end - len(value) : end] = np.frombuffer(value, dtype=np.uint8)

    # Leading zero bytes leave a zero register at zero, so padded first blocks need no special case.
    register = np.zeros(len(data), dtype=np.uint32)
    for position in range(_BLOCK):
        register = _step(register, data[:, position])

    skip = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for _ in range(_BLOCK):
        skip = _step(skip, np.uint32(0))

    # The standard start value is all ones: its effect is that register moved past the whole message.
    head = lengths - (blocks - 1) * _BLOCK
    start = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    for position in range(_BLOCK):
        moving = position < head
        if not moving.any():
            break
        start[moving] = _step(start[moving], np.uint32(0))
    crc = start ^ register[first]
    for number in range(1, int(blocks.max(initial=1))):
        rows = np.flatnonzero(blocks > number)
        moved = crc[rows]
        joined = register[first[rows] + number]
        for byte in range(4):
            joined = joined ^ skip[byte][(moved >> (8 * byte)) & 0xFF]
        crc[rows] = joined
    return crc ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(T.BinaryType())
def _crc32c(content: pd.Series) -> pd.Series:
    present = content.dropna()
    out = pd.Series([None] * len(content), index=content.index, dtype=object)
    if len(present):
        crcs = _crc32c_rows([bytes(v) for v in present])
        out[present.index] = [int(c).to_bytes(4, "big") for c in crcs]
    return out


def crc32c_base64(content: Column) -> Column:
    """Big-endian CRC-32C of a string (its UTF-8 bytes) or binary column, as base64 text."""

    return F.base64(_crc32c(content.cast("binary")))
