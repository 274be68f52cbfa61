"""Byte codecs that no built-in function has, as Arrow-batched UDFs, and their plain forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DecimalType, LongType

#: The Castagnoli polynomial, reflected; FNV-1a's offset basis and prime, 64 bits.
CASTAGNOLI = 0x82F63B78
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte
        for _ in range(8):
            x = (x >> 1) ^ (CASTAGNOLI if x & 1 else 0)
        out.append(x)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x = _CRC[(x ^ b) & 0xFF] ^ (x >> 8)
    return x ^ 0xFFFFFFFF


def fnv1a(data: bytes) -> int:
    x = FNV_BASIS
    for b in data:
        x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return x


def varint(n: int) -> bytes:
    """Seven bits a byte, low ones first, the high bit set on all but the last."""
    if n < 0:
        raise ValueError("varints are unsigned")
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position behind it); ValueError where the bytes end early."""
    n = shift = 0
    while at < len(data):
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return n, at
    raise ValueError("truncated varint")


def fixed64(n: int) -> bytes:
    return n.to_bytes(8, "little")


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def escape_key(key: bytes) -> bytes:
    """Order-preserving: a zero byte becomes 00 FF, the end is 00 00."""
    return key.replace(b"\0", b"\0\xff") + b"\0\0"


def data_key(key: bytes, commit_ts: int) -> bytes:
    """Sorts by key, newest version first."""
    return b"d" + escape_key(key) + (0xFFFFFFFFFFFFFFFF - commit_ts).to_bytes(8, "big")


def read_data_key(raw: bytes) -> tuple[bytes, int]:
    body = raw[1:-8]
    return body[:-2].replace(b"\0\xff", b"\0"), 0xFFFFFFFFFFFFFFFF - int.from_bytes(raw[-8:], "big")


@pandas_udf(LongType())
def crc32c_udf(data: pd.Series) -> pd.Series:
    return data.map(crc32c, na_action="ignore").astype("Int64")


@pandas_udf(DecimalType(20, 0))
def fnv1a_udf(data: pd.Series) -> pd.Series:
    from decimal import Decimal

    return data.map(lambda b: Decimal(fnv1a(b)), na_action="ignore")


@pandas_udf(BinaryType())
def data_key_udf(key: pd.Series, commit_ts: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or ts is None or np.isnan(ts) else data_key(k, int(ts)) for k, ts in zip(key, commit_ts, strict=True)])
