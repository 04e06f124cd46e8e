"""Functions on byte strings: separators, checksums, internal keys, variable-length integers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import DELETE, NEWEST, PUT, parse_op

# Fixed values of the checksum: reflected Castagnoli polynomial, and the mask of stored checksums.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
_U32 = 0xFFFFFFFF


def separator(a: bytes, b: bytes) -> bytes:
    """A short s with a <= s < b: the common start and one byte more, raised by one, where there is room."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
    if n is None or a[n] + 1 >= b[n]:
        return a
    return a[:n] + bytes([a[n] + 1])


def key_successor(a: bytes) -> bytes:
    """A short s >= a: up to the first byte that can be raised, raised by one."""
    n = next((i for i, x in enumerate(a) if x != 0xFF), None)
    return a if n is None else a[:n] + bytes([a[n] + 1])


def internal_separator(a: tuple[bytes, int, int], b: tuple[bytes, int, int]) -> tuple[bytes, int, int]:
    """Separator of two internal keys (key, seq, op): a shortened user key gets the newest seq."""
    s = separator(a[0], b[0])
    return (s, NEWEST, PUT) if len(s) < len(a[0]) and s > a[0] else a


def internal_successor(a: tuple[bytes, int, int]) -> tuple[bytes, int, int]:
    s = key_successor(a[0])
    return (s, NEWEST, PUT) if len(s) < len(a[0]) and s > a[0] else a


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


@lru_cache(maxsize=1)
def _crc_list() -> list[int]:
    return _crc_table().tolist()


def crc32c(data: bytes, crc: int = 0) -> int:
    table, c = _crc_list(), crc ^ _U32
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ _U32


#: Byte strings from which a position of all of them is cheaper at once than one string after the other.
_LANES = 32


def crc32c_all(rows: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings: a position at a time over all of them, the last few longest one by one."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(rows) + b"\0", dtype=np.uint8)
    start = (np.cumsum(lengths) - lengths)[order]
    longest = -lengths[order]
    c = np.full(len(rows), _U32, dtype=np.uint32)
    table = _crc_table()
    together = int(-longest[_LANES]) if len(rows) > _LANES else 0
    ends = np.searchsorted(longest, -np.arange(together), side="left")  # rows that have the position
    for i in range(together):
        n = ends[i]
        c[:n] = table[(c[:n] ^ data[start[:n] + i]) & np.uint32(0xFF)] ^ (c[:n] >> np.uint32(8))
    for j in range(min(_LANES, len(rows))):
        c[j] = crc32c(rows[order[j]][together:], int(c[j]) ^ _U32) ^ _U32
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(_U32)
    return out


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17) & _U32) + MASK_DELTA) & _U32


def unmask(masked: int) -> int:
    x = (masked - MASK_DELTA) & _U32
    return ((x >> 17) | (x << 15)) & _U32


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int, bits: int = 64) -> tuple[int, int]:
    """(value, offset behind it); ValueError when it is cut off or too wide."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("integer cut off")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            break
        shift += 7
    if n >> bits:
        raise ValueError("integer too wide")
    return n, at


def prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def read_prefixed(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = read_varint(data, at, 32)
    if at + n > len(data):
        raise ValueError("bytes cut off")
    return bytes(data[at : at + n]), at + n


def encode_internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + seq.to_bytes(8, "little") + bytes([op])


def decode_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 9:
        raise ValueError("internal key is shorter than nine bytes")
    if data[-1] not in (DELETE, PUT):
        raise ValueError(f"unknown operation {data[-1]}")
    return bytes(data[:-9]), int.from_bytes(data[-9:-1], "little"), data[-1]


# Characters that are shown escaped.
ESCAPES = {"\\": "\\\\", '"': '\\"', "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def key_text(key: Column, seq: Column, op: Column) -> Column:
    """``key @ seq : Op`` as logs show an internal key; an unknown operation is an error.

    Bytes that are no UTF-8 become replacement characters; quotes, backslashes and control characters of
    ``ESCAPES`` are escaped.
    """
    text = F.make_valid_utf8(key.cast("string"))
    for plain, shown in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return F.concat(text, F.lit(" @ "), seq.cast("string"), F.lit(" : "), parse_op(op))


def key_bytes(key: Column) -> Column:
    """Approximate size of an internal key."""
    return F.octet_length(key) + 9


def file_number(name: Column) -> Column:
    """Number in the name of a table, log, manifest or temporary file; null for other names."""
    n = F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^(?:(?:wal-|MANIFEST-)?(\d+)\.(?:rdb|parquet|log|manifest|dbtemp))$", 1)
    return F.when(n != "", n).cast("long")


def _on_bytes(f):
    def udf(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*map(bytes, row)) for row in zip(*columns)], dtype=object)

    return udf


def separator_of(a: Column, b: Column) -> Column:
    f = _on_bytes(separator)

    @F.pandas_udf(T.BinaryType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    return udf(a, b)


def successor_of(a: Column) -> Column:
    f = _on_bytes(key_successor)

    @F.pandas_udf(T.BinaryType())
    def udf(a: pd.Series) -> pd.Series:
        return f(a)

    return udf(a)


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    """CRC32C of binary values; null for null."""
    known = data.notna()
    out = pd.Series([None] * len(data), dtype="Int64")
    if known.any():
        out[known.to_numpy()] = crc32c_all([bytes(x) for x in data[known]]).astype(np.int64)
    return out


def masked(crc: Column) -> Column:
    """Stored form of a checksum, within the JVM."""
    low = crc.bitwiseAND((1 << 15) - 1)
    rotated = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(low, 17))
    return (rotated + MASK_DELTA) % (1 << 32)
