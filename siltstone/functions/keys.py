"""Typed values as binary keys whose unsigned byte order is the values' order.

All are Column expressions that stay in the JVM, but for the two float codecs: SQL has no
bit view of a float, so they are vectorised over Arrow.

Parts of a composite key are joined by one zero byte. Encodings of integers may hold zero
bytes themselves, so composite keys order well but can't be taken apart again. A null
part is one zero byte. -0.0 is encoded as 0.0, so that equal floats have equal keys.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR, LAST = b"\x00", b"\xff"
SIGN = -(2**63)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def string_key(x: Column | str) -> Column:
    return F.encode(_c(x), "UTF-8")


def bytes_key(x: Column | str) -> Column:
    return _c(x)


def uuid_key(x: Column | str) -> Column:
    """16 bytes in network order; an error if the text is no UUID."""
    plain = F.replace(_c(x), F.lit("-"), F.lit(""))
    ok = plain.isNull() | plain.rlike("^[0-9a-fA-F]{32}$")
    return F.when(ok, F.unhex(plain)).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), _c(x))).cast("binary"))


def i64_key(x: Column | str) -> Column:
    """Any signed integer: 64 bits, sign bit flipped, big-endian."""
    return F.unhex(F.lpad(F.hex(_c(x).cast("long").bitwiseXOR(F.lit(SIGN))), 16, "0"))


def u64_key(x: Column | str) -> Column:
    """An unsigned integer held in a long, big-endian."""
    return F.unhex(F.lpad(F.hex(_c(x).cast("long")), 16, "0"))


def u8_key(x: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(_c(x).cast("long").bitwiseAND(F.lit(255))), 2, "0"))


def bool_key(x: Column | str) -> Column:
    c = _c(x).cast("boolean")
    return F.when(c, F.lit(b"\x01")).when(~c, F.lit(b"\x00"))


def timestamp_key(x: Column | str) -> Column:
    """Nanoseconds since 1970 in UTC, like an integer."""
    return i64_key(F.unix_micros(_c(x).cast("timestamp")) * 1000)


def interval_key(x: Column | str) -> Column:
    """A day-time interval in ticks of 100 ns, like an integer."""
    return i64_key(F.unix_micros(F.timestamp_seconds(F.lit(0)) + _c(x)) * 10)


def _ordered_bits(v: np.ndarray, bits: str, sign: int, nan: int) -> np.ndarray:
    raw = (v + 0.0).view(bits)  # turns -0.0 into 0.0
    out = np.where(v < 0, ~raw, raw | np.array(sign, dtype=bits))
    return np.where(np.isnan(v), np.array(nan, dtype=bits), out).astype(f">{bits}")


def _float_udf(kind: str, bits: str, sign: int, nan: int):
    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        missing = x.isna().to_numpy()
        raw = _ordered_bits(np.where(missing, 0, x.to_numpy(dtype=kind, na_value=0)).astype(kind), bits, sign, nan).tobytes()
        n = len(raw) // max(1, len(x))
        return pd.Series([None if gone else raw[i * n : (i + 1) * n] for i, gone in enumerate(missing)], dtype=object)

    return encode


def float_key(x: Column | str) -> Column:
    """4 bytes; NaN sorts as one fixed value."""
    c = _c(x).cast("float")
    coded = _float_udf("f4", "u4", 1 << 31, 0x7FC00001)(F.when(~F.isnan(c), c))
    return F.when(F.isnan(c), F.lit(bytes.fromhex("7fc00001"))).otherwise(coded)


def double_key(x: Column | str) -> Column:
    """8 bytes; NaN sorts as one fixed value."""
    c = _c(x).cast("double")
    coded = _float_udf("f8", "u8", 1 << 63, 0x7FF8000000000001)(F.when(~F.isnan(c), c))
    return F.when(F.isnan(c), F.lit(bytes.fromhex("7ff8000000000001"))).otherwise(coded)


def part(x: Column) -> Column:
    """A part of a composite key: null becomes one zero byte."""
    return F.coalesce(x, F.lit(SEPARATOR))


def tuple_key(*parts: Column) -> Column:
    """Encoded parts joined by zero bytes; at least one."""
    if not parts:
        raise ValueError("a key needs at least one part")
    out: list[Column] = [part(parts[0])]
    for p in parts[1:]:
        out += [F.lit(SEPARATOR), part(p)]
    return F.concat(*out)


def first_key(prefix: Column) -> Column:
    """Lower bound of the keys below a prefix."""
    return F.concat(prefix, F.lit(SEPARATOR))


def last_key(prefix: Column) -> Column:
    """Upper bound (exclusive) of the keys below a prefix, and of keys that begin with its bytes."""
    return F.concat(prefix, F.lit(LAST))


def to_hex(key: Column | str) -> Column:
    return F.lower(F.hex(_c(key)))


def from_hex(text: Column | str) -> Column:
    """Bytes of a hex string; an error for odd lengths and other characters."""
    x = _c(text)
    ok = x.isNull() | x.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(ok, F.unhex(x)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), x)).cast("binary"))


def is_empty(key: Column | str) -> Column:
    return F.octet_length(_c(key)) == 0


def fnv1a(key: Column | str) -> Column:
    """FNV-1a of 32 bits, as a long."""
    digits = F.hex(_c(key))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    index = F.when(F.octet_length(_c(key)) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.octet_length(_c(key)) - 1))
    return F.aggregate(index, F.lit(2166136261).cast("long"), step)


def encode(*parts) -> bytes:
    """The same encoding for Python values on the driver (bounds of scans, keys of lookups)."""
    if not parts:
        raise ValueError("a key needs at least one part")
    return SEPARATOR.join(_encode(p) for p in parts)


def encode_first(*parts) -> bytes:
    return encode(*parts) + SEPARATOR


def encode_last(*parts) -> bytes:
    return encode(*parts) + LAST


def _encode(p) -> bytes:
    if p is None:
        return SEPARATOR
    if isinstance(p, bool):
        return b"\x01" if p else b"\x00"
    if isinstance(p, int):
        return (p + 2**63).to_bytes(8, "big")
    if isinstance(p, float):
        return _ordered_bits(np.array([p]), "u8", 1 << 63, 0x7FF8000000000001).tobytes()
    if isinstance(p, str):
        return p.encode()
    if isinstance(p, (bytes, bytearray)):
        return bytes(p)
    if isinstance(p, uuid.UUID):
        return p.bytes
    if isinstance(p, dt.datetime):
        when = p if p.tzinfo else p.replace(tzinfo=dt.timezone.utc)
        gone = when - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return _encode((gone // dt.timedelta(microseconds=1)) * 1000)
    if isinstance(p, dt.timedelta):
        return _encode((p // dt.timedelta(microseconds=1)) * 10)
    raise ValueError(f"no key encoding for {type(p).__name__}")


def encode_float32(x: float) -> bytes:
    return _ordered_bits(np.array([x], dtype="f4"), "u4", 1 << 31, 0x7FC00001).tobytes()


def encode_unsigned(x: int, size: int = 8) -> bytes:
    return struct.pack(">Q", x)[8 - size :]
