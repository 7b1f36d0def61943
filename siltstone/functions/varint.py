"""LEB128 variable-length integers."""

from __future__ import annotations


def put(x: int) -> bytes:
    if x < 0:
        raise ValueError("varints are unsigned")
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def get(raw: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, next position); ValueError if it is cut off or too long."""
    x = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("the varint is cut off")
        b = raw[at]
        at += 1
        x |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            if x >> bits:
                raise ValueError(f"the varint has more than {bits} bits")
            return x, at
        if shift >= bits + 7:
            raise ValueError(f"the varint has more than {bits} bits")
