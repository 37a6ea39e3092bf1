"""Payload codecs. JSON is native; MessagePack and the varint codec of struct-like payloads go through Arrow batches."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack_msgpack(data: bytes):
    """Decode one MessagePack value (public specification; extension types come back as bytes)."""
    value, end = _msgpack(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _msgpack(b: bytes, i: int):
    t = b[i]
    i += 1
    if t <= 0x7F or t >= 0xE0:
        return (t if t <= 0x7F else t - 256), i
    if 0x80 <= t <= 0x8F:
        return _items(b, i, t & 15, True)
    if 0x90 <= t <= 0x9F:
        return _items(b, i, t & 15, False)
    if 0xA0 <= t <= 0xBF:
        return b[i : i + (t & 31)].decode(), i + (t & 31)
    if t in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[t], i
    if t in (0xCA, 0xCB):
        n = 4 if t == 0xCA else 8
        return struct.unpack(">f" if n == 4 else ">d", b[i : i + n])[0], i + n
    if 0xCC <= t <= 0xD3:
        n = 1 << ((t - 0xCC) % 4)
        return int.from_bytes(b[i : i + n], "big", signed=t >= 0xD0), i + n
    if 0xD4 <= t <= 0xD8:
        n = 1 << (t - 0xD4)
        return b[i + 1 : i + 1 + n], i + 1 + n
    kinds = {0xC4: (1, "bin"), 0xC5: (2, "bin"), 0xC6: (4, "bin"), 0xC7: (1, "ext"), 0xC8: (2, "ext"), 0xC9: (4, "ext"), 0xD9: (1, "str"), 0xDA: (2, "str"), 0xDB: (4, "str"), 0xDC: (2, "list"), 0xDD: (4, "list"), 0xDE: (2, "map"), 0xDF: (4, "map")}
    size, kind = kinds[t]
    n = int.from_bytes(b[i : i + size], "big")
    i += size
    if kind in ("list", "map"):
        return _items(b, i, n, kind == "map")
    if kind == "ext":
        return b[i + 1 : i + 1 + n], i + 1 + n
    if len(b) < i + n:
        raise ValueError("cut off")
    return (b[i : i + n].decode() if kind == "str" else b[i : i + n]), i + n


def _items(b: bytes, i: int, n: int, pairs: bool):
    out = []
    for _ in range(n * (1 + pairs)):
        v, i = _msgpack(b, i)
        out.append(v)
    return (dict(zip(out[::2], out[1::2], strict=True)) if pairs else out), i


def pack_msgpack(v) -> bytes:
    """Encode None, booleans, numbers, strings, bytes, lists and dicts in their shortest form."""
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if 0 <= v <= 0x7F or -32 <= v < 0:
            return struct.pack("b" if v < 0 else "B", v)
        for code, kind, low, high in ((0xCC, "B", 0, 255), (0xCD, ">H", 0, 65535), (0xCE, ">I", 0, 2**32 - 1), (0xCF, ">Q", 0, 2**64 - 1), (0xD0, "b", -128, 0), (0xD1, ">h", -32768, 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if low <= v <= high:
                return bytes([code]) + struct.pack(kind, v)
        raise ValueError("integer out of range")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, (str, bytes)):
        raw = v.encode() if isinstance(v, str) else v
        heads = (((0xD9, "B"), (0xDA, ">H"), (0xDB, ">I")) if isinstance(v, str) else ((0xC4, "B"), (0xC5, ">H"), (0xC6, ">I")))
        if isinstance(v, str) and len(raw) < 32:
            return bytes([0xA0 | len(raw)]) + raw
        code, kind = heads[(len(raw) > 255) + (len(raw) > 65535)]
        return bytes([code]) + struct.pack(kind, len(raw)) + raw
    items = [x for p in v.items() for x in p] if isinstance(v, dict) else list(v)
    n, short, wide = len(v), (0x80 if isinstance(v, dict) else 0x90), (0xDE if isinstance(v, dict) else 0xDC)
    head = bytes([short | n]) if n < 16 else bytes([wide]) + struct.pack(">H", n) if n < 65536 else bytes([wide + 1]) + struct.pack(">I", n)
    return head + b"".join(map(pack_msgpack, items))


def unpack_varint_record(data: bytes, fields: list[tuple[str, str]]) -> dict:
    """Decode a record of (name, kind) fields without field tags: u64, i64 (zigzag), f64, bool and string, numbers as varints."""
    out, i = {}, 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            byte = data[i]
            i += 1
            n |= (byte & 0x7F) << shift
            if byte < 0x80:
                return n
            shift += 7

    for name, kind in fields:
        if kind == "u64":
            out[name] = varint()
        elif kind == "i64":
            z = varint()
            out[name] = (z >> 1) ^ -(z & 1)
        elif kind == "f64":
            out[name] = struct.unpack("<d", data[i : i + 8])[0]
            i += 8
        elif kind == "bool":
            out[name] = bool(data[i])
            i += 1
        elif kind == "string":
            n = varint()
            out[name] = data[i : i + n].decode()
            i += n
        else:
            raise ValueError(f"unknown kind {kind!r}")
    return out


def pack_varint_record(row: dict, fields: list[tuple[str, str]]) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out) + bytes([n])

    parts = []
    for name, kind in fields:
        v = row[name]
        if kind == "u64":
            parts.append(varint(v))
        elif kind == "i64":
            parts.append(varint((v << 1) ^ (v >> 63)))
        elif kind == "f64":
            parts.append(struct.pack("<d", v))
        elif kind == "bool":
            parts.append(bytes([bool(v)]))
        else:
            parts.append(varint(len(v.encode())) + v.encode())
    return b"".join(parts)


def to_json_text(payload: Column, codec: str, fields: list[tuple[str, str]] | None = None) -> Column:
    """A binary payload as JSON text; null where it can't be decoded."""
    if codec == "json":
        return F.to_json(F.try_parse_json(F.try_validate_utf8(payload.cast("string"))))
    decode = unpack_msgpack if codec == "msgpack" else lambda b: unpack_varint_record(b, fields or [])

    def one(b) -> str | None:
        try:
            return None if b is None else json.dumps(decode(bytes(b)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, IndexError, KeyError, TypeError, struct.error):
            return None

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(one)

    return run(payload)
