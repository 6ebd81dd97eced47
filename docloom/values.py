"""Document values in Python: types, equality, the total order, and order-preserving binary keys.

Missing is told apart from null by the MISSING marker. These are the exact semantics; the typed
profile reproduces them with columns, the dynamic profile runs them.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import struct
import time
from datetime import date, datetime, timezone
from typing import Any


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


class ObjectId:
    """Twelve bytes: seconds, five random bytes, a counter."""

    _random, _counter = os.urandom(5), itertools.count(int.from_bytes(os.urandom(3), "big"))

    def __init__(self, value: str | bytes | None = None):
        if value is None:
            value = struct.pack(">I", int(time.time())) + self._random + (next(self._counter) & 0xFFFFFF).to_bytes(3, "big")
        self.binary = bytes.fromhex(value) if isinstance(value, str) else bytes(value)
        if len(self.binary) != 12:
            raise ValueError("an ObjectId has 12 bytes or 24 hexadecimal digits")

    def __str__(self) -> str:
        return self.binary.hex()

    def __repr__(self) -> str:
        return f"ObjectId('{self}')"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ObjectId) and self.binary == other.binary

    def __hash__(self) -> int:
        return hash(self.binary)


#: Fixed values: $type names and numbers.
TYPE_CODES = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10, "regex": 11, "dbPointer": 12,
    "javascript": 13, "symbol": 14, "javascriptWithScope": 15, "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127,
}
NUMBER_CODES = {1, 16, 18, 19}


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def type_code(v: Any) -> int:
    if v is None:
        return 10
    if isinstance(v, bool):
        return 8
    if isinstance(v, (int, float)):
        whole = isinstance(v, int) or (math.isfinite(v) and v == math.floor(v))
        if whole and -(2**31) <= v < 2**31:
            return 16
        return 18 if isinstance(v, int) and abs(v) > 2**53 else 1
    for kind, code in ((str, 2), (dict, 3), (list, 4), (bytes, 5), (ObjectId, 7), (datetime, 9), (date, 9), (re.Pattern, 11)):
        if isinstance(v, kind):
            return code
    raise TypeError(f"not a document value: {type(v).__name__}")


def bracket(v: Any) -> str | None:
    """The kinds of value that range operators compare with each other."""
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (datetime, date)):
        return "date"
    return "objectId" if isinstance(v, ObjectId) else None


def milliseconds(v: date | datetime) -> int:
    if not isinstance(v, datetime):
        v = datetime(v.year, v.month, v.day)
    if v.tzinfo is None:
        v = v.replace(tzinfo=timezone.utc)
    return round(v.timestamp() * 1000)


def equal(a: Any, b: Any) -> bool:
    """1 == 1.0, NaN == NaN, typed otherwise; documents field by field in order."""
    if is_number(a) and is_number(b):
        return a == b or (a != a and b != b)
    if isinstance(a, dict) and isinstance(b, dict):
        return list(a) == list(b) and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, (datetime, date)) and isinstance(b, (datetime, date)):
        return milliseconds(a) == milliseconds(b)
    if a is MISSING or b is MISSING:
        return a is b
    return type(a) is type(b) and a == b


# Ranks of the total order.
EMPTY_ARRAY, NULL, NUMBER, STRING, OBJECT, ARRAY, BINARY, OBJECT_ID, BOOL, DATE = range(10)


def order_key(v: Any) -> bytes:
    """Bytes that compare as the values do: empty array, null and missing, numbers (NaN first), strings by code point, documents
    (per field by type, name, value), arrays, binary (length first), ObjectIds, booleans, dates."""
    if v is MISSING or v is None:
        return bytes([NULL])
    if isinstance(v, bool):
        return bytes([BOOL, v])
    if is_number(v):
        return bytes([NUMBER]) + _number_key(v)
    if isinstance(v, str):
        return bytes([STRING]) + _escaped(v.encode("utf-8", "surrogatepass"))
    if isinstance(v, dict):
        parts = []
        for name, x in v.items():
            key = order_key(x)
            parts.append(b"\x01" + key[:1] + _escaped(name.encode()) + key)
        return bytes([OBJECT]) + b"".join(parts) + b"\x00"
    if isinstance(v, list):
        if not v:
            return bytes([EMPTY_ARRAY])
        return bytes([ARRAY]) + b"".join(b"\x01" + order_key(x) for x in v) + b"\x00"
    if isinstance(v, bytes):
        return bytes([BINARY]) + struct.pack(">Q", len(v)) + v
    if isinstance(v, ObjectId):
        return bytes([OBJECT_ID]) + v.binary
    return bytes([DATE]) + struct.pack(">Q", milliseconds(v) + 2**63)


def _escaped(data: bytes) -> bytes:
    return data.replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def _number_key(v: int | float) -> bytes:
    if v != v:
        return b"\x00" * 16
    if isinstance(v, int) and abs(v) > 2**53:  # beyond exact doubles: the nearest double below, then the rest
        near = float(v) if float(v) <= v else math.nextafter(float(v), -math.inf)
        return _double_key(near) + struct.pack(">Q", v - int(near))
    return _double_key(float(v) + 0.0) + b"\x00" * 8


def _double_key(v: float) -> bytes:
    bits = struct.unpack(">Q", struct.pack(">d", v if v else 0.0))[0]
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def compare(a: Any, b: Any) -> int:
    x, y = order_key(a), order_key(b)
    return (x > y) - (x < y)


def sort_value_key(values: list[Any], descending: bool) -> bytes:
    """Key of a sort path: the least (ascending) or greatest (descending) element where it ends at an array, an empty array below null."""
    keys = []
    for v in values or [MISSING]:
        if isinstance(v, list):
            keys += [order_key(x) for x in v] or [order_key(v)]
        else:
            keys.append(order_key(v))
    return (max if descending else min)(keys)


def inverted(key: bytes) -> bytes:
    """The key in descending order. No key is the beginning of another one, so inverting the bytes is enough."""
    return key.translate(INVERSE)


INVERSE = bytes(range(255, -1, -1))


def to_json(v: Any) -> str:
    """Canonical extended JSON; field order is kept."""
    return json.dumps(_plain(v), ensure_ascii=False, separators=(",", ":"))


def _plain(v: Any) -> Any:
    if isinstance(v, dict):
        fields = {k: _plain(x) for k, x in v.items()}
        return {"$doc": list(fields.items())} if any(k.startswith("$") for k in fields) else fields
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return {"$num": "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"}
    if isinstance(v, bytes):
        return {"$bin": v.hex()}
    if isinstance(v, ObjectId):
        return {"$oid": str(v)}
    if isinstance(v, (datetime, date)):
        return {"$date": milliseconds(v)}
    return v


def from_json(text: str) -> Any:
    return json.loads(text, object_hook=_special)


def _special(d: dict) -> Any:
    if len(d) == 1:
        ((k, v),) = d.items()
        if k == "$num":
            return float(v.replace("Infinity", "inf").replace("NaN", "nan"))
        if k == "$bin":
            return bytes.fromhex(v)
        if k == "$oid":
            return ObjectId(v)
        if k == "$date":
            return datetime.fromtimestamp(v / 1000, timezone.utc).replace(tzinfo=None)
        if k == "$doc":
            return {name: x for name, x in v}
    return d
