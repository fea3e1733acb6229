"""Order-preserving binary keys, and the Column that gives one: for systems that sort bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEGATIVE, _ZERO, _POSITIVE = b"\x00", b"\x01", b"\x02"


def _signed(v: int, size: int) -> bytes:
    limit = 1 << (8 * size)
    if not -limit < v < limit:
        raise OverflowError(f"{v} does not fit {size} bytes")
    if v < 0:
        return _NEGATIVE + (limit - 1 - -v).to_bytes(size, "big")
    return (_POSITIVE if v else _ZERO) + v.to_bytes(size, "big")


class KeyBuilder:
    """Appends fields, each behind a running number of one byte. The bytes of two keys compare as their fields do, one by one."""

    def __init__(self):
        self._parts: list[bytes] = []

    def _add(self, data: bytes) -> KeyBuilder:
        self._parts.append(bytes([len(self._parts) + 1]) + data)
        return self

    def int64(self, v: int) -> KeyBuilder:
        return self._add(_signed(v, 8))

    def int32(self, v: int) -> KeyBuilder:
        return self._add(_signed(v, 4))

    def int16(self, v: int) -> KeyBuilder:
        return self._add(_signed(v, 2))

    def uint64(self, v: int) -> KeyBuilder:
        return self._add(v.to_bytes(8, "big"))

    def uint32(self, v: int) -> KeyBuilder:
        return self._add(v.to_bytes(4, "big"))

    def uint16(self, v: int) -> KeyBuilder:
        return self._add(v.to_bytes(2, "big"))

    def byte(self, v: int) -> KeyBuilder:
        return self._add(bytes([v]))

    def string(self, v: str) -> KeyBuilder:
        return self._add(v.encode())

    def binary(self, v: bytes) -> KeyBuilder:
        return self._add(v)

    def big_int(self, v: int, bits: int) -> KeyBuilder:
        return self._add(_signed(v, bits // 8))

    def reset(self) -> KeyBuilder:
        self._parts.clear()
        return self

    def bytes(self) -> bytes:
        return b"".join(self._parts)


def encode_key(table_id: int, index_id: int, index_key: bytes, order_key: bytes, primary_key: bytes) -> bytes:
    """One key of a whole store: rows of an index come by key length, key, order length, order and primary key."""
    return bytes([table_id, index_id]) + len(index_key).to_bytes(4, "big") + index_key + len(order_key).to_bytes(4, "big") + order_key + primary_key


def decode_key(key: bytes) -> tuple[int, int, bytes, bytes, bytes]:
    if len(key) < 10:
        raise ValueError("the key is too short")
    n = int.from_bytes(key[2:6], "big")
    m = int.from_bytes(key[6 + n : 10 + n], "big")
    if len(key) < 10 + n + m:
        raise ValueError("the key is too short")
    return key[0], key[1], key[6 : 6 + n], key[10 + n : 10 + n + m], key[10 + n + m :]


def sort_key(column: str | Column) -> Column:
    """A bigint as 16 hex digits whose order is the numbers'."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
