"""Numbers that sort by the time they were drawn: 40 bits of seconds and 24 bits of a counter."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class NumberSequence:
    """Draws numbers in the driver; any number of threads may."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self._clock, self._count, self._lock = clock, 0, threading.Lock()

    def next(self) -> int:
        with self._lock:
            self._count = (self._count + 1) & 0xFFFFFF
            return int(self._clock()) << 24 | self._count

    @staticmethod
    def timestamp(n: int) -> int:
        return n >> 24

    @staticmethod
    def number(n: int) -> int:
        return n & 0xFFFFFF


def sequence_timestamp(column: str) -> Column:
    return F.timestamp_seconds(F.shiftrightunsigned(column, 24))


def sequence_number(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(0xFFFFFF))


def new_uuid() -> Column:
    return F.expr("uuid()")
