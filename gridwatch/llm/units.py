"""A bounded table of distinct text units and what an encoder makes of each, for one Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from .common import release


class UnitTable(dict):
    """Encodes each distinct unit once. ``limit`` bounds memory in bytes, as ``size`` estimates it for a unit and
    what is kept of it: a table that would outgrow it starts anew, and units that come again are encoded again,
    with the same result. Units longer than ``LONG`` stay only until the next call."""

    LONG = 256

    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], limit: int = 48 << 20, overhead: int = 250, factor: int = 2):
        super().__init__()
        self.encode, self.limit, self.overhead, self.factor = encode, limit, overhead, factor
        self.held, self.long = 0, []

    def cover(self, units: set[str]) -> None:
        """Make sure that every one of ``units`` is in the table."""
        for u in self.long:
            self.pop(u, None)
        missing = units.difference(self)
        size = self._size(missing)
        if self.held + size > self.limit:
            self.clear()
            missing, self.held = units, 0
            size = self._size(missing)
        self.held += size
        self.long = [u for u in missing if len(u) > self.LONG]
        if missing:
            order = list(missing)
            self.update(zip(order, self.encode(order), strict=True))

    def release(self) -> None:
        """Give the memory back at the end of a task."""
        self.clear()
        self.held, self.long = 0, []
        release()

    def _size(self, units: set[str]) -> int:
        return len(units) * self.overhead + self.factor * sum(map(len, units))
