"""Cursors over the packets of captures: pages are read, then committed or discarded; handles go stale when closed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Generic, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import paging
from packetloom.sinks import batches

# How many of each may be open at once.
MAX_DATASETS, MAX_CURSORS = 1024, 65_536

T = TypeVar("T")
Handle = tuple[int, int]


class CursorError(ValueError):
    """category is invalid_handle, invalid_state, invalid_argument, unsupported_version, out_of_range or resource_limit."""

    def __init__(self, category: str, message: str):
        super().__init__(category, message)
        self.category = category


class Handles(Generic[T]):
    """Up to most things by (slot, generation): a slot is used again, under the next generation."""

    def __init__(self, most: int):
        self.most, self._held, self._free, self._generation = most, {}, [], []

    def insert(self, thing: T) -> Handle:
        if len(self._held) >= self.most:
            raise CursorError("resource_limit", f"at most {self.most} may be open at once")
        if not self._free:
            self._free.append(len(self._generation))
            self._generation.append(0)
        slot = self._free.pop()
        self._generation[slot] += 1
        self._held[handle := (slot, self._generation[slot])] = thing
        return handle

    def get(self, handle: Handle) -> T:
        if handle not in self._held:
            raise CursorError("invalid_handle", "nothing is open under this handle")
        return self._held[handle]

    def remove(self, handle: Handle) -> T:
        thing = self.get(handle)
        del self._held[handle]
        self._free.append(handle[0])
        return thing

    def items(self) -> list[tuple[Handle, T]]:
        return list(self._held.items())


class _Dataset:
    def __init__(self, packets: DataFrame):
        self.packets = packets

    @cached_property
    def total(self) -> int:
        return self.packets.count()


@dataclass
class _Cursor:
    dataset: Handle
    next_row: int
    pending: tuple[int, int] | None = None


class Registry:
    """What a client has open. A page is at most one batch; nothing of a dataset is kept but its plan and its count."""

    def __init__(self) -> None:
        self._datasets: Handles[_Dataset] = Handles(MAX_DATASETS)
        self._cursors: Handles[_Cursor] = Handles(MAX_CURSORS)

    def open(self, packets: DataFrame, capture_id: str | None = None) -> Handle:
        """The packets of one capture; capture_id chooses it among several."""
        return self._datasets.insert(_Dataset(packets if capture_id is None else packets.where(F.col("capture_id") == capture_id)))

    def close(self, dataset: Handle) -> None:
        """The dataset and its cursors."""
        self._datasets.remove(dataset)
        for handle, cursor in self._cursors.items():
            if cursor.dataset == dataset:
                self._cursors.remove(handle)

    def cursor(self, dataset: Handle, start: int = 0) -> Handle:
        if not 0 <= start <= self._datasets.get(dataset).total:
            raise CursorError("out_of_range", "a cursor starts beyond its dataset")
        return self._cursors.insert(_Cursor(dataset, start))

    def close_cursor(self, cursor: Handle) -> None:
        self._cursors.remove(cursor)

    def read(self, cursor: Handle, rows: int = paging.MAX_ROWS, budget: int = paging.MAX_BYTES) -> bytes:
        """The next packed batch, of at most rows packets and budget bytes; the cursor waits for commit or discard."""
        if not 0 < budget <= paging.MAX_BYTES:
            raise CursorError("invalid_argument", "the budget of a batch is out of bounds")
        if not 0 <= rows <= paging.MAX_ROWS:
            raise CursorError("resource_limit", f"a batch has at most {paging.MAX_ROWS} rows")
        c = self._cursors.get(cursor)
        if c.pending is not None:
            raise CursorError("invalid_state", "the last batch is neither committed nor discarded")
        dataset = self._datasets.get(c.dataset)
        left, fit = min(rows, dataset.total - c.next_row), paging.rows_in(budget)
        if budget < paging.HEADER_BYTES or (left and not fit):
            raise CursorError("invalid_argument", "the budget is too small for a batch")
        end = c.next_row + min(left, fit)
        page = paging.packet_rows(dataset.packets.where(F.col("packet_id").between(c.next_row, end - 1))).orderBy("packet_id").toArrow()
        batch = batches.encoded(page, c.next_row, dataset.total)
        c.pending = (c.next_row, end)
        return batch

    def commit(self, cursor: Handle, start: int, end: int, schema: int = batches.SCHEMA) -> None:
        """Go on behind the batch read last, which was of the rows from start up to end."""
        self._settle(cursor, start, end, schema).next_row = end

    def discard(self, cursor: Handle, start: int, end: int, schema: int = batches.SCHEMA) -> None:
        """Forget the batch read last: it is read again."""
        self._settle(cursor, start, end, schema)

    def _settle(self, cursor: Handle, start: int, end: int, schema: int) -> _Cursor:
        c = self._cursors.get(cursor)
        if c.pending is None:
            raise CursorError("invalid_state", "no batch waits")
        if schema != batches.SCHEMA:
            raise CursorError("unsupported_version", "the version of the batch is not supported")
        if (start, end) != c.pending:
            raise CursorError("invalid_argument", "another batch waits")
        c.pending = None
        return c
