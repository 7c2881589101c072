"""Packed batches of packet rows: a header, a descriptor for each column, the columns in little-endian order; and their reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.paging import HEADER_BYTES, MAX_BYTES, MAX_ROWS, packet_rows

# The layout of a batch. A column's id is its place from 1; type ids are those of TYPES.
MAGIC = b"WLPKTB01"
SCHEMA, API = 1, 1
HEAD = struct.Struct("<8sHHIHHIIIIIQQQ")
DESCRIPTOR = struct.Struct("<HBBIIIII")
TYPES = {"u1": 1, "u4": 2, "u8": 3, "i8": 4}
COLUMNS = {
    "packet_id": "u4",
    "section_id": "u4",
    "interface_id": "u4",
    "captured_length": "u4",
    "original_length": "u4",
    "evidence_length": "u4",
    "evidence_offset": "u8",
    "ts_seconds": "i8",
    "ts_fraction": "u8",
    "ts_present": "u1",
    "res_kind": "u1",
    "res_exp": "u1",
}
NULLABLE = {"ts_seconds", "ts_fraction", "res_kind", "res_exp"}
ROWS = 4096


class BatchError(ValueError):
    """A batch that breaks its layout."""


def _head(rows: int, size: int, start: int, total: int) -> bytes:
    done = int(start + rows >= total)
    return HEAD.pack(MAGIC, SCHEMA, HEAD.size, API, DESCRIPTOR.size, len(COLUMNS), done, rows, HEAD.size, HEADER_BYTES, size, start, start + rows, total)


def _of_total(batch: bytes, start: int, rows: int, total: int) -> bytes:
    return _head(rows, len(batch), start, total) + batch[HEAD.size :]


def encoded(rows: pa.Table, start: int, total: int) -> bytes:
    """Rows as of paging.packet_rows, in order from id start on, of a capture of total packets."""
    n, at, descriptors, columns = rows.num_rows, HEADER_BYTES, b"", []
    if n > MAX_ROWS:
        raise BatchError("too many rows for a batch")
    for k, (name, kind) in enumerate(COLUMNS.items(), 1):
        values = rows.column(name).to_numpy().astype(np.int64)
        kept = values.astype("<" + kind)
        if (kept.astype(np.int64) != values).any() or (kind != "i8" and (values < 0).any()):
            raise BatchError(f"{name} is out of its type's range")
        columns.append(kept.tobytes())
        width = kept.dtype.itemsize
        descriptors += DESCRIPTOR.pack(k, TYPES[kind], name in NULLABLE, width, at, n, n * width, 0)
        at += n * width
    return _head(n, at, start, total) + descriptors + b"".join(columns)


def decoded(batch: bytes) -> tuple[pa.Table, int, int, int]:
    """The rows of a batch, its start, next and total rows; an error if anything in it is not as it must be."""
    if not HEADER_BYTES <= len(batch) <= MAX_BYTES:
        raise BatchError("a batch's size is out of bounds")
    n, start, total = struct.unpack_from("<I", batch, 24)[0], *struct.unpack_from("<Q8xQ", batch, 40)
    if n > MAX_ROWS or start + n > total or batch[: HEAD.size] != _head(n, len(batch), start, total):
        raise BatchError("the header of a batch is not consistent")
    at, found = HEADER_BYTES, {}
    for k, (name, kind) in enumerate(COLUMNS.items(), 1):
        width = np.dtype(kind).itemsize
        place = HEAD.size + DESCRIPTOR.size * (k - 1)
        if batch[place : place + DESCRIPTOR.size] != DESCRIPTOR.pack(k, TYPES[kind], name in NULLABLE, width, at, n, n * width, 0) or at + n * width > len(batch):
            raise BatchError(f"the descriptor of {name} is not consistent")
        found[name] = np.frombuffer(batch, "<" + kind, n, at).astype(np.int64)
        at += n * width
    if at != len(batch):
        raise BatchError("bytes behind the last column")
    if (found["packet_id"] != start + np.arange(n)).any():
        raise BatchError("packet ids are not those asked for")
    if (found["captured_length"] != found["evidence_length"]).any():
        raise BatchError("captured bytes and evidence differ in length")
    if (found["ts_present"] > 1).any() or ((found["ts_present"] == 1) & (found["res_kind"] > 1)).any() or (found["res_exp"] > 127).any():
        raise BatchError("a time is not consistent")
    arrays = {name: pa.array(a.astype(bool) if name == "ts_present" else a) for name, a in found.items()}
    return pa.table(arrays), start, start + n, total


def packet_batches(packets: DataFrame, rows: int = ROWS) -> DataFrame:
    """capture_id, start_row, next_row, total_rows, batch: the packets of each capture in batches of so many ids.

    Ids must be dense from 0. A batch is one group of at most rows packets; the totals join the few
    batches, not the packets. A capture without packets has no batch.
    """
    if not 0 < rows <= min(MAX_ROWS, (MAX_BYTES - HEADER_BYTES) // 51):
        raise ValueError("rows of a batch out of bounds")
    flat = packet_rows(packets, "capture_id")

    def packed(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("packet_id")
        start = ordered.column("packet_id")[0].as_py()
        body = encoded(ordered, start, start + ordered.num_rows)
        return pa.table({"capture_id": ordered.column("capture_id").slice(0, 1), "start_row": pa.array([start], pa.int64()), "next_row": pa.array([start + ordered.num_rows], pa.int64()), "batch": pa.array([body], pa.binary())})

    def finished(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            whole = [_of_total(x, a, b - a, n) for a, b, n, x in zip(*(page.column(c).to_pylist() for c in ("start_row", "next_row", "total_rows", "batch")), strict=True)]
            yield page.set_column(page.schema.get_field_index("batch"), "batch", pa.array(whole, pa.binary()))

    pages = flat.groupBy("capture_id", F.floor(F.col("packet_id") / rows).alias("_page")).applyInArrow(packed, "capture_id string, start_row bigint, next_row bigint, batch binary")
    totals = flat.groupBy("capture_id").agg(F.count("*").alias("total_rows"))
    joined = pages.join(totals, "capture_id").select("capture_id", "start_row", "next_row", "total_rows", "batch")
    return joined.mapInArrow(finished, "capture_id string, start_row bigint, next_row bigint, total_rows bigint, batch binary")


def batch_rows(batches: DataFrame) -> DataFrame:
    """The packet rows of batches (capture_id, batch), every one of them checked."""

    def opened(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            for capture, batch in zip(*(page.column(c).to_pylist() for c in ("capture_id", "batch")), strict=True):
                rows = decoded(batch)[0]
                yield from rows.add_column(0, "capture_id", pa.array([capture] * rows.num_rows, pa.string())).to_batches()

    return batches.select("capture_id", "batch").mapInArrow(opened, "capture_id string, " + ", ".join(f"{c} {'boolean' if c == 'ts_present' else 'bigint'}" for c in COLUMNS))
