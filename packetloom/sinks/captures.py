"""Packets back into captures: a row of path and content for each capture, as Spark's binaryFile reader gives them."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.sources.pcap import EPB, IDB, SHB, block_bytes

#: Formats: byte order, whether blocks, resolution (kind, exponent), and the classic magic as a number.
FORMATS = {
    "micro_little": ("<", False, ("decimal", 6), 0xA1B2C3D4),
    "nano_big": (">", False, ("decimal", 9), 0xA1B23C4D),
    "blocks_nano_little": ("<", True, ("decimal", 9), None),
    "blocks_binary_big": (">", True, ("binary", 20), None),
}
SNAP = 65_535
_COLUMNS = ["capture_id", "packet_id", "interface_id", "seconds", "fraction", "original_length", "data"]


def option_bytes(order: str, code: int, value: bytes) -> bytes:
    return struct.pack(order + "HH", code, len(value)) + value + b"\0" * (-len(value) % 4)


def encoded(rows: list[tuple], style: str, link: int = 1) -> bytes:
    """A capture of (interface, seconds, fraction, original length, bytes) in the ticks of the format's resolution.

    A classic record without time gets a fraction of a whole second, which readers take for none; a
    block without time stands at 0. Blocks have as many interfaces as are named, eth0 and on.
    """
    order, blocks, (kind, exponent), magic = FORMATS[style]
    per_second = (10 if kind == "decimal" else 2) ** exponent
    if not blocks:
        head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, SNAP, link)
        timed = lambda s, f: (0, per_second) if s is None or f is None else (s, f)
        return head + b"".join(struct.pack(order + "IIII", *timed(s, f), len(b), n) + b for _, s, f, n, b in rows)
    out = [block_bytes(SHB, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)]
    resolution = bytes([exponent | (0x80 if kind == "binary" else 0)])
    for face in range(1 + max((r[0] for r in rows), default=-1)):
        options = option_bytes(order, 2, f"eth{face}".encode()) + option_bytes(order, 9, resolution) + option_bytes(order, 0, b"")
        out.append(block_bytes(IDB, struct.pack(order + "HHI", link, 0, SNAP) + options, order))
    for face, s, f, n, b in rows:
        ticks = (s or 0) * per_second + (f or 0)
        out.append(block_bytes(EPB, struct.pack(order + "IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(b), n) + b, order))
    return b"".join(out)


def capture_files(packets: DataFrame, style: str = "style") -> DataFrame:
    """path, content: a capture for each capture_id, of its packets by packet_id, in the FORMATS named by its first packet's style.

    A capture is one file and so one task's work. Packets whose data is null are empty ones.
    """

    def written(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("packet_id")
        rows = list(zip(*(ordered.column(c).to_pylist() for c in _COLUMNS[2:]), strict=True))
        content = encoded([(*r[:4], r[4] or b"") for r in rows], ordered.column(style)[0].as_py())
        return pa.table({"path": ordered.column("capture_id").slice(0, 1), "content": pa.array([content], pa.binary())})

    return packets.select(*_COLUMNS, style).groupBy("capture_id").applyInArrow(written, "path string, content binary")
