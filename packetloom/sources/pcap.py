"""PCAP and PCAPNG captures as tables, through Spark's own file readers.

Files come as binaryFile rows, so any store that Spark reads will do and listing, globs and streaming
triggers are Spark's. A file's records are a chain, read by one task; files are read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Magics as they stand in the file, block types, diagnostic codes.
CLASSIC = {"d4c3b2a1": ("<", 6, 16), "a1b2c3d4": (">", 6, 16), "4d3cb2a1": ("<", 9, 16), "a1b23c4d": (">", 9, 16), "34cdb2a1": ("<", 6, 24), "a1b2cd34": (">", 6, 24)}
NG = "0a0d0d0a"
ADMITTED_BYTES = 256 << 20
SHB, IDB, SPB, EPB = 0x0A0D0D0A, 1, 3, 6
BAD_HEADER, CUT_RECORD, SKIPPED_BLOCK, BAD_TIME, BAD_LENGTH, OVER_LIMIT = 1, 2, 3, 5, 6, 7
SCHEMA = (
    "capture_id string, kind string, format string, id bigint, section_id bigint, interface_id bigint, section_index bigint, link_type bigint, snap_length bigint, name string, byte_order string, "
    "seconds bigint, fraction bigint, res_kind string, res_exp int, captured_length bigint, original_length bigint, offset bigint, length bigint, data binary, code int, severity string, recovery string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


@dataclass(frozen=True)
class Limits:
    """Most bytes of a block, options of a block, packets, sections, interfaces, diagnostics and bytes of names of a capture, and bytes of its file; None: no limit."""

    block_bytes: int | None = 16 << 20
    options: int | None = 4096
    packets: int | None = None
    sections: int | None = None
    interfaces: int | None = None
    diagnostics: int | None = None
    string_bytes: int | None = None
    capture_bytes: int | None = (1 << 31) - 1

    def __post_init__(self) -> None:
        if any(x is not None and x <= 0 for x in vars(self).values()):
            raise CaptureError("invalid_limits", "limits are positive")


def admission(capture_bytes: int) -> Limits:
    """The limits under which an interactive session takes a capture of that size: packets in proportion to bytes."""
    if capture_bytes > ADMITTED_BYTES:
        raise CaptureError("resource_limit", f"a capture of {capture_bytes} bytes")
    return Limits(4 << 20, 4096, min(131_072, 1024 + capture_bytes // 256), 1024, 16_384, 1024, 256 << 10, ADMITTED_BYTES)


class CaptureError(ValueError):
    """A capture that can't be read: category is invalid_header, truncated_input, resource_limit or invalid_limits."""

    def __init__(self, category: str, message: str):
        super().__init__(category, message)
        self.category = category


class _Stop(Exception):
    """code, offset: the rest of the capture is given up."""


class Importer:
    """The records of one capture in order: section, interface, packet and diagnostic rows."""

    def __init__(self, capture_id: str, data: bytes, limits: Limits | None = None):
        self.name, self.d, self.limits = capture_id, data, limits or Limits()
        self.n = {"section": 0, "interface": 0, "packet": 0, "diagnostic": 0}
        self.string_bytes = 0
        self.format = "pcapng" if data[:4].hex() == NG else "pcap"

    def row(self, kind: str, **values) -> dict:
        if kind in self.n:
            values["id"] = self.n[kind]
            self.n[kind] += 1
            most = getattr(self.limits, f"{kind}s")
            if most is not None and self.n[kind] > most:
                raise CaptureError("resource_limit", f"more than {most} {kind}s")
        return {"capture_id": self.name, "kind": kind, "format": self.format} | values

    def diagnostic(self, code: int, severity: str, recovery: str, offset: int, length: int, packet: int | None = None) -> dict:
        return self.row("diagnostic", code=code, severity=severity, recovery=recovery, offset=offset, length=length) | {"id": packet}

    def rows(self) -> Iterator[dict]:
        try:
            yield from self.pcapng() if self.format == "pcapng" else self.classic()
        except _Stop as stop:
            code, at = stop.args
            yield self.diagnostic(code, "error", "capture_rejected" if code == BAD_HEADER else "record_skipped", at, len(self.d) - at)

    # --- classic -----------------------------------------------------------------------------
    def classic(self) -> Iterator[dict]:
        d = self.d
        if d[:4].hex() not in CLASSIC or len(d) < 24:
            known = len(d) >= 4 and d[:4].hex() not in CLASSIC
            raise CaptureError(*(("invalid_header", "not a capture") if known else ("truncated_input", "the capture ends within its header")))
        order, digits, header = CLASSIC[d[:4].hex()]
        major, minor, _, _, snap, link = struct.unpack(order + "HHiIII", d[4:24])
        if (major, minor) != (2, 4) or snap == 0:
            raise CaptureError("invalid_header", "unsupported version or no snapshot length")
        resolution = {"res_kind": "decimal", "res_exp": digits}
        yield self.row("section", byte_order="little" if order == "<" else "big", offset=0, length=len(d))
        yield self.row("interface", section_id=0, section_index=0, link_type=link & 0x0FFFFFFF, snap_length=snap, offset=0, length=24, **resolution)
        at = 24
        while at < len(d):
            if at + header > len(d):
                raise _Stop(CUT_RECORD, at)
            seconds, part, captured, original = struct.unpack(order + "IIII", d[at : at + 16])
            if at + header + captured > len(d):
                raise _Stop(CUT_RECORD, at)
            timed = part < 10**digits
            packet = self.row("packet", section_id=0, interface_id=0, seconds=seconds if timed else None, fraction=part if timed else None, captured_length=captured, original_length=original, offset=at + header, length=captured, data=d[at + header : at + header + captured], link_type=link & 0x0FFFFFFF, **resolution)
            yield packet
            if not timed:
                yield self.diagnostic(BAD_TIME, "warning", "continued", at, header, packet["id"])
            if captured > snap or captured > original:
                yield self.diagnostic(BAD_LENGTH, "warning", "continued", at, header, packet["id"])
            at += header + captured

    # --- blocks ------------------------------------------------------------------------------
    def pcapng(self) -> Iterator[dict]:
        d, at, order, section, end = self.d, 0, "<", None, None
        faces: list[dict] = []
        open_section: dict | None = None
        try:
            while at < len(d):
                if at + 12 > len(d):
                    raise _Stop(CUT_RECORD, at)
                head = d[at : at + 4].hex() == NG
                if end is not None and (at > end or (at == end and not head)):
                    raise _Stop(BAD_HEADER, at)
                if head:
                    magic = d[at + 8 : at + 12].hex()
                    if magic not in ("4d3c2b1a", "1a2b3c4d"):
                        raise _Stop(BAD_HEADER, at)
                    order = "<" if magic == "4d3c2b1a" else ">"
                kind, size = struct.unpack(order + "II", d[at : at + 8])
                if size < (28 if head else 12) or size % 4:
                    raise _Stop(BAD_HEADER, at)
                if self.limits.block_bytes is not None and size > self.limits.block_bytes:
                    raise CaptureError("resource_limit", f"a block of {size} bytes")
                if at + size > len(d):
                    raise _Stop(CUT_RECORD, at)
                if struct.unpack(order + "I", d[at + size - 4 : at + size])[0] != size or (end is not None and at + size > end and not head):
                    raise _Stop(BAD_HEADER, at)
                if head:
                    major, minor, length = struct.unpack(order + "HHq", d[at + 12 : at + 24])
                    if major != 1 or minor not in (0, 2) or length < -1 or (length > 0 and length % 4):
                        raise _Stop(BAD_HEADER, at)
                    if open_section is not None:
                        yield open_section | {"length": at - open_section["offset"]}
                    open_section = self.row("section", byte_order="little" if order == "<" else "big", offset=at)
                    section, faces, end = open_section["id"], [], None if length < 0 else at + size + length
                elif kind == IDB:
                    face = self.interface(order, at, size, section, len(faces))
                    yield from face
                    faces.append(face[0])
                elif kind == EPB:
                    yield from self.enhanced(order, at, size, section, faces)
                elif kind == SPB:
                    yield from self.simple(order, at, size, section, faces)
                else:
                    yield self.diagnostic(SKIPPED_BLOCK, "info", "record_skipped", at, size)
                at += size
            if end is not None and at != end:
                raise _Stop(CUT_RECORD, at)
        except _Stop as stop:
            if open_section is None:
                raise CaptureError("truncated_input" if stop.args[0] == CUT_RECORD else "invalid_header", "no readable section header") from stop
            yield open_section | {"length": stop.args[1] - open_section["offset"]}
            open_section = None
            raise
        if open_section is not None:
            yield open_section | {"length": at - open_section["offset"]}

    def options(self, order: str, at: int, end: int) -> dict[int, bytes]:
        """First value of each option; a list that doesn't add up gives up the capture."""
        out: dict[int, bytes] = {}
        count = 0
        while at < end:
            if at + 4 > end:
                raise _Stop(BAD_HEADER, at)
            code, size = struct.unpack(order + "HH", self.d[at : at + 4])
            count += 1
            if self.limits.options is not None and count > self.limits.options:
                raise CaptureError("resource_limit", f"more than {self.limits.options} options in a block")
            if at + 4 + size > end:
                raise _Stop(BAD_HEADER, at)
            if code == 0:
                break
            out.setdefault(code, self.d[at + 4 : at + 4 + size])
            at += 4 + (size + 3 & ~3)
        return out

    def interface(self, order: str, at: int, size: int, section: int | None, index: int) -> list[dict]:
        if size < 20:
            raise _Stop(BAD_HEADER, at)
        link, _, snap = struct.unpack(order + "HHI", self.d[at + 8 : at + 16])
        given = self.options(order, at + 16, at + size - 4)
        kind, exponent, shift, warn = "decimal", 6, 0, False
        if (raw := given.get(9)) is not None:
            warn |= len(raw) != 1
            if len(raw) == 1:
                kind, exponent = ("binary" if raw[0] & 0x80 else "decimal"), raw[0] & 0x7F
        if (raw := given.get(14)) is not None:
            warn |= len(raw) != 8
            if len(raw) == 8:
                shift = struct.unpack(order + "q", raw)[0]
        self.string_bytes += len(given.get(2, b""))
        if self.limits.string_bytes is not None and self.string_bytes > self.limits.string_bytes:
            raise CaptureError("resource_limit", f"more than {self.limits.string_bytes} bytes of names")
        row = self.row("interface", section_id=section, section_index=index, link_type=link, snap_length=snap, offset=at, length=size, res_kind=kind, res_exp=exponent, name=given[2].decode("utf-8", "replace") if 2 in given else None)
        row["_shift"] = shift
        return [row, *([self.diagnostic(BAD_TIME, "warning", "continued", at, size)] if warn else [])]

    def enhanced(self, order: str, at: int, size: int, section: int | None, faces: list[dict]) -> Iterator[dict]:
        if size < 32:
            raise _Stop(BAD_HEADER, at)
        which, high, low, captured, original = struct.unpack(order + "IIIII", self.d[at + 8 : at + 28])
        begin = at + 28
        if begin + (captured + 3 & ~3) > at + size - 4:
            raise _Stop(BAD_HEADER, at)
        self.options(order, begin + (captured + 3 & ~3), at + size - 4)
        if which >= len(faces):
            yield self.diagnostic(BAD_HEADER, "error", "record_skipped", at, size)
            return
        face = faces[which]
        per_second = (10 if face["res_kind"] == "decimal" else 2) ** face["res_exp"]
        whole, part = divmod(high << 32 | low, per_second)
        whole += face["_shift"]
        timed = -(1 << 63) <= whole < 1 << 63
        packet = self.packet(section, face, whole if timed else None, part if timed else None, captured, original, begin)
        yield packet
        if not timed:
            yield self.diagnostic(BAD_TIME, "warning", "continued", at, size, packet["id"])
        if (face["snap_length"] and captured > face["snap_length"]) or captured > original:
            yield self.diagnostic(BAD_LENGTH, "warning", "continued", at, size, packet["id"])

    def simple(self, order: str, at: int, size: int, section: int | None, faces: list[dict]) -> Iterator[dict]:
        if size < 16:
            raise _Stop(BAD_HEADER, at)
        original = struct.unpack(order + "I", self.d[at + 8 : at + 12])[0]
        if not faces:
            yield self.diagnostic(BAD_HEADER, "error", "record_skipped", at, size)
            return
        captured = min(original, faces[0]["snap_length"]) if faces[0]["snap_length"] else original
        if at + 12 + captured > at + size - 4:
            raise _Stop(BAD_HEADER, at)
        yield self.packet(section, faces[0], None, None, captured, original, at + 12)

    def packet(self, section: int | None, face: dict, seconds: int | None, fraction: int | None, captured: int, original: int, begin: int) -> dict:
        return self.row("packet", section_id=section, interface_id=face["id"], link_type=face["link_type"], seconds=seconds, fraction=fraction, res_kind=face["res_kind"], res_exp=face["res_exp"], captured_length=captured, original_length=original, offset=begin, length=captured, data=self.d[begin : begin + captured])


def _parsed(limits: Limits, permissive: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[dict] = []
                importer = Importer(path, content.as_py(), limits)
                try:
                    for r in importer.rows():
                        rows.append(r)
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                except CaptureError as e:
                    if not permissive:
                        raise
                    code = OVER_LIMIT if e.category == "resource_limit" else CUT_RECORD if e.category == "truncated_input" else BAD_HEADER
                    rows.append({"capture_id": path, "kind": "diagnostic", "format": importer.format, "code": code, "severity": "fatal", "recovery": "capture_rejected", "offset": 0, "length": len(importer.d)})
                yield _batch(rows)

    return parse


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[k]) for c, k in (x.split() for x in SCHEMA.split(", "))], _COLUMNS)


def read_captures(spark: SparkSession, path: str | list[str], limits: Limits | None = None, mode: str = "PERMISSIVE", glob: str | None = None) -> DataFrame:
    """All records of the captures at path, a row each: see SCHEMA and the functions below.

    mode: FAILFAST fails on a capture without a readable header or beyond a limit; PERMISSIVE leaves a
    diagnostic of severity fatal for it. A capture that is cut or damaged later keeps what came before.
    """
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return _records(reader.load(path), limits, mode)


def stream_captures(spark: SparkSession, path: str, limits: Limits | None = None, mode: str = "PERMISSIVE", files_per_trigger: int = 64) -> DataFrame:
    """The same records of captures as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _records(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path), limits, mode)


def _records(files: DataFrame, limits: Limits | None, mode: str) -> DataFrame:
    """A file over the limit of bytes is never read: its length alone is known."""
    limits = limits or Limits()
    if limits.capture_bytes is None:
        return parse_captures(files, limits, mode)
    known = {"capture_id": F.col("path"), "kind": F.lit("diagnostic"), "code": F.lit(OVER_LIMIT), "severity": F.lit("fatal"), "recovery": F.lit("capture_rejected"), "offset": F.lit(0), "length": F.col("length")}
    refused = [known.get(c, F.lit(None)).cast(k).alias(c) for c, k in (x.split() for x in SCHEMA.split(", "))]
    large = files.where(F.col("length") > limits.capture_bytes)
    if mode.upper() != "PERMISSIVE":
        large = large.where(F.raise_error(F.lit("resource_limit: a capture over the limit of bytes")).cast("boolean"))
    return parse_captures(files.where(F.col("length") <= limits.capture_bytes), limits, mode).unionByName(large.select(*refused))


def parse_captures(files: DataFrame, limits: Limits | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """The records of captures that come as rows of path and content, from any source."""
    return files.select("path", "content").mapInArrow(_parsed(limits or Limits(), mode.upper() == "PERMISSIVE"), SCHEMA)


def packets(records: DataFrame) -> DataFrame:
    return records.where("kind = 'packet'").select("capture_id", F.col("id").alias("packet_id"), "section_id", "interface_id", "link_type", "seconds", "fraction", "res_kind", "res_exp", "captured_length", "original_length", F.col("offset").alias("evidence_offset"), "data", F.array().cast("array<int>").alias("diag_codes"))


def interfaces(records: DataFrame) -> DataFrame:
    return records.where("kind = 'interface'").select("capture_id", F.col("id").alias("interface_id"), "section_id", "section_index", "link_type", "snap_length", "res_kind", "res_exp", "name", F.col("offset").alias("start"), "length")


def sections(records: DataFrame) -> DataFrame:
    return records.where("kind = 'section'").select("capture_id", F.col("id").alias("section_id"), "byte_order", F.col("offset").alias("start"), "length")


def diagnostics(records: DataFrame) -> DataFrame:
    return records.where("kind = 'diagnostic'").select("capture_id", F.col("id").alias("packet_id"), "code", "severity", "recovery", F.col("offset").alias("start"), "length")


def import_summary(records: DataFrame) -> DataFrame:
    """Counts of each capture, and its warnings."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return records.groupBy("capture_id").agg(F.max("format").alias("format"), of("section").alias("sections"), of("interface").alias("interfaces"), of("packet").alias("packets"), of("diagnostic").alias("diagnostics"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def resource_stats(records: DataFrame) -> DataFrame:
    """What each capture holds: packets and their bytes, bytes of its sections, bytes of interface names."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    return records.groupBy("capture_id").agg(of("packet", F.lit(1)).alias("packets"), of("packet", F.col("length")).alias("packet_bytes"), of("section", F.col("length")).alias("capture_bytes"), of("interface", F.octet_length("name")).alias("string_bytes"))


def sniff(header: Column) -> Column:
    """pcap, pcapng, malformed, need_more_bytes or unsupported, of a file's first bytes (12 are enough)."""
    start = F.lower(F.hex(F.substring(header, 1, 4)))
    known = [m for m in CLASSIC if not m.endswith("cd34") and not m.startswith("34cd")]
    order = F.lower(F.hex(F.substring(header, 9, 4)))
    return F.when(F.length(header) < 4, "need_more_bytes").when(start.isin(*known), "pcap").when((start == NG) & (F.length(header) < 12), "need_more_bytes").when((start == NG) & order.isin("4d3c2b1a", "1a2b3c4d"), "pcapng").when(start == NG, "malformed").otherwise("unsupported")


def hint_warning(path: Column, detected: Column) -> Column:
    """Whether a file's extension suggests another format than its bytes: a warning, the bytes decide."""
    return F.coalesce(filename_hint(path) != detected, F.lit(False))


def filename_hint(path: Column) -> Column:
    """The format that a file's extension suggests, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("pcap", "cap"), "pcap").when(ext.isin("pcapng", "ntar"), "pcapng")



def classic_bytes(frames: list[tuple[int, int, bytes]], link: int = 1, order: str = "<", snap: int = 65535) -> bytes:
    """A classic capture of (seconds, microseconds, bytes)."""
    magic = {"<": bytes.fromhex("d4c3b2a1"), ">": bytes.fromhex("a1b2c3d4")}[order]
    return magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, snap, link) + b"".join(struct.pack(order + "IIII", s, u, len(b), len(b)) + b for s, u, b in frames)


def block_bytes(kind: int, body: bytes, order: str = "<") -> bytes:
    """A PCAPNG block around its body."""
    size = 12 + len(body) + -len(body) % 4
    return struct.pack(order + "II", kind, size) + body + b"\0" * (-len(body) % 4) + struct.pack(order + "I", size)
