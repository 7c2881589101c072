"""Pages of packet rows and of evidence bytes: keyset pages, never an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and the layout of a packed page.
MAX_ROWS = 65_536
MAX_BYTES = 8 << 20
ROW_BYTES = 51
HEADER_BYTES = 352
EVIDENCE_BYTES = 4096
CAPTURE_EVIDENCE_BYTES = 1 << 20
DETAIL_LAYERS, DETAIL_FIELDS = 32, 1024
TRUNCATED_PROTOCOL = 8
HEX_WIDTH = 16


def rows_in(budget: int) -> int:
    """The most rows of which a packed page fits budget bytes."""
    return max(0, min(MAX_ROWS, (min(budget, MAX_BYTES) - HEADER_BYTES) // ROW_BYTES))


def packet_rows(packets: DataFrame, *keys: str) -> DataFrame:
    """keys, and the twelve columns of a packet row; what a packet without time lacks is 0. res_kind: 0 decimal, 1 binary."""
    here = F.col("seconds").isNotNull()
    zero = lambda c: F.coalesce(F.when(here, c), F.lit(0)).cast("bigint")
    return packets.select(
        *keys, "packet_id", F.col("section_id") if "section_id" in packets.columns else F.lit(0).cast("bigint").alias("section_id"), "interface_id", "captured_length", "original_length",
        F.col("captured_length").alias("evidence_length"), (F.col("evidence_offset") if "evidence_offset" in packets.columns else F.lit(0)).cast("bigint").alias("evidence_offset"),
        zero(F.col("seconds")).alias("ts_seconds"), zero(F.col("fraction")).alias("ts_fraction"), here.alias("ts_present"),
        F.when(here & (F.col("res_kind") == "binary"), 1).otherwise(0).cast("bigint").alias("res_kind"), zero(F.col("res_exp")).alias("res_exp"),
    )


def packet_page(packets: DataFrame, start: int, rows: int = MAX_ROWS, budget: int = MAX_BYTES) -> DataFrame:
    """Packet rows from id start on, as many as rows and budget allow. The next page starts after the last id."""
    if not 0 < rows <= MAX_ROWS or budget <= 0:
        raise ValueError("a page needs 1 to 65,536 rows and a positive budget")
    return packet_rows(packets.where(F.col("packet_id") >= start)).orderBy("packet_id").limit(min(rows, rows_in(budget)))


def evidence(data: Column, start: Column, most: int = EVIDENCE_BYTES, strict: bool = False) -> Column:
    """Up to most bytes from start: empty at the end of the packet; beyond it null, or an error if strict."""
    if not 0 < most <= EVIDENCE_BYTES:
        raise ValueError(f"a page of evidence has 1 to {EVIDENCE_BYTES} bytes")
    beyond = F.raise_error(F.lit("evidence_out_of_range")).cast("binary") if strict else F.lit(None).cast("binary")
    return F.when(start.between(0, F.length(data)), F.substring(data, start.cast("int") + 1, F.lit(most))).when(start.isNotNull() & data.isNotNull(), beyond)


def capture_evidence(content: Column, offset: Column, length: int) -> Column:
    """length bytes of a capture at an absolute offset; an error if they are not all in it."""
    if not 0 <= length <= CAPTURE_EVIDENCE_BYTES:
        raise ValueError(f"at most {CAPTURE_EVIDENCE_BYTES} bytes of a capture at once")
    outside = F.raise_error(F.lit("evidence_out_of_range")).cast("binary")
    return F.when((offset >= 0) & (offset + length <= F.length(content)), F.substring(content, offset.cast("int") + 1, F.lit(length))).otherwise(outside)


def truncation_flags() -> list[Column]:
    """wire_truncated and protocol_truncated of a packet with its diagnostics."""
    return [(F.col("original_length") > F.col("captured_length")).alias("wire_truncated"), F.exists("diagnostics", lambda d: d["code"] == TRUNCATED_PROTOCOL).alias("protocol_truncated")]


def packet_detail(trees: DataFrame, max_layers: int = DETAIL_LAYERS, max_fields: int = DETAIL_FIELDS) -> DataFrame:
    """trees whole or not at all: a packet with more layers or fields fails the query."""
    within = (F.size("layers") <= max_layers) & (F.size("fields") <= max_fields)
    return trees.where(F.when(within, F.lit(True)).otherwise(F.raise_error(F.lit("packet_detail_limit")).cast("boolean")))


def hex_rows(data: Column, width: int = HEX_WIDTH) -> Column:
    """An array of (offset, hex, ascii), width bytes each, as a hexadecimal view shows them; empty for no bytes."""
    raw = lambda i: F.substring(data, i * width + 1, F.lit(width))
    shown = lambda i: F.regexp_replace(F.decode(raw(i), "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    row = lambda i: F.struct((i * width).alias("offset"), F.rtrim(F.regexp_replace(F.lower(F.hex(raw(i))), "(..)", "$1 ")).alias("hex"), shown(i).alias("ascii"))
    last = F.ceil(F.length(data) / width).cast("int") - 1
    return F.when(F.length(data) > 0, F.transform(F.sequence(F.lit(0), last), row)).otherwise(F.filter(F.array(row(F.lit(0))), lambda x: F.lit(False)))


def byte_range(start: Column, length: Column) -> Column:
    """How a range of bytes is told: "bytes 14-33 (20 B)"."""
    last = start + length - 1
    return F.when(length > 0, F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), last.cast("string"), F.lit(" ("), length.cast("string"), F.lit(" B)"))).otherwise(F.concat(F.lit("at byte "), start.cast("string"), F.lit(" (0 B)")))
