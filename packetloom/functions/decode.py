"""Fixed protocol headers as native columns over a packet's bytes: no Python, pruned where unused.

Offsets are Columns or ints from the first byte of the packet. A value whose bytes were not captured is
null. Option lists, extension chains, DNS names and checksums are in packetloom.functions.tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETHERNET = 14
# Extension headers that are walked (hop-by-hop, routing, fragment, authentication, destination), and limits.
_EXTENSIONS = (0, 43, 44, 51, 60)
MAX_EXTENSIONS, MAX_EXTENSION_BYTES = 8, 512


def _at(offset: Column | int) -> Column:
    return offset if isinstance(offset, Column) else F.lit(offset)


def raw(data: Column, offset: Column | int, length: int) -> Column:
    """length bytes at offset, null if they are not all there."""
    o = _at(offset)
    return F.when(F.length(data) >= o + length, F.substring(data, o + 1, F.lit(length)))


def uint(data: Column, offset: Column | int, length: int) -> Column:
    """Big-endian unsigned integer of 1 to 4 bytes, as bigint."""
    return F.conv(F.hex(raw(data, offset, length)), 16, 10).cast("bigint")


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask).cast("bigint"))


def flag(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def ethernet(data: Column) -> dict[str, Column]:
    return {"destination": raw(data, 0, 6), "source": raw(data, 6, 6), "ether_type": uint(data, 12, 2)}


def vlan(data: Column) -> dict[str, Column]:
    tci = uint(data, 14, 2)
    return {"tag_protocol_identifier": uint(data, 12, 2), "tag_control_information": tci, "priority_code_point": bits(tci, 13, 7), "drop_eligible": flag(tci, 0x1000), "vlan_identifier": bits(tci, 0, 0xFFF), "inner_ether_type": uint(data, 16, 2)}


def ipv4(data: Column, at: Column | int = ETHERNET) -> dict[str, Column]:
    o = _at(at)
    first, service, fragment = uint(data, o, 1), uint(data, o + 1, 1), uint(data, o + 6, 2)
    return {
        "version": bits(first, 4, 15), "header_length": bits(first, 0, 15) * 4, "differentiated_services": bits(service, 2, 63), "explicit_congestion_notification": bits(service, 0, 3),
        "total_length": uint(data, o + 2, 2), "identification": uint(data, o + 4, 2), "flags": bits(fragment, 13, 7), "reserved_flag": flag(fragment, 0x8000), "dont_fragment": flag(fragment, 0x4000), "more_fragments": flag(fragment, 0x2000),
        "fragment_offset": bits(fragment, 0, 0x1FFF), "fragment_offset_bytes": bits(fragment, 0, 0x1FFF) * 8, "time_to_live": uint(data, o + 8, 1), "protocol": uint(data, o + 9, 1), "header_checksum": uint(data, o + 10, 2),
        "source_address": raw(data, o + 12, 4), "destination_address": raw(data, o + 16, 4),
    }


def ipv6(data: Column, at: Column | int = ETHERNET) -> dict[str, Column]:
    o = _at(at)
    first = uint(data, o, 4)
    return {"version": bits(first, 28, 15), "traffic_class": bits(first, 20, 255), "flow_label": bits(first, 0, 0xFFFFF), "payload_length": uint(data, o + 4, 2), "next_header": uint(data, o + 6, 1), "hop_limit": uint(data, o + 7, 1), "source_address": raw(data, o + 8, 16), "destination_address": raw(data, o + 24, 16)}


def tcp(data: Column, at: Column | int) -> dict[str, Column]:
    o = _at(at)
    word = uint(data, o + 12, 2)
    names = ("cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin")
    return {
        "source_port": uint(data, o, 2), "destination_port": uint(data, o + 2, 2), "sequence_number": uint(data, o + 4, 4), "acknowledgment_number": uint(data, o + 8, 4),
        "data_offset_words": bits(word, 12, 15), "header_length": bits(word, 12, 15) * 4, "reserved": bits(word, 8, 15), "flags": bits(word, 0, 255), **{n: flag(word, 0x80 >> k) for k, n in enumerate(names)},
        "window": uint(data, o + 14, 2), "checksum": uint(data, o + 16, 2), "urgent_pointer": uint(data, o + 18, 2),
    }


def udp(data: Column, at: Column | int) -> dict[str, Column]:
    o = _at(at)
    return {"source_port": uint(data, o, 2), "destination_port": uint(data, o + 2, 2), "length": uint(data, o + 4, 2), "checksum": uint(data, o + 6, 2)}


def icmp(data: Column, at: Column | int) -> dict[str, Column]:
    o = _at(at)
    return {"type": uint(data, o, 1), "code": uint(data, o + 1, 1), "checksum": uint(data, o + 2, 2), "identifier": uint(data, o + 4, 2), "sequence_number": uint(data, o + 6, 2)}


def dns_header(data: Column, at: Column | int) -> dict[str, Column]:
    o = _at(at)
    w = uint(data, o + 2, 2)
    counts = ("question_count", "answer_count", "authority_count", "additional_count")
    return {
        "transaction_id": uint(data, o, 2), "flags": w, "is_response": flag(w, 0x8000), "opcode": bits(w, 11, 15), "authoritative_answer": flag(w, 0x400), "truncated": flag(w, 0x200), "recursion_desired": flag(w, 0x100),
        "recursion_available": flag(w, 0x80), "reserved": flag(w, 0x40), "authenticated_data": flag(w, 0x20), "checking_disabled": flag(w, 0x10), "response_code": bits(w, 0, 15), **{n: uint(data, o + 4 + 2 * k, 2) for k, n in enumerate(counts)},
    }


_FLAT = "family int, src_addr binary, dst_addr binary, protocol string, src_port int, dst_port int, is_tcp boolean, seq bigint, ack_no bigint, syn boolean, ack boolean, fin boolean, rst boolean, dns_txid int, dns_is_response boolean, dns_rcode int, dns_qdcount int, dns_ancount int"
_NOTHING = (None, None, None, None, None, None, False, None, None, False, False, False, False, None, None, None, None, None)


def _after_extensions(d: bytes, at: int, stop: int, kind: int) -> tuple[int, int | None]:
    """Where the transport header of an IPv6 packet begins, and its protocol: None behind a later fragment or a chain that can't be read."""
    start, count = at, 0
    if kind == 0 and stop == at:
        return at, None
    while kind in _EXTENSIONS:
        size = 8 if kind == 44 or at + 2 > len(d) else (d[at + 1] + 2) * 4 if kind == 51 else (d[at + 1] + 1) * 8
        if (kind == 0 and count) or at + size > min(stop, len(d)) or count == MAX_EXTENSIONS or at + size - start > MAX_EXTENSION_BYTES or (kind == 51 and (size < 12 or size % 8)):
            return at, None
        if kind == 44 and int.from_bytes(d[at + 2 : at + 4], "big") >> 3:
            return at, None
        kind, at, count = d[at], at + size, count + 1
    return at, kind


def _flat(d: bytes | None) -> tuple:
    """The columns of _FLAT for one frame."""
    if d is None or len(d) < 14:
        return _NOTHING
    kind, at = int.from_bytes(d[12:14], "big"), 14
    if kind == 0x8100 and len(d) >= 18:
        kind, at = int.from_bytes(d[16:18], "big"), 18
    if kind == 0x0800 and len(d) >= at + 20 and d[at] >> 4 == 4 and d[at] & 15 >= 5:
        family, src, dst, after = 4, d[at + 12 : at + 16], d[at + 16 : at + 20], at + (d[at] & 15) * 4
        proto = None if int.from_bytes(d[at + 6 : at + 8], "big") & 0x1FFF else d[at + 9]
    elif kind == 0x86DD and len(d) >= at + 40 and d[at] >> 4 == 6:
        family, src, dst = 6, d[at + 8 : at + 24], d[at + 24 : at + 40]
        after, proto = _after_extensions(d, at + 40, at + 40 + int.from_bytes(d[at + 4 : at + 6], "big"), d[at + 6])
    else:
        return _NOTHING
    seq = ack_no = dns = None
    flags = 0
    if proto == 6 and len(d) >= after + 20 and d[after + 12] >> 4 >= 5:
        name, seq, ack_no, flags = "tcp", int.from_bytes(d[after + 4 : after + 8], "big"), int.from_bytes(d[after + 8 : after + 12], "big"), d[after + 13]
        end = after + (d[after + 12] >> 4) * 4
        if len(d) >= end + 2 and int.from_bytes(d[end : end + 2], "big") == len(d) - end - 2:
            dns = end + 2
    elif proto == 17 and len(d) >= after + 8 and int.from_bytes(d[after + 4 : after + 6], "big") >= 8:
        name, dns = "udp", after + 8
    else:
        return (family, src, dst, *_NOTHING[3:])
    ports = int.from_bytes(d[after : after + 2], "big"), int.from_bytes(d[after + 2 : after + 4], "big")
    asked: tuple = (None,) * 5
    if 53 in ports and dns is not None and len(d) >= dns + 8:
        asked = (int.from_bytes(d[dns : dns + 2], "big"), d[dns + 2] >= 0x80, d[dns + 3] & 15, int.from_bytes(d[dns + 4 : dns + 6], "big"), int.from_bytes(d[dns + 6 : dns + 8], "big"))
    return (family, src, dst, name, *ports, name == "tcp", seq, ack_no, bool(flags & 2), bool(flags & 16), bool(flags & 1), bool(flags & 4), *asked)


def flat_packets(frames: DataFrame) -> DataFrame:
    """Flow columns of Ethernet frames (data): network, transport and DNS header, for the flow operators.

    One VLAN tag and IPv6 extension headers are skipped. Fragments after the first, other protocols and cut headers give nulls, and
    such packets have no flow. The chain of headers, each placed by the one before, is one Arrow pass;
    single headers at known places are the native columns above.
    """
    names = [c.split()[0] for c in _FLAT.split(", ")]
    kept = [f for f in frames.schema.fields if f.name not in names]
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[c.split()[1]] for c in _FLAT.split(", ")]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_flat(d) for d in batch.column("data").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])

    return frames.select(*[f.name for f in kept]).mapInArrow(decoded, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _FLAT]))
