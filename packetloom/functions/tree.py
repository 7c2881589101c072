"""Protocol trees of packets: what loops, so what native columns can't say.

Headers are described as tables of (name, first bit, bits, kind) and read by one routine. The decoder of
a packet is a class so that a caller may register another one; an error in it costs that packet's rows
and leaves a diagnostic. Batches come and go through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Diagnostic codes, priorities of findings, limits.
TRUNCATED, MALFORMED, UNSUPPORTED, LIMIT, CHECKSUM = 8, 9, 10, 7, 12
SEVERITY = {TRUNCATED: "error", MALFORMED: "warning", UNSUPPORTED: "info", LIMIT: "warning", CHECKSUM: "warning"}
MAX_EXTENSIONS, MAX_EXTENSION_BYTES = 8, 512
DNS_QUESTIONS, DNS_RECORDS, DNS_NAMES, DNS_HOPS, DNS_TEXTS, DNS_NAME_BYTES = 16, 16, 64, 16, 16, 255

Spec = tuple[tuple[str, int, int, str], ...]  #: name, first bit, bits, kind: u(nsigned), b(oolean), x (bytes)


def _spec(text: str) -> Spec:
    """"name bits kind" in order, by commas; a "-" skips bits; "@n" goes to bit n."""
    out, at = [], 0
    for item in text.split(","):
        name, size, *kind = item.split()
        if name == "@":
            at = int(size)
            continue
        if name != "-":
            out.append((name, at, int(size), kind[0] if kind else "u"))
        at += int(size)
    return tuple(out)


ETHERNET = _spec("destination 48 x, source 48 x, ether_type 16")
VLAN = _spec("tag_protocol_identifier 16, tag_control_information 16, @ 16, priority_code_point 3, drop_eligible 1 b, vlan_identifier 12, inner_ether_type 16")
ARP = _spec("hardware_type 16, protocol_type 16, hardware_length 8, protocol_length 8, operation 16")
IPV4 = _spec("version 4, header_length_words 4, differentiated_services 6, explicit_congestion_notification 2, total_length 16, identification 16, flags 3, @ 48, reserved_flag 1 b, dont_fragment 1 b, more_fragments 1 b, fragment_offset 13, time_to_live 8, protocol 8, header_checksum 16, source_address 32 x, destination_address 32 x")
IPV6 = _spec("version 4, traffic_class 8, flow_label 20, payload_length 16, next_header 8, hop_limit 8, source_address 128 x, destination_address 128 x")
FRAGMENT = _spec("next_header 8, reserved 8, fragment_offset 13, - 2, more_fragments 1 b, identification 32")
TCP = _spec("source_port 16, destination_port 16, sequence_number 32, acknowledgment_number 32, data_offset_words 4, reserved 4, flags 8, @ 104, cwr 1 b, ece 1 b, urg 1 b, ack 1 b, psh 1 b, rst 1 b, syn 1 b, fin 1 b, window 16, checksum 16, urgent_pointer 16")
UDP = _spec("source_port 16, destination_port 16, length 16, checksum 16")
ICMP = _spec("type 8, code 8, checksum 16")
DNS = _spec("transaction_id 16, flags 16, @ 16, is_response 1 b, opcode 4, authoritative_answer 1 b, truncated 1 b, recursion_desired 1 b, recursion_available 1 b, reserved 1 b, authenticated_data 1 b, checking_disabled 1 b, response_code 4, question_count 16, answer_count 16, authority_count 16, additional_count 16")


@dataclass
class Tree:
    data: bytes
    fields: list[dict] = field(default_factory=list)
    layers: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    finding: tuple[int, int, int, int] | None = None  #: priority, code, start, length

    def add(self, name: str, start: int, length: int, parent: int | None = None, kind: str = "none", u: int | None = None, s: str | None = None) -> int:
        layer = len(self.layers) if parent is None else self.fields[parent]["layer_index"]
        depth = 0 if parent is None else self.fields[parent]["depth"] + 1
        self.fields.append({"field_id": len(self.fields), "parent_id": parent, "layer_index": layer, "depth": depth, "name": name, "kind": kind, "u": u, "s": s, "start": start, "length": length})
        return len(self.fields) - 1

    def layer(self, protocol: str, start: int, length: int) -> int:
        root = self.add(protocol, start, length)
        self.layers.append({"layer_index": len(self.layers), "protocol": protocol, "start": start, "length": length, "root_field": root})
        return root

    def read(self, spec: Spec, base: int, end: int, parent: int) -> dict[str, int]:
        """Adds the fields whose bytes all lie before end; what they hold, bytes as integers."""
        got = {}
        for name, bit, size, kind in spec:
            first, last = base + bit // 8, base + (bit + size + 7) // 8
            if last > end:
                continue
            value = int.from_bytes(self.data[first:last], "big") >> (-(bit + size) % 8) & ((1 << size) - 1)
            got[name] = value
            shown = {"u": "unsigned", "b": "boolean", "x": "bytes"}[kind]
            self.add(name, first, last - first, parent, shown, None if kind == "x" else value)
        return got

    def found(self, priority: int, code: int, start: int, length: int) -> None:
        """Of all findings of network, transport and application layers the first of the highest priority stays."""
        if self.finding is None or priority > self.finding[0]:
            self.finding = (priority, code, start, length)

    def tell(self, code: int, start: int, length: int) -> None:
        self.diagnostics.append({"code": code, "severity": SEVERITY[code], "start": start, "length": length})


def internet_checksum(*parts: bytes) -> int:
    """One's-complement sum of 16-bit words; an odd byte pairs with the next part's first."""
    whole = b"".join(parts)
    total = sum(whole[0::2]) * 256 + sum(whole[1::2])
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


@dataclass
class Network:
    version: int
    protocol: int
    start: int
    end: int  #: captured
    declared: int
    source: bytes
    destination: bytes | None  #: None where a route hides the last one
    fragmented: bool
    later_fragment: bool

    def checksum_valid(self, data: bytes, length: int) -> bool | None:
        if self.fragmented or self.destination is None or self.start + length > self.end:
            return None
        pseudo = self.source + self.destination + (bytes([0, self.protocol]) + length.to_bytes(2, "big") if self.version == 4 else length.to_bytes(4, "big") + bytes([0, 0, 0, self.protocol]))
        return internet_checksum(pseudo, data[self.start : self.start + length]) == 0xFFFF


class EthernetDecoder:
    """Ethernet II, one VLAN tag, ARP, IPv4, IPv6, TCP, UDP, ICMP and DNS."""

    link_type = 1

    def decode(self, data: bytes) -> Tree:
        t = Tree(data)
        root = t.layer("ethernet", 0, min(14, len(data)))
        got = t.read(ETHERNET, 0, len(data), root)
        if "ether_type" not in got:
            t.tell(TRUNCATED, 0, len(data))
        else:
            self._dispatch(t, got["ether_type"], 12, 14, False)
        if t.finding:
            t.tell(*t.finding[1:])
        return t

    def _dispatch(self, t: Tree, kind: int, at: int, start: int, tagged: bool) -> None:
        if kind == 0x0806:
            self._arp(t, start)
        elif kind == 0x8100 and not tagged:
            self._vlan(t)
        elif kind == 0x0800:
            self._ipv4(t, start)
        elif kind == 0x86DD:
            self._ipv6(t, start)
        elif kind <= 1500:
            self._unsupported(t, "ieee_802_3", at, start)
        elif kind < 1536:
            t.tell(MALFORMED, at, 2)
            self._unsupported(t, "ambiguous_type_or_length", at, start)
        elif kind in (0x88A8, 0x9100):
            self._unsupported(t, "provider_vlan", at, start)
        elif kind == 0x8100:
            self._unsupported(t, "stacked_vlan", at, start)

    def _unsupported(self, t: Tree, what: str, at: int, start: int) -> None:
        root = t.add(what, at, len(t.data) - at)
        t.layers.append({"layer_index": len(t.layers), "protocol": "unsupported", "start": at, "length": len(t.data) - at, "root_field": root})
        if start < len(t.data):
            t.add("data", start, len(t.data) - start, root, "bytes")
        t.tell(UNSUPPORTED, at, len(t.data) - at)

    def _vlan(self, t: Tree) -> None:
        end = min(18, len(t.data))
        got = t.read(VLAN, 12, end, t.layer("vlan", 12, end - 12))
        if "inner_ether_type" not in got:
            t.tell(TRUNCATED, 12, end - 12)
        else:
            self._dispatch(t, got["inner_ether_type"], 16, 18, True)

    def _arp(self, t: Tree, at: int) -> None:
        end = len(t.data)
        got_length = min(28, end - at)
        root = t.layer("arp", at, got_length)
        got = t.read(ARP, at, end, root)
        if "operation" not in got:
            return t.tell(TRUNCATED, at, end - at)
        if got["hardware_type"] != 1 or got["protocol_type"] != 0x0800:
            return self._unsupported(t, "arp_addressing", at, at + 8)
        if (got["hardware_length"], got["protocol_length"]) != (6, 4):
            return t.tell(MALFORMED, at + 4, 2)
        if got["operation"] not in (1, 2):
            return self._unsupported(t, "arp_operation", at + 6, at + 8)
        t.add("is_request", at + 6, 2, root, "boolean", int(got["operation"] == 1))
        t.add("is_reply", at + 6, 2, root, "boolean", int(got["operation"] == 2))
        o = at + 8
        for name, n in (("sender_hardware_address", 6), ("sender_protocol_address", 4), ("target_hardware_address", 6), ("target_protocol_address", 4)):
            if o + n > end:
                return t.tell(TRUNCATED, at, end - at)
            t.add(name, o, n, root, "bytes")
            o += n

    # --- network -----------------------------------------------------------------------------
    def _ipv4(self, t: Tree, at: int) -> None:
        d, end = t.data, len(t.data)
        root = t.layer("ipv4", at, max(0, min(end - at, (d[at] & 15) * 4 if at < end and (d[at] & 15) >= 5 else 20)))
        got = t.read(IPV4, at, end, root)
        if not got:
            return t.found(100, TRUNCATED, at, end - at)
        words = got["header_length_words"]
        t.add("header_length", at, 1, root, "unsigned", words * 4)
        if got["version"] != 4 or words < 5:
            return t.found(120, MALFORMED, at, 1)
        header = words * 4
        if "destination_address" not in got or at + header > end:
            return t.found(100, TRUNCATED, at, end - at)
        t.add("fragment_offset_bytes", at + 6, 2, root, "unsigned", got["fragment_offset"] * 8)
        good = internet_checksum(d[at : at + header]) == 0xFFFF
        t.add("header_checksum_valid", at + 10, 2, root, "boolean", int(good))
        if not good:
            t.found(10, CHECKSUM, at + 10, 2)
        total, offset, more = got["total_length"], got["fragment_offset"], got["more_fragments"]
        if total < header:
            return t.found(90, MALFORMED, at + 2, 2)
        if total > end - at:
            t.found(100, TRUNCATED, at + 2, 2)
        if got["reserved_flag"] or (got["dont_fragment"] and (more or offset)) or (more and (total - header) % 8):
            return t.found(80, MALFORMED, at + 6, 2)
        routed, o = False, at + 20
        while o < at + header:
            kind = d[o]
            if kind == 0:
                t.add("end_of_options", o, at + header - o, root, "unsigned", 0)
                break
            if kind == 1:
                t.add("no_operation", o, 1, root, "unsigned", 1)
                o += 1
                continue
            n = d[o + 1] if o + 1 < at + header else 0
            if n < 2 or o + n > at + header:
                return t.found(90, MALFORMED, o, at + header - o)
            option = t.add("option", o, n, root)
            t.add("type", o, 1, option, "unsigned", kind)
            t.add("length", o + 1, 1, option, "unsigned", n)
            if n > 2:
                t.add("data", o + 2, n - 2, option, "bytes")
            routed |= kind in (131, 137)
            o += n
        self._transport(t, Network(4, got["protocol"], at + header, min(end, at + total), total - header, d[at + 12 : at + 16], None if routed else d[at + 16 : at + 20], bool(more or offset), bool(offset)))

    def _ipv6(self, t: Tree, at: int) -> None:
        d, end = t.data, len(t.data)
        root = t.layer("ipv6", at, min(40, end - at))
        got = t.read(IPV6, at, end, root)
        if "version" in got and got["version"] != 6:
            return t.found(120, MALFORMED, at, 1)
        if "destination_address" not in got:
            return t.found(100, TRUNCATED, at, end - at)
        length, o, kind = got["payload_length"], at + 40, got["next_header"]
        if length == 0 and kind == 0 and end > o:
            root = t.add("jumbogram", o, end - o)
            t.layers.append({"layer_index": len(t.layers), "protocol": "unsupported", "start": o, "length": end - o, "root_field": root})
            return t.found(50, UNSUPPORTED, o, end - o)
        stop = o + length
        if stop > end:
            t.found(100, TRUNCATED, at + 4, 2)
        routed = fragmented = later = False
        count, start, selector = 0, o, at + 6  # selector: where the next header's kind stands
        while kind in (0, 43, 44, 51, 60):
            if kind == 0 and count:
                return t.found(120, MALFORMED, o, min(1, max(0, end - o)))
            size = 8 if kind == 44 else 8 if o + 2 > end else (d[o + 1] + 2) * 4 if kind == 51 else (d[o + 1] + 1) * 8
            if o + (8 if kind == 44 else 2) > stop or o + size > stop or (kind == 51 and (size < 12 or size % 8)):
                return t.found(120, MALFORMED, o, max(0, min(end, stop) - o))
            if count == MAX_EXTENSIONS or o + size - start > MAX_EXTENSION_BYTES:
                root = t.add("unsupported_ipv6_extension_chain", selector, 1)
                t.layers.append({"layer_index": len(t.layers), "protocol": "unsupported", "start": selector, "length": 1, "root_field": root})
                t.add("next_header", selector, 1, root, "unsigned", kind)
                return t.found(110, LIMIT, selector, 1)
            if o + size > end:
                return t.found(100, TRUNCATED, o, max(0, end - o))
            name = {0: "hop_by_hop_options", 43: "routing", 44: "fragment", 51: "authentication", 60: "destination_options"}[kind]
            root = t.layer(f"ipv6_{name}", o, size)
            if kind == 44:
                f = t.read(FRAGMENT, o, end, root)
                t.add("fragment_offset_bytes", o + 2, 2, root, "unsigned", f["fragment_offset"] * 8)
                fragmented, later = bool(f["fragment_offset"] or f["more_fragments"]), f["fragment_offset"] > 0
            else:
                t.add("next_header", o, 1, root, "unsigned", d[o])
                t.add("payload_length" if kind == 51 else "header_extension_length", o + 1, 1, root, "unsigned", d[o + 1])
                if kind == 51:
                    t.add("security_parameters_index", o + 4, 4, root, "unsigned", int.from_bytes(d[o + 4 : o + 8], "big"))
                    t.add("sequence_number", o + 8, 4, root, "unsigned", int.from_bytes(d[o + 8 : o + 12], "big"))
                    t.add("authentication_data", o + 12, size - 12, root, "bytes")
                elif kind == 43:
                    routed = True
                    t.add("routing_type", o + 2, 1, root, "unsigned", d[o + 2])
                    t.add("segments_left", o + 3, 1, root, "unsigned", d[o + 3])
                    t.add("data", o + 4, size - 4, root, "bytes")
                else:
                    t.add("data", o + 2, size - 2, root, "bytes")
            kind, selector, o, count = d[o], o, o + size, count + 1
            if later:
                return None
        if kind == 50:
            root = t.layer("ipv6_esp", o, max(0, min(end, stop) - o))
            if o + 8 > min(end, stop):
                return t.found(100, TRUNCATED, o, max(0, end - o))
            t.read(_spec("security_parameters_index 32, sequence_number 32"), o, end, root)
            t.add("data", o + 8, min(end, stop) - o - 8, root, "bytes")
            return t.found(50, UNSUPPORTED, o, min(end, stop) - o)
        self._transport(t, Network(6, kind, o, min(end, stop), stop - o, d[at + 8 : at + 24], None if routed else d[at + 24 : at + 40], fragmented, later))

    # --- transport ---------------------------------------------------------------------------
    def _transport(self, t: Tree, n: Network) -> None:
        if n.later_fragment:
            return
        if n.protocol == 6:
            self._tcp(t, n)
        elif n.protocol == 17:
            self._udp(t, n)
        elif n.protocol == (1 if n.version == 4 else 58):
            self._icmp(t, n)

    def _checksum(self, t: Tree, n: Network, root: int, length: int, at: int) -> None:
        good = n.checksum_valid(t.data, length)
        if good is not None:
            t.add("checksum_valid", at, 2, root, "boolean", int(good))
            if not good:
                t.found(10, CHECKSUM, at, 2)

    def _short(self, t: Tree, n: Network, need: int) -> None:
        """A header that the datagram itself can't hold is malformed; one that was not captured is truncated."""
        if not n.fragmented and n.declared < need:
            t.found(120, MALFORMED, n.start, n.end - n.start)
        elif n.end - n.start < n.declared:
            t.found(100, TRUNCATED, n.start, n.end - n.start)

    def _udp(self, t: Tree, n: Network) -> None:
        size = n.end - n.start
        root = t.layer("udp", n.start, max(0, min(8, size)))
        got = t.read(UDP, n.start, n.end, root)
        if "checksum" not in got:
            return self._short(t, n, 8)
        if not n.fragmented and n.version == 6 and got["checksum"] == 0:
            t.found(10, CHECKSUM, n.start + 6, 2)
        if got["length"] < 8:
            return t.found(120, MALFORMED, n.start + 4, 2)
        if n.fragmented:
            return None
        if got["length"] > n.declared:
            return t.found(120, MALFORMED, n.start + 4, 2)
        if got["length"] > size:
            return t.found(100, TRUNCATED, n.start + 4, 2)
        if got["checksum"]:
            self._checksum(t, n, root, got["length"], n.start + 6)
        if 53 in (got["source_port"], got["destination_port"]):
            self._dns(t, n.start + 8, n.start + got["length"])

    def _tcp(self, t: Tree, n: Network) -> None:
        d, size = t.data, n.end - n.start
        header = (d[n.start + 12] >> 4) * 4 if size > 12 else 20
        root = t.layer("tcp", n.start, max(0, min(max(20, header), size)))
        got = t.read(TCP, n.start, n.end, root)
        if "urgent_pointer" not in got:
            return self._short(t, n, 20)
        t.add("header_length", n.start + 12, 1, root, "unsigned", header)
        if header < 20 or (not n.fragmented and header > n.declared):
            return t.found(120, MALFORMED, n.start + 12, 1)
        if header > size:
            return t.found(100, TRUNCATED, n.start, size)
        self._checksum(t, n, root, n.declared, n.start + 16)
        if not self._tcp_options(t, root, n.start + 20, n.start + header):
            return t.found(120, MALFORMED, n.start + 20, header - 20)
        start = n.start + header
        if not n.fragmented and size == n.declared and 53 in (got["source_port"], got["destination_port"]) and n.end - start >= 2 and int.from_bytes(d[start : start + 2], "big") == n.end - start - 2:
            self._dns(t, start + 2, n.end)

    def _tcp_options(self, t: Tree, root: int, o: int, end: int) -> bool:
        d = t.data
        fixed = {2: ("maximum_segment_size", 4), 3: ("window_scale", 3), 4: ("selective_acknowledgment_permitted", 2), 8: ("timestamps", 10)}
        while o < end:
            kind = d[o]
            if kind == 0:
                t.add("end_of_options", o, end - o, root, "unsigned", 0)
                return not any(d[o:end])
            if kind == 1:
                t.add("no_operation", o, 1, root, "unsigned", 1)
                o += 1
                continue
            n = d[o + 1] if o + 1 < end else 0
            name, want = fixed.get(kind, ("selective_acknowledgment" if kind == 5 else "option", n))
            if n < 2 or o + n > end or n != want or (kind == 5 and (n < 10 or (n - 2) % 8)):
                return False
            option = t.add(name, o, n, root)
            t.add("kind", o, 1, option, "unsigned", kind)
            t.add("length", o + 1, 1, option, "unsigned", n)
            if kind in (2, 3):
                t.add("value", o + 2, n - 2, option, "unsigned", int.from_bytes(d[o + 2 : o + n], "big"))
            elif kind == 8:
                t.read(_spec("timestamp_value 32, timestamp_echo_reply 32"), o + 2, o + n, option)
            elif kind == 5:
                for b in range(o + 2, o + n, 8):
                    t.read(_spec("left_edge 32, right_edge 32"), b, b + 8, option)
            elif n > 2:
                t.add("data", o + 2, n - 2, option, "bytes")
            o += n
        return True

    def _icmp(self, t: Tree, n: Network) -> None:
        d, size = t.data, n.end - n.start
        v4 = n.version == 4
        root = t.layer("icmp" if v4 else "icmpv6", n.start, max(0, min(8, size)))
        got = t.read(ICMP, n.start, n.end, root)
        kind = got.get("type")
        echo, rest = ((0, 8), (3, 11)) if v4 else ((128, 129), (1, 3))
        need = 8 if kind in (*echo, *rest, *((12,) if v4 else (2, 4))) else 4
        if size < need:
            return self._short(t, n, need)
        o = n.start + 4
        if kind in echo:
            t.read(_spec("identifier 16, sequence_number 16"), o, n.end, root)
        elif kind in rest:
            t.add("rest_of_header", o, 4, root, "bytes")
        elif v4 and kind == 12:
            t.add("pointer", o, 1, root, "unsigned", d[o])
        elif not v4 and kind in (2, 4):
            t.add("mtu" if kind == 2 else "pointer", o, 4, root, "unsigned", int.from_bytes(d[o : o + 4], "big"))
        if v4 and not n.fragmented and size >= n.declared:
            good = internet_checksum(d[n.start : n.start + n.declared]) == 0xFFFF
            t.add("checksum_valid", n.start + 2, 2, root, "boolean", int(good))
            if not good:
                t.found(10, CHECKSUM, n.start + 2, 2)
        elif not v4:
            self._checksum(t, n, root, n.declared, n.start + 2)

    # --- DNS ---------------------------------------------------------------------------------
    def _dns(self, t: Tree, start: int, end: int) -> None:
        root = t.layer("dns", start, end - start)
        try:
            DnsReader(t, root, start, end).read()
        except DnsFault as fault:
            t.found(*fault.args)


class DnsFault(Exception):
    """priority, code, start, length."""


# RDATA of class IN, by type: its name and its parts (n a name, 2 and 4 unsigned, x bytes).
RDATA = {1: "address x", 28: "address x", 2: "name_server n", 5: "canonical_name n", 12: "domain_name n", 15: "preference 2, exchange n", 6: "primary_name_server n, responsible_mailbox n, serial 4, refresh 4, retry 4, expire 4, minimum 4"}


class DnsReader:
    def __init__(self, t: Tree, root: int, start: int, end: int):
        self.t, self.d, self.root, self.start, self.end = t, t.data, root, start, end
        self.names = self.texts = 0
        self.boundaries: set[int] = set()  #: where labels of read names begin, from the message's start

    def fail(self, priority: int, at: int) -> None:
        raise DnsFault(priority, {100: TRUNCATED, 110: LIMIT, 120: MALFORMED}[priority], at, max(0, self.end - at))

    def need(self, at: int, n: int, end: int | None = None) -> None:
        if at + n > (self.end if end is None else end):
            self.fail(100 if end is None else 120, at)

    def name(self, at: int) -> tuple[str, int]:
        """The name at a place, escaped, and where the next thing begins."""
        self.names += 1
        if self.names > DNS_NAMES:
            self.fail(110, at)
        out, o, after, hops, size, mine = [], at, None, 0, 1, []
        while True:
            self.need(o, 1)
            n = self.d[o]
            if n >= 0xC0:
                self.need(o, 2)
                target = ((n & 0x3F) << 8 | self.d[o + 1]) + self.start
                hops += 1
                if hops > DNS_HOPS:
                    self.fail(110, o)
                if target >= o or target - self.start not in self.boundaries:
                    self.fail(120, o)
                after, o = o + 2 if after is None else after, target
            elif n >= 0x40:
                self.fail(120, o)
            elif n == 0:
                mine.append(o - self.start)
                break
            else:
                self.need(o, n + 1)
                size += n + 1
                if size > DNS_NAME_BYTES:
                    self.fail(120, o)
                mine.append(o - self.start)
                out.append("".join(chr(b) if 33 <= b <= 126 and b not in b".\\" else f"\\{b:03d}" for b in self.d[o + 1 : o + 1 + n]))
                o += n + 1
        self.boundaries.update(mine)
        return ".".join(out) + ".", o + 1 if after is None else after

    def add_name(self, label: str, at: int, parent: int) -> int:
        text, after = self.name(at)
        self.t.add(label, at, after - at, parent, "string", None, text)
        return after

    def read(self) -> None:
        got = self.t.read(DNS, self.start, self.end, self.root)
        if "additional_count" not in got:
            self.fail(100, self.start)
        counts = [got[k] for k in ("answer_count", "authority_count", "additional_count")]
        if got["question_count"] > DNS_QUESTIONS:
            self.fail(110, self.start + 4)
        if sum(counts) > DNS_RECORDS:
            self.fail(110, self.start + 6)
        o = self.start + 12
        for _ in range(got["question_count"]):
            q = self.t.add("question", o, 0, self.root)
            first, o = o, self.add_name("name", o, q)
            self.need(o, 4)
            self.t.read(_spec("type 16, class 16"), o, o + 4, q)
            o += 4
            self.t.fields[q]["length"] = o - first
        for label, n in zip(("answer", "authority", "additional"), counts, strict=True):
            for _ in range(n):
                o = self.record(label, o)
        if o < self.end:
            self.fail(120, o)

    def record(self, label: str, at: int) -> int:
        """Adds a record, or nothing of one that can't be read."""
        before = len(self.t.fields)
        try:
            return self.whole_record(label, at)
        except DnsFault:
            del self.t.fields[before:]
            raise

    def whole_record(self, label: str, at: int) -> int:
        r = self.t.add(label, at, 0, self.root)
        o = self.add_name("name", at, r)
        self.need(o, 10)
        got = self.t.read(_spec("type 16, class 16, ttl 32, rdata_length 16"), o, o + 10, r)
        o += 10
        end = o + got["rdata_length"]
        if end > self.end:
            self.fail(100, o)
        self.t.fields[r]["length"] = end - at
        kind = got["type"] if got["class"] == 1 else None
        if kind in (1, 28) and end - o != (4 if kind == 1 else 16):
            self.fail(120, o)
        if kind == 16:
            if o == end:
                self.fail(120, o - 2)
            while o < end:
                self.texts += 1  # of the whole message
                if self.texts > DNS_TEXTS:
                    self.fail(110, o)
                self.need(o, 1 + self.d[o], end)
                self.t.add("text", o + 1, self.d[o], r, "bytes")
                o += 1 + self.d[o]
        elif kind in RDATA:
            for part in RDATA[kind].split(", "):
                name, how = part.split()
                if how == "n":
                    o = self.add_name(name, o, r)
                elif how == "x":
                    self.t.add(name, o, end - o, r, "bytes")
                    o = end
                else:
                    self.need(o, int(how), end)
                    self.t.read(_spec(f"{name} {8 * int(how)}"), o, o + int(how), r)
                    o += int(how)
            if o != end:
                self.fail(120, o)
        elif end > o:
            self.t.add("data", o, end - o, r, "bytes")
        return end


_FIELD = "struct<field_id:int,parent_id:int,layer_index:int,depth:int,name:string,kind:string,u:bigint,s:string,start:int,length:int>"
_LAYER = "struct<layer_index:int,protocol:string,start:int,length:int,root_field:int>"
_DIAGNOSTIC = "struct<code:int,severity:string,start:int,length:int>"
_A_FIELD = pa.struct([("field_id", pa.int32()), ("parent_id", pa.int32()), ("layer_index", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("u", pa.int64()), ("s", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
_A_LAYER = pa.struct([("layer_index", pa.int32()), ("protocol", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("root_field", pa.int32())])
_A_DIAGNOSTIC = pa.struct([("code", pa.int32()), ("severity", pa.string()), ("start", pa.int32()), ("length", pa.int32())])


#: Packets whose trees are Python objects at one time: a tree takes some 20 KB as such.
TOGETHER = 512


def decode_trees(packets: DataFrame, decoder: Callable[[], object] = EthernetDecoder, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """capture_id, packet_id, keep, layers, fields, diagnostics: the tree of each packet (column data), narrow work.

    An error of the decoder fails the query if strict; else that packet has no rows and one diagnostic
    of code 9. Packets of another link_type than the decoder's, if there is such a column, have none.
    """
    names = ["capture_id", "packet_id", *keep, "data", *(["link_type"] if "link_type" in packets.columns else [])]
    kept = ["capture_id", "packet_id", *keep]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder()
        for batch in (whole.slice(a, TOGETHER) for whole in batches for a in range(0, whole.num_rows, TOGETHER)):
            links = batch.column("link_type").to_pylist() if "link_type" in names else [d.link_type] * batch.num_rows
            trees = []
            for data, link in zip(batch.column("data").to_pylist(), links, strict=True):
                tree = Tree(data or b"")
                if data is not None and link == d.link_type:
                    try:
                        tree = d.decode(data)
                    except Exception:
                        if strict:
                            raise
                        tree.tell(MALFORMED, 0, len(data))
                trees.append(tree)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([t.layers for t in trees], pa.list_(_A_LAYER)), pa.array([t.fields for t in trees], pa.list_(_A_FIELD)), pa.array([t.diagnostics for t in trees], pa.list_(_A_DIAGNOSTIC))], [*kept, "layers", "fields", "diagnostics"])

    wanted = packets.select(*names)
    also = "".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}, " for c in keep)
    return wanted.mapInArrow(decoded, f"capture_id string, packet_id bigint, {also}layers array<{_LAYER}>, fields array<{_FIELD}>, diagnostics array<{_DIAGNOSTIC}>")


def table(trees: DataFrame, which: str) -> DataFrame:
    """layers, fields or diagnostics, a row each. Fields are in preorder by field_id within their layer."""
    rows = trees.selectExpr("capture_id", "packet_id", f"inline({which})")
    return rows.withColumn("preorder", rows.field_id) if which == "fields" else rows
