"""Registered queries over all packets of the events trace, against brute force on the smallest table."""

from collections import defaultdict

import pytest

from packetloom.plans.queries import R
from packetloom.plans.trace import events_trace

SF = "/root/testdata/sf0.001"
LAYERS = {"ethernet", "vlan", "ipv4", "ipv6", "tcp", "udp", "dns"}


@pytest.fixture(scope="module")
def packets(spark):
    return events_trace(spark, SF).select("packet_id", "captured_length", "family", "protocol", "src_port", "dst_port").collect()


def matches(packet_id):
    """Fields that the packet's selection hits, primary first."""
    s0, n = packet_id % 40, packet_id % 7
    s1, found = s0 + n, []
    for i in range(24):
        f0, size = i * 5 % 37, i * i % 9
        f1 = f0 + size
        if (n == 0 and size == 0 and f0 == s0) or (n and set(range(f0, f1)) & set(range(s0, s1))):
            holds = f0 <= s0 and f1 >= s1
            found.append((-((f0, f1) == (s0, s1)), -holds, size if holds else 0, max(f0, s0) - min(f1, s1), -(i % 4), size, i))
    return [x[-1] for x in sorted(found)]


def test_selections_of_all_packets(spark, packets):
    want = {p.packet_id: matches(p.packet_id) for p in packets}
    got = {(r.packet_id, r["rank"]): r.field_id for r in R.queries["correlate_fields"](spark, SF).collect()}
    assert got == {(p, k): f for p, fields in want.items() for k, f in enumerate(fields)}
    assert {r.selection_id: r.n for r in R.queries["range_overlap_join"](spark, SF).collect()} == {p: len(f) for p, f in want.items() if f}
    assert {r.packet_id for r in R.queries["selection_out_of_bounds"](spark, SF).collect()} == {p.packet_id for p in packets if p.packet_id % 40 + p.packet_id % 7 * 20 > p.captured_length}


def test_fields_of_all_layers(spark, packets):
    names = defaultdict(dict)
    for r in R.queries["field_preorder"](spark, SF).collect():
        names[r.packet_id][r.position] = r.name
    assert all(sorted(own) == list(range(len(own))) for own in names.values())
    for p in packets:
        want = ["ethernet", *(["vlan"] if p.packet_id % 11 == 0 else []), f"ipv{p.family}", p.protocol, *(["dns"] if p.protocol == "udp" and 53 in (p.src_port, p.dst_port) else [])]
        assert [names[p.packet_id][k] for k in sorted(names[p.packet_id]) if names[p.packet_id][k] in LAYERS] == want
    found = [r.name for r in R.queries["string_dictionary"](spark, SF).collect()]
    assert sorted(found) == sorted({n for own in names.values() for n in own.values()})
    assert {"vlan_identifier", "hop_limit", "sequence_number", "checksum", "transaction_id"} <= set(found)
