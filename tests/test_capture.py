"""Framing, decoding and the facade over small captures."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.functions.tree import EthernetDecoder, internet_checksum
from packetloom.session import Session
from packetloom.sources import pcap

MACS = bytes.fromhex("020000000001020000000002")


def ipv4(protocol, payload, source=bytes([192, 0, 2, 1]), destination=bytes([198, 51, 100, 2])):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 0, 0, 64, protocol, 0) + source + destination
    return MACS + b"\x08\x00" + head[:10] + struct.pack(">H", 0xFFFF - internet_checksum(head)) + head[12:] + payload


def udp(payload, source=53000, destination=53):
    return ipv4(17, struct.pack(">HHHH", source, destination, 8 + len(payload), 0) + payload)


QUERY = struct.pack(">HHHHHH", 7, 0x100, 1, 0, 0, 0) + b"\3www\7example\0" + struct.pack(">HH", 1, 1)
REPLY = struct.pack(">HHHHHH", 7, 0x8180, 1, 1, 0, 0) + QUERY[12:] + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([192, 0, 2, 7])


def names(tree):
    return [layer["protocol"] for layer in tree.layers], [d["code"] for d in tree.diagnostics]


def value(tree, name):
    return next(f for f in tree.fields if f["name"] == name)


def test_dns_over_udp():
    t = EthernetDecoder().decode(udp(REPLY, 53, 53000))
    assert names(t) == (["ethernet", "ipv4", "udp", "dns"], [])
    assert value(t, "name")["s"] == "www.example." and value(t, "address")["length"] == 4 and value(t, "header_checksum_valid")["u"] == 1


@pytest.mark.parametrize("payload, code", [(QUERY[:20], 8), (QUERY + b"x", 9), (struct.pack(">HHHHHH", 1, 0, 17, 0, 0, 0), 7), (struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c", 9)])
def test_dns_faults(payload, code):
    assert names(EthernetDecoder().decode(udp(payload)))[1] == [code]


def test_tcp_options_and_checksum():
    options = b"\x02\x04\x05\xb4\x01\x03\x03\x07\x04\x02\x00\x00"
    segment = struct.pack(">HHIIBBHHH", 1, 2, 3, 4, (20 + len(options)) // 4 << 4, 0x12, 512, 0, 0) + options
    t = EthernetDecoder().decode(ipv4(6, segment))
    assert names(t) == (["ethernet", "ipv4", "tcp"], [12])
    assert value(t, "maximum_segment_size")["length"] == 4 and value(t, "syn")["u"] == 1 and value(t, "fin")["u"] == 0
    bad = segment[:20] + b"\x02\x09\x05\xb4" + segment[24:]
    assert names(EthernetDecoder().decode(ipv4(6, bad)))[1] == [9]


def test_links():
    assert names(EthernetDecoder().decode(MACS[:5])) == (["ethernet"], [8])
    assert names(EthernetDecoder().decode(MACS + b"\x00\x10" + bytes(16))) == (["ethernet", "unsupported"], [10])
    tagged = MACS + b"\x81\x00\x00\x64\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes(20)
    t = EthernetDecoder().decode(tagged)
    assert names(t) == (["ethernet", "vlan", "arp"], []) and value(t, "vlan_identifier")["u"] == 100 and value(t, "is_request")["u"] == 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.sampled_from([b"\x08\x00", b"\x86\xdd", b"\x08\x06", b"\x81\x00"]))
def test_any_bytes_stay_inside(data, kind):
    frame = MACS + kind + data
    t = EthernetDecoder().decode(frame)
    for f in t.fields:
        assert 0 <= f["start"] and f["start"] + f["length"] <= len(frame)
        if f["parent_id"] is not None:
            assert f["parent_id"] < f["field_id"]
    for d in t.diagnostics:
        assert 0 <= d["start"] and d["start"] + d["length"] <= len(frame)


def ng(*blocks):
    return pcap.block_bytes(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + b"".join(blocks)


IDB = pcap.block_bytes(1, struct.pack("<HHI", 1, 0, 0))


def kinds(data, **limits):
    return [(r["kind"], r.get("code")) for r in pcap.Importer("x", data, pcap.Limits(**limits)).rows()]


def test_framing():
    whole = pcap.classic_bytes([(1, 5, b"abcd"), (2, 6, b"ef")])
    assert kinds(whole) == [("section", None), ("interface", None), ("packet", None), ("packet", None)]
    assert kinds(whole[:-1])[-1] == ("diagnostic", 2)
    epb = pcap.block_bytes(6, struct.pack("<IIIII", 0, 0, 3_000_001, 4, 4) + b"abcd")
    spb = pcap.block_bytes(3, struct.pack("<I", 4) + b"wxyz")
    rows = list(pcap.Importer("x", ng(IDB, epb, spb, pcap.block_bytes(5, b"")), pcap.Limits()).rows())
    assert [r["kind"] for r in rows] == ["interface", "packet", "packet", "diagnostic", "section"]
    assert (rows[1]["seconds"], rows[1]["fraction"], rows[1]["data"], rows[2]["seconds"], rows[2]["data"]) == (3, 1, b"abcd", None, b"wxyz")
    assert kinds(ng(epb))[0] == ("diagnostic", 1)
    for bad in (b"", b"\x7fELF" + bytes(30), whole[:20]):
        with pytest.raises(pcap.CaptureError):
            kinds(bad)
    with pytest.raises(pcap.CaptureError):
        kinds(whole, packets=1)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.booleans())
def test_any_capture(data, blocks):
    seed = ng(IDB) if blocks else pcap.classic_bytes([])
    last = len(seed + data)
    for r in pcap.Importer("x", seed + data, pcap.Limits(None, None)).rows():
        if r.get("offset") is not None:
            assert 0 <= r["offset"] and r["offset"] + r["length"] <= last


def test_session(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.classic_bytes([(1, 0, udp(QUERY)), (1, 250000, ipv4(17, struct.pack(">HHHH", 53, 53000, 8 + len(REPLY), 0) + REPLY, bytes([198, 51, 100, 2]), bytes([192, 0, 2, 1])))]))
    (tmp_path / "b.pcap").write_bytes(b"nothing")
    s = Session(spark, str(tmp_path))
    assert {r.capture_id[-6:]: (r.packets, r.diagnostics) for r in s.summary().collect()} == {"a.pcap": (2, 0), "b.pcap": (0, 1)}
    m = s.metrics().collect()
    assert len(m) == 1 and m[0].dns_response_ticks == 250_000 and m[0].packets_total == 2
    assert s.packets(1).count() == 1 and bytes(s.evidence(0, 0, 6).first().bytes) == MACS[:6]
    assert s.correlate(0, 12, 2).where("rank = 0").count() == 1
    assert s.extrema()[1][:2] == (1, 250000)


def test_streaming_matches_batch(spark, tmp_path):
    from packetloom.functions.decode import flat_packets
    from packetloom.operators.flows import bidirectional_flows
    from packetloom.streaming.flows import streaming_flows

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(pcap.classic_bytes([(i, 0, udp(QUERY, 53000 + i % 3)) for i in range(9)]))
    stream = streaming_flows(flat_packets(pcap.packets(pcap.stream_captures(spark, str(tmp_path / "in")))))
    query = stream.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = bidirectional_flows(flat_packets(pcap.packets(pcap.read_captures(spark, str(tmp_path / "in")))))
    columns = ["packets_a_to_b", "packets_b_to_a", "bytes_a_to_b"]
    assert sorted(map(tuple, spark.table("seen").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
