"""Flow analytics on small traces with known answers."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as X
from packetloom.plans.trace import PACKET_COLUMNS

NAMES = [c.split()[0] for c in PACKET_COLUMNS.split(", ")]
A, B = bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])


def packet(i, ts=None, back=False, proto="tcp", ports=(1000, 443), size=32, diag=(), interface=0, family=4, ends=(A, B), **more):
    src, dst = ends[::-1] if back else ends
    p = dict.fromkeys(NAMES) | {"capture_id": "c", "packet_id": i, "interface_id": interface, "res_kind": "decimal", "res_exp": 6, "captured_length": size, "original_length": size, "diag_codes": list(diag), "family": family, "src_addr": src, "dst_addr": dst, "protocol": proto, "src_port": ports[1] if back else ports[0], "dst_port": ports[0] if back else ports[1], "is_tcp": proto == "tcp"}
    p |= dict.fromkeys(("syn", "ack", "fin", "rst"), False) | more
    if ts is not None:
        p["seconds"], p["fraction"] = ts
    return tuple(p[n] for n in NAMES)


@pytest.fixture
def trace(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PACKET_COLUMNS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_two_opposite_packets(trace):
    r = one(X.bidirectional_flows(trace(packet(0, (10, 200), ports=(443, 443)), packet(1, (8, 900), back=True, ports=(443, 443)))))
    assert (r.packets_a_to_b, r.packets_b_to_a, r.bytes_a_to_b, r.bytes_b_to_a) == (1, 1, 32, 32)
    assert tuple(r.first_t) == (8, 900) and tuple(r.last_t) == (10, 200)


def test_separation_order_and_skips(trace):
    six = (bytes(15) + b"\1", bytes(15) + b"\2")
    p = trace(packet(0), packet(1, proto="udp"), packet(2, interface=1), packet(3, family=6, ends=six), packet(4, proto="icmp"), packet(5, ports=(None, None)))
    rows = X.flow_ids(X.bidirectional_flows(p)).orderBy("flow_id").collect()
    assert [(r.flow_id, r.interface_id, r.protocol, r.a.family) for r in rows] == [(0, 0, "tcp", 4), (1, 0, "tcp", 6), (2, 0, "udp", 4), (3, 1, "tcp", 4)]


def test_metrics_and_borrowed_seconds(trace):
    p = trace(packet(0, (1, 0)), packet(1, (1, 250000)), packet(2, (2, 0)))
    r = one(X.flow_metrics(p))
    assert (r.packets_total, r.bytes_total, r.duration_ticks, r.bin0, r.bin1, r.partial_capture) == (3, 96, 1_000_000, 3, 0, True)
    late = trace(packet(0, (1, 900000)), packet(1, (2, 100000)))
    assert one(X.flow_metrics(late)).duration_ticks is None
    assert one(X.flow_metrics(late, exact=True)).duration_ticks == 200_000


def test_handshake_first_data_and_establishment(trace):
    p = trace(packet(0, (1, 0), syn=True, seq=1), packet(1, (2, 0), True, syn=True, ack=True, seq=1), packet(2, (3, 0), ack=True, seq=2), packet(3, (4, 0), seq=3))
    m, s = one(X.flow_metrics(p)), one(X.tcp_flows(p))
    assert (m.handshake_ticks, m.first_data_ticks) == (2_000_000, 1_000_000)
    assert (s.establishment, s.establishment_confidence, s.first_syn, s.syn_ack, s.established, s.termination, s.partial_capture) == ("established", "certain", 0, 1, 2, "not_observed", True)


def test_reset_repeats_and_fins(trace):
    s = one(X.tcp_flows(trace(packet(0, syn=True), packet(1, back=True, rst=True))))
    assert (s.establishment, s.termination, s.reset) == ("failed_reset", "reset", 1)
    s = one(X.tcp_flows(trace(packet(0, (1, 0), syn=True), packet(1, (1, 250000), syn=True), packet(2, (2, 0), True, syn=True, ack=True))))
    assert (s.establishment, s.repeated_syn) == ("failed_repeated_syn", 1)
    s = one(X.tcp_flows(trace(packet(0, syn=True), packet(2, fin=True), packet(3, back=True, fin=True))))
    assert (s.termination, s.termination_confidence, s.first_fin, s.second_fin) == ("fin", "certain", 2, 3)


def test_indicators(trace):
    p = trace(packet(0, seq=10, syn=True), packet(1, back=True, seq=20, syn=True, ack=True), packet(2, seq=11), packet(3, back=True, seq=22, ack_no=12, ack=True), packet(4, back=True, seq=23, ack_no=12, ack=True), packet(5, seq=11), packet(6, seq=5))
    s = one(X.tcp_flows(p))
    assert (s.retransmission["first"], s.retransmission["second"], s.duplicate_ack["first"], s.duplicate_ack["second"], s.out_of_order["first"], s.out_of_order["second"]) == (2, 5, 3, 4, 5, 6)


def kinds(df):
    return [r.kind for r in df.orderBy("kind_order", "first").collect()]


def test_anomalies(trace):
    assert kinds(X.anomalies(trace(packet(0, (10, 0), syn=True), packet(1, (11, 0), True, syn=True, ack=True), packet(2, (14, 0), ack=True)))) == ["LongHandshake"]
    assert kinds(X.anomalies(trace(*(packet(i, seq=3000) for i in range(3)), packet(3, back=True)))) == ["ExcessiveRetransmission"]
    r = one(X.anomalies(trace(packet(0, syn=True), packet(1, back=True, rst=True, diag=(2,)))))
    assert (r.kind, r.confidence, r.limitations) == ("ConnectionReset", "inferred", "capture_truncated")
    dns = dict(proto="udp", ports=(5000, 53), dns_qdcount=1)
    q = trace(packet(0, (1, 0), dns_txid=1, dns_is_response=False, **dns), packet(1, (1, 250000), True, dns_txid=1, dns_is_response=True, dns_rcode=2, **dns), packet(2, dns_txid=2, dns_is_response=False, **dns))
    assert kinds(X.anomalies(q)) == ["DnsErrorResponse", "DnsRequestWithoutResponse"]
    assert one(X.dns_latency(q)).dns_response_ticks == 250_000


def test_timeline_and_zoom(trace):
    p = trace(*(packet(i, (1 + i, 0)) for i in range(6)))
    z = X.zoom(X.timeline(p), max_points=2).orderBy("entry").collect()
    assert [(r.packet_count, r.total_bytes, r.first_offset, r.last_offset) for r in z] == [(3, 96, 0, 2_000_000), (3, 96, 3_000_000, 5_000_000)]
    assert X.zoom(X.timeline(p), max_points=0).count() == 0 and X.zoom(X.timeline(p)).count() == 6
    t = X.timeline(trace(packet(0), packet(1, (5, 0), True), packet(2, (5, 0)))).orderBy("packet_id").collect()
    assert [(r.message_index, r.lane, r.offset_ticks) for r in t] == [(0, "a", None), (1, "b", 0), (2, "a", 0)]


def test_empty(trace, spark):
    p = spark.createDataFrame([], PACKET_COLUMNS)
    for f in (X.bidirectional_flows, X.tcp_flows, X.flow_metrics, X.anomalies, X.timeline):
        assert f(p).count() == 0
    assert X.flow_ids(X.bidirectional_flows(p)).select(F.max("flow_id")).first()[0] is None
