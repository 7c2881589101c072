"""What the trace doesn't show: other resolutions, several captures, damaged messages, limits, hexadecimal views."""

import struct

import pytest
from pyspark.sql import functions as F

from packetloom.functions import decode, tree
from packetloom.functions.time import ticks_per_second
from packetloom.functions.tree import EthernetDecoder
from packetloom.operators import correlate, flows, paging, validate
from packetloom.session import Session
from packetloom.sinks import captures as sink
from packetloom.sources import pcap

MACS = bytes.fromhex("020000000001020000000002")


def udp_dns(message):
    udp = struct.pack(">HHHH", 53, 50000, 8 + len(message), 0) + message
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0) + bytes([10, 0, 0, 1, 192, 0, 2, 2])
    return MACS + b"\x08\x00" + head + udp


def record(kind, rdata, owner=b"\x01a\x00"):
    return owner + struct.pack(">HHIH", kind, 1, 60, len(rdata)) + rdata


def dns(*records):
    return udp_dns(struct.pack(">HHHHHH", 7, 0x8180, 0, len(records), 0, 0) + b"".join(records))


def answers(frame):
    t = EthernetDecoder().decode(frame)
    return sum(f["name"] == "answer" for f in t.fields), [d["code"] for d in t.diagnostics], t


def test_records_are_whole_or_absent():
    good = record(16, b"\x01x")
    assert answers(dns(good, good))[0] == 2
    for bad in (record(16, b""), record(16, b"\x05x"), record(1, b"abc"), record(15, b"\x00"), record(2, b"\x00z"), record(6, b"\x00\x00" + bytes(19))):
        n, codes, t = answers(dns(good, bad))
        assert (n, codes) == (1, [9]) and [f["field_id"] for f in t.fields] == list(range(len(t.fields)))


def test_texts_are_limited_over_the_message():
    nine = record(16, b"\x00" * 9)
    assert answers(dns(nine))[:2] == (1, [12])
    assert answers(dns(nine, nine))[:2] == (1, [7])
    assert answers(dns(record(16, b"\x00" * 8), record(16, b"\x00" * 8)))[:2] == (2, [12])


def ipv6(next_header, body):
    return MACS + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), next_header, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + body


TCP = struct.pack(">HHIIHHHH", 5000, 443, 1, 2, 0x5010, 100, 0, 0)


def test_a_long_chain_leaves_a_marker():
    chain = b"".join(bytes([60 if k < 8 else 6, 0]) + bytes(6) for k in range(9))
    t = EthernetDecoder().decode(ipv6(60, chain + TCP))
    assert t.layers[-1]["protocol"] == "unsupported" and (t.layers[-1]["start"], t.layers[-1]["length"]) == (14 + 40 + 56, 1)
    assert t.fields[-1]["name"] == "next_header" and t.fields[-1]["u"] == 60 and [d["code"] for d in t.diagnostics] == [7]


@pytest.mark.parametrize("first, chain, found", [(6, b"", True), (0, b"\x06\x00" + bytes(6), True), (43, b"\x3c\x00" + bytes(6) + b"\x06\x01" + bytes(14), True), (51, b"\x06\x02" + bytes(14), True), (44, b"\x06\x00\x00\x01" + bytes(4), True), (44, b"\x06\x00\x00\x09" + bytes(4), False), (60, b"\x00\x00" + bytes(6) + b"\x06\x00" + bytes(6), False), (60, b"\x06\x09" + bytes(6), False)])
def test_flat_and_tree_agree_behind_extensions(first, chain, found):
    frame = ipv6(first, chain + TCP)
    assert (decode._flat(frame)[3] == "tcp") == found
    assert any(x["protocol"] == "tcp" for x in EthernetDecoder().decode(frame).layers) == found


def written(tmp_path, style, packets, name):
    (tmp_path / name).write_bytes(sink.encoded(packets, style))


def v4(sport, dport, flags, seq=1):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 100, 0, 0)
    addresses = bytes([10, 0, 0, 1, 192, 0, 2, 2]) if sport > dport else bytes([192, 0, 2, 2, 10, 0, 0, 1])
    return MACS + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 40, 0, 0, 64, 6, 0) + addresses + tcp


def test_durations_in_ticks_of_each_capture(spark, tmp_path):
    per = {"micro_little": 10**6, "nano_big": 10**9, "blocks_nano_little": 10**9, "blocks_binary_big": 1 << 20}
    for style, n in per.items():
        syn, answer, done = v4(40000, 443, 2), v4(443, 40000, 18), v4(40000, 443, 16)
        written(tmp_path, style, [(0, 10, 0, 54, syn), (0, 10, n // 2, 54, answer), (0, 13, 7, 54, done)], f"{style}.pcap")
    s = Session(spark, str(tmp_path))
    got = {r.capture_id.split("/")[-1].removesuffix(".pcap"): r for r in s.metrics().collect()}
    assert {k: (r.ticks_per_second, r.duration_ticks, r.handshake_ticks) for k, r in got.items()} == {k: (n, 3 * n + 7, 3 * n + 7) for k, n in per.items()}
    long = [r for r in s.anomalies().collect() if r.kind == "LongHandshake"]
    assert len(long) == 4


def test_captures_stay_apart(spark, tmp_path):
    for name in ("a.pcap", "b.pcap"):
        written(tmp_path, "micro_little", [(0, 1, 0, 54, v4(40000, 443, 2)), (0, 2, 0, 54, v4(443, 40000, 18))], name)
    s = Session(spark, str(tmp_path))
    got = s.correlate(1, 26, 4).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r.capture_id, []).append(r["rank"])
    assert len(ranks) == 2 and all(sorted(x) == list(range(len(x))) for x in ranks.values()) and len(set(map(len, ranks.values()))) == 1
    one = next(iter(ranks))
    assert s.correlate(1, 26, 4, one).count() == len(ranks[one]) and s.detail(1, one).count() == 1 and s.detail(1).count() == 2
    fields = tree.table(s._trees, "fields")
    places = correlate.preorder(fields).groupBy("capture_id", "packet_id").agg(F.max("position").alias("p"), F.count("*").alias("n")).collect()
    assert len(places) == 4 and all(r.p == r.n - 1 for r in places)
    assert {bytes(r.bytes) for r in s.capture_evidence(24 + 16, 12).collect()} == {MACS}
    with pytest.raises(Exception, match="evidence_out_of_range"):
        s.capture_evidence(24 + 16, 1000).collect()


def test_limits_and_their_categories(spark, tmp_path):
    style, frames = "blocks_nano_little", [(0, 1, 0, 54, v4(40000, 443, 2))] * 3
    data = sink.encoded(frames, style)
    for limits, category in ((pcap.Limits(packets=2), "resource_limit"), (pcap.Limits(string_bytes=3), "resource_limit"), (pcap.Limits(options=1), "resource_limit"), (pcap.Limits(block_bytes=40), "resource_limit")):
        with pytest.raises(pcap.CaptureError) as e:
            list(pcap.Importer("x", data, limits).rows())
        assert e.value.category == category
    for raw, category in ((b"\x7fELF" + bytes(40), "invalid_header"), (data[:20], "truncated_input"), (b"", "truncated_input")):
        with pytest.raises(pcap.CaptureError) as e:
            list(pcap.Importer("x", raw).rows())
        assert e.value.category == category
    with pytest.raises(pcap.CaptureError):
        pcap.Limits(packets=0)
    assert pcap.admission(0).packets == 1024 and pcap.admission(1 << 27).packets == 131_072
    with pytest.raises(pcap.CaptureError):
        pcap.admission((256 << 20) + 1)
    (tmp_path / "x.pcapng").write_bytes(data)
    got = pcap.read_captures(spark, str(tmp_path), pcap.Limits(capture_bytes=100)).collect()
    assert [(r.kind, r.code, r.severity) for r in got] == [("diagnostic", 7, "fatal")]
    with pytest.raises(Exception, match="resource_limit"):
        pcap.read_captures(spark, str(tmp_path), pcap.Limits(capture_bytes=100), "FAILFAST").collect()


def test_pages_of_bytes(spark):
    raw = [bytes(range(40)), b"plain text, 16 b and more", b"", None, bytes(16)]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(raw)], "k int, b binary")
    got = {r.k: [(x.offset, x.hex, x.ascii) for x in (r.h or [])] for r in df.select("k", paging.hex_rows(F.col("b")).alias("h")).collect()}
    for k, b in enumerate(raw):
        parts = [(b or b"")[i : i + 16] for i in range(0, len(b or b""), 16)]
        assert got[k] == [(16 * i, p.hex(" "), "".join(chr(c) if 32 <= c < 127 else "." for c in p)) for i, p in enumerate(parts)]
    at = lambda start, strict: df.where("k = 1").select(paging.evidence(F.col("b"), F.lit(start), 8, strict).alias("x")).first().x
    assert bytes(at(3, True)) == raw[1][3:11] and bytes(at(25, True)) == b"" and at(26, False) is None
    with pytest.raises(Exception, match="evidence_out_of_range"):
        at(26, True)
    told = df.limit(1).select(paging.byte_range(F.lit(14), F.lit(20)).alias("a"), paging.byte_range(F.lit(3), F.lit(0)).alias("b")).first()
    assert (told.a, told.b) == ("bytes 14-33 (20 B)", "at byte 3 (0 B)")


def test_whole_details_or_none(spark):
    df = spark.createDataFrame([("c", 0, v4(40000, 443, 2))], "capture_id string, packet_id bigint, data binary")
    trees = tree.decode_trees(df)
    assert paging.packet_detail(trees).count() == 1
    for caps in ({"max_layers": 2}, {"max_fields": 5}):
        with pytest.raises(Exception, match="packet_detail_limit"):
            paging.packet_detail(trees, **caps).collect()


def test_broken_trees_are_counted(spark):
    field = "field_id int, parent_id int, start int, length int"
    whole = [(0, None, 0, 10), (1, 0, 2, 3), (2, 1, 4, 1)]
    rows = [(10, whole), (9, whole), (None, whole), (10, [(0, None, -1, 4), (1, 5, 0, 1), (2, 2, 0, 1), (7, 0, 1, 3)]), (10, [(4, None, 0, 5), (6, 4, 3, 3)]), (3, []), (10, None)]
    trees = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"packet_id long, captured_length int, fields array<struct<{field.replace(' int', ':int').replace(', ', ',')}>>")
    got = {r.check: r.violations for r in validate.check_trees(trees).collect()}
    assert got == {"field_parent_missing": 1, "field_before_parent": 2, "field_outside_parent": 2, "field_outside_packet": 5}
    tables = validate.check_fields(trees.selectExpr("packet_id", "inline(fields)"), trees.select("packet_id", "captured_length"))
    assert got == {r.check: r.violations for r in tables.collect()}
    none = {r.check: r.violations for r in validate.check_trees(trees.limit(0)).collect()}
    assert list(none.values()) == [0] * 4


def test_trees_in_small_batches_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(tree, "TOGETHER", 2)
    df = spark.createDataFrame([("c", k, k + 7, v4(40000 + k, 443, 2)) for k in range(5)], "capture_id string, packet_id bigint, captured_length int, data binary").coalesce(1)
    trees = tree.decode_trees(df, keep=("captured_length",))
    assert sorted((r.packet_id, r.captured_length) for r in trees.collect()) == [(k, k + 7) for k in range(5)]
    # no packet's tree meets another's: the check is one pass and one sum
    plan = validate.check_trees(trees)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_ticks(spark):
    cases = [("decimal", 0, 1), ("decimal", 18, 10**18), ("decimal", 19, None), ("binary", 20, 1 << 20), ("binary", 62, 1 << 62), ("binary", 63, None), (None, 6, None)]
    got = spark.createDataFrame([(k, e) for k, e, _ in cases], "k string, e int").select(ticks_per_second(F.col("k"), F.col("e")).alias("t")).collect()
    assert [r.t for r in got] == [t for *_, t in cases]


def test_hints(spark):
    r = spark.range(1).select(pcap.hint_warning(F.lit("/a/x.pcapng"), F.lit("pcap")).alias("a"), pcap.hint_warning(F.lit("/a/x.cap"), F.lit("pcap")).alias("b"), pcap.hint_warning(F.lit("/a/x"), F.lit("pcap")).alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, False)


def test_flows_of_mixed_resolutions_have_no_duration(spark):
    rows = [("c", k, 0, 5 + k, 0, kind, e, 60, 60, [], v4(40000, 443, 16)) for k, (kind, e) in enumerate([("decimal", 6), ("decimal", 9)])]
    df = spark.createDataFrame(rows, "capture_id string, packet_id bigint, interface_id bigint, seconds bigint, fraction bigint, res_kind string, res_exp int, captured_length bigint, original_length bigint, diag_codes array<int>, data binary")
    r = flows.flow_metrics(decode.flat_packets(df)).first()
    assert r.ticks_per_second is None and r.duration_ticks is None and r.packets_total == 2
