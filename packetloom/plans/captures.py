"""The events trace written as captures of several formats, read back, and asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import decode as D
from packetloom.functions import tree as T
from packetloom.operators import flows as X
from packetloom.operators import paging as G
from packetloom.plans.frames import frames
from packetloom.plans.trace import events_trace
from packetloom.sinks.captures import FORMATS, capture_files
from packetloom.sources import pcap as S

#: Packets of a capture; the capture's number says its format.
PACKETS = 500
_STYLES = list(FORMATS)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the captures: times in the ticks of each format, classic ones on a single interface."""
    number, pid = F.floor(F.col("packet_id") / PACKETS), F.col("packet_id")
    p = frames(events_trace(spark, sf_dir)).withColumn("style", F.element_at(F.array(*map(F.lit, _STYLES)), (number % len(_STYLES) + 1).cast("int")))
    fraction = F.when(F.col("style") == _STYLES[0], F.col("fraction")).when(F.col("style") == _STYLES[3], F.shiftleft(F.col("fraction"), 20) / 1_000_000).otherwise(F.col("fraction") * 1000 + pid % 1000)
    p = p.withColumns({
        "capture_id": F.concat(F.lit("capture-"), F.lpad(number.cast("string"), 6, "0"), F.when(number % len(_STYLES) < 2, ".pcap").otherwise(".pcapng")),
        "interface_id": F.when(number % len(_STYLES) < 2, F.lit(0)).otherwise(F.col("interface_id")).cast("bigint"),
        "fraction": fraction.cast("bigint"), "original_length": F.length("data") + F.when(pid % 5 == 0, 100).otherwise(0),
    })
    return capture_files(p)


def capture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures, cached: for measuring what reads them."""
    files = _files(spark, sf_dir).cache()
    files.count()
    return files


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_captures(_files(spark, sf_dir))


def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet of every capture, as read back."""
    p = S.packets(_records(spark, sf_dir))
    return p.select("capture_id", "packet_id", "interface_id", "link_type", "seconds", "fraction", "res_kind", F.col("res_exp").cast("bigint").alias("res_exp"), "captured_length", "original_length", F.length("data").cast("bigint").alias("bytes"), "evidence_offset")


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.import_summary(_records(spark, sf_dir))


def capture_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.interfaces(_records(spark, sf_dir))
    return i.select("capture_id", "interface_id", "name", "link_type", "snap_length", "res_kind", F.col("res_exp").cast("bigint").alias("res_exp"))


def capture_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(_records(spark, sf_dir)).select("capture_id", "section_id", "byte_order", "start", "length")


def capture_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader has to say: packets without time."""
    d = S.diagnostics(_records(spark, sf_dir))
    return d.select("capture_id", "packet_id", F.col("code").cast("bigint").alias("code"), "severity", "recovery")


def capture_flow_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of each capture, and how long they last in the ticks of its resolution."""
    f = X.bidirectional_flows(D.flat_packets(S.packets(_records(spark, sf_dir))))
    ticks = X.duration(F.col("first_t"), F.col("last_t"), F.col("ticks_per_second"), exact=True)
    ends = [F.lower(F.hex(F.col(x)["addr"])).alias(f"{x}_addr") for x in "ab"] + [F.col(x)["port"].cast("bigint").alias(f"{x}_port") for x in "ab"]
    return f.select("capture_id", "interface_id", "protocol", *ends, "packets_total", "bytes_total", "ticks_per_second", ticks.alias("duration_ticks"))


def packet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of which the wire had more, and those whose protocols end early."""
    p = S.packets(_records(spark, sf_dir))
    return p.join(T.decode_trees(p), ["capture_id", "packet_id"]).select("capture_id", "packet_id", *G.truncation_flags())


def evidence_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of each packet, read by their place in the capture's file."""
    files = _files(spark, sf_dir)
    p = S.packets(S.parse_captures(files)).select("capture_id", "packet_id", F.col("evidence_offset").alias("o"))
    return p.join(files, p.capture_id == files.path).select("capture_id", "packet_id", F.lower(F.hex(G.capture_evidence(F.col("content"), F.col("o"), 12))).alias("bytes"))


def evidence_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second row of each packet's hexadecimal view."""
    p = frames(events_trace(spark, sf_dir))
    return p.select("packet_id", F.explode(G.hex_rows(F.col("data"))).alias("r")).where("r.offset = 16").select("packet_id", F.col("r.hex").alias("hex"), F.col("r.ascii").alias("ascii"))


def resource_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resource_stats(_records(spark, sf_dir))


# --- the same in SQL -----------------------------------------------------------------------------
#: Over p of the trace: the capture, its format, and each packet as it should come back.
_CAPTURES = """
c0 as (select *, packet_id // 500 as number, packet_id // 500 % 4 as style, case when packet_id % 11 = 0 then 18 else 14 end + case when family = 4 then 20 else 40 end + 20 as bytes from p),
c1 as (select *, 'capture-' || printf('%06d', number) || case when style < 2 then '.pcap' else '.pcapng' end as capture_id, row_number() over (partition by number order by packet_id) - 1 as n,
  case when style < 2 then 0 else interface_id end as face, case style when 0 then 6 when 3 then 20 else 9 end as digits, case when style = 3 then 'binary' else 'decimal' end as kind,
  bytes + case when packet_id % 5 = 0 then 100 else 0 end as wire, t // 1000000 as s,
  case style when 0 then t % 1000000 when 3 then ((t % 1000000) * 1048576) // 1000000 else (t % 1000000) * 1000 + packet_id % 1000 end as f from c0),
c as (select *, case when t is null and style >= 2 then 0 else s end as seconds, case when t is null and style >= 2 then 0 else f end as fraction from c1)"""
_FACES = "faces as (select capture_id, number, style, max(case when style < 2 then 0 else interface_id end) as last from c group by all)"

SQL_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "capture_packets": ((_CAPTURES,), """select capture_id, n::bigint as packet_id, face::bigint as interface_id, 1::bigint as link_type, seconds, fraction, kind as res_kind, digits::bigint as res_exp, bytes::bigint as captured_length, wire::bigint as original_length, bytes::bigint as bytes,
  (case when style < 2 then 24 + coalesce(sum(bytes + 16) over w, 0) + 16 else 28 + 40 * (1 + max(face) over (partition by capture_id)) + coalesce(sum(32 + (bytes + 3) // 4 * 4) over w, 0) + 28 end)::bigint as evidence_offset
  from c window w as (partition by capture_id order by n rows between unbounded preceding and 1 preceding)"""),
    "import_summary": ((_CAPTURES, _FACES), """select capture_id, case when any_value(c.style) < 2 then 'pcap' else 'pcapng' end as format, 1::bigint as sections, 1 + max(last)::bigint as interfaces, count(*) as packets,
  count(*) filter (t is null and c.style < 2) as diagnostics, count(*) filter (t is null and c.style < 2) as warnings from c join faces using (capture_id) group by capture_id"""),
    "capture_interfaces": ((_CAPTURES, _FACES), """select capture_id, i::bigint as interface_id, case when style >= 2 then 'eth' || i end as name, 1::bigint as link_type, 65535::bigint as snap_length, case when style = 3 then 'binary' else 'decimal' end as res_kind, case style when 0 then 6 when 3 then 20 else 9 end::bigint as res_exp
  from faces, range(2) r(i) where i <= last"""),
    "capture_sections": ((_CAPTURES, _FACES), """select capture_id, 0::bigint as section_id, case when c.style in (0, 2) then 'little' else 'big' end as byte_order, 0::bigint as start,
  (case when c.style < 2 then 24 + sum(bytes + 16) else 28 + 40 * (1 + max(last)) + sum(32 + (bytes + 3) // 4 * 4) end)::bigint as length from c join faces using (capture_id) group by capture_id, c.style"""),
    "capture_diagnostics": ((_CAPTURES,), "select capture_id, n::bigint as packet_id, 5::bigint as code, 'warning' as severity, 'continued' as recovery from c where t is null and style < 2"),
    "capture_flow_durations": ((_CAPTURES,), """select capture_id, interface_id, protocol, a_addr, b_addr, a_port, b_port, packets_total, bytes_total, per as ticks_per_second, case when last >= first then last - first end as duration_ticks from (
  select capture_id, face::bigint as interface_id, protocol, case when fwd then src else dst end as a_addr, case when fwd then src_port else dst_port end::bigint as a_port, case when fwd then dst else src end as b_addr, case when fwd then dst_port else src_port end::bigint as b_port,
    count(*) as packets_total, sum(bytes)::bigint as bytes_total, any_value(case style when 0 then 1000000 when 3 then 1048576 else 1000000000 end)::bigint as per,
    min(seconds * case style when 0 then 1000000 when 3 then 1048576 else 1000000000 end + fraction)::bigint as first, max(seconds * case style when 0 then 1000000 when 3 then 1048576 else 1000000000 end + fraction)::bigint as last
  from (select *, (src, src_port) < (dst, dst_port) as fwd from c) group by all)"""),
    "packet_flags": ((_CAPTURES,), "select capture_id, n::bigint as packet_id, packet_id % 5 = 0 as wire_truncated, protocol = 'udp' and 53 in (src_port, dst_port) and (qd > 0 or is_response) as protocol_truncated from c"),
    "evidence_absolute": ((_CAPTURES,), "select capture_id, n::bigint as packet_id, '020000000001020000000002' as bytes from c"),
    "resource_stats": ((_CAPTURES, _FACES), """select capture_id, count(*) as packets, sum(bytes)::bigint as packet_bytes, (case when any_value(c.style) < 2 then 24 + sum(bytes + 16) else 28 + 40 * (1 + max(last)) + sum(32 + (bytes + 3) // 4 * 4) end)::bigint as capture_bytes,
  case when any_value(c.style) < 2 then 0 else 4 * (1 + max(last)) end::bigint as string_bytes from c join faces using (capture_id) group by capture_id"""),
}
QUERIES = {f.__name__: f for f in (capture_packets, import_summary, capture_interfaces, capture_sections, capture_diagnostics, capture_flow_durations, packet_flags, evidence_absolute, evidence_hex, resource_stats)}
