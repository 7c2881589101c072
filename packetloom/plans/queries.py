"""Registered queries over the events trace, with SQL for the same rows written on the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import decode as D
from packetloom.functions import tree as T
from packetloom.functions.time import extrema
from packetloom.operators import correlate as C
from packetloom.operators import flows as X
from packetloom.operators import paging as G
from packetloom.operators import validate as V
from packetloom.plans import captures, wire
from packetloom.plans.frames import frames
from packetloom.plans.trace import events_trace
from packetloom.sinks import batches as B
from packetloom.sources import pcap as S

Query = Callable[[SparkSession, str], DataFrame]

# --- the trace in DuckDB's SQL -------------------------------------------------------------------
_TRACE = """
e0 as (select event_id, user_id, event_type, value, epoch_us(ts) as us0, cast(regexp_extract(props, '(\\d+)', 1) as int) as k from events),
e1 as (select *, case when user_id % 7 = 3 then us0 // 100000 else us0 end as us, user_id % 10 = 7 as v6, user_id % 3 = 2 as udp, (event_id * 7 + k) % 3 = 0 as back, user_id % 50 = 49 as self,
  40000 + event_id // 1000 as cport,
  case when user_id % 10 = 7 then '20010db8' || printf('%024x', user_id) else printf('%08x', 167772160 + user_id) end as client from e0),
e2 as (select *, case when self then client when v6 then '20010db8ffff' || printf('%020x', user_id % 5 + 1) when user_id % 4 = 1 then printf('%08x', 16843008 + user_id % 5 + 1)
  else printf('%08x', 3221225984 + user_id % 5 + 1) end as server, case when self then cport when udp then 53 else 443 end as sport from e1),
p as (select event_id as packet_id, user_id % 2 as interface_id, case when event_id % 97 <> 0 then us end as t, 40 + cast(floor(value) as bigint) as size,
  40 + cast(floor(value) as bigint) + case when event_id % 5 = 0 then 100 else 0 end as original_length, event_id % 89 = 0 as truncated,
  case when v6 then 6 else 4 end as family, case when udp then 'udp' else 'tcp' end as protocol,
  case when back then server else client end as src, case when back then client else server end as dst,
  case when back then sport else cport end as src_port, case when back then cport else sport end as dst_port,
  case when not udp and event_id % 31 <> 0 then 1000 + k % 7 end as seq, case when not udp and event_id % 37 <> 0 then 2000 + k % 5 end as ack_no,
  not udp and event_type = 'signup' as syn,
  not udp and (event_type in ('click', 'purchase') or (event_type = 'signup' and back) or (event_type = 'error' and k >= 30)) as ack,
  not udp and event_type = 'purchase' as fin, not udp and event_type = 'error' and k < 30 as rst,
  case when udp then k % 8 end as txid, back as is_response, case when udp then k % 4 end as rcode, case when udp then 1 - cast(k % 10 = 0 as int) end as qd from e2),
f0 as (select *, (src, src_port) < (dst, dst_port) as fwd, (src, src_port) = (dst, dst_port) as same from p),
fp as (select *, case when fwd then src else dst end as a_addr, case when fwd then src_port else dst_port end as a_port,
  case when fwd then dst else src end as b_addr, case when fwd then dst_port else src_port end as b_port,
  case when same then 'unknown' when fwd then 'a_to_b' else 'b_to_a' end as direction from f0)"""

_K = "interface_id, protocol, a_addr, a_port, b_addr, b_port"
_ON = "using (interface_id, protocol, a_addr, a_port, b_addr, b_port)"


def _dur(a: str, b: str) -> str:
    return f"case when {b} >= {a} and ({b}) % 1000000 >= ({a}) % 1000000 then ({b}) - ({a}) end"


_FLOWS = f"""
flows as (select {_K}, count(*) filter (direction <> 'b_to_a') as packets_a_to_b, count(*) filter (direction = 'b_to_a') as packets_b_to_a,
  cast(coalesce(sum(size) filter (direction <> 'b_to_a'), 0) as bigint) as bytes_a_to_b, cast(coalesce(sum(size) filter (direction = 'b_to_a'), 0) as bigint) as bytes_b_to_a,
  min(t) as first_t, max(t) as last_t, min(packet_id) as first_packet, bool_or(truncated) as truncation_seen, count(*) as packets_total, cast(sum(size) as bigint) as bytes_total,
  min(size) as size_min, max(size) as size_max,
  {", ".join(f"count(*) filter (size >= {low}{f' and size < {X.SIZE_BOUNDS[k + 1]}' if k < 7 else ''}) as bin{k}" for k, low in enumerate(X.SIZE_BOUNDS))}
  from fp group by all)"""

_TCP = f"""
s1 as (select *, min(packet_id) filter (syn and not ack) over w as first_syn from fp where protocol = 'tcp' window w as (partition by {_K})),
s2 as (select *, max(direction) filter (packet_id = first_syn) over w as sdir from s1 window w as (partition by {_K})),
s3 as (select *, min(packet_id) filter (syn and ack and packet_id > first_syn and direction <> sdir) over w as syn_ack from s2 window w as (partition by {_K})),
s4 as (select *, min(packet_id) filter (ack and packet_id > syn_ack and direction = sdir) over w as established from s3 window w as (partition by {_K})),
q as (select packet_id, lag(seq) over w as pseq, lag(packet_id) over w as pseq_id from s4 where seq is not null and direction <> 'unknown' window w as (partition by {_K}, direction order by packet_id)),
r as (select packet_id, lag(ack_no) over w as pack, lag(packet_id) over w as pack_id from s4 where ack_no is not null and direction <> 'unknown' window w as (partition by {_K}, direction order by packet_id)),
s5 as (select s4.*, pseq, pseq_id, pack, pack_id from s4 left join q using (packet_id) left join r using (packet_id)),
tcp as (select {_K}, max(first_syn) as first_syn, max(syn_ack) as syn_ack, max(established) as established,
  max(t) filter (packet_id = first_syn) as syn_t, max(t) filter (packet_id = established) as est_t,
  min(packet_id) filter (syn and not ack and packet_id > first_syn and direction = sdir) as repeated_syn,
  min(packet_id) filter (seq = pseq) as re_second, arg_min(pseq_id, packet_id) filter (seq = pseq) as re_first, arg_min(direction, packet_id) filter (seq = pseq) as re_dir,
  min(packet_id) filter (seq < pseq) as oo_second, arg_min(pseq_id, packet_id) filter (seq < pseq) as oo_first, arg_min(direction, packet_id) filter (seq < pseq) as oo_dir,
  min(packet_id) filter (ack_no = pack and ack) as da_second, arg_min(pack_id, packet_id) filter (ack_no = pack and ack) as da_first, arg_min(direction, packet_id) filter (ack_no = pack and ack) as da_dir,
  count(*) filter (seq = pseq and direction = 'a_to_b') as re_a, count(*) filter (seq = pseq and direction = 'b_to_a') as re_b,
  arg_min(t, packet_id) filter (seq is not null and not syn and not fin and not rst and not ack and t is not null) as data_t,
  max(packet_id) filter (rst) as reset, list_sort(list(packet_id) filter (fin)) as fins from s5 group by all),
states as (select *, fins[1] as first_fin, fins[2] as second_fin,
  case when established is not null then 'established' when first_syn is not null and reset is not null then 'failed_reset' when repeated_syn is not null then 'failed_repeated_syn' when first_syn is not null then 'in_progress' else 'not_observed' end as establishment,
  case when established is not null or (first_syn is not null and reset is not null) then 'certain' when first_syn is not null then 'inferred' end as establishment_confidence,
  case when reset is not null then 'reset' when fins[1] is not null then 'fin' else 'not_observed' end as termination,
  case when reset is not null or fins[2] is not null then 'certain' when fins[1] is not null then 'inferred' end as termination_confidence,
  packets_a_to_b = 0 or packets_b_to_a = 0 as one_sided from tcp join flows {_ON}),
tcps as (select *, one_sided or establishment <> 'established' or termination = 'not_observed' as partial_capture from states)"""


def _dns(name: str, where: str) -> str:
    return f"""
{name}_0 as (select *, coalesce(sum(cast(is_response as int)) over (partition by {_K}, txid order by packet_id rows between unbounded preceding and 1 preceding), 0) as epoch from fp where txid is not null{where}),
{name} as (select {_K}, txid, epoch, arg_min(t, packet_id) filter (not is_response and qd > 0) as first_t, max(packet_id) filter (not is_response and qd > 0) as last_query,
  min(packet_id) filter (is_response) as response, min(t) filter (is_response) as response_t, coalesce(max(rcode) filter (is_response), 0) as rcode from {name}_0 group by all)"""


_LATENCY = f"""{_dns("timed", " and t is not null")},
latency as (select {_K}, min({_dur("first_t", "response_t")}) as dns_response_ticks from timed group by all)"""

_ANOMALIES = f"""{_dns("every", "")},
found as (
  select {_K}, 0 as kind_order, 'inferred' as base, first_syn as first, null::bigint as second from tcps where first_syn is not null and syn_ack is null and reset is null
  union all select {_K}, 1, 'certain', first_syn, repeated_syn from tcps where repeated_syn is not null
  union all select {_K}, 2, 'certain', first_syn, reset from tcps where reset is not null and first_syn is not null
  union all select {_K}, 3, 'certain', coalesce(last_query, response), case when last_query is not null then response end from every where response is not null and rcode <> 0
  union all select {_K}, 4, 'inferred', last_query, null from every where response is null and last_query is not null
  union all select {_K}, 5, 'inferred', re_first, re_second from tcps where greatest(re_a, re_b) >= 2
  union all select {_K}, 6, 'inferred', first_syn, established from tcps where {_dur("syn_t", "est_t")} > 2000000
  union all select {_K}, 7, 'inferred', first_packet, null from flows where packets_a_to_b = 0 or packets_b_to_a = 0),
anomalies as (select {_K}, kind_order, ['{"', '".join(X.ANOMALIES)}'][kind_order + 1] as kind, case when packets_a_to_b = 0 or packets_b_to_a = 0 or truncation_seen then 'inferred' else base end as confidence,
  concat_ws(',', case when packets_a_to_b = 0 or packets_b_to_a = 0 then 'one_sided_view' end, case when truncation_seen then 'capture_truncated' end) as limitations, first, second from found join flows {_ON})"""

_TIMELINE = f"""
m0 as (select *, min(t) over (partition by {_K}) as first_t, row_number() over (partition by {_K} order by packet_id) - 1 as message_index from fp),
messages as (select {_K}, message_index, packet_id, direction, case when direction = 'b_to_a' then 'b' else 'a' end as lane, size, {_dur("first_t", "t")} as offset_ticks from m0)"""


def _zoom_sql(where: str, points: int) -> str:
    return f"""
z0 as (select *, count(*) over (partition by {_K}) as n, row_number() over (partition by {_K} order by packet_id) - 1 as r from messages where {where}),
zoomed as (select {_K}, cast(r // cast(ceil(n / {points}.0) as bigint) as bigint) as entry, count(*) as packet_count, min(packet_id) as first_packet, max(packet_id) as last_packet,
  arg_min(size, packet_id) as first_size, arg_max(size, packet_id) as last_size, cast(sum(size) as bigint) as total_bytes,
  first(offset_ticks order by packet_id) as first_offset, last(offset_ticks order by packet_id) as last_offset, min(offset_ticks) as min_offset, max(offset_ticks) as max_offset from z0 group by all)"""


def _sql(*parts: str, select: str) -> str:
    return "with " + ",\n".join([_TRACE.strip(), *(p.strip() for p in parts)]) + "\n" + select


# --- shapes of results ---------------------------------------------------------------------------
def ends(df: DataFrame) -> DataFrame:
    """Keys as plain columns, addresses in hexadecimal."""
    flat = {f"{x}_{n}": v for x in "ab" for n, v in (("addr", F.lower(F.hex(F.col(x)["addr"]))), ("port", F.col(x)["port"].cast("bigint")))}
    return df.withColumns(flat).drop("a", "b", "capture_id")


_KEYS = [c.strip() for c in _K.split(",")]


def _micros(column: str) -> Column:
    return (F.col(column)["seconds"] * 1_000_000 + F.col(column)["fraction"]).alias(column)


class _Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(events_trace(spark, sf_dir))

        self.queries[name] = query
        if sql:
            self.sql[name] = sql


R = _Registry()
_FLOW_COLUMNS = ["packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a", "first_t", "last_t"]
R.add("flow_key_directions", lambda p: ends(X.flow_packets(p)).select("packet_id", *_KEYS, "direction"), _sql(select=f"select packet_id, {_K}, direction from fp"))
R.add("flows_bidirectional", lambda p: ends(X.bidirectional_flows(p)).select(*_KEYS, *_FLOW_COLUMNS[:4], _micros("first_t"), _micros("last_t")), _sql(_FLOWS, select=f"select {_K}, {', '.join(_FLOW_COLUMNS)} from flows"))
R.add("flow_totals", lambda p: ends(X.bidirectional_flows(p)).select(*_KEYS, "packets_total", "bytes_total"), _sql(_FLOWS, select=f"select {_K}, packets_total, bytes_total from flows"))
R.add("flow_ids", lambda p: ends(X.flow_ids(X.bidirectional_flows(p))).select("flow_id", *_KEYS), _sql(_FLOWS, select=f"select row_number() over (order by interface_id, protocol, length(a_addr), a_addr, a_port, length(b_addr), b_addr, b_port) - 1 as flow_id, {_K} from flows"))
R.add("flow_duration", lambda p: ends(X.bidirectional_flows(p)).select(*_KEYS, X.duration(F.col("first_t"), F.col("last_t"), F.col("ticks_per_second")).alias("duration_ticks")), _sql(_FLOWS, select=f"select {_K}, {_dur('first_t', 'last_t')} as duration_ticks from flows"))
_SIZES = ["size_min", "size_max", *(f"bin{k}" for k in range(8))]
R.add("packet_size_distribution", lambda p: ends(X.flow_packets(p).groupBy(*X.KEY).agg(*X.size_columns())).select(*_KEYS, F.col("size_count").alias("packets_total"), F.col("size_sum").alias("bytes_total"), *_SIZES), _sql(_FLOWS, select=f"select {_K}, packets_total, bytes_total, {', '.join(_SIZES)} from flows"))
_METRICS = ["packets_total", "bytes_total", *_FLOW_COLUMNS[:4], *_SIZES, "duration_ticks", "handshake_ticks", "first_data_ticks", "dns_response_ticks", "partial_capture"]
R.add("flow_metrics", lambda p: ends(X.flow_metrics(p)).select(*_KEYS, *_METRICS), _sql(_FLOWS, _TCP, _LATENCY, select=f"select {', '.join('f.' + k for k in _KEYS)}, f.packets_total, f.bytes_total, {', '.join('f.' + c for c in _FLOW_COLUMNS[:4])}, {', '.join('f.' + c for c in _SIZES)}, {_dur('f.first_t', 'f.last_t')} as duration_ticks, nullif({_dur('syn_t', 'est_t')}, 0) as handshake_ticks, nullif({_dur('est_t', 'data_t')}, 0) as first_data_ticks, dns_response_ticks, coalesce(partial_capture, true) as partial_capture from flows f left join tcps {_ON} left join latency {_ON}"))
for _name, _columns, _sqls in (
    ("tcp_first_syn", ["first_syn"], ["first_syn"]),
    ("tcp_handshake", ["first_syn", "syn_ack", "established"], ["first_syn", "syn_ack", "established"]),
    ("tcp_repeated_syn", ["first_syn", "repeated_syn"], ["first_syn", "repeated_syn"]),
    ("tcp_retransmission", ["retransmission.first", "retransmission.second", "retransmission.direction", "retransmissions_a", "retransmissions_b"], ["re_first as first", "re_second as second", "re_dir as direction", "re_a as retransmissions_a", "re_b as retransmissions_b"]),
    ("tcp_out_of_order", ["out_of_order.first", "out_of_order.second", "out_of_order.direction"], ["oo_first as first", "oo_second as second", "oo_dir as direction"]),
    ("tcp_duplicate_ack", ["duplicate_ack.first", "duplicate_ack.second", "duplicate_ack.direction"], ["da_first as first", "da_second as second", "da_dir as direction"]),
    ("tcp_termination", ["termination", "termination_confidence", "reset", "first_fin", "second_fin"], ["termination", "termination_confidence", "reset", "first_fin", "second_fin"]),
    ("tcp_establishment", ["establishment", "establishment_confidence"], ["establishment", "establishment_confidence"]),
    ("tcp_partial_capture", ["one_sided", "partial_capture"], ["one_sided", "partial_capture"]),
    ("tcp_connection_states", ["establishment", "establishment_confidence", "termination", "termination_confidence", "partial_capture", "first_syn", "syn_ack", "established", "reset"], ["establishment", "establishment_confidence", "termination", "termination_confidence", "partial_capture", "first_syn", "syn_ack", "established", "reset"]),
):
    R.add(_name, lambda p, c=_columns: ends(X.tcp_flows(p)).select(*_KEYS, *c), _sql(_FLOWS, _TCP, select=f"select {_K}, {', '.join(_sqls)} from tcps"))
R.add("tcp_first_data", lambda p: ends(X.tcp_flows(p)).select(*_KEYS, _micros("data_t")), _sql(_FLOWS, _TCP, select=f"select {_K}, data_t from tcps"))
R.add("handshake_latency", lambda p: ends(X.flow_metrics(p)).select(*_KEYS, "handshake_ticks").where("handshake_ticks is not null"), _sql(_FLOWS, _TCP, select=f"select {_K}, {_dur('syn_t', 'est_t')} as handshake_ticks from tcps where {_dur('syn_t', 'est_t')} > 0"))
R.add("time_to_first_data", lambda p: ends(X.flow_metrics(p)).select(*_KEYS, "first_data_ticks").where("first_data_ticks is not null"), _sql(_FLOWS, _TCP, select=f"select {_K}, {_dur('est_t', 'data_t')} as first_data_ticks from tcps where {_dur('est_t', 'data_t')} > 0"))
R.add("dns_latency", lambda p: ends(X.dns_latency(p)), _sql(_LATENCY, select="select * from latency where dns_response_ticks is not null"))
R.add("dns_pair_join", lambda p: ends(X.dns_epochs(p, False).where("last_query is not null and response is not null")).select(*_KEYS, F.col("dns_txid").cast("bigint").alias("txid"), F.col("last_query.id").alias("query_packet"), F.col("response.id").alias("response_packet")), _sql(_dns("every", ""), select=f"select {_K}, txid::bigint as txid, last_query as query_packet, response as response_packet from every where last_query is not null and response is not null"))
_AN = ["kind", "confidence", "limitations", "first", "second"]
R.add("anomaly_catalog", lambda p: ends(X.anomalies(p)).select(*_KEYS, *_AN), _sql(_FLOWS, _TCP, _ANOMALIES, select=f"select {_K}, {', '.join(_AN)} from anomalies"))
for _k, _kind in enumerate(X.ANOMALIES):
    _snake = "".join("_" + c.lower() if c.isupper() else c for c in _kind).strip("_")
    _label = {"dns_error_response": "dns_errors", "dns_request_without_response": "dns_unanswered"}.get(_snake, f"anomaly_{_snake}")
    R.add(_label, lambda p, k=_k: ends(X.anomalies(p).where(F.col("kind_order") == k)).select(*_KEYS, *_AN), _sql(_FLOWS, _TCP, _ANOMALIES, select=f"select {_K}, {', '.join(_AN)} from anomalies where kind_order = {_k}"))
R.add("anomaly_confidence", lambda p: X.anomalies(p).groupBy("kind", "confidence", "limitations").agg(F.count("*").alias("n")), _sql(_FLOWS, _TCP, _ANOMALIES, select="select kind, confidence, limitations, count(*) as n from anomalies group by all"))
R.add("flow_truncation_seen", lambda p: ends(X.bidirectional_flows(p)).select(*_KEYS, "truncation_seen"), _sql(_FLOWS, select=f"select {_K}, truncation_seen from flows"))
_MSG = ["message_index", "packet_id", "direction", "lane", "size", "offset_ticks"]
R.add("timeline_messages", lambda p: ends(X.timeline(p)).select(*_KEYS, *_MSG), _sql(_TIMELINE, select=f"select {_K}, {', '.join(_MSG)} from messages"))
R.add("timeline_lanes", lambda p: ends(X.timeline(p).groupBy(*X.KEY, "lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list("message_index")), lambda x: x.cast("string")), ",").alias("messages"))), _sql(_TIMELINE, select=f"select {_K}, lane, string_agg(message_index::varchar, ',' order by message_index) as messages from messages group by all"))
R.add("timeline_offsets", lambda p: X.timeline(p).select("packet_id", "offset_ticks"), _sql(_TIMELINE, select="select packet_id, offset_ticks from messages"))
R.add("timeline_window", lambda p: X.timeline(p).where(X.in_window(F.col("offset_ticks"), 1_000_000, 600_000_000)).select("packet_id", "offset_ticks"), _sql(_TIMELINE, select="select packet_id, offset_ticks from messages where offset_ticks is null or offset_ticks between 1000000 and 600000000"))
R.add("timeline_zoom", lambda p: ends(X.zoom(X.timeline(p), None, 3_000_000_000, 3)), _sql(_TIMELINE, _zoom_sql("offset_ticks is null or offset_ticks <= 3000000000", 3), select="select * from zoomed"))
R.add("protocol_filter", lambda p: p.where("protocol = 'tcp'").select("packet_id", "captured_length"), _sql(select="select packet_id, size as captured_length from p where protocol = 'tcp'"))
R.add("port53_filter", lambda p: p.where("src_port = 53 or dst_port = 53").select("packet_id"), _sql(select="select packet_id from p where src_port = 53 or dst_port = 53"))
R.add("truncated_filter", lambda p: X.flow_packets(p).where("truncated").select("packet_id"), _sql(select="select packet_id from p where truncated"))


# --- decoded frames, selections, pages and checks ------------------------------------------------
def _frames(p: DataFrame) -> DataFrame:
    return frames(p)


_WIRE = """
w as (select *, packet_id % 11 = 0 as tagged, case when family = 4 then 2048 else 34525 end as ether, case when family = 4 then 20 else 40 end as net,
  case when packet_id % 11 = 0 then 18 else 14 end as n from p)"""
_N = "case when length(data) > 14 and substring(data, 13, 2) = X'8100' then 18 else 14 end"


def _decoded(p: DataFrame, columns: dict[str, Column], keep: list[str], where: str | None = None) -> DataFrame:
    f = p.withColumns({c: columns[c] for c in keep})
    return (f.where(where) if where else f).select("packet_id", *[F.lower(F.hex(c)).alias(c) if "address" in c or c in ("source", "destination") else F.col(c).cast("bigint").alias(c) if c != "checked" else F.col(c) for c in keep])


def _net(column: str = "data") -> Column:
    return F.expr(_N)


def _transport(p: DataFrame) -> Column:
    return F.expr(f"{_N} + case when family = 4 then 20 else 40 end")


def _add(name: str, keep: list[str], spec: Callable[[DataFrame], dict[str, Column]], where: str | None, sql_columns: str, sql_where: str = "true") -> None:
    R.add(name, lambda p: (lambda f: _decoded(f, spec(f), keep, where))(_frames(p).drop("protocol", "fin", "syn", "rst", "ack", "flags") if name != "udp_decode" else _frames(p).drop("protocol")), _sql(_WIRE, select=f"select packet_id, {sql_columns} from w where {sql_where}"))


_add("ethernet_decode", ["destination", "source", "ether_type"], lambda f: D.ethernet(F.col("data")), None, "'020000000001' as destination, '020000000002' as source, case when tagged then 33024 else ether end::bigint as ether_type")
_add("vlan_decode", ["tag_control_information", "priority_code_point", "drop_eligible", "vlan_identifier", "inner_ether_type"], lambda f: D.vlan(F.col("data")), "substring(data, 13, 2) = X'8100'", "(packet_id % 4096)::bigint as tag_control_information, 0::bigint as priority_code_point, 0::bigint as drop_eligible, (packet_id % 4096)::bigint as vlan_identifier, ether::bigint as inner_ether_type", "tagged")
_add("ipv4_decode", ["version", "header_length", "total_length", "dont_fragment", "fragment_offset", "time_to_live", "protocol", "source_address", "destination_address"], lambda f: D.ipv4(F.col("data"), _net()), "family = 4", "4::bigint as version, 20::bigint as header_length, 40::bigint as total_length, 1::bigint as dont_fragment, 0::bigint as fragment_offset, 64::bigint as time_to_live, case when protocol = 'tcp' then 6 else 17 end::bigint as protocol, src as source_address, dst as destination_address", "family = 4")
_add("ipv6_decode", ["version", "traffic_class", "flow_label", "payload_length", "next_header", "hop_limit", "source_address", "destination_address"], lambda f: D.ipv6(F.col("data"), _net()), "family = 6", "6::bigint as version, 0::bigint as traffic_class, 0::bigint as flow_label, 20::bigint as payload_length, case when protocol = 'tcp' then 6 else 17 end::bigint as next_header, 64::bigint as hop_limit, src as source_address, dst as destination_address", "family = 6")
_add("tcp_decode", ["source_port", "destination_port", "sequence_number", "acknowledgment_number", "header_length", "syn", "ack", "fin", "rst", "window"], lambda f: D.tcp(F.col("data"), _transport(f)), "is_tcp", "src_port::bigint as source_port, dst_port::bigint as destination_port, coalesce(seq, 0)::bigint as sequence_number, coalesce(ack_no, 0)::bigint as acknowledgment_number, 20::bigint as header_length, syn::bigint as syn, ack::bigint as ack, fin::bigint as fin, rst::bigint as rst, 8192::bigint as window", "protocol = 'tcp'")
_add("udp_decode", ["source_port", "destination_port", "length", "checksum"], lambda f: D.udp(F.col("data"), _transport(f)), "not is_tcp", "src_port::bigint as source_port, dst_port::bigint as destination_port, 20::bigint as length, 0::bigint as checksum", "protocol = 'udp'")
_add("dns_header", ["transaction_id", "is_response", "response_code", "question_count", "answer_count"], lambda f: D.dns_header(F.col("data"), _transport(f) + 8), "not is_tcp and (src_port = 53 or dst_port = 53)", "txid::bigint as transaction_id, is_response::bigint as is_response, case when is_response then rcode else 0 end::bigint as response_code, qd::bigint as question_count, case when is_response then 1 else 0 end::bigint as answer_count", "protocol = 'udp' and (src_port = 53 or dst_port = 53)")
R.add("decoded_flows", lambda p: ends(X.bidirectional_flows(D.flat_packets(_frames(p).select("capture_id", "packet_id", "interface_id", "seconds", "fraction", "captured_length", "diag_codes", "data")))).select(*_KEYS, "packets_total", "bytes_total"), _sql(_FLOWS, select=f"select {_K}, packets_total, bytes_total from flows"))


def _trees(p: DataFrame) -> DataFrame:
    return T.decode_trees(_frames(p))


R.add("layer_tree", lambda p: T.table(_trees(p), "layers").select("packet_id", "layer_index", "protocol", "start", "length").where("protocol <> 'dns'").select("packet_id", F.col("layer_index").cast("bigint").alias("layer_index"), "protocol", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length")), _sql(_WIRE, select="select packet_id, l.layer_index::bigint as layer_index, l.protocol as protocol, l.start::bigint as start, l.length::bigint as length from (select packet_id, unnest(list_filter([{'layer_index': 0, 'protocol': 'ethernet', 'start': 0, 'length': 14}, case when tagged then {'layer_index': 1, 'protocol': 'vlan', 'start': 12, 'length': 6} end, {'layer_index': 1 + tagged::int, 'protocol': case when family = 4 then 'ipv4' else 'ipv6' end, 'start': n, 'length': net}, {'layer_index': 2 + tagged::int, 'protocol': protocol, 'start': n + net, 'length': case when protocol = 'tcp' then 20 else 8 end}], lambda x: x is not null)) as l from w)"))
R.add("string_dictionary", lambda p: C.dictionary(T.table(_trees(p), "fields")))
R.add("field_preorder", lambda p: C.preorder(T.table(_trees(p), "fields"), 1024).select("packet_id", F.col("position"), "name"))

_MAGICS = ["d4c3b2a1", "a1b2c3d4", "4d3cb2a1", "a1b23c4d", "0a0d0d0a1c0000004d3c2b1a", "0a0d0d0a1c00000000000000", "0a0d0d0a", "7f454c46"]

# selections and fields as plain ranges, so that SQL can say the same
_SEL = "selections as (select packet_id as selection_id, packet_id, packet_id % 40 as s0, packet_id % 40 + packet_id % 7 as s1 from p)"
_FLD = "fields as (select packet_id, i as field_id, i % 4 as depth, (i * 5) % 37 as f0, (i * 5) % 37 + (i * i) % 9 as f1 from p, (select unnest(range(0, 24)) as i))"
_HIT = "case when s0 = s1 then f0 = s0 and f1 = f0 else f1 > f0 and f0 < s1 and f1 > s0 end"


def _ranges(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = p.selectExpr("packet_id as selection_id", "packet_id", "packet_id % 40 as start", "packet_id % 7 as length")
    f = p.selectExpr("packet_id", "explode(sequence(0L, 23L)) as field_id").selectExpr("packet_id", "field_id", "field_id % 4 as depth", "field_id * 5 % 37 as start", "field_id * field_id % 9 as length")
    return s, f


_RANK = "row_number() over (partition by selection_id order by (f0 = s0 and f1 = s1) desc, (f0 <= s0 and f1 >= s1) desc, case when f0 <= s0 and f1 >= s1 then f1 - f0 else 0 end, least(f1, s1) - greatest(f0, s0) desc, depth desc, f1 - f0, field_id) - 1"
R.add("correlate_fields", lambda p: C.correlate(*_ranges(p)), _sql(_SEL, _FLD, select=f"select selection_id, s.packet_id, field_id, {_RANK} as rank from selections s join fields f on s.packet_id = f.packet_id where {_HIT}"))
R.add("range_overlap_join", lambda p: C.correlate(*_ranges(p)).groupBy("selection_id").agg(F.count("*").alias("n")), _sql(_SEL, _FLD, select=f"select selection_id, count(*) as n from selections s join fields f on s.packet_id = f.packet_id where {_HIT} group by 1"))
R.add("selection_out_of_bounds", lambda p: C.out_of_bounds(_ranges(p)[0].withColumn("length", F.col("length") * 20), p), _sql(_SEL, select="select selection_id, s.packet_id, 'selection_out_of_bounds' as reason from selections s join p on s.packet_id = p.packet_id where s0 + (s1 - s0) * 20 > size"))
# a number's bytes as hexadecimal digits, the lowest byte first
_LE = lambda x, n: " || ".join(f"printf('%02x', (({x}) >> {8 * i}) & 255)" for i in range(n))
_HEAD = " || ".join(["'574c504b54423031010040000100000018000c00'", _LE("(b = n)::bigint", 4), _LE("b - a", 4), "'4000000060010000'", _LE("352 + 51 * (b - a)", 4), _LE("a", 8), _LE("b", 8), _LE("n", 8)])
_BATCH = f"select 'events' as capture_id, a as start_row, b as next_row, n as total_rows, 352 + 51 * (b - a) as bytes, {_HEAD} as head from (select min(packet_id) as a, max(packet_id) + 1 as b, (select count(*) from p) as n from p group by packet_id // 4096)"
_ROW = "packet_id, 0::bigint as section_id, interface_id, size as captured_length, original_length, size as evidence_length, 0::bigint as evidence_offset, coalesce(t // 1000000, 0)::bigint as ts_seconds, coalesce(t % 1000000, 0)::bigint as ts_fraction, t is not null as ts_present, 0::bigint as res_kind, case when t is not null then 6 else 0 end::bigint as res_exp"
R.add("packet_rows", lambda p: G.packet_rows(p), _sql(select=f"select {_ROW} from p"))
R.add("packet_batches", lambda p: B.packet_batches(p).select("capture_id", "start_row", "next_row", "total_rows", F.length("batch").cast("bigint").alias("bytes"), F.lower(F.hex(F.substring("batch", 1, 64))).alias("head")), _sql(select=_BATCH))
R.add("packet_batch_rows", lambda p: B.batch_rows(B.packet_batches(p)).drop("capture_id"), _sql(select=f"select {_ROW} from p"))
R.add("packet_page", lambda p: G.packet_page(p, 500, 200, 8192), _sql(select=f"select {_ROW} from p where packet_id >= 500 order by packet_id limit 153"))
R.add("evidence_slice", lambda p: _frames(p).select("packet_id", F.lower(F.hex(G.evidence(F.col("data"), F.lit(6), 6))).alias("bytes")), _sql(select="select packet_id, '020000000002' as bytes from p"))
R.add("capture_extrema", lambda p: p.sparkSession.createDataFrame([(a[0] * 1_000_000 + a[1], b[0] * 1_000_000 + b[1]) for a, b in [extrema(p)]], "started_at bigint, ended_at bigint"), _sql(select="select min(t) as started_at, max(t) as ended_at from p"))
R.add("interface_join", lambda p: p.join(F.broadcast(p.sparkSession.createDataFrame([("events", 0, "eth0"), ("events", 1, "eth1")], "capture_id string, interface_id bigint, name string")), ["capture_id", "interface_id"]).groupBy("name").agg(F.count("*").alias("n")), _sql(select="select 'eth' || interface_id as name, count(*) as n from p group by 1"))
R.add("validate_packets", lambda p: V.check_packets(p), "select unnest(['packet_id_dense', 'captured_length_negative', 'timestamp_halves', 'timestamp_fraction']) as \"check\", 0::bigint as violations")
R.add("validate_fields", lambda p: V.check_trees(T.decode_trees(_frames(p).withColumn("captured_length", F.length("data")), keep=("captured_length",))), "select unnest(['field_parent_missing', 'field_before_parent', 'field_outside_parent', 'field_outside_packet']) as \"check\", 0::bigint as violations")
R.add("format_sniff", lambda p: p.select("packet_id", F.unhex(F.element_at(F.array(*map(F.lit, _MAGICS)), (F.col("packet_id") % len(_MAGICS) + 1).cast("int"))).alias("h")).select("packet_id", S.sniff(F.col("h")).alias("format")), _sql(select=f"select packet_id, [{', '.join(repr(x) for x in ('pcap', 'pcap', 'pcap', 'pcap', 'pcapng', 'malformed', 'need_more_bytes', 'unsupported'))}][packet_id % 8 + 1] as format from p"))
R.add("filename_hint", lambda p: p.select("packet_id", S.filename_hint(F.concat(F.lit("/a.b/x"), F.element_at(F.array(*map(F.lit, [".pcap", ".PCAPNG", ".txt", ""])), (F.col("packet_id") % 4 + 1).cast("int")))).alias("hint")), _sql(select="select packet_id, ['pcap', 'pcapng', null, null][packet_id % 4 + 1] as hint from p"))

R.queries |= wire.QUERIES | captures.QUERIES
R.sql |= wire.SQL | {name: _sql(*parts, select=select) for name, (parts, select) in captures.SQL_PARTS.items()}
