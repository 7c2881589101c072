"""Frames of many protocols made of the events table, one for each event, and queries over what decodes from them.

An event's id says all of its frame: the last digit is its case, the digits before it (j) the variant.
Checksums are computed here, and broken on purpose in some variants, so a decoder that doesn't check
them, or misplaces a header, gives other rows than the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import decode as D
from packetloom.functions import tree as T
from packetloom.operators import flows as X
from packetloom.plans.frames import _hex
from packetloom.plans.trace import spread

MACS = "020000000001020000000002"
#: Addresses of the two hosts, as 16-bit words.
V4 = ((0x0A00, 0x0001), (0xC000, 0x0202))
V6 = ((0x2001, 0x0DB8, 0, 0, 0, 0, 0, 1), (0x2001, 0x0DB8, 0, 0, 0, 0, 0, 2))


def _id() -> Column:
    return F.col("packet_id")


def _variant() -> Column:
    return F.col("j")


def _words(*values: Column | int) -> Column:
    """Their 16-bit words in hexadecimal."""
    return F.concat(*[_hex(v, 4) for v in values])


def _checksum(*values: Column | int) -> Column:
    """The internet checksum of 16-bit words."""
    total = sum((v if isinstance(v, Column) else F.lit(v) for v in values), F.lit(0)).cast("bigint")
    for _ in range(2):
        total = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(total, 16)
    return F.lit(0xFFFF).cast("bigint") - total


def _broken(value: Column, when: Column) -> Column:
    return F.when(when, value.bitwiseXOR(F.lit(1).cast("bigint"))).otherwise(value)


def _ipv4(length: Column | int, protocol: int, broken: Column, options: tuple[Column | int, ...] = ()) -> Column:
    """An IPv4 header whose datagram has length bytes."""
    words: list[Column | int] = [0x4500 + (len(options) << 7), length, 0, 0, 0x4000 + protocol]
    rest = [*V4[0], *V4[1], *options]
    return F.concat(F.lit("0800"), _words(*words, _broken(_checksum(*words, *rest), broken), *rest))


def _ipv6(length: Column | int, next_header: int) -> Column:
    return F.concat(F.lit("86dd60000000"), _words(length, next_header * 256 + 64, *V6[0], *V6[1]))


def _high(value: Column) -> Column:
    return F.shiftright(value, 16).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def _arp() -> Column:
    operation = F.when(_variant() % 7 == 0, 9).otherwise(1 + _variant() % 2)
    return F.concat(F.lit("0806"), _words(1, 0x0800, 0x0604, operation), F.lit("0200000000020a000001000000000000c0000202"))


def _icmp_behind_options() -> Column:
    """No operation, router alert with a value, end of options; then an echo request."""
    alert, echo = _low(_id()), [0x0800, _low(_id()), _low(_variant())]
    options = (0x0194, F.lit(0x0400) + F.shiftright(alert, 8), alert.bitwiseAND(F.lit(0xFF).cast("bigint")) * 256, 0)
    return F.concat(_ipv4(36, 1, _variant() % 3 == 0, options), _words(0x0800, _broken(_checksum(*echo), _variant() % 4 == 0), *echo[1:]))


def _tcp_behind_extensions() -> Column:
    """Hop-by-hop and destination options, then TCP with segment size, selective acknowledgment, timestamps, window scale."""
    before = [40000 + _id() % 1000, 443, _high(_id()), _low(_id()), 0, 0, 0xA010, 0x2000]
    options = [0x0204, 0x05B4, 0x0402, 0x080A, _high(_id()), _low(_id()), 0, 0, 0x0103, 0x0307]
    check = _checksum(*V6[0], *V6[1], 40, 6, *before, *options)
    return F.concat(_ipv6(56, 0), F.lit("3c00010400000000" + "0600010400000000"), _words(*before, _broken(check, _variant() % 3 == 0), 0, *options))


def _udp_fragment() -> Column:
    return F.concat(_ipv6(24, 44), _words(0x1100, (_variant() % 3) * 8 + 1, _high(_id()), _low(_id()), 5000, 6000, 16, 0), F.lit("00" * 8))


def _dns_response() -> Column:
    """A question; an address for its name; then a mail exchange, or in some variants a text record without text."""
    empty = _variant() % 5 == 1
    size = F.when(empty, 56).otherwise(65)
    question = F.concat(F.lit("0268"), _hex(0x30 + _variant() % 10, 2), F.lit("076578616d706c6500" + "00010001"))
    address = F.concat(F.lit("c00c00010001"), _hex(_low(_id()), 8), F.lit("0004c0000207"))
    last = F.when(empty, F.lit("c00c00100001" + "0000003c" + "0000")).otherwise(F.concat(F.lit("c00c000f0001" + "0000003c" + "0009" + "000a"), F.lit("046d61696cc00f")))
    return F.concat(_ipv4(size + 28, 17, F.lit(False)), _words(53, 50000, size + 8, 0, _low(_id()), 0x8180, 1, 2, 0, 0), question, address, last)


def _icmpv6_echo() -> Column:
    echo = [0x8000, _low(_id()), 7]
    return F.concat(_ipv6(8, 58), _words(0x8000, _broken(_checksum(*V6[0], *V6[1], 8, 58, *echo), _variant() % 3 == 0), *echo[1:]))


def _tcp_over_broken_ipv4() -> Column:
    """TCP without a right checksum, in some variants with an option of a wrong length: the graver finding stays."""
    return F.concat(_ipv4(44, 6, F.lit(True)), _words(50001, 80, 0, 1, 0, 0, 0x6010, 0x2000, 0, 0), F.when(_variant() % 2 == 1, F.lit("02030000")).otherwise(F.lit("01010101")))


def _long_chain() -> Column:
    """Nine destination options: one more than are read."""
    return F.concat(_ipv6(72, 60), F.lit("3c00010400000000" * 8 + "3b00010400000000"))


def wire_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, packet_id, data and the columns of a packet, of each event."""
    made = [_arp(), _icmp_behind_options(), _tcp_behind_extensions(), _udp_fragment(), _dns_response(), _icmpv6_echo(), F.lit("88a800010800"), F.lit("080045000014000000004001"), _tcp_over_broken_ipv4(), _long_chain()]
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")).select(F.lit("wire").alias("capture_id"), F.col("event_id").cast("bigint").alias("packet_id"), F.floor(F.col("event_id") / 10).cast("bigint").alias("j"))
    case = F.lit(None).cast("string")
    for k, body in enumerate(made):
        case = F.when(_id() % 10 == k, body).otherwise(case)
    e = e.withColumn("data", F.unhex(F.concat(F.lit(MACS), case)))
    return e.withColumns({"interface_id": F.lit(0).cast("bigint"), "seconds": _id(), "fraction": F.lit(0).cast("bigint"), "captured_length": F.length("data").cast("bigint"), "diag_codes": F.array().cast("array<int>")}).drop("j")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.decode_trees(wire_frames(spark, sf_dir))


def _fields_of(trees: DataFrame, protocols: str) -> DataFrame:
    """packet_id, name, start, length, value, text: fields below the root of layers whose protocol is like protocols."""
    inside = F.transform(F.filter("layers", lambda x: x["protocol"].like(protocols)), lambda x: x["layer_index"])
    some = trees.select("packet_id", inside.alias("_in"), "fields").select("packet_id", F.explode(F.filter("fields", lambda x: F.array_contains("_in", x["layer_index"]) & (x["depth"] > 0))).alias("f"))
    return some.select("packet_id", "f.name", F.col("f.depth").cast("bigint").alias("depth"), F.col("f.start").cast("bigint").alias("start"), F.col("f.length").cast("bigint").alias("length"), F.col("f.u").alias("value"), F.col("f.s").alias("text"))


_PLACED = ["packet_id", "name", "start", "length", "value"]


def arp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_of(_decoded(spark, sf_dir), "arp").select(*_PLACED)


def ipv4_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between the fixed header and its end."""
    return _fields_of(_decoded(spark, sf_dir), "ipv4").where("start >= 34").select(*_PLACED)


def icmp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the checksum's own value."""
    return _fields_of(_decoded(spark, sf_dir), "icmp%").where("name <> 'checksum'").select(*_PLACED)


def ipv6_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_of(_decoded(spark, sf_dir), "ipv6#_%".replace("#", "\\")).select(*_PLACED)


def tcp_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and what is in them: behind the fixed header of 20 bytes."""
    return _fields_of(_decoded(spark, sf_dir), "tcp").where("name in ('no_operation', 'end_of_options', 'maximum_segment_size', 'window_scale', 'selective_acknowledgment_permitted', 'timestamps') or depth > 1").select(*_PLACED)


def dns_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _fields_of(_decoded(spark, sf_dir), "dns").where("start between 54 and 69")
    value = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    return q.groupBy("packet_id").agg(value("name", "text").alias("qname"), value("type", "value").alias("qtype"), value("class", "value").alias("qclass"), value("question", "length").alias("length"))


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_of(_decoded(spark, sf_dir), "dns").where("start >= 70").select(*_PLACED, "text")


def dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_of(_decoded(spark, sf_dir), "dns").where("text is not null").select("packet_id", "name", "text")


def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every checksum that could be checked, of headers and of messages."""
    return T.table(_decoded(spark, sf_dir), "fields").where("name in ('header_checksum_valid', 'checksum_valid')").select("packet_id", "name", F.col("u").alias("valid"))


def protocol_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(_decoded(spark, sf_dir), "diagnostics").select("packet_id", F.col("code").cast("bigint").alias("code"), "severity")


def finding_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets by the number of their diagnostics and the code that stayed."""
    d = T.table(_decoded(spark, sf_dir), "diagnostics").groupBy("packet_id").agg(F.count("*").alias("n"), F.max("code").cast("bigint").alias("code"))
    return d.groupBy("n", "code").agg(F.count("*").alias("packets"))


def layer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = T.table(_decoded(spark, sf_dir), "layers")
    return layers.select("packet_id", F.col("layer_index").cast("bigint").alias("layer_index"), "protocol", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))


def flows_behind_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of all frames: those behind extension headers and first fragments count."""
    p = wire_frames(spark, sf_dir).select("capture_id", "packet_id", "interface_id", "seconds", "fraction", "captured_length", "diag_codes", "data")
    f = X.bidirectional_flows(D.flat_packets(p))
    return f.select("protocol", F.col("a")["port"].cast("bigint").alias("a_port"), F.col("b")["port"].cast("bigint").alias("b_port"), "packets_a_to_b", "packets_b_to_a", "bytes_total")


# --- the same in SQL -----------------------------------------------------------------------------
_W = "w as (select event_id as packet_id, event_id % 10 as c, event_id // 10 as j from events)"


def _rows(case: str, *rows: tuple[str, int, int, str]) -> str:
    """A row for each field of the packets of a case: name, start, length, value."""
    return " union all ".join(f"select packet_id, '{name}' as name, {start}::bigint as start, {length}::bigint as length, ({value})::bigint as value from w where {case}" for name, start, length, value in rows)


_ARP = _rows("c = 0", ("hardware_type", 14, 2, "1"), ("protocol_type", 16, 2, "2048"), ("hardware_length", 18, 1, "6"), ("protocol_length", 19, 1, "4"), ("operation", 20, 2, "case when j % 7 = 0 then 9 else 1 + j % 2 end"))
_ARP += " union all " + _rows("c = 0 and j % 7 <> 0", ("is_request", 20, 2, "1 - j % 2"), ("is_reply", 20, 2, "j % 2"), ("sender_hardware_address", 22, 6, "null"), ("sender_protocol_address", 28, 4, "null"), ("target_hardware_address", 32, 6, "null"), ("target_protocol_address", 38, 4, "null"))

_IPV4_OPTIONS = _rows("c = 1", ("no_operation", 34, 1, "1"), ("option", 35, 4, "null"), ("type", 35, 1, "148"), ("length", 36, 1, "4"), ("data", 37, 2, "null"), ("end_of_options", 39, 3, "0"))

_ICMP = _rows("c = 1", ("type", 42, 1, "8"), ("code", 43, 1, "0"), ("identifier", 46, 2, "packet_id % 65536"), ("sequence_number", 48, 2, "j % 65536"), ("checksum_valid", 44, 2, "case when j % 4 = 0 then 0 else 1 end"))
_ICMP += " union all " + _rows("c = 5", ("type", 54, 1, "128"), ("code", 55, 1, "0"), ("identifier", 58, 2, "packet_id % 65536"), ("sequence_number", 60, 2, "7"), ("checksum_valid", 56, 2, "case when j % 3 = 0 then 0 else 1 end"))


def _plain_extension(case: str, at: int, following: int) -> str:
    return _rows(case, ("next_header", at, 1, str(following)), ("header_extension_length", at + 1, 1, "0"), ("data", at + 2, 6, "null"))


_EXTENSIONS = " union all ".join([
    _plain_extension("c = 2", 54, 60), _plain_extension("c = 2", 62, 6),
    _rows("c = 3", ("next_header", 54, 1, "17"), ("reserved", 55, 1, "0"), ("fragment_offset", 56, 2, "j % 3"), ("more_fragments", 57, 1, "1"), ("identification", 58, 4, "packet_id"), ("fragment_offset_bytes", 56, 2, "j % 3 * 8")),
    *[_plain_extension("c = 9", 54 + 8 * k, 60) for k in range(8)],
])

_TCP_OPTIONS = _rows(
    "c = 2", ("maximum_segment_size", 90, 4, "null"), ("kind", 90, 1, "2"), ("length", 91, 1, "4"), ("value", 92, 2, "1460"), ("selective_acknowledgment_permitted", 94, 2, "null"), ("kind", 94, 1, "4"), ("length", 95, 1, "2"),
    ("timestamps", 96, 10, "null"), ("kind", 96, 1, "8"), ("length", 97, 1, "10"), ("timestamp_value", 98, 4, "packet_id"), ("timestamp_echo_reply", 102, 4, "0"), ("no_operation", 106, 1, "1"), ("window_scale", 107, 3, "null"), ("kind", 107, 1, "3"), ("length", 108, 1, "3"), ("value", 109, 1, "7"),
)
_TCP_OPTIONS += " union all " + _rows("c = 8 and j % 2 = 0", *[("no_operation", 54 + k, 1, "1") for k in range(4)])

_QNAME = "'h' || (j % 10) || '.example.'"
_DNS_QUESTIONS = f"select packet_id, {_QNAME} as qname, 1::bigint as qtype, 1::bigint as qclass, 16::bigint as length from w where c = 4"


def _record(case: str, at: int, label: str, kind: int, ttl: str, size: int) -> str:
    return _rows(case, (label, at, 12 + size, "null"), ("name", at, 2, "null"), ("type", at + 2, 2, str(kind)), ("class", at + 4, 2, "1"), ("ttl", at + 6, 4, ttl), ("rdata_length", at + 10, 2, str(size)))


_DNS_RECORDS = f"""select packet_id, name, start, length, value, case when name = 'name' then {_QNAME.replace('j', 'packet_id // 10')} when name = 'exchange' then 'mail.example.' end as text from (
  {_record("c = 4", 70, "answer", 1, "packet_id % 65536", 4)} union all {_rows("c = 4", ("address", 82, 4, "null"))}
  union all {_record("c = 4 and j % 5 <> 1", 86, "answer", 15, "60", 9)} union all {_rows("c = 4 and j % 5 <> 1", ("preference", 98, 2, "10"), ("exchange", 100, 7, "null"))})"""
_DNS_NAMES = f"""select packet_id, 'name' as name, {_QNAME} as text from w, range(3) r(n) where c = 4 and (n < 2 or j % 5 <> 1)
  union all select packet_id, 'exchange', 'mail.example.' from w where c = 4 and j % 5 <> 1"""

_CHECKSUM = """select packet_id, 'header_checksum_valid' as name, case when c = 8 or (c = 1 and j % 3 = 0) then 0 else 1 end::bigint as valid from w where c in (1, 4, 8)
  union all select packet_id, 'checksum_valid', case when c = 8 or j % (case when c = 1 then 4 else 3 end) = 0 then 0 else 1 end::bigint from w where c in (1, 2, 5, 8)"""

_CODES = """codes as (select packet_id, case
  when c = 0 and j % 7 = 0 then 10 when c = 1 and (j % 3 = 0 or j % 4 = 0) then 12 when c in (2, 5) and j % 3 = 0 then 12 when c = 4 and j % 5 = 1 then 9
  when c = 6 then 10 when c = 7 then 8 when c = 8 and j % 2 = 1 then 9 when c = 8 then 12 when c = 9 then 7 end::bigint as code from w)"""
_SEVERITY = "case code when 8 then 'error' when 10 then 'info' else 'warning' end"

_LAYERS = """select packet_id, l.i::bigint as layer_index, l.p as protocol, l.s::bigint as start, l.n::bigint as length from (select packet_id, unnest(
  [{'i': 0, 'p': 'ethernet', 's': 0, 'n': 14}] || case c
  when 0 then [{'i': 1, 'p': 'arp', 's': 14, 'n': 28}] || case when j % 7 = 0 then [{'i': 2, 'p': 'unsupported', 's': 20, 'n': 22}] else [] end
  when 1 then [{'i': 1, 'p': 'ipv4', 's': 14, 'n': 28}, {'i': 2, 'p': 'icmp', 's': 42, 'n': 8}]
  when 2 then [{'i': 1, 'p': 'ipv6', 's': 14, 'n': 40}, {'i': 2, 'p': 'ipv6_hop_by_hop_options', 's': 54, 'n': 8}, {'i': 3, 'p': 'ipv6_destination_options', 's': 62, 'n': 8}, {'i': 4, 'p': 'tcp', 's': 70, 'n': 40}]
  when 3 then [{'i': 1, 'p': 'ipv6', 's': 14, 'n': 40}, {'i': 2, 'p': 'ipv6_fragment', 's': 54, 'n': 8}] || case when j % 3 = 0 then [{'i': 3, 'p': 'udp', 's': 62, 'n': 8}] else [] end
  when 4 then [{'i': 1, 'p': 'ipv4', 's': 14, 'n': 20}, {'i': 2, 'p': 'udp', 's': 34, 'n': 8}, {'i': 3, 'p': 'dns', 's': 42, 'n': case when j % 5 = 1 then 56 else 65 end}]
  when 5 then [{'i': 1, 'p': 'ipv6', 's': 14, 'n': 40}, {'i': 2, 'p': 'icmpv6', 's': 54, 'n': 8}]
  when 6 then [{'i': 1, 'p': 'unsupported', 's': 12, 'n': 6}]
  when 7 then [{'i': 1, 'p': 'ipv4', 's': 14, 'n': 10}]
  when 8 then [{'i': 1, 'p': 'ipv4', 's': 14, 'n': 20}, {'i': 2, 'p': 'tcp', 's': 34, 'n': 24}]
  else [{'i': 1, 'p': 'ipv6', 's': 14, 'n': 40}] || list_transform(range(8), lambda k: {'i': k + 2, 'p': 'ipv6_destination_options', 's': 54 + 8 * k, 'n': 8}) || [{'i': 10, 'p': 'unsupported', 's': 110, 'n': 1}] end) as l from w)"""

_FLOWS = """select protocol, a_port, b_port, cast(sum(ab) as bigint) as packets_a_to_b, cast(sum(1 - ab) as bigint) as packets_b_to_a, cast(sum(size) as bigint) as bytes_total from (
  select 'tcp' as protocol, 40000 + packet_id % 1000 as a_port, 443 as b_port, 1 as ab, 110 as size from w where c = 2
  union all select 'udp', 5000, 6000, 1, 78 from w where c = 3 and j % 3 = 0
  union all select 'udp', 53, 50000, 1, case when j % 5 = 1 then 98 else 107 end from w where c = 4
  union all select 'tcp', 50001, 80, 1, 58 from w where c = 8) group by all"""

QUERIES = {f.__name__: f for f in (arp_decode, ipv4_options, icmp_decode, ipv6_extensions, tcp_options, dns_questions, dns_records, dns_names, checksum, protocol_diagnostics, finding_arbitration, layer_variants, flows_behind_extensions)}
SQL = {
    "arp_decode": f"with {_W} {_ARP}",
    "ipv4_options": f"with {_W} {_IPV4_OPTIONS}",
    "icmp_decode": f"with {_W} {_ICMP}",
    "ipv6_extensions": f"with {_W} {_EXTENSIONS}",
    "tcp_options": f"with {_W} {_TCP_OPTIONS}",
    "dns_questions": f"with {_W} {_DNS_QUESTIONS}",
    "dns_records": f"with {_W} {_DNS_RECORDS}",
    "dns_names": f"with {_W} {_DNS_NAMES}",
    "checksum": f"with {_W} {_CHECKSUM}",
    "protocol_diagnostics": f"with {_W}, {_CODES} select packet_id, code, {_SEVERITY} as severity from codes where code is not null",
    "finding_arbitration": f"with {_W}, {_CODES} select 1::bigint as n, code, count(*) as packets from codes where code is not null group by code",
    "layer_variants": f"with {_W} {_LAYERS}",
    "flows_behind_extensions": f"with {_W} {_FLOWS}",
}
