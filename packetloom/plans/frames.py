"""Ethernet frames of the events trace: what its packets would be on the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex(value: Column | int, digits: int) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.lpad(F.hex(v.cast("bigint")), digits, "0")


def frames(p: DataFrame) -> DataFrame:
    """p with data: Ethernet, every eleventh with a VLAN tag, then IPv4 or IPv6, TCP or UDP, and a DNS header in UDP."""
    vid = F.col("packet_id") % 4096
    tag = F.when(F.col("packet_id") % 11 == 0, F.concat(F.lit("8100"), _hex(vid, 4))).otherwise(F.lit(""))
    flags = sum((F.when(F.col(n), m).otherwise(0) for n, m in (("fin", 1), ("syn", 2), ("rst", 4), ("ack", 16))), F.lit(0))
    dns = F.concat(_hex(F.col("dns_txid"), 4), _hex(F.when(F.col("dns_is_response"), 0x8000 + F.col("dns_rcode")).otherwise(0), 4), _hex(F.col("dns_qdcount"), 4), _hex(F.col("dns_ancount"), 4), F.lit("00000000"))
    tcp = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), _hex(F.coalesce("seq", F.lit(0)), 8), _hex(F.coalesce("ack_no", F.lit(0)), 8), F.lit("50"), _hex(flags, 2), F.lit("200000000000"))
    udp = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), F.lit("00140000"), dns)
    body = F.when(F.col("is_tcp"), tcp).otherwise(udp)  # 20 bytes either way
    proto = F.when(F.col("is_tcp"), "06").otherwise("11")
    v4 = F.concat(F.lit("0800450000280000400040"), proto, F.lit("0000"), F.hex("src_addr"), F.hex("dst_addr"))
    v6 = F.concat(F.lit("86dd600000000014"), proto, F.lit("40"), F.hex("src_addr"), F.hex("dst_addr"))
    net = F.when(F.col("family") == 4, v4).otherwise(v6)
    return p.withColumn("data", F.unhex(F.concat(F.lit("020000000001020000000002"), tag, net, body)))
