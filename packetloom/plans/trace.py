"""A deterministic packet trace made of the events table: one packet for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_COLUMNS = (
    "capture_id string, packet_id bigint, interface_id bigint, seconds bigint, fraction bigint, res_kind string, res_exp int, "
    "captured_length bigint, original_length bigint, diag_codes array<int>, family int, src_addr binary, dst_addr binary, "
    "protocol string, src_port int, dst_port int, is_tcp boolean, seq bigint, ack_no bigint, syn boolean, ack boolean, "
    "fin boolean, rst boolean, dns_txid int, dns_is_response boolean, dns_rcode int, dns_qdcount int, dns_ancount int"
)


def spread(events: DataFrame) -> DataFrame:
    """events over as many tasks as there are cores, or more: a small file is one task's, and what follows is dear.

    Only for a scan, whose number of tasks is known without running anything.
    """
    n = events.sparkSession.sparkContext.defaultParallelism
    return events if events.rdd.getNumPartitions() >= n else events.repartition(n, "event_id")


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, flat: see PACKET_COLUMNS. Narrow work on one scan; no shuffle but where the scan has fewer tasks than there are cores."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts", "props")).select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us0"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )
    e = e.selectExpr("*", "case when user_id % 7 = 3 then us0 div 100000 else us0 end as us", "user_id % 10 = 7 as v6", "user_id % 3 = 2 as udp", "(event_id * 7 + k) % 3 = 0 as back")
    e = e.selectExpr(
        "*",
        "case when v6 then unhex(concat('20010db8', lpad(hex(user_id), 24, '0'))) else unhex(lpad(hex(167772160L + user_id), 8, '0')) end as client",
        "cast(40000 + event_id div 1000 as int) as client_port",
        "user_id % 50 = 49 as self",
    )
    e = e.selectExpr(
        "*",
        """case when self then client when v6 then unhex(concat('20010db8ffff', lpad(hex(user_id % 5 + 1), 20, '0')))
           when user_id % 4 = 1 then unhex(lpad(hex(16843008L + user_id % 5 + 1), 8, '0')) else unhex(lpad(hex(3221225984L + user_id % 5 + 1), 8, '0')) end as server""",
        "case when self then client_port when udp then 53 else 443 end as server_port",
    )
    return e.selectExpr(
        "'events' as capture_id", "event_id as packet_id", "user_id % 2 as interface_id",
        "case when event_id % 97 <> 0 then us div 1000000 end as seconds",
        "case when event_id % 97 <> 0 then us % 1000000 end as fraction",
        "'decimal' as res_kind", "6 as res_exp",
        "40 + cast(floor(value) as bigint) as captured_length",
        "40 + cast(floor(value) as bigint) + case when event_id % 5 = 0 then 100 else 0 end as original_length",
        "case when event_id % 89 = 0 then array(8) else cast(array() as array<int>) end as diag_codes",
        "case when v6 then 6 else 4 end as family",
        "case when back then server else client end as src_addr", "case when back then client else server end as dst_addr",
        "case when udp then 'udp' else 'tcp' end as protocol",
        "case when back then server_port else client_port end as src_port", "case when back then client_port else server_port end as dst_port",
        "not udp as is_tcp",
        "case when not udp and event_id % 31 <> 0 then 1000L + k % 7 end as seq", "case when not udp and event_id % 37 <> 0 then 2000L + k % 5 end as ack_no",
        "not udp and event_type = 'signup' as syn",
        "not udp and (event_type in ('click', 'purchase') or (event_type = 'signup' and back) or (event_type = 'error' and k >= 30)) as ack",
        "not udp and event_type = 'purchase' as fin", "not udp and event_type = 'error' and k < 30 as rst",
        "case when udp then cast(k % 8 as int) end as dns_txid", "case when udp then back end as dns_is_response", "case when udp then cast(k % 4 as int) end as dns_rcode",
        "case when udp then 1 - cast(k % 10 = 0 as int) end as dns_qdcount", "case when udp and back then 1 when udp then 0 end as dns_ancount",
    )
