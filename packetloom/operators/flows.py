"""Bidirectional flows: keys, totals, TCP evidence, DNS matching, metrics, anomalies and timelines.

Packets are read in the order of their ids. All per-flow work hangs on one exchange by flow key: windows
and the final aggregate below reuse it. A flow's rows of a window spill if they exceed memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.time import MICRO, duration, instant, ticks_per_second

KEY = ["capture_id", "interface_id", "protocol", "a", "b"]
# Thresholds and size classes.
RETRANSMISSIONS = 2
LONG_HANDSHAKE_SECONDS = 2
SIZE_BOUNDS = [0, 64, 128, 256, 512, 1024, 2048, 4096]
TRUNCATION_CODES = (2, 8)
ANOMALIES = ["SynWithoutResponse", "RepeatedSynAttempts", "ConnectionReset", "DnsErrorResponse", "DnsRequestWithoutResponse", "ExcessiveRetransmission", "LongHandshake", "OneSidedCommunication"]


def flow_packets(packets: DataFrame) -> DataFrame:
    """Eligible packets with key (a <= b) and direction; others are left out.

    A packet needs an address pair and a TCP or UDP layer with both ports. Equal endpoints have the
    direction unknown, which counts on side a. tps: ticks of a second, by the packet's resolution; microseconds
    where packets have none.
    """
    src = F.struct(F.col("family"), F.col("src_addr").alias("addr"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("family"), F.col("dst_addr").alias("addr"), F.col("dst_port").alias("port"))
    some = packets.where(F.col("protocol").isin("tcp", "udp") & F.col("src_port").isNotNull() & F.col("dst_port").isNotNull() & F.col("src_addr").isNotNull() & F.col("dst_addr").isNotNull())
    known = {"res_kind", "res_exp"} <= set(packets.columns)
    with_ends = some.withColumns({"_s": src, "_d": dst, "tps": ticks_per_second(F.col("res_kind"), F.col("res_exp")) if known else F.lit(MICRO).cast("bigint")})
    return with_ends.withColumns({
        "a": F.least("_s", "_d"), "b": F.greatest("_s", "_d"),
        "direction": F.when(F.col("_s") < F.col("_d"), "a_to_b").when(F.col("_s") > F.col("_d"), "b_to_a").otherwise("unknown"),
        "t": instant(F.col("seconds"), F.col("fraction")),
        "truncated": F.exists("diag_codes", lambda d: d.isin(*TRUNCATION_CODES)),
    }).drop("_s", "_d")


def _resolution() -> Column:
    """The ticks of a second of all packets of a group, null where they are not alike."""
    low, high, none = F.min("tps"), F.max("tps"), F.count_if(F.col("tps").isNull() & F.col("t").isNotNull())
    return F.when((low == high) & (none == 0), low).alias("ticks_per_second")


def _totals() -> list[Column]:
    from_b = F.col("direction") == "b_to_a"
    size = F.col("captured_length")
    return [
        F.count_if(~from_b).alias("packets_a_to_b"), F.count_if(from_b).alias("packets_b_to_a"),
        F.coalesce(F.sum(F.when(~from_b, size)), F.lit(0)).alias("bytes_a_to_b"), F.coalesce(F.sum(F.when(from_b, size)), F.lit(0)).alias("bytes_b_to_a"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("packet_id").alias("first_packet"), F.bool_or("truncated").alias("truncation_seen"), _resolution(),
    ]


def size_columns() -> list[Column]:
    """Count, extremes, sum and the eight size classes of captured_length."""
    size = F.col("captured_length")
    bins = []
    for k, low in enumerate(SIZE_BOUNDS):
        inside = size >= low if k + 1 == len(SIZE_BOUNDS) else (size >= low) & (size < SIZE_BOUNDS[k + 1])
        bins.append(F.count_if(inside).alias(f"bin{k}"))
    return [F.count("*").alias("size_count"), F.min(size).alias("size_min"), F.max(size).alias("size_max"), F.sum(size).alias("size_sum"), *bins]


def bidirectional_flows(packets: DataFrame) -> DataFrame:
    """A row for each flow: packets and bytes by direction, first and last time, totals."""
    f = flow_packets(packets).groupBy(*KEY).agg(*_totals())
    return f.withColumns({"packets_total": F.col("packets_a_to_b") + F.col("packets_b_to_a"), "bytes_total": F.col("bytes_a_to_b") + F.col("bytes_b_to_a")})


def dense_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in ascending order of columns: range-partitioned, numbered within, shifted by counts."""
    ranged = df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id())
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*columns)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each partition
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size"))
    return inside.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_range", "_n", "_size", "_start")


def flow_ids(flows: DataFrame, name: str = "flow_id") -> DataFrame:
    """Flows numbered by capture, interface, protocol (TCP before UDP) and endpoints."""
    return dense_ids(flows, KEY, name)


def with_tcp_evidence(fp: DataFrame) -> DataFrame:
    """Packets with, on every row, the flow's handshake stages, and on its own row what it repeats.

    first_syn, syn_ack, established: ids of the first SYN, of the first SYN-ACK against it after, of the
    first ACK in its direction after that. prev_seq, prev_ack: the last value in the same direction
    before, with its packet; a value in an unknown direction has none. fin_rank numbers a flow's FINs.
    """
    flow = Window.partitionBy(*KEY)
    before = Window.partitionBy(*KEY, "direction").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    pid, known = F.col("packet_id"), F.col("direction") != "unknown"
    t = fp.withColumn("first_syn", F.min(F.when(F.col("syn") & ~F.col("ack"), pid)).over(flow))
    t = t.withColumn("syn_direction", F.max(F.when(pid == F.col("first_syn"), F.col("direction"))).over(flow))
    t = t.withColumn("syn_ack", F.min(F.when(F.col("syn") & F.col("ack") & (pid > F.col("first_syn")) & (F.col("direction") != F.col("syn_direction")), pid)).over(flow))
    t = t.withColumn("established", F.min(F.when(F.col("ack") & (pid > F.col("syn_ack")) & (F.col("direction") == F.col("syn_direction")), pid)).over(flow))
    last = lambda c: F.when(known, F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), pid.alias("id"))), ignorenulls=True).over(before))
    fins = Window.partitionBy(*KEY).orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({"prev_seq": last("seq"), "prev_ack": last("ack_no"), "fin_rank": F.when(F.col("fin"), F.count(F.when(F.col("fin"), 1)).over(fins))})


def _tcp_columns() -> list[Column]:
    pid, seq, prev = F.col("packet_id"), F.col("seq"), F.col("prev_seq")
    pair = lambda cond, p: F.min(F.when(cond, F.struct(pid.alias("second"), p["id"].alias("first"), F.col("direction").alias("direction"))))
    again = seq == prev["v"]
    first_at = lambda c: F.max(F.when(pid == F.col(c), F.col("t")))
    return [
        F.max("first_syn").alias("first_syn"), F.max("syn_ack").alias("syn_ack"), F.max("established").alias("established"),
        first_at("first_syn").alias("syn_t"), first_at("established").alias("established_t"),
        F.min(F.when(F.col("syn") & ~F.col("ack") & (pid > F.col("first_syn")) & (F.col("direction") == F.col("syn_direction")), pid)).alias("repeated_syn"),
        pair(again, prev).alias("retransmission"), pair(seq < prev["v"], prev).alias("out_of_order"),
        pair((F.col("ack_no") == F.col("prev_ack")["v"]) & F.col("ack"), F.col("prev_ack")).alias("duplicate_ack"),
        F.count_if(again & (F.col("direction") == "a_to_b")).alias("retransmissions_a"), F.count_if(again & (F.col("direction") == "b_to_a")).alias("retransmissions_b"),
        F.min(F.when(seq.isNotNull() & ~F.col("syn") & ~F.col("fin") & ~F.col("rst") & ~F.col("ack") & F.col("t").isNotNull(), F.struct(pid.alias("id"), F.col("t").alias("t"))))["t"].alias("data_t"),
        F.max(F.when(F.col("rst"), pid)).alias("reset"), F.min(F.when(F.col("fin"), pid)).alias("first_fin"),
        F.when(F.count_if(F.col("fin")) > 1, F.array_sort(F.array(F.min(F.when(F.col("fin"), pid)), F.min(F.when(F.col("fin") & (F.col("fin_rank") == 2), pid))))[1]).alias("second_fin"),
    ]


def tcp_flows(packets: DataFrame) -> DataFrame:
    """A row for each TCP flow: totals, evidence, establishment, termination, indicators and partial_capture."""
    return _with_states(with_tcp_evidence(flow_packets(packets).where("protocol = 'tcp'")).groupBy(*KEY).agg(*_totals(), *_tcp_columns()))


def _with_states(f: DataFrame) -> DataFrame:
    syn, none = F.col("first_syn"), F.lit("not_observed")
    state = F.when(F.col("established").isNotNull(), "established").when(syn.isNotNull() & F.col("reset").isNotNull(), "failed_reset").when(F.col("repeated_syn").isNotNull(), "failed_repeated_syn").when(syn.isNotNull(), "in_progress").otherwise(none)
    f = f.withColumns({
        "establishment": state,
        "establishment_confidence": F.when(state.isin("established", "failed_reset"), "certain").when(state != none, "inferred"),
        "termination": F.when(F.col("reset").isNotNull(), "reset").when(F.col("first_fin").isNotNull(), "fin").otherwise(none),
        "termination_confidence": F.when(F.col("reset").isNotNull() | F.col("second_fin").isNotNull(), "certain").when(F.col("first_fin").isNotNull(), "inferred"),
        "one_sided": (F.col("packets_a_to_b") == 0) | (F.col("packets_b_to_a") == 0),
    })
    return f.withColumn("partial_capture", F.col("one_sided") | (F.col("establishment") != "established") | (F.col("termination") == none))


def _limits() -> Column:
    return F.array_compact(F.array(F.when(F.col("one_sided"), F.lit("one_sided_view")), F.when(F.col("truncation_seen"), F.lit("capture_truncated")))).alias("limits")


def dns_epochs(packets: DataFrame, timed: bool) -> DataFrame:
    """A row for each flow, transaction and epoch: the queries before a response, and the response if there is one.

    An epoch ends with a response. Queries that ask nothing don't count. timed: packets without time
    are left out, as for latencies; anomalies count them. one_sided, truncation_seen: of the whole flow.
    """
    flow, from_b = Window.partitionBy(*KEY), F.col("direction") == "b_to_a"
    d = flow_packets(packets)
    if not timed:
        d = d.withColumns({"one_sided": F.bool_and(from_b).over(flow) | F.bool_and(~from_b).over(flow), "truncation_seen": F.bool_or("truncated").over(flow)})
    else:
        d = d.withColumns({"one_sided": F.lit(None).cast("boolean"), "truncation_seen": F.lit(None).cast("boolean")})
    d = d.where("dns_txid is not null")
    d = d.where("t is not null") if timed else d
    response = F.coalesce(F.col("dns_is_response"), F.lit(False))
    earlier = Window.partitionBy(*KEY, "dns_txid").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("epoch", F.coalesce(F.sum(response.cast("long")).over(earlier), F.lit(0)))
    asks = ~response & F.coalesce(F.col("dns_qdcount") > 0, F.lit(True))
    row = F.struct(F.col("packet_id").alias("id"), F.col("t").alias("t"))
    return d.groupBy(*KEY, "dns_txid", "epoch").agg(
        F.min(F.when(asks, row)).alias("first_query"), F.max(F.when(asks, row)).alias("last_query"),
        _resolution(), F.bool_or("one_sided").alias("one_sided"), F.bool_or("truncation_seen").alias("truncation_seen"), F.min(F.when(response, row)).alias("response"), F.coalesce(F.max(F.when(response, F.col("dns_rcode"))), F.lit(0)).alias("rcode"),
    )


def dns_latency(packets: DataFrame, exact: bool = False) -> DataFrame:
    """Least ticks from a flow's first pending query to its response."""
    return dns_epochs(packets, timed=True).withColumn("ticks", duration(F.col("first_query")["t"], F.col("response")["t"], F.col("ticks_per_second"), exact)).groupBy(*KEY).agg(F.min("ticks").alias("dns_response_ticks")).where("dns_response_ticks is not null")


def _with_dns_ticks(fp: DataFrame, exact: bool) -> DataFrame:
    """fp with dns_ticks: on a response, the ticks since the first query of its transaction that waits for it."""
    timed = F.col("dns_txid").isNotNull() & F.col("t").isNotNull()
    response = timed & F.coalesce(F.col("dns_is_response"), F.lit(False))
    asks = timed & ~response & F.coalesce(F.col("dns_qdcount") > 0, F.lit(True))
    earlier = Window.partitionBy(*KEY, "dns_txid").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    fp = fp.withColumn("_epoch", F.coalesce(F.sum(response.cast("long")).over(earlier), F.lit(0)))
    query = F.min(F.when(asks, F.struct("packet_id", "t", "tps"))).over(Window.partitionBy(*KEY, "dns_txid", "_epoch"))
    fp = fp.withColumn("_query", query)
    return fp.withColumn("dns_ticks", F.when(response & (F.col("_query")["tps"] == F.col("tps")), duration(F.col("_query")["t"], F.col("t"), F.col("tps"), exact))).drop("_epoch", "_query")


def flow_metrics(packets: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each flow: totals, duration, sizes, latencies, partial_capture. UDP flows are always partial.

    One scan and one exchange by flow: evidence and DNS epochs are windows over it, all else one aggregate.

    Durations are in ticks of the flow's own resolution, ticks_per_second; null where its packets' differ.
    """
    fp = with_tcp_evidence(_with_dns_ticks(flow_packets(packets), exact))
    out = _with_states(fp.groupBy(*KEY).agg(*_totals(), *size_columns(), *_tcp_columns(), F.min("dns_ticks").alias("dns_response_ticks")))
    between = lambda a, b: F.nullif(duration(F.col(a), F.col(b), F.col("ticks_per_second"), exact), F.lit(0))
    return out.withColumns({
        "handshake_ticks": between("syn_t", "established_t"), "first_data_ticks": between("established_t", "data_t"),
        "duration_ticks": duration(F.col("first_t"), F.col("last_t"), F.col("ticks_per_second"), exact),
        "packets_total": F.col("packets_a_to_b") + F.col("packets_b_to_a"), "bytes_total": F.col("bytes_a_to_b") + F.col("bytes_b_to_a"),
    })


def anomalies(packets: DataFrame, exact: bool = False) -> DataFrame:
    """Findings: key, kind, kind_order, confidence, limitations (joined by comma), first, second (evidence packets).

    A flow seen from one side, or with truncated packets, has limitations, and then nothing is certain.
    """
    tcp = tcp_flows(packets)
    first = F.col("first_syn")
    handshake = duration(F.col("syn_t"), F.col("established_t"), F.col("ticks_per_second"), exact)
    no = F.lit(None).cast("bigint")
    cases = [
        (0, first.isNotNull() & F.col("syn_ack").isNull() & F.col("reset").isNull(), "inferred", first, no),
        (1, F.col("repeated_syn").isNotNull(), "certain", first, F.col("repeated_syn")),
        (2, F.col("reset").isNotNull() & first.isNotNull(), "certain", first, F.col("reset")),
        (5, F.greatest("retransmissions_a", "retransmissions_b") >= RETRANSMISSIONS, "inferred", F.col("retransmission")["first"], F.col("retransmission")["second"]),
        (7, F.col("one_sided"), "inferred", F.col("first_packet"), no),
        (6, handshake > F.try_multiply(F.col("ticks_per_second"), F.lit(LONG_HANDSHAKE_SECONDS)), "inferred", first, F.col("established")),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind_order"), F.lit(conf).alias("base"), a.alias("first"), b.alias("second"))) for k, c, conf, a, b in cases]), lambda x: x.isNotNull())
    from_tcp = tcp.select(*KEY, _limits(), F.explode(found).alias("x")).select(*KEY, "limits", "x.*")
    dns = dns_epochs(packets, timed=False).withColumn("limits", _limits())
    error = dns.where("response is not null and rcode <> 0").select(*KEY, "limits", F.lit(3).alias("kind_order"), F.lit("certain").alias("base"), F.coalesce(F.col("last_query")["id"], F.col("response")["id"]).alias("first"), F.when(F.col("last_query").isNotNull(), F.col("response")["id"]).alias("second"))
    waiting = dns.where("response is null and last_query is not null").select(*KEY, "limits", F.lit(4).alias("kind_order"), F.lit("inferred").alias("base"), F.col("last_query")["id"].alias("first"), no.alias("second"))
    # TCP flows seen from one side are among from_tcp
    flows = bidirectional_flows(packets.where("protocol = 'udp'")).withColumn("one_sided", (F.col("packets_a_to_b") == 0) | (F.col("packets_b_to_a") == 0))
    sided = flows.where("one_sided").select(*KEY, _limits(), F.lit(7).alias("kind_order"), F.lit("inferred").alias("base"), F.col("first_packet").alias("first"), no.alias("second"))
    every = from_tcp.unionByName(error).unionByName(waiting).unionByName(sided)
    return every.select(
        *KEY, "kind_order", F.element_at(F.array(*map(F.lit, ANOMALIES)), F.col("kind_order") + 1).alias("kind"),
        F.when(F.size("limits") > 0, F.lit("inferred")).otherwise(F.col("base")).alias("confidence"), F.array_join("limits", ",").alias("limitations"), "first", "second",
    )


def timeline(packets: DataFrame, exact: bool = False) -> DataFrame:
    """Messages of each flow in packet order: message_index, lane (a or b), offset_ticks since the flow's first time."""
    flow = Window.partitionBy(*KEY)
    fp = flow_packets(packets).withColumns({"_first": F.min("t").over(flow), "_low": F.min("tps").over(flow), "_high": F.max("tps").over(flow)})
    return fp.select(
        *KEY, (F.row_number().over(flow.orderBy("packet_id")) - 1).cast("bigint").alias("message_index"), "packet_id", "direction",
        F.when(F.col("direction") == "b_to_a", "b").otherwise("a").alias("lane"), F.col("captured_length").alias("size"), duration(F.col("_first"), F.col("t"), F.when(F.col("_low") == F.col("_high"), F.col("_low")), exact).alias("offset_ticks"),
    )


def in_window(offset: Column, start: int | None, end: int | None) -> Column:
    """Inclusive bounds; a message without an offset always passes."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (offset >= start)
    if end is not None:
        inside = inside & (offset <= end)
    return offset.isNull() | inside


def zoom(messages: DataFrame, start: int | None = None, end: int | None = None, max_points: int | None = None) -> DataFrame:
    """Timeline entries of each flow: single packets, or runs of them where there are more than max_points."""
    some = messages.where(in_window(F.col("offset_ticks"), start, end))
    flow = Window.partitionBy(*KEY)
    some = some.withColumns({"_n": F.count("*").over(flow), "_r": F.row_number().over(flow.orderBy("packet_id")) - 1})
    if max_points is None:
        width = F.lit(1)
    elif max_points == 0:
        return some.where(F.lit(False)).groupBy(*KEY, F.lit(0).cast("bigint").alias("entry")).agg(*_chunk())
    else:
        width = F.ceil(F.col("_n") / max_points)
    return some.groupBy(*KEY, F.floor(F.col("_r") / width).cast("bigint").alias("entry")).agg(*_chunk())


def _chunk() -> list[Column]:
    at = lambda c, f: f(F.struct("packet_id", F.col(c).alias("v")))["v"]
    return [
        F.count("*").alias("packet_count"), F.min("packet_id").alias("first_packet"), F.max("packet_id").alias("last_packet"),
        at("size", F.min).alias("first_size"), at("size", F.max).alias("last_size"), F.sum("size").alias("total_bytes"),
        at("offset_ticks", F.min).alias("first_offset"), at("offset_ticks", F.max).alias("last_offset"), F.min("offset_ticks").alias("min_offset"), F.max("offset_ticks").alias("max_offset"),
    ]
