"""Flow totals over a stream of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.flows import KEY, _totals, flow_packets


def streaming_flows(packets: DataFrame, watermark: str = "1 hour", window: str | None = "1 day") -> DataFrame:
    """bidirectional_flows of a stream by windows of event time, whose state is dropped behind the watermark.

    Without a window a flow is never over: its state stays for as long as the query runs.

    Event time is the packet's own; packets without time can't be placed and are left out here, unlike
    in batch.
    """
    timed = packets.where("seconds is not null").withColumn("event_time", F.timestamp_seconds(F.col("seconds"))).withWatermark("event_time", watermark)
    fp = flow_packets(timed)
    keys = [*KEY, F.window("event_time", window)] if window else KEY
    return fp.groupBy(*keys).agg(*_totals())
