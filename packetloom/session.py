"""One capture set, and what can be asked of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import decode, tree
from packetloom.functions.time import extrema
from packetloom.operators import correlate, flows, paging
from packetloom.sources import pcap


class Session:
    """Lazy: each answer is a DataFrame, planned when asked for."""

    def __init__(self, spark: SparkSession, path: str | list[str], limits: pcap.Limits | None = None, mode: str = "PERMISSIVE"):
        self.spark, self.path, self.records = spark, path, pcap.read_captures(spark, path, limits, mode)

    @cached_property
    def _packets(self) -> DataFrame:
        return pcap.packets(self.records)

    @cached_property
    def _trees(self) -> DataFrame:
        return tree.decode_trees(self._packets)

    @cached_property
    def _flat(self) -> DataFrame:
        codes = self._trees.select("capture_id", "packet_id", F.transform("diagnostics", lambda d: d["code"]).alias("diag_codes"))
        return decode.flat_packets(self._packets.where("link_type = 1").drop("diag_codes")).join(codes, ["capture_id", "packet_id"])

    def packets(self, start: int = 0, rows: int = paging.MAX_ROWS) -> DataFrame:
        return paging.packet_page(self._packets, start, rows)

    def _one(self, df: DataFrame, packet_id: int, capture_id: str | None) -> DataFrame:
        """That packet of one capture, or of each if none is named."""
        df = df.where(F.col("packet_id") == packet_id)
        return df if capture_id is None else df.where(F.col("capture_id") == capture_id)

    def detail(self, packet_id: int, capture_id: str | None = None) -> DataFrame:
        return paging.packet_detail(tree.decode_trees(self._one(self._packets, packet_id, capture_id)))

    def correlate(self, packet_id: int, start: int, length: int, capture_id: str | None = None) -> DataFrame:
        one = self.spark.range(1).select(F.lit(0).cast("bigint").alias("selection_id"), F.lit(packet_id).cast("bigint").alias("packet_id"), F.lit(start).cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("length"))
        return correlate.correlate(one, tree.table(self.detail(packet_id, capture_id), "fields"))

    def evidence(self, packet_id: int, start: int = 0, most: int = paging.EVIDENCE_BYTES, capture_id: str | None = None) -> DataFrame:
        return self._one(self._packets, packet_id, capture_id).select("capture_id", "packet_id", paging.evidence(F.col("data"), F.lit(start), most).alias("bytes"))

    def capture_evidence(self, offset: int, length: int, capture_id: str | None = None) -> DataFrame:
        """Bytes at an absolute offset of a capture."""
        files = self.spark.read.format("binaryFile").load(self.path)
        files = files if capture_id is None else files.where(F.col("path") == capture_id)
        return files.select(F.col("path").alias("capture_id"), paging.capture_evidence(F.col("content"), F.lit(offset), length).alias("bytes"))

    def resource_stats(self) -> DataFrame:
        return pcap.resource_stats(self.records)

    def diagnostics(self) -> DataFrame:
        return pcap.diagnostics(self.records)

    def summary(self) -> DataFrame:
        return pcap.import_summary(self.records)

    def extrema(self) -> list[tuple[int, int, str, int]]:
        return extrema(self._packets)

    def flows(self) -> DataFrame:
        return flows.flow_ids(flows.bidirectional_flows(self._flat))

    def tcp_states(self) -> DataFrame:
        return flows.tcp_flows(self._flat)

    def metrics(self) -> DataFrame:
        return flows.flow_metrics(self._flat)

    def anomalies(self) -> DataFrame:
        return flows.anomalies(self._flat)

    def timelines(self) -> DataFrame:
        return flows.timeline(self._flat)
