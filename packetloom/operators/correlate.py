"""Fields and byte selections: preorder, overlap and the seven-key order of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _packet_keys(*tables: DataFrame) -> list[str]:
    """What names a packet in all these tables: its id, with the capture's where all have it."""
    return ["capture_id", "packet_id"] if all("capture_id" in t.columns for t in tables) else ["packet_id"]


def preorder(fields: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Fields of each packet by layer and preorder place; a packet with more than max_fields fails the query."""
    keys = _packet_keys(fields)
    if max_fields is not None:
        n = F.count("*").over(Window.partitionBy(*keys))
        fields = fields.withColumn("_n", n).where(F.when(F.col("_n") > max_fields, F.raise_error(F.lit("field limit exceeded")).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("layer_index", "preorder")) - 1
    return fields.withColumn("position", place.cast("bigint"))


def correlate(selections: DataFrame, fields: DataFrame) -> DataFrame:
    """Matches of selections (selection_id, packet_id, start, length) in fields (packet_id, field_id, depth, start, length).

    A selection of bytes matches fields of bytes that overlap it; an empty one matches empty fields at
    its start. rank 0 is the primary match: exact, then containing, of these the shorter, then the
    larger overlap, the deeper, the shorter, the smaller field_id. An equi-join on packet_id, and on
    capture_id if both tables have it; selections without it are asked of each capture.
    """
    keys = _packet_keys(selections, fields)
    capture = ["capture_id"] if "capture_id" in fields.columns else []
    s = selections.select("selection_id", *keys, F.col("start").alias("s0"), (F.col("start") + F.col("length")).alias("s1"))
    f = fields.select("packet_id", *capture, "field_id", "depth", F.col("start").alias("f0"), (F.col("start") + F.col("length")).alias("f1"))
    empty = F.col("s0") == F.col("s1")
    hit = F.when(empty, (F.col("f0") == F.col("s0")) & (F.col("f1") == F.col("f0"))).otherwise((F.col("f1") > F.col("f0")) & (F.col("f0") < F.col("s1")) & (F.col("f1") > F.col("s0")))
    m = s.join(f, keys).where(hit)
    size = F.col("f1") - F.col("f0")
    exact = (F.col("f0") == F.col("s0")) & (F.col("f1") == F.col("s1"))
    holds = (F.col("f0") <= F.col("s0")) & (F.col("f1") >= F.col("s1"))
    overlap = F.least("f1", "s1") - F.greatest("f0", "s0")
    order = Window.partitionBy("selection_id", *capture).orderBy(exact.desc(), holds.desc(), F.when(holds, size).otherwise(0).asc(), overlap.desc(), F.col("depth").desc(), size.asc(), F.col("field_id").asc())
    return m.select("selection_id", *capture, "packet_id", "field_id", (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def out_of_bounds(selections: DataFrame, packets: DataFrame) -> DataFrame:
    """Selections whose packet is absent or ends before them, with the reason."""
    keys = _packet_keys(selections, packets)
    j = selections.join(packets.select(*keys, "captured_length"), keys, "left")
    reason = F.when(F.col("captured_length").isNull(), "packet_not_found").when(F.col("start") + F.col("length") > F.col("captured_length"), "selection_out_of_bounds")
    return j.withColumn("reason", reason).where("reason is not null").select("selection_id", *keys, "reason")


def dictionary(fields: DataFrame) -> DataFrame:
    """Distinct field names."""
    return fields.select("name").distinct()
