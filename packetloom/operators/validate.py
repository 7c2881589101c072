"""Integrity of a capture's tables: each check counts the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _count(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def check_packets(packets: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """check, violations: dense ids, lengths, time parts, and the interface of each packet."""
    ids = packets.groupBy("capture_id").agg(F.min("packet_id").alias("a"), F.max("packet_id").alias("b"), F.countDistinct("packet_id").alias("d"), F.count("*").alias("n"))
    checks = [
        _count("packet_id_dense", ids.where("a <> 0 or b <> n - 1 or d <> n")),
        _count("captured_length_negative", packets.where("captured_length < 0")),
        _count("timestamp_halves", packets.where("(seconds is null) <> (fraction is null)")),
        _count("timestamp_fraction", packets.where("fraction < 0 or fraction >= case when res_kind = 'decimal' then power(10, res_exp) else power(2, res_exp) end")),
    ]
    if "data" in packets.columns:
        checks.append(_count("data_length", packets.where("length(data) <> captured_length")))
    if interfaces is not None:
        known = interfaces.select("capture_id", "interface_id", F.col("res_kind").alias("_k"), F.col("res_exp").alias("_e"))
        j = packets.join(known, ["capture_id", "interface_id"], "left")
        checks += [_count("packet_interface", j.where("_e is null")), _count("packet_resolution", j.where("seconds is not null and (_k <> res_kind or _e <> res_exp)"))]
    return reduce(DataFrame.unionByName, checks)


def check_sections(sections: DataFrame) -> DataFrame:
    """Sections of a capture in order and without overlap."""
    before = F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("capture_id").orderBy("section_id"))
    return _count("section_order", sections.withColumn("_b", before).where("_b > start"))


def check_fields(fields: DataFrame, packets: DataFrame) -> DataFrame:
    """Fields inside their packet and their parent, after it, with a parent that exists."""
    keys = ["capture_id", "packet_id"] if "capture_id" in fields.columns and "capture_id" in packets.columns else ["packet_id"]
    parent = fields.select(*keys, F.col("field_id").alias("parent_id"), F.col("start").alias("p0"), (F.col("start") + F.col("length")).alias("p1"))
    j = fields.where("parent_id is not null").join(parent, [*keys, "parent_id"], "left")
    inside = fields.join(packets.select(*keys, "captured_length"), keys, "left")
    return reduce(DataFrame.unionByName, [
        _count("field_parent_missing", j.where("p0 is null")), _count("field_before_parent", j.where("field_id <= parent_id")),
        _count("field_outside_parent", j.where("start < p0 or start + length > p1")), _count("field_outside_packet", inside.where("captured_length is null or start < 0 or start + length > captured_length")),
    ])


def check_trees(trees: DataFrame) -> DataFrame:
    """The checks of check_fields on trees that kept the captured_length of their packet: a row each, so no row meets another.

    A parent is looked for where its field_id says, then among all fields; of several the first.
    """
    parent = "case when get(fields, f.parent_id).field_id = f.parent_id then get(fields, f.parent_id) else get(filter(fields, g -> g.field_id = f.parent_id), 0) end"
    pairs = trees.selectExpr("captured_length", f"transform(fields, f -> struct(f.field_id, f.parent_id, f.start, f.start + f.length as stop, {parent} as p)) as pairs")
    bad = {
        "field_parent_missing": "f.parent_id is not null and f.p is null",
        "field_before_parent": "f.field_id <= f.parent_id",
        "field_outside_parent": "f.start < f.p.start or f.stop > f.p.start + f.p.length",
        "field_outside_packet": "captured_length is null or f.start < 0 or f.stop > captured_length",
    }
    counts = pairs.agg(*[F.coalesce(F.sum(F.expr(f"size(filter(pairs, f -> {rule}))").cast("bigint")), F.lit(0)).alias(name) for name, rule in bad.items()])
    return counts.selectExpr(f"stack({len(bad)}, {', '.join(f"'{name}', {name}" for name in bad)}) as (`check`, violations)")
