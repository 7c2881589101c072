"""Connected components of a link table: of few links on the driver, of more by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm._shared import forgotten, written

#: Links, of 16 bytes, that the driver joins by itself.
FEW = 1 << 17


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links u-v: at most a link for each node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(u):
        one, two = label[a], label[b]
        if (one == two).all():
            break
        least = np.minimum(one, two)
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _large(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node in sight."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them. u > v in e."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60, few: int | None = None) -> DataFrame:
    """node, root for every node of links (u, v: bigint): root is the least node of its component.

    Over few links (else FEW): only aggregates that combine before the shuffle, and joins whose hot side
    Spark may split, so a node with very many links is no single task's work. Each round is written to the
    shared folder, which on a local disk starts a process for each file and folder; few links need no round.
    Self links and links with a null are left out; an empty table gives an empty one.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "links")
    if e.count() <= (FEW if few is None else few):
        found = e.toArrow()
        forgotten(e)
        node, root = forest(found.column("u").to_numpy(), found.column("v").to_numpy())
        own = np.unique(root)
        return links.sparkSession.createDataFrame(pa.table({"node": pa.array(np.concatenate([node, own]), pa.int64()), "root": pa.array(np.concatenate([root, own]), pa.int64())}))
    last = None
    for _ in range(most_rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")).first()
        if state == last or not state.n:
            break
        last = state
        before, e = e, written(_small(_large(e).distinct()).distinct(), "links")
        forgotten(before)
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
