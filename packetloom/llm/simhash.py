"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is two halves of 32. Of two fingerprints at 3 or fewer differing bits, one
half differs in at most one bit (the threshold within a half is 3 // 2 = 1). In each half the anchors
are the words of the perfect Hamming code of 31 bits, with the last bit free: the covering radius is 1,
so each half lies within 1 of an anchor, its home. Every fingerprint is copied to all anchors within
covering radius plus threshold, 2 bits: 17 at most. A half at one bit from another is therefore found
at the other's home, and only fingerprints at the same anchor are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _bytes as B
from packetloom.llm._shared import written
from packetloom.llm.components import components, forest

THRESHOLD = 3
#: Fingerprints at one anchor that one task compares with each other; more are dealt out in squares.
BUCKET = 4096
_CODE = 31


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 bytes, A-Z lower-cased, words parted by ASCII space."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    step = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(step)[:-1]])
    end = start[size - 1 :] + step[size - 1 :] - 1
    n, ones, digest = len(end), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 15):
        cut = [digest(joined[s:e], seed) for s, e in zip(start[a : a + (1 << 15)].tolist(), end[a : a + (1 << 15)].tolist())]
        ones += np.unpackbits(np.array(cut, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """key, fp (bigint with the 64 bits) of each row; null and wordless texts have fp 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column("t"))
            whole = memoryview(np.ascontiguousarray(data))
            fp = np.array([fingerprint(bytes(whole[a:b]), size) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fp.view(np.int64))], ["k", "fp"])
        B.release()

    wanted = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return wanted.mapInArrow(hashed, f"k {wanted.schema['k'].dataType.simpleString()}, fp bigint").withColumnRenamed("k", key)


def _masks() -> list[int]:
    """Bit positions 1..31 (bit p - 1 of the half) whose number has bit j: the parity checks."""
    return [sum(1 << (p - 1) for p in range(1, _CODE + 1) if p >> j & 1) for j in range(5)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within 2 bits of each 32-bit half."""
    half = half.astype(np.uint32)
    syndrome = np.zeros(len(half), np.int64)
    for j, mask in enumerate(_masks()):
        syndrome |= (np.bitwise_count(half & np.uint32(mask)).astype(np.int64) & 1) << j
    bit = np.array([0] + [1 << (p - 1) for p in range(1, _CODE + 1)], np.uint32)
    home = half ^ bit[syndrome]
    rows, found = [np.arange(len(half))] * 2, [home, home ^ np.uint32(1 << 31)]
    for p in range(1, _CODE + 1):
        q = syndrome ^ p
        pair = np.flatnonzero((syndrome > 0) & (q > p))
        rows.append(pair)
        found.append(half[pair] ^ bit[p] ^ bit[q[pair]])
    return np.concatenate(rows), np.concatenate(found)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(every), 1 << 14):
            fp = every[a : a + (1 << 14)]
            keys, values = [], []
            for k, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
                row, anchor = anchors(half)
                keys.append(anchor.astype(np.int64) | np.int64(k << 32))
                values.append(fp[row].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], ["anchor", "fp"])


def _links(group: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fp of each run of equal group, reduced to a forest."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(group)))
    us, vs = [], []
    small = np.repeat(size <= 24, size)
    x, g = fp[small], group[small]
    for d in range(1, min(24, len(x))):
        near = np.flatnonzero((g[d:] == g[:-d]))
        if not len(near):
            break
        near = near[np.bitwise_count(x[near + d] ^ x[near]) <= most]
        us.append(x[near + d])
        vs.append(x[near])
    for a, n in zip(edge[size > 24], size[size > 24], strict=True):
        one, pu, pv = fp[a : a + n], [], []
        for b in range(0, n, 256):
            i, j = np.nonzero(np.bitwise_count(one[b : b + 256, None] ^ one[None, b:]) <= most)
            off = i < j
            ru, rv = forest(one[b + i[off]], one[b + j[off]])
            pu.append(ru)
            pv.append(rv)
        ru, rv = forest(np.concatenate(pu), np.concatenate(pv))
        us.append(ru)
        vs.append(rv)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(us), np.concatenate(vs))


def links(distinct: DataFrame, most: int = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """u, v: links that join all fingerprints (column fp, no repeats) at most or fewer bits apart.

    Not every pair: of the pairs found together a forest stays, which has the same components. An
    anchor with more than bucket fingerprints is cut in s parts, and each two parts meet in a task of
    their own, so no task holds more than about two parts of one anchor.
    """
    if not 0 <= most <= THRESHOLD:
        raise ValueError(f"anchors cover 0 to {THRESHOLD} bits")
    copies = distinct.select("fp").mapInArrow(_copies, "anchor bigint, fp bigint")
    part = max(2, bucket // 2)
    hot = copies.groupBy("anchor").count().where(F.col("count") > bucket).select("anchor", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    dealt = copies.join(hot, "anchor", "left").withColumn("_p", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), "parts").cast("int")))
    many = dealt.where("parts is not null").withColumn("_q", F.explode(F.expr("sequence(0, parts - 1)"))).select("anchor", "fp", (F.least("_p", "_q") * F.col("parts") + F.greatest("_p", "_q") + 1).alias("square"))
    few = dealt.where("parts is null").select("anchor", "fp", F.lit(0).alias("square"))
    met = few.unionByName(many)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def out(g: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            u, v = _links(g, x, most)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "square")]
            g = B.mixed(raw[0].view(np.uint64)) + raw[1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            last = int(np.flatnonzero(np.append(True, g[1:] != g[:-1]))[-1])
            if last:
                rest.append((g[:last], x[:last]))
                yield out(*(np.concatenate(c) for c in zip(*rest, strict=True)))
                rest = [(g[last:], x[last:])]
            elif rest and rest[-1][0][-1] != g[0]:
                yield out(*(np.concatenate(c) for c in zip(*rest, strict=True)))
                rest = [(g, x)]
            else:
                rest.append((g, x))
        if rest:
            yield out(*(np.concatenate(c) for c in zip(*rest, strict=True)))

    return met.repartition("anchor", "square").sortWithinPartitions("anchor", "square").mapInArrow(compared, "u bigint, v bigint").distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, most: int = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id for each row of df.

    Fingerprints link at most or fewer differing bits; component_id is the smallest key reachable by
    links, its own included. Null, empty and wordless texts have fingerprint zero, which links like
    any other; repeated rows keep a row each; a null key is in a class but never names it, unless the
    class has no other (then component_id is null). Other columns are not read.
    """
    marked = written(fingerprints(df, text, key, size), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(key).alias("_least"))
    roots = components(links(least.select("fp"), most, bucket))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = named.join(first, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
