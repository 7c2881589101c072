"""Mixing sources to target weights: a temperature found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm._shared import written

#: Up to so many sources their token sums are bisected on the driver, beyond by Spark.
MAX_LOCAL_SOURCES = 100_000
#: Blocks of a source at most; blocks grow beyond.
MAX_BLOCKS = 4096
#: Plans of sources of up to so many bytes are broadcast; beyond, both sides are dealt by source and one of SALTS.
MAX_BROADCAST = 16 << 20
SALTS = 64


def bisect(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0, steps: int = 50) -> float:
    """The least value between low and high that is good, for a test that stays good once it is; high if none."""
    if good(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def entropy_of(weights: list[float]) -> float:
    """Share of the largest possible entropy, 1 for a single source."""
    full = [w for w in weights if w > 0]
    return 1.0 if len(full) < 2 else -sum(w * math.log(w) for w in full) / math.log(len(full))


def _summary(tokens: DataFrame, local: list[int] | None, alpha: float, budget: float) -> tuple[float, float, float]:
    """The sum of tokens ** alpha, the entropy share and the largest repetition of these weights."""
    if local is not None:
        total = math.fsum(t**alpha for t in local)
        return total, entropy_of([t**alpha / total for t in local]), max(t**alpha / total * budget / t for t in local)
    x = F.pow(F.col("n").cast("double"), F.lit(alpha))
    r = tokens.where("n > 0").agg(F.sum(x).alias("s"), F.sum(x * F.log(x)).alias("l"), F.max(x / F.col("n")).alias("m"), F.count("*").alias("k")).first()
    entropy = 1.0 if r.k < 2 else (math.log(r.s) - r.l / r.s) / math.log(r.k)
    return r.s, entropy, r.m / r.s * budget


def exponent(tokens: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None) -> tuple[float, float]:
    """alpha and the sum of tokens ** alpha, of sources (column n) with a token at least.

    Weights are proportional to tokens ** alpha, alpha from 0 (all alike) to 1 (as they come). Entropy
    falls as alpha grows: alpha is the largest that keeps target_entropy (a share of the largest
    possible), but never so small that a source repeats more than max_repeats times. Where even alpha 1
    repeats more, as for a budget beyond what there is, it stays 1.
    """
    some = tokens.where("n > 0").select("n").limit(MAX_LOCAL_SOURCES + 1).collect()
    local = [r.n for r in some] if len(some) <= MAX_LOCAL_SOURCES else None
    if local == []:
        return 1.0, 1.0
    alpha = 1.0
    if target_entropy is not None:
        # the mirror image: the least beta = 1 - alpha with enough entropy
        alpha = 1.0 - bisect(lambda b: _summary(tokens, local, 1.0 - b, budget)[1] >= target_entropy)
    elif max_repeats is not None:
        alpha = 0.0
    if max_repeats is not None:
        alpha = max(alpha, bisect(lambda a: _summary(tokens, local, a, budget)[2] <= max_repeats * (1 + 1e-9)))
    return alpha, _summary(tokens, local, alpha, budget)[0]


def _planned(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """rows with the plan of their source, never dealt by source alone: one may have a third of all rows."""
    if small:
        return rows.join(F.broadcast(plan), "s")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"]).drop("salt")


def _share(*columns: Column) -> Column:
    """A number from 0 to 1, drawn by a hash of columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def mix(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    budget: int | None = None,
    target_entropy: float | None = 0.97,
    max_repeats: float | None = 4.0,
    block_tokens: int = 200_000,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, source, tokens, epoch, block, place, and the columns carry: a row for each copy of a row of df in the mixture.

    Tokens are runs of other than ASCII white space. A source's weight is its share to the power alpha
    (see exponent), normalised; its quota is its weight of budget (default: all tokens there are). Its
    rows are dealt to blocks by a hash of source, key and text; an epoch takes the blocks, and the rows in
    each, in an order drawn for that epoch. Whole epochs come first, and of the last one rows as long as
    their tokens, summed in its order, stay within the quota; so a source falls short of it by less than
    one row.

    Ascending place, from 0 to 1, is the order of reading: where a copy stands among the tokens of all its
    source's copies, as a share of them. All sources advance alike, so each stretch of the order has about
    the weights. Inside its block a row's place is drawn.

    A null source is the source "". Null or empty texts have no tokens and come along with their epoch;
    a source without tokens comes once. Repeated rows count each, ties of the order are broken by key and
    tokens; null keys are keys like any. An empty table gives an empty one. Other columns are not read;
    carried ones may have any name but key's and source's.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n"), F.xxhash64(F.col(key), t).alias("h")]
    rows = written(df.select(*columns), "tokens")
    sources = rows.groupBy("s").agg(F.sum("n").alias("n"))
    # four numbers of 8 bytes come with each name
    known = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("s") + 32), F.lit(0)).alias("bytes")).first()
    budget = known.n if budget is None else budget
    alpha, total = exponent(sources, float(budget), target_entropy, max_repeats)
    quota = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(alpha)) / total * budget).otherwise(F.lit(0.0))
    plan = sources.withColumn("quota", F.floor(quota + 1e-6)).select(
        "s",
        F.col("n").alias("all"),
        F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(F.lit(0)).cast("bigint").alias("epochs"),
        F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("rest"),
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens))).cast("bigint").alias("blocks"),
    )
    small = known.bytes <= MAX_BROADCAST
    block = F.pmod(F.xxhash64(F.lit(seed), "s", "h"), "blocks")
    # where each block begins in each epoch's order of blocks
    sums = _planned(rows, plan, small).withColumn("block", block).groupBy("s", "block", "epochs").agg(F.sum("n").alias("sum"))
    order = Window.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed), "s", "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    begins = sums.withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)"))).withColumn("begin", F.sum("sum").over(order) - F.col("sum"))
    begins = begins.groupBy("s", "block").agg(F.first("sum").alias("sum"), F.transform(F.array_sort(F.collect_list(F.struct("epoch", "begin"))), lambda x: x["begin"]).alias("begins"))
    whole = df.select(*columns, *[F.col(c).alias(f"c_{c}") for c in carry]) if carry else rows
    placed = _planned(whole, plan, small).withColumn("block", block).join(begins, ["s", "block"]).withColumn("begin", F.expr("begins[epochs]"))
    at = _share(F.lit(seed), "s", "epochs", "h")
    inside = Window.partitionBy("s", "block").orderBy(at, "k", "n").rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("begin") + F.col("sum") > F.col("rest")) & (F.col("begin") <= F.col("rest"))
    # only the block in which the quota ends is summed row by row
    partly = placed.where(cut).withColumn("last", F.col("begin") + F.sum("n").over(inside) <= F.col("rest"))
    wholly = placed.where(~cut).withColumn("last", F.col("begin") + F.col("sum") <= F.col("rest"))
    copies = wholly.unionByName(partly).withColumn("copies", F.col("epochs") + F.col("last").cast("bigint")).where("copies > 0")
    each = copies.withColumn("epoch", F.explode(F.expr("sequence(0L, copies - 1)")))
    share = _share(F.lit(seed), "s", "epoch", "h")
    tokens = F.col("epoch") * F.col("all") + F.expr("begins[epoch]") + share * F.col("sum")
    taken = F.col("epochs") * F.col("all") + F.col("rest")
    place = F.when(taken > 0, F.least(tokens / taken, F.lit(1.0))).otherwise(share)
    return each.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("tokens"), "epoch", "block", place.alias("place"), *[F.col(f"c_{c}").alias(c) for c in carry])
