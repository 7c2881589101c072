"""Document fingerprints: threshold-scaled sketches, by DataFrame functions alone.

Of the hashes of a text's word shingles, every one below a fixed fraction of the hash range is kept, the
same fraction for all texts. What two sketches keep is chosen by the hash and not by the text, so sketches
merge by union and compare by intersection, and a short text's share of a very long one can be read off.
A digest of the whole text stands before them: it tells equal texts, also those too short to keep a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm._shared import written

#: Hashes are the first DIGITS hex digits of MD5; those below this digit are kept: 4 of 16.
BELOW = "4"
DIGITS = 12
SHINGLE = 5


def _digest(text: Column) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, DIGITS)


def sketch(text: Column, below: str = BELOW, size: int = SHINGLE) -> Column:
    """The fingerprint of a text column: the text's digest, "|", and the hashes kept, ascending, by commas. A null text is empty."""
    return F.concat(_digest(text), F.lit("|"), F.array_join(_hashes(text, below, size), ","))


def packed(text: Column) -> Column:
    """The same in bytes, half a byte for a digit: what a shuffle carries."""
    return F.unhex(F.concat(_digest(text), F.array_join(_hashes(text, BELOW, SHINGLE), "")))


def unpacked(fingerprint: Column) -> Column:
    """The fingerprint of packed()."""
    digits = F.lower(F.hex(fingerprint))
    hashes = F.regexp_replace(F.substring(digits, F.lit(DIGITS + 1), F.length(digits)), f"(.{{{DIGITS}}})(?=.)", "$1,")
    return F.concat(F.substring(digits, 1, DIGITS), F.lit("|"), hashes)


def _hashes(text: Column, below: str, size: int) -> Column:
    """The hashes that a text keeps, ascending."""
    whole = F.coalesce(text, F.lit(""))
    split = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def kept(words: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(words) - size + 1)
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, F.lit(size)), " ")), 1, DIGITS))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.filter(each, lambda h: h < below))))

    # transform() over one element binds the words, so that they are split once
    return F.transform(F.array(split), kept)[0]


def hashes_of(fingerprint: Column) -> Column:
    """The array of hashes that a fingerprint keeps."""
    return F.filter(F.split(F.substring_index(fingerprint, "|", -1), ","), lambda h: h != "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller of two texts in the other, 0 to 1; 1 for equal texts, 0 where another text keeps no hash."""

    def compared(s: Column) -> Column:
        least = F.least(F.size(s["x"]), F.size(s["y"]))
        return F.when(least > 0, F.size(F.array_intersect(s["x"], s["y"])) / least).otherwise(F.lit(0.0))

    both = F.array(F.struct(hashes_of(a).alias("x"), hashes_of(b).alias("y")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.transform(both, compared)[0])


def merge(fingerprints: Column) -> Column:
    """The sketch of several texts together, from an array of theirs: the union of what they keep, without a digest."""
    return F.concat(F.lit("|"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.transform(fingerprints, hashes_of)))), ","))


def successors(ids: DataFrame, *columns: str) -> DataFrame:
    """ids with _prev: a struct of columns of the row before in ascending order of columns; the last row's for the first.

    ids must have no repeats. Sorted by range, and written, so that a lost executor doesn't number ranges
    anew; only the last row of each range meets the others'.
    """
    ranged = written(ids.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")
    here = F.struct(*columns)
    inside = ranged.withColumn("_prev", F.lag(here).over(Window.partitionBy("_range").orderBy(*columns)))
    ends = ranged.groupBy("_range").agg(F.max(here).alias("_last"))
    by_range = Window.orderBy("_range")  # a row for each range
    ends = ends.withColumn("_before", F.coalesce(F.lag("_last").over(by_range), F.last("_last").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inside.join(F.broadcast(ends.select("_range", "_before")), "_range").select(*ids.columns, F.coalesce("_prev", "_before").alias("_prev"))


def fingerprint_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of df.

    The edited text has the last n_chars // 4 code points replaced by as many first ones of the next
    text, or all of it if it is shorter. Next is by ascending key (nulls first), for one key by
    xxhash64 of the text; after the last comes the first. A lone row is its own next. Null texts count
    as empty; repeated rows are one to this order and each keep a row.
    """
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    order = base.select(F.struct("k", "h").alias("at"), F.length("t").alias("n")).groupBy("at").agg(F.max("n").alias("n"))
    order = successors(order, "at", "n")
    order = order.select("at", F.col("_prev")["at"].alias("prev"), F.floor(F.col("_prev")["n"] / 4).cast("int").alias("want"))
    # texts and their sketches are dealt once: both branches below read all columns of that exchange
    own = base.select(F.struct("k", "h").alias("at"), "k", "t", packed(F.col("t")).alias("fp"))
    handed = own.join(order, "at").select(F.col("prev").alias("at"), "k", F.expr("substring(t, 1, want)").alias("head"), F.col("fp").alias("next_fp"))
    handed = handed.groupBy("at").agg(F.max_by(F.struct("head", "next_fp"), F.struct("k")).alias("_n"))
    n = F.length("t")
    joined = own.join(handed, "at").withColumn("edited", F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 4) as int))"), F.col("_n.head")))
    out = joined.select(F.col("k").alias(key), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), unpacked(F.col("fp")).alias("fingerprint"), sketch(F.col("edited")).alias("edited_fingerprint"), unpacked(F.col("_n.next_fp")).alias("next_fp"))
    return out.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fp"))}).drop("next_fp")
