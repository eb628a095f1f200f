"""Mixing sources to target weights by systematic sampling.

A source's target over its size is the expected number of copies of each of
its documents. Along the documents of a source in order of size, the expected
copies are prefix-summed, one random offset (from a hash of the source) is
added, and a document is emitted once for each integer boundary its step
crosses. Going by size spreads the boundaries over short and long documents
alike, which keeps the words taken near the target.

The prefix sum is a rank times a constant, so only ranks within the source
are needed: a range partitioning by (source, size, id) cuts a source of any
share into many partitions, ranks run inside partitions, and a summary with
a row for each partition and source adds what lies before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartlens.llm.common import stage

WORDS = r"[^\x20\x09-\x0D]+"
# The contract's weights by code point order of the source, and the most
# copies a document may have.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
# Table of sources: at most this many rows are broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): the sources
    share all sizes by weight, none beyond ``max_copies`` times its own size;
    what a capped source leaves is shared again by weight.

    With sources in order of cap per weight the capped ones come first, so
    the level of the others follows from running sums. One row per source."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    per = per.withColumn("weight", weight)
    everything = W.partitionBy()
    rising = W.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    cap = F.col("source_size") * max_copies
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("parts", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("parts"))
        .withColumn("capped", F.col("level") * F.col("weight") > cap)
    )
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    per = per.withColumn("level", level)
    return per.select(
        "source", "source_size", "weight", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def offset(source):
    """The source's random offset in [0, 1): the first 32 bits of the md5 of
    its name (null and empty name differ)."""
    named = F.coalesce(F.concat(F.lit("mix:"), source), F.lit("mix"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranks(sized: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, source, size, rank): rank from 1 along (size, keys) within the
    source. Repeated rows take neighbouring ranks."""
    sized = stage(sized, "sizes")
    dealt = sized.repartitionByRange("source", "size", *keys).sortWithinPartitions("source", "size", *keys)
    placed = stage(dealt.withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33))
    parts = placed.groupBy("part", "source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("part").alias("p"),
        F.col("source").alias("s"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start") + 1).alias("shift"),
    )
    joined = placed.join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select(*keys, "source", "size", (F.col("place") + F.col("shift")).alias("rank"))


def copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    word: str = WORDS,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """(keys, source, size, source_size, target, copies) for every row; the
    keys order the rows of a size.

    A null text has size 0; a null source is a source of its own, last in
    order; sources without words have target 0 and no copies. Repeated rows
    count each; rows without an id are ranked among themselves; an empty
    table gives an empty result; other columns are not read. Reruns agree."""
    sized = docs.select(
        *keys, "source", F.coalesce(F.regexp_count("text", F.lit(word)), F.lit(0)).cast("long").alias("size")
    )
    ranked = ranks(sized, keys)
    per = stage(targets(ranked, weights, max_copies), "targets")
    per = per.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        offset(F.col("source")).alias("offset"),
    )
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    joined = ranked.join(per, F.col("source").eqNullSafe(F.col("s")))
    upto = F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    below = F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return joined.select(*keys, "source", "size", "source_size", "target", (upto - below).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs``, each once per copy, with ``copy`` counted from 1
    in place of a column of that name; other columns pass through.

    Rows are told apart by a key of their own, so those that repeat an id or
    have none are taken each by its own copies, and rows alike in source, size
    and id spread over many partitions. Reruns agree: such rows go by a hash
    of their values."""
    kept = [c for c in docs.columns if c.lower() != "copy"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"))
    rows = packed.select("doc", F.xxhash64("doc").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "rows")
    read = rows.select(*[F.col("doc")[c].alias(c) for c in ("doc_id", "source", "text")], "hash", "row")
    taken = copies(read, weights, max_copies, keys=("doc_id", "hash", "row")).where(F.col("copies") > 0)
    return (
        rows.join(taken.select("row", "copies"), "row")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select(*[F.col("doc")[c].alias(c) for c in kept], "copy")
    )
