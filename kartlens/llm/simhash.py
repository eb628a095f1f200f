"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits keys for all variants within half the
linking radius; two fingerprints within the radius meet at a variant. The
radius 3 is odd, so half of it is one bit and a half: the whole bit is a
flipped bit, the half bit is a masked block (four blocks of 16 bits, one
masked at a time, a flip in the other 48). If at most three bits differ, the
block that holds one of them is masked and the other two meet at a flip; all
three in one block meet at the unflipped key. That is 4 x 49 keys for each
fingerprint instead of the 2,081 of a ball of radius two.

Keys go through one shuffle; groups are linked as stars to their smallest and
largest member, never as all pairs:

* members within the radius of the smallest or of the largest one are linked to
  it (verified by the bit distance);
* only where some member is farther and the key's rows are not one component
  yet, they take a second step whose keys fix the masked block but for one
  bit, so that any two rows under one such key are within the radius and the
  star to the smallest is exact. Whenever a pair's differing bits are not
  three in one block, a block can be masked so that at most one of them is in
  it and the pair meets under a plain such key. Three in one block leave the
  other 48 bits alike: only where unflipped rows of different components meet,
  those rows also flip a bit of the block below the masked one.

Components come from repeated contraction to a neighbour, in an order hashed
anew each round; each round is a written table, so nothing is lost with an executor and nothing
passes through the driver but a row count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartlens.llm.common import map_batches, stage, texts, words_spaced

SEED = 42
BLOCK_BITS = 16
BLOCKS = 64 // BLOCK_BITS
CHUNK = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, ngram: int) -> int:
    """Unsigned 64-bit SimHash of the text's word ``ngram``-shingles."""
    words = words_spaced(text)
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= ngram:
        shingles = [buf]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - ngram + 1]
        shingles = [buf[a:b] for a, b in zip(starts.tolist(), ends[ngram - 1 :].tolist(), strict=True)]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), CHUNK):
        hashes = np.array([h(s, SEED) for s in shingles[i : i + CHUNK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    majority = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, ngram: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the signed 64-bit SimHash of every whole text; null and
    wordless texts give 0. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, ngram) for t in texts(batch, text_col)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def _rotated(fp, block):
    """``fp`` rotated so that ``block`` holds its lowest bits."""
    return reduce(
        lambda other, b: F.when(
            block == b, F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseOR(F.shiftleft(fp, 64 - b * BLOCK_BITS))
        ).otherwise(other),
        range(1, BLOCKS),
        fp,
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LOW = (1 << BLOCK_BITS) - 1


def roots(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root) for every row of ``fps`` (one per distinct ``fp``): root is
    the same for fingerprints reachable from each other over pairs at
    ``max_bits`` (2 or 3) or fewer differing bits."""
    if max_bits not in (2, 3):
        raise ValueError("max_bits must be 2 or 3")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    if max_bits == 2:
        keys = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
        blocks = 0
    else:
        high = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BLOCK_BITS, 64)])
        block = F.explode(F.array(*[F.lit(b).cast("long") for b in range(BLOCKS)])).alias("block")
        unmasked = _rotated(F.col("fp"), F.col("block")).bitwiseAND(F.lit(_signed(~LOW % (1 << 64))))
        keys = (
            fps.select("fp", block)
            .select("fp", unmasked.bitwiseOR(F.col("block")).alias("base"))
            .select("fp", F.explode(F.transform(high, lambda m: F.col("base").bitwiseXOR(m))).alias("key"))
        )
        blocks = BLOCKS
    same_key = W.partitionBy("key")
    met = (
        keys.withColumn("lo", F.min("fp").over(same_key))
        .withColumn("bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("lo"))))
        .withColumn("far", F.max("bits").over(same_key))
        .withColumn("hi", F.max("fp").over(same_key))
        .where(F.col("far") > 0)
    )
    met = stage(met, "met")
    near = reduce(
        DataFrame.union,
        [
            met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col(end))).between(1, max_bits)).select(
                F.col("fp").alias("u"), F.col(end).alias("v")
            )
            for end in ("lo", "hi")
        ],
    )
    first = stage(components(near.distinct()), "first")
    # A key's rows need the second step only if they aren't one component yet.
    apart = (
        met.where(F.col("far") > max_bits)
        .select("key", "fp")
        .join(first, "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .withColumn("lowest", F.min("root").over(same_key))
        .withColumn("highest", F.max("root").over(same_key))
        .where(F.col("lowest") != F.col("highest"))
        .select("key", "fp", "root")
    )
    second = components(_deep_links(apart, blocks).distinct())
    return (
        fps.select("fp")
        .join(first.withColumnRenamed("root", "r1"), "fp", "left")
        .select("fp", F.coalesce("r1", "fp").alias("r1"))
        .join(second.select(F.col("fp").alias("r1"), F.col("root").alias("r2")), "r1", "left")
        .select("fp", F.coalesce("r2", "r1").alias("root"))
    )


def _deep_links(met: DataFrame, blocks: int) -> DataFrame:
    """(u, v): edges between the roots that meet inside key groups which reach
    beyond the radius of their smallest member."""
    if not blocks:  # a ball of one bit: any two members are within two bits
        sub = met.withColumn("sub", F.lit(0).cast("long"))
    else:
        block = F.col("key").bitwiseAND(F.lit(LOW).cast("long"))
        unflipped = F.shiftrightunsigned("key", BLOCK_BITS) == F.shiftrightunsigned("rot", BLOCK_BITS)
        value = F.col("rot").bitwiseAND(F.lit(LOW).cast("long"))
        same_key = W.partitionBy("key")
        masks = range(BLOCK_BITS)

        def fixed(v, j: int):
            return v.bitwiseAND(F.lit(LOW & ~(1 << j)).cast("long")).bitwiseOR(F.lit(j << BLOCK_BITS).cast("long"))

        plain = [fixed(F.col("value"), j) for j in masks]
        # Of three differing bits the highest is masked and each row flips one
        # of the other two, so flips lie below the mask.
        flipped = [
            fixed(F.col("value").bitwiseXOR(F.lit(1 << i).cast("long")), j) for j in masks for i in masks if i < j
        ]
        sub = (
            met.withColumn("rot", _rotated(F.col("fp"), block))
            .select("key", "root", value.alias("value"), F.when(unflipped, F.col("root")).alias("alike"))
            .withColumn("apart", F.min("alike").over(same_key) != F.max("alike").over(same_key))
            .select("key", "root", "value", (F.col("alike").isNotNull() & F.col("apart")).alias("flips"))
            .distinct()  # rows alike in these have the same keys below
            .withColumn("sub", F.explode(F.when(F.col("flips"), F.array(*plain, *flipped)).otherwise(F.array(*plain))))
            .select("key", "sub", "root")
        )
    lowest = F.min("root").over(W.partitionBy("key", "sub"))
    linked = sub.withColumn("lo", lowest).where(F.col("root") != F.col("lo"))
    return linked.select(F.col("root").alias("u"), F.col("lo").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every vertex of ``edges`` (u, v): root is one vertex of
    its component, the same for all of them. Each round orders the vertices by
    a hash of its own, every vertex moves to the first of itself and its
    neighbours, and the edges follow. As the order is new each round, chains
    shrink by a constant share whatever their values, so the rounds are
    logarithmic. A third of all edges at one vertex is a map-side combined
    minimum and an adaptively split join."""
    edges = stage(edges, "edges")
    rounds: list[DataFrame] = []
    while edges.head(1):

        def placed(vertex: str, seed: int = len(rounds)):
            return F.struct(F.xxhash64(vertex, F.lit(seed)).alias("h"), F.col(vertex).alias("x"))

        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(placed("v")).alias("v"))
        moved = stage(first.select("u", F.least(placed("u"), F.col("v"))["x"].alias("p")), "moved")
        rounds.append(moved)
        edges = stage(
            edges.join(moved, "u")
            .select("v", F.col("p").alias("pu"))
            .join(moved.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .where(F.col("pu") != F.col("pv"))
            .select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
            .distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    found = rounds[0].select(F.col("u").alias("fp"), F.col("p").alias("root"))
    for moved in rounds[1:]:
        found = found.join(moved.select(F.col("u").alias("root"), "p"), "root", "left").select(
            "fp", F.coalesce("p", "root").alias("root")
        )
    return found


def near_duplicates(
    docs: DataFrame, ngram: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id among the rows reachable over links
    (equal fingerprints, or at most ``max_bits`` bits apart), itself included;
    null only where no row of the component has an id. Null and wordless
    texts have fingerprint 0 and link like any other; repeated rows and ties
    share their component; an empty table gives an empty result; other
    columns are not read, whatever their names."""
    rows = stage(fingerprints(docs, ngram, id_col, text_col), "fingerprints")
    labelled = stage(_labelled(rows, max_bits, F.min(id_col)), "labelled")
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(lowest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, "fp", "component_id")


def _labelled(rows: DataFrame, max_bits: int, first) -> DataFrame:
    """(fp, first, root) for every distinct ``fp`` of ``rows``; ``first`` is an
    aggregate."""
    distinct = stage(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    return distinct.join(roots(distinct.select("fp"), max_bits), "fp")


def keep_one(docs: DataFrame, ngram: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row
    stays, the one with the smallest id (of rows that repeat it the one with
    the smallest hash of its values), or where no row has an id the one with
    the smallest hash. Rows are told apart by a key of their own, so unrelated
    texts that share an id, or have none, stand for their own components.
    Other columns pass through, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = stage(
        packed.select("doc", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc").alias("hash")), "rows"
    )
    # Nulls are the least of a struct's values, so a flag puts them last.
    key = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("id"), "hash", "row").alias("key")
    prints = stage(fingerprints(rows.select(key, F.col("doc.text").alias("text")), ngram, "key"), "fingerprints")
    best = _labelled(prints, max_bits, F.min("key")).groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(best.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")


def hex_fingerprint(fp):
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
