"""Merkle manifest of a dataset from concatenated-level strings.

Each row is a leaf. The leaves of a group (a source) stand in order; every
``FANOUT`` consecutive nodes of a level become one node of the next until one
remains, the group's subroot. The subroots in order of their groups are the
leaves of one more tree, whose last node is the root.

A block is ``FANOUT ** LEVELS`` aligned nodes of a group. It keeps each level as
one hex string (held as bytes, so that a substring is cut without counting
characters): parents are the hashes of substrings of ``FANOUT`` digests, and the
siblings of a node are the substrings left and right of it in its run. Block
tops are the nodes of the next tier, which recurses in the same way with a
``FANOUT ** LEVELS``-th of the rows, until every group is one block. Then paths come
down again: what a block's top has above it is joined to the block's row, once
for all its rows.

Positions come from a range partitioning by (group, order), so a group with a
third of all rows lies in many partitions; a block holds a bounded number of
rows. Only digests are shuffled, never texts. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartlens.llm.common import stage

FANOUT = 16
LEVELS = 2
DIGEST = 64  # hex digits of a hash
BLOCK = FANOUT**LEVELS


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' bytes, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of a row's values: each ``-`` if null, else its length in UTF-8
    bytes, a colon and the value (numbers in decimal)."""
    marked = []
    for v in values:
        s = v.cast("string")
        marked.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(*marked)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def siblings_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, each left to right."""
    return F.sha2(F.concat(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")).cast("binary"), 256)


def _piece(level: Column, start: Column, n: Column | int) -> Column:
    """``n`` digests of a level's string, from digest ``start`` on."""
    return F.substring(level, start * DIGEST + 1, (n if isinstance(n, Column) else F.lit(n)) * DIGEST)


def _count(level: Column) -> Column:
    return F.octet_length(level) / DIGEST


def _parents(level: Column) -> Column:
    """A level's parents as one string."""
    runs = F.sequence(F.lit(0), F.ceil(_count(level) / FANOUT).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: F.sha2(_piece(level, r * FANOUT, FANOUT), 256)), "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, members, l0 .. l``LEVELS``, top) from nodes (g, n, pos, node,
    carry) of groups with ``n`` nodes. A level stays null where the group has
    one node already: those below are the top."""
    members = F.array_sort(F.collect_list(F.struct("pos", "node", "carry")))
    rows = nodes.groupBy("g", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(members.alias("members"))
    rows = rows.withColumn("l0", F.array_join("members.node", "").cast("binary"))
    for k in range(LEVELS):  # nodes of the group on level k: n / FANOUT ** k, rounded up
        rows = rows.withColumn(f"l{k + 1}", F.when(F.col("n") > FANOUT**k, _parents(F.col(f"l{k}"))))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
    return rows.withColumn("top", top.cast("string"))


def _path(at: Column) -> Column:
    """Siblings in a block's levels of the member at place ``at``: (left,
    right) for each level that has parents."""
    steps = []
    for k in range(LEVELS):
        level, i = F.col(f"l{k}"), F.floor(at / FANOUT**k).cast("int")
        first = i - i % FANOUT
        left = _piece(level, first, i % FANOUT).cast("string")
        right = _piece(level, i + 1, FANOUT - 1 - i % FANOUT).cast("string")
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


NO_PATH = "array<struct<left:string,right:string>>"


def _tree(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, tops) of nodes (g, n, pos, node, carry): rows (g, carry, path)
    with each node's siblings up to its group's top, tops (g, top)."""
    tiers = []
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        blocks = stage(_blocks(nodes), f"{name}-blocks")
        tiers.append(blocks)
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = blocks.select(
            "g",
            F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.col("block").alias("pos"),
            F.col("top").alias("node"),
            F.lit(None).cast("int").alias("carry"),
        )
    tops = tiers[-1].select("g", "top")
    above = None  # (g, block, path) of the tier below: its blocks' way up
    for blocks in reversed(tiers):
        if above is None:
            rows = blocks.withColumn("above", F.array().cast(NO_PATH))
        else:
            up = above.select(F.col("g").alias("ug"), F.col("pos").alias("ub"), F.col("path").alias("above"))
            rows = blocks.join(up, blocks["g"].eqNullSafe(up["ug"]) & (blocks["block"] == up["ub"])).drop("ug", "ub")
        one = F.explode("members").alias("m")
        levels = [f"l{k}" for k in range(LEVELS + 1)]
        rows = rows.select("g", "above", *levels, one)
        at = (F.col("m.pos") % BLOCK).cast("int")
        above = rows.select(
            "g", F.col("m.pos").alias("pos"), F.col("m.carry").alias("carry"), F.concat(_path(at), "above").alias("path")
        )
    return above, tops


def _numbered(leaves: DataFrame) -> DataFrame:
    """(g, n, pos, node, carry): each leaf's place in its group and the
    group's size. Equal (group, order) go by hash."""
    keys = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("node"), F.col("k")]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(dealt.select("g", "node", "carry", F.monotonically_increasing_id().alias("place")), "placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33))
    parts = placed.groupBy("part", "g").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("rows"))
    along = W.partitionBy("g").orderBy("part")  # a row for each partition and group
    parts = parts.select(
        F.col("part").alias("p"),
        F.col("g").alias("pg"),
        (F.coalesce(F.sum("rows").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("rows").over(W.partitionBy("g")).alias("n"),
    )
    joined = placed.join(parts, (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("pg")))
    return joined.select("g", "n", (F.col("place") + F.col("shift")).alias("pos"), "node", "carry")


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "source",
    order_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """(order_col, group_col, leaf, subroot, root, proof, and ``carry``'s
    columns) for every row of ``docs``: the leaf of the row's ``columns``, its
    group's subroot, the dataset's root, and the proof, an array of (left,
    right) with the concatenated siblings of each level up to the root.

    ``carry`` names expressions over ``docs`` to return along with the rows.
    Null groups are a group of their own, first in order; null order values
    come first in their group, and rows alike in both go by their hash (rows
    alike in all columns are interchangeable). A group of one row is its own
    subroot, a single group's subroot is the root. An empty table gives an
    empty result. No other columns are read, whatever their names; a carried
    name must differ from the six above. Reruns give the same hashes."""
    carry = carry or {}
    if clash := {order_col, group_col, "leaf", "subroot", "root", "proof"} & set(carry):
        raise ValueError(f"carried names clash with the result's: {sorted(clash)}")
    leaves = docs.select(
        F.col(group_col).alias("g"),
        F.col(order_col).alias("o"),
        leaf_hash(*[F.col(c) for c in columns]).alias("node"),
        F.monotonically_increasing_id().alias("k"),  # so that ranges cut runs of repeated rows too
        F.struct(F.col(order_col).alias("o"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())]).alias("carry"),
    )
    # The node is the leaf; carried along so that the rows that come out have it.
    rows = _numbered(stage(leaves, "leaves"))
    rows = rows.withColumn("carry", F.struct(F.col("carry.*"), F.col("node").alias("leaf")))
    proofs, subroots = _tree(rows, "leaves")

    # The groups' subroots are the leaves of the last tree, of one group.
    tops = subroots.select(F.lit(0).alias("g"), F.col("g").alias("o"), F.col("top").alias("node"), F.lit(0).alias("k"), F.struct(F.col("g").alias("o"), F.col("top").alias("subroot")).alias("carry"))
    ways, root = _tree(_numbered(tops), "groups")
    ways = ways.join(root, "g").select(
        F.col("carry.o").alias("wg"), F.col("carry.subroot").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("last")
    )
    joined = proofs.join(stage(ways, "ways"), F.col("g").eqNullSafe(F.col("wg")))
    return joined.select(
        F.col("carry.o").alias(order_col),
        F.col("g").alias(group_col),
        F.col("carry.leaf").alias("leaf"),
        "subroot",
        "root",
        F.concat("path", "last").alias("proof"),
        *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)],
    )
