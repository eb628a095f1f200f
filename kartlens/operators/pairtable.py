"""The pair table: every frequent pair counted once, read by Q11-Q13, X3 and D5.

    pairs:   anchor_id, co_id, orders, lines, anchor_orders, co_orders

``lines`` counts line pairs (step 7a), ``orders`` distinct orders (step 7b); as
lines >= orders, a table of the pairs with ``lines`` at a threshold holds those of
both counts at that threshold and above.

1. ``reaching``: baskets with each order's largest multiplicity, stored bucketed by
   order_id, so that everything below joins and aggregates by order without
   an exchange.
2. ``support`` per item: orders, lines, and the most line pairs it can reach.
3. ``pair_filter``, before the quadratic step's shuffle: pairs are hashed into a
   table of a fixed number of buckets and counted there, in tasks first (a
   task ships at most one row a bucket, not one a pair). A pair can reach the
   threshold only if its bucket does, so the others are dropped map-side
   before the pairs themselves are counted. No frequent pair is lost, whatever
   the hash. Where the average bucket would reach the threshold, the table
   can't tell anything: that is known from the order widths before a pair is
   made, and pairs are then counted plainly; likewise where the table turns
   out full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartlens.functions.joins import BROADCAST_ROWS, bounded_broadcast, catalog_join
from kartlens.model import Tables
from kartlens.operators.copurchase import baskets, order_pairs

# Buckets of the filter's table. Where more than half of them, or more than may
# be broadcast, reach the threshold, the table is full.
BUCKETS = 1 << 21


def reaching(tables: Tables, level_name: str = "product") -> DataFrame:
    """(order_id, item, m, maxm): baskets with the order's largest m."""
    most = F.max("m").over(Window.partitionBy("order_id"))
    return baskets(tables, level_name).withColumn("maxm", most)


def support(rows: DataFrame) -> DataFrame:
    """(item, item_orders, reach): an item's orders and the most line pairs
    that any one pair with it can have."""
    return rows.groupBy("item").agg(
        F.count(F.lit(1)).alias("item_orders"), F.sum(F.col("m") * F.col("maxm")).alias("reach")
    )


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("anchor_id", "co_id"), F.lit(buckets)).cast("int")


def line_pairs(rows: DataFrame) -> int:
    """Line pairs of different items over all orders: half of (sum m)^2 less
    the sum of m^2, without making a pair."""
    m = F.col("m").cast("decimal(18,0)")
    per_order = rows.groupBy("order_id").agg(F.sum(m).alias("s"), F.sum(m * m).alias("q"))
    total = per_order.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("n")).first()["n"]
    return int(total or 0)


def pair_filter(
    pairs: DataFrame,
    total: int,
    min_pairs: int,
    store: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> DataFrame | None:
    """(bucket): the buckets whose pairs add up to ``min_pairs``, as ``store``
    keeps them, or None where they would drop too little. ``total`` is the sum
    of all counts."""
    if total >= min_pairs * buckets:
        return None  # the average bucket reaches it
    counted = pairs.groupBy(bucket(buckets).alias("bucket")).agg(F.sum("w").alias("n"))
    able = store(counted.where(F.col("n") >= min_pairs).select("bucket"))
    return able if able.count() <= min(buckets // 2, BROADCAST_ROWS) else None


def kept_rows(rows: DataFrame, items: DataFrame, min_pairs: int, item_bound: int) -> DataFrame:
    """Rows of items that can reach ``min_pairs`` line pairs."""
    able = items.where(F.col("reach") >= min_pairs).select("item")
    return rows.join(bounded_broadcast(able, item_bound), "item").select("order_id", "item", "m")


def filtered(pairs: DataFrame, able: DataFrame | None, buckets: int = BUCKETS) -> DataFrame:
    """``pairs`` of the buckets in ``able`` (all, without a filter)."""
    if able is None:
        return pairs
    marked = pairs.withColumn("bucket", bucket(buckets))
    return marked.join(F.broadcast(able), "bucket", "left_semi").drop("bucket")


def pair_table(
    rows: DataFrame,
    items: DataFrame,
    min_pairs: int,
    item_bound: int,
    store: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
    slice_width: int | None = None,
) -> DataFrame:
    """The pair table at threshold ``min_pairs`` from ``reaching`` and
    ``support`` rows. ``store`` writes a frame and reads it back."""
    kept = kept_rows(rows, items, min_pairs, item_bound)
    pairs = order_pairs(kept, slice_width)
    able = pair_filter(pairs, line_pairs(kept), min_pairs, store, buckets)
    counted = (
        filtered(pairs, able, buckets)
        .groupBy("anchor_id", "co_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("w").alias("lines"))
        .where(F.col("lines") >= min_pairs)
    )
    counted = store(counted)

    def totals(side: str, name: str) -> DataFrame:
        return items.select(F.col("item").alias(side), F.col("item_orders").alias(name))

    out = catalog_join(counted, totals("anchor_id", "anchor_orders"), "anchor_id", item_bound)
    return catalog_join(out, totals("co_id", "co_orders"), "co_id", item_bound)
