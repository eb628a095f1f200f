"""Co-purchased pairs (steps 7a, 7b) and their share of the anchor's orders.

A pair is two different items of one order; the anchor is always the
smaller id (rule N4), so each pair appears once. Two counts exist:

* ``pairs`` (7a) counts line-item pairs: a product on two lines of an order
  pairs twice (finding B10). With m = lines of an item in an order this is
  sum over orders of m_a * m_b.
* ``share`` (7b) counts distinct orders holding both, and divides by the
  anchor's distinct orders.

Plan, shared by both:

1. ``baskets``: one row per (order, item) with multiplicity m
   (partial + final aggregate; a hot order is spread by item before the
   shuffle).
2. Exact support pruning before the quadratic step (Apriori property): a
   pair can reach the threshold T only if each of its items can. For the
   distinct count an item needs >= T orders, which is known from the totals,
   so the other rows are dropped before they are shuffled by order. For the
   line count an item a in order o contributes at most m_a(o) * maxm(o), so
   it needs sum_o m_a(o) * maxm(o) >= T, which is known after step 3 only.
   No qualifying pair is ever dropped. The qualifying set is a subset of the
   catalog, so it is broadcast under the catalog bound and the order
   partitioning survives.
3. One exchange on order_id, reused by every consumer: per order the width
   k (distinct items) and the largest multiplicity (hash aggregate, no
   sort). After step 1 an order has at most one row per distinct item, so
   its partition share is bounded by the catalog.
4. Self-join on order_id with a.item < b.item. Orders up to ``slice_width``
   items join in place (sort-merge, both sides already hash-partitioned
   by order_id: no exchange). Wider orders are cut into ceil(k / slice_width) slices
   by a hash of the anchor-side item, and the co-side rows are repeated
   once per slice, so one very wide order is spread over many tasks instead
   of producing all its k^2/2 pairs in one.
5. Partial + final aggregate on (anchor, co), filter >= T, then names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlens.functions.joins import bounded_broadcast, catalog_join
from kartlens.functions.rounding import as_double, percent2
from kartlens.model import Tables

# Items per slice of a wide order (step 4): a slice task joins at most
# slice_width * k rows of one order.
SLICE_WIDTH = 2048


def baskets(tables: Tables, level_name: str = "product") -> DataFrame:
    """(order_id, item, m) for product or aisle level.

    Lines of products missing from the catalog are left out first: every
    pair or total involving them is dropped by the final name joins anyway,
    and this way every per-item frame downstream provably has at most one
    row per catalog product (the bound its broadcasts rely on)."""
    lines = tables.lines.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
    if level_name == "product":
        catalog = bounded_broadcast(tables.products.select("product_id"), tables.catalog_rows())
        items = lines.join(catalog, "product_id", "left_semi").select("order_id", F.col("product_id").alias("item"))
    elif level_name == "aisle":
        aisles = bounded_broadcast(tables.aisles.select("aisle_id"), tables.rows("aisles"))
        aisle_of = tables.products.select("product_id", "aisle_id").join(aisles, "aisle_id")
        items = lines.join(bounded_broadcast(aisle_of, tables.catalog_rows()), "product_id").select(
            "order_id", F.col("aisle_id").alias("item")
        )
    else:
        raise ValueError(f"pairs are built at product or aisle level, not {level_name!r}")
    return items.groupBy("order_id", "item").agg(F.count(F.lit(1)).alias("m"))


def item_support(basket_rows: DataFrame) -> DataFrame:
    """(item, orders, lines): distinct orders and line items per item."""
    return basket_rows.groupBy("item").agg(F.count(F.lit(1)).alias("orders"), F.sum("m").alias("lines"))


def pair_counts(
    basket_rows: DataFrame,
    min_pairs: int,
    by_lines: bool,
    item_bound: int,
    support: DataFrame | None = None,
    slice_width: int | None = None,
) -> DataFrame:
    """(anchor_id, co_id, n) for pairs with n >= ``min_pairs``, where n counts
    line pairs (``by_lines``) or distinct orders. ``item_bound`` bounds the
    number of distinct items (the catalog size). For the distinct count,
    ``support`` may pass the ``item_support`` frame already built for the
    anchor totals, so the pruning reuses it instead of aggregating again.
    ``slice_width`` defaults to the module's ``SLICE_WIDTH``."""

    def prune(rows: DataFrame, reach: DataFrame) -> DataFrame:
        # Unique items, so an inner join prunes exactly like a semi join;
        # unlike a semi join it is never pushed below a shared exchange, which
        # would give that branch its own copy of the exchange.
        return rows.join(bounded_broadcast(reach.where(F.col("reach") >= min_pairs).select("item"), item_bound), "item")

    # One exchange on order_id that every consumer below reads (reused):
    # the window, the per-order widths and the wide-order rows. After the
    # dedupe an order has at most one row per distinct item.
    if by_lines:
        by_order = basket_rows.repartition("order_id")
        most = by_order.groupBy("order_id").agg(F.max("m").alias("maxm"))
        reach = (
            by_order.join(most.hint("shuffle_hash"), "order_id")
            .groupBy("item")
            .agg(F.sum(F.col("m") * F.col("maxm")).alias("reach"))
        )
        kept = prune(by_order, reach)
    else:
        reach = (support if support is not None else item_support(basket_rows)).select(
            "item", F.col("orders").alias("reach")
        )
        kept = prune(basket_rows, reach).repartition("order_id")
    if not by_lines:
        kept = kept.withColumn("m", F.lit(1))
    return (
        order_pairs(kept, slice_width)
        .groupBy("anchor_id", "co_id")
        .agg(F.sum("w").alias("n"))
        .where(F.col("n") >= min_pairs)
    )


def order_pairs(kept: DataFrame, slice_width: int | None = None) -> DataFrame:
    """(anchor_id, co_id, w) for every two different items of an order in
    ``kept`` (order_id, item, m), anchor < co, once an order; w is the number
    of line pairs (m of one times m of the other). ``kept`` should already be
    partitioned by order_id, by an exchange or by its buckets."""
    slice_width = SLICE_WIDTH if slice_width is None else slice_width

    def join_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys] + [F.col("a.item") < F.col("b.item")]
        return left.alias("a").join(right.alias("b"), cond).select(
            F.col("a.item").alias("anchor_id"), F.col("b.item").alias("co_id"), (F.col("a.m") * F.col("b.m")).alias("w")
        )

    # Orders up to slice_width items: sort + window on the shared exchange,
    # then a sort-merge self-join on order_id that needs no further exchange
    # or sort (a broadcast would ship every basket to every task instead).
    narrow = kept.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("order_id"))).where(
        F.col("k") <= slice_width
    )
    in_place = join_pairs(narrow, narrow.hint("merge"), ["order_id"])

    # Wider orders: picked by a hash join with their widths (no sort), cut
    # into slices by a hash of the anchor-side item, the co side repeated
    # once per slice, and joined on (order_id, slice) so each slice is its
    # own task.
    widths = kept.groupBy("order_id").agg(F.count(F.lit(1)).alias("k"))
    wide = kept.join(widths.where(F.col("k") > slice_width).hint("shuffle_hash"), "order_id").withColumn(
        "slices", F.ceil(F.col("k") / F.lit(slice_width))
    )
    wide_a = wide.withColumn("slice", F.pmod(F.xxhash64("item"), F.col("slices")))
    wide_b = wide.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    return in_place.unionByName(join_pairs(wide_a, wide_b, ["order_id", "slice"]))


def named(tables: Tables, pairs: DataFrame) -> DataFrame:
    """``pairs`` (anchor_id, co_id, ...) with both products' names."""
    bound = tables.catalog_rows()

    def names(side: str, name: str) -> DataFrame:
        return tables.products.select(F.col("product_id").alias(side), F.col("product_name").alias(name))

    out = catalog_join(pairs, names("anchor_id", "anchor_name"), "anchor_id", bound)
    return catalog_join(out, names("co_id", "co_product_name"), "co_id", bound)


def copurchase_pairs(
    tables: Tables, min_pairs: int = 30, ordered: bool = True, pairs: DataFrame | None = None
) -> DataFrame:
    """Q11 (step 7a): line-item pair counts per (anchor, co-product).
    ``pairs`` may be a stored pair table (``pairtable.py``) whose threshold is
    no higher, here and below."""
    if pairs is None:
        counts = pair_counts(baskets(tables), min_pairs, by_lines=True, item_bound=tables.catalog_rows())
    else:
        counts = pairs.where(F.col("lines") >= min_pairs).select("anchor_id", "co_id", F.col("lines").alias("n"))
    out = named(tables, counts).select(
        "anchor_id",
        "anchor_name",
        F.col("co_id").alias("co_product_id"),
        "co_product_name",
        F.col("n").alias("number_of_product_pairs"),
    )
    return out.orderBy(F.col("number_of_product_pairs").desc(), "anchor_id", "co_product_id") if ordered else out


def _both_ways(pairs: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """Each row once as it is and once with the columns of each of ``sides``
    exchanged."""
    kept = [c for c in pairs.columns if not any(c in s for s in sides)]
    ways = [F.struct(*[F.col(s[i]).alias(s[0]) for s in sides], *[F.col(s[1 - i]).alias(s[1]) for s in sides]) for i in (0, 1)]
    return pairs.select(*kept, F.inline(F.array(*ways)))


def _shares(
    tables: Tables, min_pairs: int, level_name: str, symmetric: bool = False, pairs: DataFrame | None = None
) -> DataFrame:
    """Pair shares; without stored pairs the counts and the anchor totals are
    built on one basket / support frame. ``symmetric`` turns each counted pair
    into both directions."""
    items = tables.catalog_rows() if level_name == "product" else tables.rows("aisles")
    if pairs is None:
        rows = baskets(tables, level_name)
        support = item_support(rows)
        counts = pair_counts(rows, min_pairs, by_lines=False, item_bound=items, support=support)
        counts = counts.withColumnRenamed("n", "number_of_co_purchases")
        if symmetric:
            counts = _both_ways(counts, ("anchor_id", "co_id"))
        totals = support.select(F.col("item").alias("anchor_id"), F.col("orders").alias("total_anchor_orders"))
        counts = catalog_join(counts, totals, "anchor_id", items)
    else:
        counts = pairs.where(F.col("orders") >= min_pairs)
        if symmetric:
            counts = _both_ways(counts, ("anchor_id", "co_id"), ("anchor_orders", "co_orders"))
        counts = counts.select(
            "anchor_id",
            "co_id",
            F.col("orders").alias("number_of_co_purchases"),
            F.col("anchor_orders").alias("total_anchor_orders"),
        )
    return counts.select(
        "anchor_id",
        "co_id",
        "number_of_co_purchases",
        "total_anchor_orders",
        as_double(percent2(F.col("number_of_co_purchases"), F.col("total_anchor_orders"))).alias(
            "percentage_of_anchor_orders"
        ),
    )


def share_counts(
    tables: Tables, min_pairs: int = 30, level_name: str = "product", pairs: DataFrame | None = None
) -> DataFrame:
    """(anchor_id, co_id, number_of_co_purchases, total_anchor_orders,
    percentage_of_anchor_orders) for pairs in >= ``min_pairs`` orders."""
    return _shares(tables, min_pairs, level_name, pairs=pairs)


def copurchase_share(
    tables: Tables,
    min_pairs: int = 30,
    ordered: bool = True,
    symmetric: bool = False,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Q12 (step 7b); with ``symmetric`` (X3) each pair also counts for its
    larger product as anchor, with that product's order total."""
    out = named(tables, _shares(tables, min_pairs, "product", symmetric, pairs)).select(
        "anchor_id",
        "anchor_name",
        F.col("co_id").alias("co_product_id"),
        "co_product_name",
        "number_of_co_purchases",
        "total_anchor_orders",
        "percentage_of_anchor_orders",
    )
    return out.orderBy(F.col("percentage_of_anchor_orders").desc(), "anchor_id", "co_product_id") if ordered else out


def copurchase_share_by_aisle(tables: Tables, min_pairs: int = 30, ordered: bool = True) -> DataFrame:
    """Q12 at aisle level (X4): aisles bought in the same order, anchor =
    smaller aisle id, counted over distinct (order, aisle)."""
    shares = share_counts(tables, min_pairs, level_name="aisle")
    names = bounded_broadcast(tables.aisles.select("aisle_id", "aisle"), tables.rows("aisles"))
    out = (
        shares.join(names.withColumnRenamed("aisle_id", "anchor_id").withColumnRenamed("aisle", "anchor_aisle"), "anchor_id")
        .join(names.withColumnRenamed("aisle_id", "co_id").withColumnRenamed("aisle", "co_aisle"), "co_id")
        .select(
            "anchor_aisle",
            "co_aisle",
            "number_of_co_purchases",
            "total_anchor_orders",
            "percentage_of_anchor_orders",
        )
    )
    return out.orderBy(F.col("percentage_of_anchor_orders").desc(), "anchor_aisle", "co_aisle") if ordered else out
