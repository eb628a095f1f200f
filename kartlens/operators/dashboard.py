"""The dashboard's data; the reference computes these in the
dashboard tool, so the formulas not given there are our recorded choices:

* D1 relative 0-10 scores: min-max scaling over the products that have
  both metric sets, ``10 * (lift - min) / (max - min)``, 0 when max = min.
* D2 Influence Index: ``0.6 * reorder-speed score + 0.4 * order-size score``.
* D3 quadrants: fast if the cycle lift > 0, large if the size lift > 0
  (zero counts as slow / small).
* D4 KPI cards: one row per product plus one overall row.
* D5 top co-products: best k shares per anchor, ties by co-product id.
* D6 scatter: every product with both metric sets.

Min / max / overall values are scalar subqueries (one row by
construction), never a cross join. All arithmetic is decimal, rounded
half-up to two places.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartlens.functions.rounding import METRIC, as_double
from kartlens.model import Tables
from kartlens.operators.copurchase import named, share_counts
from kartlens.operators.ordersize import global_size, order_size_lift, order_sizes
from kartlens.operators.repurchase import global_cycle, repurchase_lift

# The Influence Index weights and quadrant names.
SPEED_WEIGHT = Decimal("0.6")
SIZE_WEIGHT = Decimal("0.4")
QUADRANTS = {
    (True, True): "Core Routine",
    (True, False): "Light Routine",
    (False, True): "Occasional Stock-Up",
    (False, False): "Occasional Convenience",
}
OVERALL_LABEL = "All products"


def behavior_scatter(
    tables: Tables,
    min_events: int = 30,
    min_orders: int = 30,
    baseline: Decimal | float | str | None = None,
    repurchase: DataFrame | None = None,
    order_size: DataFrame | None = None,
) -> DataFrame:
    """Reorder speed (cycle lift) against order size (size lift).
    ``repurchase`` / ``order_size`` may be the materialized Q4 / Q9 tables."""
    if repurchase is None:
        repurchase = repurchase_lift(tables, "product", min_events, ordered=False)
    if order_size is None:
        order_size = order_size_lift(tables, "product", min_orders, baseline, ordered=False)
    rep = repurchase.select(
        "product_id",
        "product_name",
        "product_avg_repurchase_cycle",
        "repurchase_cycle_lift",
        "zscore_repurchase_cycle",
        "number_of_repurchase_events",
    )
    size = order_size.select(
        "product_id", "avg_order_size", "order_size_lift", "zscore_order_size", "number_of_orders"
    )
    return rep.join(size, "product_id")


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """round(10 * (v - low) / (high - low), 2); 0 when high = low."""
    v, lo, hi = value.cast(METRIC), low.cast(METRIC), high.cast(METRIC)
    span = hi - lo
    scaled = F.round(F.lit(10).cast("decimal(3,0)") * (v - lo) / F.nullif(span, F.lit(0).cast(METRIC)), 2)
    return F.when(span == 0, F.lit(0).cast(METRIC)).otherwise(scaled).cast(METRIC)


def _scores(tables: Tables, **kw) -> DataFrame:
    """Scatter rows plus both 0-10 scores as ``decimal(18,2)``."""
    scatter = behavior_scatter(tables, **kw)
    # One scalar subquery carrying all four bounds, evaluated once.
    bounds = scatter.agg(
        F.struct(
            F.min("repurchase_cycle_lift").alias("lo_speed"),
            F.max("repurchase_cycle_lift").alias("hi_speed"),
            F.min("order_size_lift").alias("lo_size"),
            F.max("order_size_lift").alias("hi_size"),
        )
    ).scalar()
    lo_speed, hi_speed, lo_size, hi_size = (bounds.getField(f) for f in ("lo_speed", "hi_speed", "lo_size", "hi_size"))
    return scatter.select(
        "product_id",
        "product_name",
        _scaled(F.col("repurchase_cycle_lift"), lo_speed, hi_speed).alias("reorder_speed_score"),
        _scaled(F.col("order_size_lift"), lo_size, hi_size).alias("order_size_score"),
        "repurchase_cycle_lift",
        "order_size_lift",
        "product_avg_repurchase_cycle",
        "avg_order_size",
        "number_of_orders",
    )


def relative_scores(tables: Tables, **kw) -> DataFrame:
    """0-10 reorder-speed and order-size scores."""
    return _scores(tables, **kw).withColumn(
        "reorder_speed_score", as_double(F.col("reorder_speed_score"))
    ).withColumn("order_size_score", as_double(F.col("order_size_score")))


def _influence(speed: Column, size: Column) -> Column:
    weighted = F.lit(SPEED_WEIGHT).cast("decimal(2,1)") * speed + F.lit(SIZE_WEIGHT).cast("decimal(2,1)") * size
    return F.round(weighted, 2).cast(METRIC)


def influence_index(tables: Tables, **kw) -> DataFrame:
    """The weighted 0-10 Influence Index."""
    scores = _scores(tables, **kw)
    return scores.select(
        "product_id",
        "product_name",
        as_double(F.col("reorder_speed_score")).alias("reorder_speed_score"),
        as_double(F.col("order_size_score")).alias("order_size_score"),
        as_double(_influence(F.col("reorder_speed_score"), F.col("order_size_score"))).alias("influence_index"),
    )


def quadrant(cycle_lift: Column, size_lift: Column) -> Column:
    fast, large = cycle_lift > 0, size_lift > 0
    return (
        F.when(fast & large, QUADRANTS[(True, True)])
        .when(fast, QUADRANTS[(True, False)])
        .when(large, QUADRANTS[(False, True)])
        .otherwise(QUADRANTS[(False, False)])
    )


def behavior_quadrants(tables: Tables, **kw) -> DataFrame:
    """D3: the four behaviour quadrants."""
    return behavior_scatter(tables, **kw).select(
        "product_id",
        "product_name",
        "repurchase_cycle_lift",
        "order_size_lift",
        quadrant(F.col("repurchase_cycle_lift"), F.col("order_size_lift")).alias("behavior_quadrant"),
    )


def kpi_cards(
    tables: Tables,
    cycle_base: Column | None = None,
    size_base: Column | None = None,
    orders_with_lines: Column | None = None,
    **kw,
) -> DataFrame:
    """Per product, and one overall row (product_id null): Influence
    Index (overall: mean over products), Reorder Speed (mean cycle; overall:
    the global mean), Order Size (mean order size; overall: the global
    mean) and Total Orders (orders holding the product; overall: orders
    with line items). The three overall values may be passed in as stored."""
    scores = _scores(tables, **kw).withColumn(
        "influence", _influence(F.col("reorder_speed_score"), F.col("order_size_score"))
    )
    per_product = scores.select(
        "product_id",
        "product_name",
        as_double(F.col("influence")).alias("influence_index"),
        F.col("product_avg_repurchase_cycle").alias("reorder_speed"),
        F.col("avg_order_size").alias("order_size"),
        F.col("number_of_orders").alias("total_orders"),
    )
    # Mean of two-place values, rounded half-up exactly: integer hundredths.
    hundredths = (F.col("influence") * 100).cast("long")
    n = F.count(F.lit(1))
    if orders_with_lines is None:
        orders_with_lines = order_sizes(tables).agg(F.count("order_id")).scalar()
    overall = scores.agg(
        F.lit(None).cast(per_product.schema["product_id"].dataType).alias("product_id"),
        F.lit(OVERALL_LABEL).alias("product_name"),
        (F.floor((F.lit(2) * F.sum(hundredths) + n) / (F.lit(2) * n)) / F.lit(100.0)).alias("influence_index"),
    ).select(
        "product_id",
        "product_name",
        "influence_index",
        as_double(global_cycle(tables) if cycle_base is None else cycle_base).alias("reorder_speed"),
        as_double(global_size(tables) if size_base is None else size_base).alias("order_size"),
        orders_with_lines.alias("total_orders"),
    )
    return per_product.unionByName(overall)


def top_coproducts(tables: Tables, min_pairs: int = 30, k: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    """The ``k`` co-products with the highest share of each anchor's
    orders. Ids are ranked (Spark cuts each task's group to ``k`` rows before
    the exchange) and names joined to what is left. The pair table has at most
    one row per (anchor, co-product), so a window group is bounded by the
    catalog; k is the feature (a top-k report), not a cap on work. ``pairs``
    may be the stored pair table."""
    shares = share_counts(tables, min_pairs, pairs=pairs)
    rank = F.row_number().over(
        Window.partitionBy("anchor_id").orderBy(F.col("percentage_of_anchor_orders").desc(), F.col("co_id"))
    )
    # Every id is in the catalog (baskets are built from it), so naming after
    # ranking drops no row.
    best = shares.withColumn("rank", rank).where(F.col("rank") <= k)
    return named(tables, best).select(
        "anchor_id",
        "anchor_name",
        "rank",
        F.col("co_id").alias("co_product_id"),
        "co_product_name",
        "number_of_co_purchases",
        "percentage_of_anchor_orders",
    )
