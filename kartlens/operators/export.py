"""Q13: the dashboard extract, one row per frequent (anchor, co-product) pair.

Each pair of the share step carries the anchor's repurchase metrics (Q4),
its order-size metrics (Q9), its department and aisle. Inner joins: an
anchor lacking either metric set, a department or an aisle drops out
(J1i, N8); the co-product needs only a name.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlens.functions.joins import bounded_broadcast, catalog_join
from kartlens.model import Tables
from kartlens.operators.copurchase import share_counts
from kartlens.operators.ordersize import order_size_lift
from kartlens.operators.repurchase import repurchase_lift

COLUMNS = (
    "anchor_id",
    "anchor_name",
    "repurchase_cycle_lift",
    "zscore_repurchase_cycle",
    "product_avg_repurchase_cycle",
    "stddev_repurchase_cycle",
    "number_of_repurchase_events",
    "order_size_lift",
    "zscore_order_size",
    "avg_order_size",
    "stddev_order_size",
    "number_of_orders",
    "department",
    "aisle",
    "co_product_id",
    "co_product_name",
    "number_of_co_purchases",
    "total_anchor_orders",
    "percent_anchor_orders",
)


def anchor_profile(
    tables: Tables,
    min_events: int = 30,
    min_orders: int = 30,
    baseline: Decimal | float | str | None = None,
    repurchase: DataFrame | None = None,
    order_size: DataFrame | None = None,
) -> DataFrame:
    """Per product: both metric sets, department and aisle. ``repurchase``
    and ``order_size`` may be the materialized Q4 / Q9 tables (S6)."""
    rep = repurchase if repurchase is not None else repurchase_lift(tables, "product", min_events, ordered=False)
    size = order_size if order_size is not None else order_size_lift(tables, "product", min_orders, baseline, ordered=False)
    rep = rep.select(
        "product_id",
        "repurchase_cycle_lift",
        "zscore_repurchase_cycle",
        "product_avg_repurchase_cycle",
        "stddev_repurchase_cycle",
        "number_of_repurchase_events",
    )
    size = size.select(
        "product_id", "order_size_lift", "zscore_order_size", "avg_order_size", "stddev_order_size", "number_of_orders"
    )
    bound = tables.catalog_rows()
    dims = (
        tables.products.select("product_id", "product_name", "department_id", "aisle_id")
        .join(bounded_broadcast(tables.departments, tables.rows("departments")), "department_id")
        .join(bounded_broadcast(tables.aisles, tables.rows("aisles")), "aisle_id")
        .select("product_id", "product_name", "department", "aisle")
    )
    return rep.join(size, "product_id").join(bounded_broadcast(dims, bound), "product_id")


def behavior_export(
    tables: Tables,
    min_events: int = 30,
    min_orders: int = 30,
    min_pairs: int = 30,
    baseline: Decimal | float | str | None = None,
    ordered: bool = True,
    repurchase: DataFrame | None = None,
    order_size: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    shares = share_counts(tables, min_pairs, pairs=pairs)
    profile = anchor_profile(tables, min_events, min_orders, baseline, repurchase, order_size).withColumnRenamed(
        "product_id", "anchor_id"
    )
    names = tables.products.select(F.col("product_id").alias("co_id"), F.col("product_name").alias("co_product_name"))
    bound = tables.catalog_rows()
    out = catalog_join(catalog_join(shares, profile, "anchor_id", bound), names, "co_id", bound).select(
        *[
            F.col("product_name").alias("anchor_name")
            if c == "anchor_name"
            else F.col("co_id").alias("co_product_id")
            if c == "co_product_id"
            else F.col("percentage_of_anchor_orders").alias("percent_anchor_orders")
            if c == "percent_anchor_orders"
            else F.col(c)
            for c in COLUMNS
        ]
    )
    return out.orderBy(F.col("percent_anchor_orders").desc(), "anchor_id", "co_product_id") if ordered else out
