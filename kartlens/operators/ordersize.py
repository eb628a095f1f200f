"""Order size: line items per order, and the orders a product is in (steps 6a-6e).

Order size counts *lines*, duplicates included, while a product is linked
to an order once (rule N6). Both come from one frame,

    sized = (order_id, product_id, m = lines of the product, order_size)

built as: lines -> partial+final aggregate on (order_id, product_id)
(map-side combine, so a hot order is spread by product before the
shuffle) -> a window sum of ``m`` per order. After the dedupe an order has
at most one row per distinct product, so the window's largest group is
bounded by the catalog, not by the data. This replaces the reference's
aggregate + join-back with one shuffle on order_id, and with none where the
lines were bucketed by it at load. Means, deviations and counts of every level
come from moments per product (``moments.py``).

Baseline: ``baseline=None`` uses the computed global mean (Q6, a scalar
subquery); a number (the reference's literal 10.09) overrides it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartlens.functions.rounding import METRIC, as_double, difference2, mean2, ratio2
from kartlens.model import Tables
from kartlens.operators.levels import by_level, level
from kartlens.operators.moments import SIZE_TYPE, deviation, mean, moments, rolled_up

# Fixed value: the reference's hard-coded global average order size.
REFERENCE_BASELINE = Decimal("10.09")


def product_orders(tables: Tables) -> DataFrame:
    """(order_id, product_id, m): one row per product of an order, with the
    number of lines it has there. Lines without an order join no order."""
    return tables.lines.where(F.col("order_id").isNotNull()).groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("m"))


def sized(tables: Tables) -> DataFrame:
    """(order_id, product_id, m, order_size)."""
    per_order = Window.partitionBy("order_id")
    return product_orders(tables).withColumn("order_size", F.sum("m").over(per_order))


def order_sizes(tables: Tables) -> DataFrame:
    """(order_id, order_size) of every order with line items."""
    return tables.lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("order_size"))


def global_size(tables: Tables) -> Column:
    """Q6 as a ``decimal(18,2)`` scalar-subquery column."""
    return order_sizes(tables).agg(mean2(F.col("order_size"))).scalar()


def size_moments(tables: Tables) -> DataFrame:
    """(product_id, n, s1, s2, lines, line_s1): moments of the size of the
    orders each product is in, its lines, and the sizes summed over them."""
    lines, size = F.col("m").cast(SIZE_TYPE), F.col("order_size").cast(SIZE_TYPE)
    return moments(
        sized(tables), F.col("order_size"), SIZE_TYPE, F.sum("m").alias("lines"), F.sum(lines * size).alias("line_s1")
    )


def baseline_column(tables: Tables, baseline: Decimal | float | str | Column | None) -> Column:
    """The baseline as a column: computed, a number, or a column as it is (a
    stored global mean)."""
    if baseline is None:
        return global_size(tables)
    if isinstance(baseline, Column):
        return baseline
    return F.lit(Decimal(str(baseline))).cast(METRIC)


def global_order_size(tables: Tables) -> DataFrame:
    """Q6 (step 6a): one row, ``global_avg_order_size``."""
    return order_sizes(tables).agg(as_double(mean2(F.col("order_size"))).alias("global_avg_order_size"))


def _size_sums(tables: Tables, lvl, per_product: DataFrame | None) -> DataFrame:
    return rolled_up(tables, size_moments(tables) if per_product is None else per_product, lvl)


def order_size(
    tables: Tables,
    level_name: str = "product",
    min_support: int = 30,
    ordered: bool = True,
    per_product: DataFrame | None = None,
) -> DataFrame:
    """Q7 (product) / Q8 (department, as coded) / aisle: mean size of the
    orders holding the group's products, over distinct (product, order)
    rows, so an order with three products of a department counts three
    times there (finding B3; ``order_size_once`` counts it once)."""
    lvl = level(level_name)
    rows = by_level(tables, sized(tables), lvl)
    stats = rows.groupBy(*lvl.keys).agg(
        mean2(F.col("order_size")).alias("_avg"), F.count(F.lit(1)).alias("number_of_orders")
    )
    stats = lvl.attach(tables, stats.where(F.col("number_of_orders") >= min_support))
    out = stats.select(*lvl.label(), as_double(F.col("_avg")).alias("avg_order_size"), "number_of_orders")
    return out.orderBy(F.col("avg_order_size").desc(), *lvl.label()) if ordered else out


def order_size_once(tables: Tables, level_name: str = "department", min_support: int = 30, ordered: bool = True) -> DataFrame:
    """The README's reading of step 6c, each order once per group."""
    lvl = level(level_name)
    rows = by_level(tables, sized(tables), lvl).select(*lvl.keys, "order_id", "order_size").distinct()
    stats = rows.groupBy(*lvl.keys).agg(
        mean2(F.col("order_size")).alias("_avg"), F.count(F.lit(1)).alias("number_of_orders")
    )
    stats = lvl.attach(tables, stats.where(F.col("number_of_orders") >= min_support))
    out = stats.select(*lvl.label(), as_double(F.col("_avg")).alias("avg_order_size"), "number_of_orders")
    return out.orderBy(F.col("avg_order_size").desc(), *lvl.label()) if ordered else out


def order_size_lift(
    tables: Tables,
    level_name: str = "product",
    min_support: int = 30,
    baseline: Decimal | float | str | Column | None = None,
    ordered: bool = True,
    per_product: DataFrame | None = None,
) -> DataFrame:
    """Q9 (product) / aisle: lift = group mean - baseline (sign opposite to
    the cycle lift), population stddev and z, over distinct (product, order)
    rows."""
    lvl = level(level_name)
    stats = _size_sums(tables, lvl, per_product).select(
        *lvl.keys, mean().alias("_avg"), deviation().alias("_sd"), F.col("n").alias("number_of_orders")
    )
    stats = lvl.attach(tables, stats.where(F.col("number_of_orders") >= min_support))
    base = baseline_column(tables, baseline)
    out = stats.select(
        *lvl.label(),
        as_double(F.col("_avg")).alias("avg_order_size"),
        as_double(F.col("_sd")).alias("stddev_order_size"),
        as_double(difference2(F.col("_avg"), base)).alias("order_size_lift"),
        as_double(ratio2(F.col("_avg") - base, F.col("_sd"))).alias("zscore_order_size"),
        "number_of_orders",
    )
    return out.orderBy(F.col("order_size_lift").desc(), *lvl.label()) if ordered else out


def order_size_lift_by_lines(
    tables: Tables,
    level_name: str = "department",
    min_support: int = 30,
    baseline: Decimal | float | str | Column | None = None,
    ordered: bool = True,
    per_product: DataFrame | None = None,
) -> DataFrame:
    """Q10 (step 6e, as coded): over *raw* line items, no dedupe, so a
    product with two lines in an order counts twice: the moments'
    ``line_s1`` over ``lines``."""
    lvl = level(level_name)
    stats = _size_sums(tables, lvl, per_product).select(
        *lvl.keys, mean("line_s1", "lines").alias("_avg"), F.col("lines").alias("number_of_orders")
    )
    stats = lvl.attach(tables, stats.where(F.col("number_of_orders") >= min_support))
    base = baseline_column(tables, baseline)
    out = stats.select(
        *lvl.label(),
        as_double(F.col("_avg")).alias("avg_order_size"),
        as_double(difference2(F.col("_avg"), base)).alias("order_size_lift"),
        "number_of_orders",
    )
    return out.orderBy(F.col("order_size_lift").desc(), *lvl.label()) if ordered else out
