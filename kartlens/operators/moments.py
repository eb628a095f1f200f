"""Mergeable moments per product: one pass for every level.

A mean, a population deviation and a count follow from n, the sum and the sum
of squares, and those of a department or aisle are the sums of its products'.
So both metric sets keep one row per product,

    cycle:  product_id, n, s1, s2            over repurchase events
    size:   product_id, n, s1, s2, lines, line_s1   over distinct (product, order)

and every result at product, aisle or department level is read off them. Sums
are decimals: order sizes are whole, and gaps are exact up to ``GAP_PLACES``
decimal places (days), so adding them in any order and grouping gives the same
digits; only the last division and square root are done in double.

A moments table has at most one row per product id of the line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartlens.functions.rounding import round2
from kartlens.model import Tables
from kartlens.operators.levels import Level, by_level

GAP_PLACES = 6
GAP_TYPE = f"decimal(18,{GAP_PLACES})"
SIZE_TYPE = "decimal(20,0)"


def moments(rows: DataFrame, value: Column, kind: str, *more: Column) -> DataFrame:
    """(product_id, n, s1, s2, ...) of ``value`` (as decimal type ``kind``)."""
    v = value.cast(kind)
    return rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), *more
    )


def rolled_up(tables: Tables, per_product: DataFrame, lvl: Level) -> DataFrame:
    """The moments of each group of a level: sums over its products. At
    product level the rows themselves."""
    if lvl.name == "product":
        return per_product
    sums = [F.sum(c).alias(c) for c in per_product.columns if c != "product_id"]
    return by_level(tables, per_product, lvl).groupBy(*lvl.keys).agg(*sums)


def mean(s1: str = "s1", n: str = "n") -> Column:
    """The mean, rounded to two places."""
    return round2(F.col(s1).cast("double") / F.col(n).cast("double"))


def deviation() -> Column:
    """The population standard deviation, rounded to two places."""
    n, s1, s2 = (F.col(c).cast("double") for c in ("n", "s1", "s2"))
    return round2(F.sqrt(F.greatest((s2 - s1 * s1 / n) / n, F.lit(0.0))))
