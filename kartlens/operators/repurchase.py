"""Repurchase cycle: days since the customer's previous order (steps 5a-5e).

A repurchase event is one line item of an order that has a previous order
(``days_since_prior_order`` not null). The global baseline averages over
*all* orders with a previous order (rule N7), including those without
line items, so it is computed from ``orders`` alone.

Plan shape: line items join the non-first orders on order_id (the one big
shuffle join; orders too large for one reducer are split off and joined
map-side, see ``cycle_events``), and moments per product are partial + final
sums, so a hot product never lands whole in one task; departments and aisles
are sums of the products' moments (``moments.py``). On tables bucketed by
order_id at load the join has no exchange. Global baselines are scalar
subqueries, computed once, never cross-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartlens.functions.joins import HOT_ROWS, hot_key_join
from kartlens.functions.rounding import as_double, difference2, mean2, ratio2
from kartlens.functions.sequence import Sequence
from kartlens.model import Tables
from kartlens.operators.levels import by_level, level
from kartlens.operators.moments import GAP_TYPE, deviation, mean, moments, rolled_up

GAP = "days_since_prior_order"


# Orders with at least this many line items are joined map-side (see
# cycle_events); at most total_lines / HOT_LINES orders can qualify.
HOT_LINES = HOT_ROWS


def cycle_events(tables: Tables) -> DataFrame:
    """(order_id, product_id, days_since_prior_order), one row per line item
    of a non-first order; duplicate lines stay duplicate events.

    A sort-merge join on order_id would send every line of a hot order to
    one reducer; ``hot_key_join`` joins orders with HOT_LINES lines or more
    map-side instead (at most total_lines // HOT_LINES of them)."""
    gaps = tables.gaps.where(F.col(GAP).isNotNull())
    return hot_key_join(tables.lines, gaps, "order_id", "inner", tables.line_rows(), HOT_LINES)


def global_cycle(tables: Tables) -> Column:
    """Q1 as a ``decimal(18,2)`` scalar-subquery column."""
    return tables.gaps.where(F.col(GAP).isNotNull()).agg(mean2(F.col(GAP))).scalar()


def global_repurchase_cycle(tables: Tables) -> DataFrame:
    """Q1 (step 5a): one row, ``global_avg_repurchase_cycle``."""
    return tables.gaps.where(F.col(GAP).isNotNull()).agg(
        as_double(mean2(F.col(GAP))).alias("global_avg_repurchase_cycle")
    )


def cycle_moments(tables: Tables) -> DataFrame:
    """(product_id, n, s1, s2) of the gaps of each product's events."""
    return moments(cycle_events(tables), F.col(GAP), GAP_TYPE)


def _group_stats(tables: Tables, lvl_name: str, spread: bool, per_product: DataFrame | None) -> tuple[DataFrame, object]:
    lvl = level(lvl_name)
    sums = rolled_up(tables, cycle_moments(tables) if per_product is None else per_product, lvl)
    cols = [mean().alias("_avg"), F.col("n").alias("number_of_repurchase_events")]
    if spread:
        cols.append(deviation().alias("_sd"))
    return sums.select(*lvl.keys, *cols), lvl


def repurchase_cycle(
    tables: Tables,
    level_name: str = "product",
    min_support: int = 30,
    ordered: bool = True,
    per_product: DataFrame | None = None,
) -> DataFrame:
    """Q2 (product) / Q3 (department) / aisle: mean cycle and event count of
    each group with at least ``min_support`` events, fastest first.
    ``per_product`` may be the stored ``cycle_moments``."""
    stats, lvl = _group_stats(tables, level_name, False, per_product)
    stats = lvl.attach(tables, stats.where(F.col("number_of_repurchase_events") >= min_support))
    avg_col = f"{lvl.prefix}_avg_repurchase_cycle"
    out = stats.select(*lvl.label(), as_double(F.col("_avg")).alias(avg_col), "number_of_repurchase_events")
    return out.orderBy(F.col(avg_col).asc(), *lvl.label()) if ordered else out


def repurchase_lift(
    tables: Tables,
    level_name: str = "product",
    min_support: int = 30,
    spread: bool | None = None,
    ordered: bool = True,
    per_product: DataFrame | None = None,
    base: Column | None = None,
) -> DataFrame:
    """Q4 (product) / Q5 (department) / aisle: lift = global - group mean
    (higher = re-bought sooner than usual).

    With ``spread`` (default at product and aisle level, as Q4 does), also
    the population standard deviation and z = lift / stddev, null when the
    rounded deviation is 0.00. Q5 has neither, so department level defaults
    to without. ``per_product`` and ``base`` may be the stored moments and
    global cycle.
    """
    if spread is None:
        spread = level_name != "department"
    stats, lvl = _group_stats(tables, level_name, spread, per_product)
    stats = lvl.attach(tables, stats.where(F.col("number_of_repurchase_events") >= min_support))
    base = global_cycle(tables) if base is None else base
    cols = [*lvl.label(), as_double(F.col("_avg")).alias(f"{lvl.prefix}_avg_repurchase_cycle")]
    if spread:
        cols.append(as_double(F.col("_sd")).alias("stddev_repurchase_cycle"))
    cols += [
        as_double(base).alias("global_avg_repurchase_cycle"),
        as_double(difference2(base, F.col("_avg"))).alias("repurchase_cycle_lift"),
    ]
    if spread:
        cols.append(as_double(ratio2(base - F.col("_avg"), F.col("_sd"))).alias("zscore_repurchase_cycle"))
    cols.append("number_of_repurchase_events")
    out = stats.select(*cols)
    return out.orderBy(F.col("repurchase_cycle_lift").desc(), *lvl.label()) if ordered else out


def same_product_events(tables: Tables) -> DataFrame:
    """X1 events: (product_id, cycle_days), one per order in which a customer
    bought a product they had bought in an earlier order, with the days
    since that earlier order (the README's definition of the cycle).

    Days are the running sum of ``days_since_prior_order`` over the
    customer's orders (first order: day 0). Both sequences, orders per
    customer and purchases per (customer, product), go through
    ``Sequence``, so a customer with a huge history is split across tasks.
    """
    orders = tables.orders.select(
        "order_id", "user_id", "order_number", F.coalesce(F.col(GAP), F.lit(0.0)).alias("gap")
    ).where(F.col("user_id").isNotNull())
    numbered = Sequence(orders, key="user_id", order=("order_number", "order_id"), rows=tables.rows("orders"))
    days = numbered.frame(running="gap")
    days = days.select("order_id", "user_id", "order_number", F.col("running_gap").alias("day"))
    purchases = (
        hot_key_join(tables.lines, days, "order_id", "inner", tables.line_rows(), HOT_LINES, sort_merge=True)
        .select(F.struct("user_id", "product_id").alias("_buyer_product"), "product_id", "order_number", "order_id", "day")
        .distinct()
    )
    # No more purchases than lines: known without joining them once more.
    seq = Sequence(purchases, key="_buyer_product", order=("order_number", "order_id"), rows=tables.line_rows())
    return (
        seq.frame("day")
        .where(F.col("prev_day").isNotNull())
        .select("product_id", (F.col("day") - F.col("prev_day")).alias("cycle_days"))
    )


def same_product_cycle(tables: Tables, level_name: str = "department", min_support: int = 30, ordered: bool = True) -> DataFrame:
    """Mean days between a customer's consecutive orders of the same
    product, by level, for groups with at least ``min_support`` events."""
    lvl = level(level_name)
    events = by_level(tables, same_product_events(tables), lvl)
    stats = events.groupBy(*lvl.keys).agg(
        mean2(F.col("cycle_days")).alias("_avg"), F.count(F.lit(1)).alias("number_of_repurchase_events")
    )
    stats = lvl.attach(tables, stats.where(F.col("number_of_repurchase_events") >= min_support))
    out = stats.select(*lvl.label(), as_double(F.col("_avg")).alias("avg_same_product_cycle"), "number_of_repurchase_events")
    return out.orderBy(F.col("avg_same_product_cycle").asc(), *lvl.label()) if ordered else out
