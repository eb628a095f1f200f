"""Micro fixtures for the repurchase and order-size steps (FIXTURES.md section 3)."""

from __future__ import annotations

from decimal import Decimal

from conftest import make_tables, rows

from kartlens.operators import ordersize, repurchase


def _events(product: int, gaps: list[float], first_order: int = 1, user: int = 1):
    """One order per gap, each holding one line of ``product``."""
    orders = [(first_order + i, user, i + 2, g) for i, g in enumerate(gaps)]
    lines = [(first_order + i, product) for i in range(len(gaps))]
    return orders, lines


PRODUCTS = [(p, f"product {p}", 1, 1) for p in range(1, 10)]


def test_tie_rounds_half_up(spark):
    # 40 events summing to 10,791: mean exactly 269.775 -> 269.78
    orders, lines = _events(1, [270.0] * 39 + [261.0])
    t = make_tables(spark, orders, lines, PRODUCTS)
    out = rows(repurchase.repurchase_cycle(t, "product", 30), "product_id", "product_avg_repurchase_cycle")
    assert out == [(1, 269.78)]


def test_negative_z_tie_rounds_away_from_zero(spark):
    # product mean 10.25, stddev 2.00; one extra order without lines brings
    # the global mean to 10.00: lift -0.25, z exactly -0.125 -> -0.13
    orders, lines = _events(1, [8.25] * 20 + [12.25] * 20)
    orders.append((100, 2, 2, 0.0))
    t = make_tables(spark, orders, lines, PRODUCTS)
    (r,) = repurchase.repurchase_lift(t, "product", 30).collect()
    assert r.global_avg_repurchase_cycle == 10.0
    assert r.product_avg_repurchase_cycle == 10.25
    assert r.stddev_repurchase_cycle == 2.0
    assert r.repurchase_cycle_lift == -0.25
    assert r.zscore_repurchase_cycle == -0.13


def test_zero_and_tiny_stddev_give_null_z(spark):
    o1, l1 = _events(1, [7.0] * 30)
    o2, l2 = _events(2, [7.004] * 15 + [6.996] * 15, first_order=100)
    t = make_tables(spark, o1 + o2, l1 + l2, PRODUCTS)
    out = {r.product_id: r for r in repurchase.repurchase_lift(t, "product", 30).collect()}
    assert out[1].stddev_repurchase_cycle == 0.0 and out[1].zscore_repurchase_cycle is None
    assert out[2].stddev_repurchase_cycle == 0.0 and out[2].zscore_repurchase_cycle is None
    assert out[1].number_of_repurchase_events == 30


def test_lift_uses_rounded_inputs(spark):
    # global 11.114 -> 11.11, product 9.116 -> 9.12: lift 1.99 (raw 1.998 would give 2.00)
    orders, lines = _events(1, [9.0] * 29 + [12.48])
    orders.append((100, 2, 2, 71.054))
    t = make_tables(spark, orders, lines, PRODUCTS)
    (r,) = repurchase.repurchase_lift(t, "product", 30).collect()
    assert (r.global_avg_repurchase_cycle, r.product_avg_repurchase_cycle, r.repurchase_cycle_lift) == (11.11, 9.12, 1.99)


def test_first_order_is_not_an_event(spark):
    orders = [(1, 1, 1, None), (2, 1, 2, 5.0)]
    lines = [(1, 1), (1, 2), (2, 1)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    out = rows(repurchase.repurchase_cycle(t, "product", 1), "product_id", "number_of_repurchase_events")
    assert out == [(1, 1)]
    assert rows(repurchase.global_repurchase_cycle(t)) == [(5.0,)]


def test_support_threshold_is_inclusive(spark):
    o1, l1 = _events(1, [3.0] * 29)
    o2, l2 = _events(2, [3.0] * 30, first_order=100)
    o3, l3 = _events(3, [3.0] * 31, first_order=200)
    t = make_tables(spark, o1 + o2 + o3, l1 + l2 + l3, PRODUCTS)
    assert [r[0] for r in rows(repurchase.repurchase_cycle(t, "product", 30), "product_id")] == [2, 3]
    assert [r[0] for r in rows(repurchase.repurchase_lift(t, "product", 30), "product_id")] == [2, 3]


def test_order_without_lines_counts_in_global_only(spark):
    orders = [(1, 1, 1, None), (2, 1, 2, 4.0), (3, 1, 3, 10.0)]
    lines = [(2, 1)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    assert rows(repurchase.global_repurchase_cycle(t)) == [(7.0,)]
    assert rows(repurchase.repurchase_cycle(t, "product", 1), "product_avg_repurchase_cycle") == [(4.0,)]


def test_duplicate_line_sizes_and_links(spark):
    orders = [(1, 1, 1, None)]
    lines = [(1, 1), (1, 1), (1, 2)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    assert rows(ordersize.global_order_size(t)) == [(3.0,)]
    out = rows(ordersize.order_size(t, "product", 1), "product_id", "avg_order_size", "number_of_orders")
    assert out == [(1, 3.0, 1), (2, 3.0, 1)]
    # step 6e counts raw lines: product 1 twice
    by_lines = rows(ordersize.order_size_lift_by_lines(t, "product", 1), "product_id", "number_of_orders")
    assert by_lines == [(1, 2), (2, 1)]


def test_department_weighting_as_coded_and_once(spark):
    orders = [(1, 1, 1, None)]
    lines = [(1, 1), (1, 2), (1, 3)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    coded = rows(ordersize.order_size(t, "department", 1), "department", "number_of_orders")
    once = rows(ordersize.order_size_once(t, "department", 1), "department", "number_of_orders")
    assert coded == [("dept 1", 3)]
    assert once == [("dept 1", 1)]


def test_fixed_baseline_shifts_lift(spark):
    orders = [(i, 1, i, None) for i in range(1, 31)]
    lines = [(i, 1) for i in range(1, 31)] + [(i, 2) for i in range(1, 16)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    (computed,) = rows(ordersize.global_order_size(t))
    comp = {r.product_id: r.order_size_lift for r in ordersize.order_size_lift(t, "product", 30).collect()}
    fixed = {
        r.product_id: r.order_size_lift
        for r in ordersize.order_size_lift(t, "product", 30, baseline=ordersize.REFERENCE_BASELINE).collect()
    }
    assert set(comp) == {1}
    diff = Decimal(str(comp[1])) - Decimal(str(fixed[1]))
    assert diff == Decimal("10.09") - Decimal(str(computed[0]))


def test_missing_department_drops_product(spark):
    orders = [(1, 1, 1, None), (2, 1, 2, 3.0)]
    lines = [(2, 1), (2, 2)]
    products = [(1, "a", 1, 1), (2, "b", 1, 99)]
    t = make_tables(spark, orders, lines, products, departments=[(1, "dept 1")])
    assert rows(repurchase.repurchase_cycle(t, "department", 1), "department", "number_of_repurchase_events") == [
        ("dept 1", 1)
    ]
