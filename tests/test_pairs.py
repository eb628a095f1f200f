"""Co-purchase fixtures, slicing of wide orders, and the export's inner joins."""

from __future__ import annotations

import itertools
import random
from collections import Counter

from conftest import make_tables, rows
from pyspark.sql import functions as F

from kartlens.operators import copurchase, export

PRODUCTS = [(p, f"product {p}", 1, 1) for p in range(1, 200)]


def _orders(n: int):
    return [(i, 1, i, None if i == 1 else 1.0) for i in range(1, n + 1)]


def test_pair_example_counts_orders(spark):
    lines = [(o, p) for o in range(1, 11) for p in (3, 7)]
    t = make_tables(spark, _orders(10), lines, PRODUCTS)
    assert rows(copurchase.copurchase_pairs(t, 10), "anchor_id", "co_product_id", "number_of_product_pairs") == [(3, 7, 10)]


def test_share_example(spark):
    lines = [(o, 5) for o in range(1, 21)] + [(o, 9) for o in range(1, 6)]
    t = make_tables(spark, _orders(20), lines, PRODUCTS)
    out = rows(copurchase.copurchase_share(t, 5), "anchor_id", "co_product_id", "total_anchor_orders", "percentage_of_anchor_orders")
    assert out == [(5, 9, 20, 25.0)]


def test_one_direction_and_symmetric(spark):
    lines = [(o, p) for o in range(1, 4) for p in (1, 2)] + [(4, 2)]
    t = make_tables(spark, _orders(4), lines, PRODUCTS)
    assert rows(copurchase.copurchase_share(t, 1), "anchor_id", "co_product_id") == [(1, 2)]
    sym = rows(copurchase.copurchase_share(t, 1, symmetric=True), "anchor_id", "co_product_id", "percentage_of_anchor_orders")
    assert sym == [(1, 2, 100.0), (2, 1, 75.0)]


def test_duplicate_lines_count_by_rows_not_orders(spark):
    lines = [(1, 1), (1, 1), (1, 2)]
    t = make_tables(spark, _orders(1), lines, PRODUCTS)
    assert rows(copurchase.copurchase_pairs(t, 1), "number_of_product_pairs") == [(2,)]
    assert rows(copurchase.copurchase_share(t, 1), "number_of_co_purchases") == [(1,)]


def test_row_multiplicity_survives_pruning(spark):
    # a on one line, b on 30 lines of one order: 30 line pairs >= 30
    lines = [(1, 1)] + [(1, 2)] * 30
    t = make_tables(spark, _orders(1), lines, PRODUCTS)
    assert rows(copurchase.copurchase_pairs(t, 30), "anchor_id", "co_product_id", "number_of_product_pairs") == [(1, 2, 30)]


def _brute(lines, by_lines: bool, t: int):
    per_order: dict[int, list[int]] = {}
    for o, p in lines:
        per_order.setdefault(o, []).append(p)
    counts: Counter = Counter()
    for items in per_order.values():
        if by_lines:
            for a, b in itertools.product(items, items):
                if a < b:
                    counts[(a, b)] += 1
        else:
            for a, b in itertools.combinations(sorted(set(items)), 2):
                counts[(a, b)] += 1
    return sorted((a, b, n) for (a, b), n in counts.items() if n >= t)


def test_wide_orders_are_sliced_exactly(spark):
    rng = random.Random(7)
    lines = []
    for o in range(1, 41):
        width = 60 if o <= 3 else rng.randint(1, 5)  # three wide orders
        lines += [(o, rng.randint(1, 80)) for _ in range(width)]
    t = make_tables(spark, _orders(40), lines, PRODUCTS)
    b = copurchase.baskets(t)
    for by_lines in (True, False):
        got = copurchase.pair_counts(b, 2, by_lines, item_bound=200, slice_width=5)
        assert rows(got, "anchor_id", "co_id", "n") == _brute(lines, by_lines, 2)
    # the wide orders really were cut into slices
    wide = b.groupBy("order_id").count().where(F.col("count") > 5).count()
    assert wide == 3


def test_export_needs_anchor_metrics(spark):
    # pair (1, 2) in 30 orders; anchor 1 has 30 repurchase events, but
    # anchor 3 of pair (3, 4) has only 29 events (its first order has none)
    orders = [(i, 1, i, 2.0) for i in range(1, 31)] + [(100 + i, 2, i + 1, None if i == 0 else 2.0) for i in range(30)]
    lines = [(i, p) for i in range(1, 31) for p in (1, 2)] + [(100 + i, p) for i in range(30) for p in (3, 4)]
    t = make_tables(spark, orders, lines, PRODUCTS)
    shares = rows(copurchase.copurchase_share(t, 30), "anchor_id", "co_product_id")
    assert shares == [(1, 2), (3, 4)]
    out = export.behavior_export(t, 30, 30, 30)
    assert rows(out, "anchor_id", "co_product_id", "number_of_repurchase_events", "number_of_orders") == [(1, 2, 30, 30)]
    assert out.columns == list(export.COLUMNS)


def test_aisle_level_pairs(spark):
    products = [(1, "a", 10, 1), (2, "b", 10, 1), (3, "c", 20, 1)]
    lines = [(o, p) for o in range(1, 4) for p in (1, 2, 3)]
    t = make_tables(spark, _orders(3), lines, products, aisles=[(10, "x"), (20, "y")])
    out = rows(copurchase.copurchase_share_by_aisle(t, 1), "anchor_aisle", "co_aisle", "number_of_co_purchases")
    assert out == [("x", "y", 3)]


def test_lines_of_unknown_products_change_nothing(spark):
    lines = [(o, p) for o in range(1, 4) for p in (1, 2)]
    orphans = [(o, 999) for o in range(1, 4)]
    known = make_tables(spark, _orders(3), lines, PRODUCTS)
    mixed = make_tables(spark, _orders(3), lines + orphans, PRODUCTS)
    for fn in (copurchase.copurchase_pairs, copurchase.copurchase_share):
        assert rows(fn(mixed, 1)) == rows(fn(known, 1))
