"""Invariants and metamorphic checks on the driver's sf0.001 tables."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kartlens.operators import copurchase, export, repurchase
from kartlens.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def t(spark):
    return registry.tables_for(spark, SF)


def test_line_pairs_cover_order_pairs(t):
    by_lines = copurchase.copurchase_pairs(t, 1, ordered=False)
    by_orders = copurchase.copurchase_share(t, 1, ordered=False)
    both = by_orders.join(by_lines, ["anchor_id", "co_product_id"], "left")
    assert both.where(F.col("number_of_product_pairs").isNull()).count() == 0
    assert both.where(F.col("number_of_product_pairs") < F.col("number_of_co_purchases")).count() == 0
    assert by_lines.where(F.col("anchor_id") >= F.col("co_product_id")).count() == 0
    shares = by_orders.agg(F.min("percentage_of_anchor_orders"), F.max("percentage_of_anchor_orders")).first()
    assert 0 < shares[0] and shares[1] <= 100


def test_lift_plus_mean_is_global(t):
    for r in repurchase.repurchase_lift(t, "product", 30, ordered=False).collect():
        assert Decimal(str(r.repurchase_cycle_lift)) + Decimal(str(r.product_avg_repurchase_cycle)) == Decimal(
            str(r.global_avg_repurchase_cycle)
        )


def test_export_pairs_are_share_pairs(t):
    shares = set(rows(copurchase.copurchase_share(t, 2, ordered=False), "anchor_id", "co_product_id"))
    extract = rows(export.behavior_export(t, 30, 30, 2, ordered=False), "anchor_id", "co_product_id")
    assert extract and set(extract) <= shares


def test_department_events_reconcile_with_lines(t):
    total = repurchase.repurchase_cycle(t, "department", 1, ordered=False).agg(F.sum("number_of_repurchase_events")).first()[0]
    gaps = t.gaps.where(F.col("days_since_prior_order").isNotNull())
    known = t.products.join(t.departments, "department_id").select("product_id")
    expected = t.lines.join(gaps, "order_id").join(known, "product_id").count()
    assert total == expected


def test_raising_threshold_only_removes_rows(t):
    low = {r.product_id: r for r in repurchase.repurchase_lift(t, "product", 10, ordered=False).collect()}
    high = {r.product_id: r for r in repurchase.repurchase_lift(t, "product", 30, ordered=False).collect()}
    assert high and set(high) < set(low)
    assert all(high[p] == low[p] for p in high)


def test_partition_count_does_not_change_results(spark, t):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(copurchase.copurchase_share(t, 2, ordered=False)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_bound_orders_match_window_semantics(t):
    import duckdb

    ref = duckdb.sql(
        f"""SELECT o_orderkey AS order_id, row_number() OVER w AS order_number,
                   date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS gap
            FROM '{SF}/orders.parquet' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
    ).fetchall()
    got = rows(t.orders, "order_id", "order_number", "days_since_prior_order")
    assert got == sorted((o, n, None if g is None else float(g)) for o, n, g in ref)


def test_results_equal_without_any_broadcast(spark, t, monkeypatch):
    from kartlens.functions import joins
    from kartlens.operators import ordersize

    queries = {
        "share": lambda: copurchase.copurchase_share(t, 2, ordered=False),
        "pairs": lambda: copurchase.copurchase_pairs(t, 2, ordered=False),
        "size_dept": lambda: ordersize.order_size(t, "department", 30, ordered=False),
        "cycle_lift": lambda: repurchase.repurchase_lift(t, "product", 30, ordered=False),
    }
    with_broadcast = {k: rows(q()) for k, q in queries.items()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for k, q in queries.items():
            df = q()
            import contextlib
            import io

            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain()
            assert "BroadcastHashJoin" not in buf.getvalue(), k
            assert rows(df) == with_broadcast[k], k
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
