"""Skewed inputs end to end: one order holds ~40% of all line items and one
customer ~40% of all orders. Results must equal a pandas brute force, with
the wide-order slicing and the sequence split actually in use."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import make_tables

from kartlens.operators import copurchase, ordersize, repurchase

N_PRODUCTS = 60


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    orders, lines = [], []
    order_id = 0
    # customer 1 is hot: 120 orders; 30 other customers: 6 orders each
    for user, count in [(1, 120)] + [(u, 6) for u in range(2, 32)]:
        for n in range(1, count + 1):
            order_id += 1
            gap = None if n == 1 else float(rng.integers(1, 30))
            orders.append((order_id, user, n, gap))
            width = 3 if order_id != 7 else 0
            items = rng.integers(1, N_PRODUCTS + 1, width)
            lines += [(order_id, int(p)) for p in items]
    # order 7 is hot: every product, several lines each -> ~40% of all lines
    hot = [(7, p) for p in range(1, N_PRODUCTS + 1) for _ in range(12)]
    lines += hot
    assert len(hot) / len(lines) > 0.35
    products = [(p, f"p{p}", p % 3 + 1, p % 4 + 1) for p in range(1, N_PRODUCTS + 1)]
    return make_tables(spark, orders, lines, products), pd.DataFrame(orders, columns=["order_id", "user_id", "n", "gap"]), pd.DataFrame(lines, columns=["order_id", "product_id"])


def _pairs(lines: pd.DataFrame, by_lines: bool, t: int):
    counts: Counter = Counter()
    for _, grp in lines.groupby("order_id"):
        items = grp["product_id"].tolist()
        if by_lines:
            for a, b in itertools.product(items, items):
                if a < b:
                    counts[(a, b)] += 1
        else:
            for a, b in itertools.combinations(sorted(set(items)), 2):
                counts[(a, b)] += 1
    return sorted((a, b, n) for (a, b), n in counts.items() if n >= t)


def test_pairs_with_a_hot_order(spark, skewed, monkeypatch):
    t, _, lines = skewed
    monkeypatch.setattr(copurchase, "SLICE_WIDTH", 8)  # the hot order (60 items) is cut into 8 slices
    got = copurchase.copurchase_pairs(t, 3, ordered=False).select("anchor_id", "co_product_id", "number_of_product_pairs")
    assert sorted(map(tuple, got.collect())) == _pairs(lines, True, 3)
    got = copurchase.copurchase_share(t, 3, ordered=False).select("anchor_id", "co_product_id", "number_of_co_purchases")
    assert sorted(map(tuple, got.collect())) == _pairs(lines, False, 3)


def test_order_size_with_a_hot_order(spark, skewed):
    t, _, lines = skewed
    size = lines.groupby("order_id").size().rename("size")
    per = lines.drop_duplicates().join(size, on="order_id").groupby("product_id")["size"]
    exp = {p: round(v + 1e-9, 2) for p, v in per.mean().items() if per.count()[p] >= 5}
    got = {r.product_id: r.avg_order_size for r in ordersize.order_size(t, "product", 5).collect()}
    assert got == exp


def test_same_product_cycle_with_a_hot_customer(spark, skewed):
    t, orders, lines = skewed
    prev_parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = repurchase.same_product_events(t).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev_parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    o = orders.sort_values(["user_id", "n"]).copy()
    o["day"] = o.groupby("user_id")["gap"].transform(lambda g: g.fillna(0).cumsum())
    pur = lines.drop_duplicates().merge(o, on="order_id").sort_values(["user_id", "product_id", "n"])
    pur["prev"] = pur.groupby(["user_id", "product_id"])["day"].shift(1)
    exp = pur.dropna(subset=["prev"])
    exp = sorted(zip(exp["product_id"], exp["day"] - exp["prev"]))
    assert sorted(zip(events["product_id"], events["cycle_days"])) == exp


def test_cycle_with_a_hot_order_joined_map_side(spark, skewed, monkeypatch):
    t, orders, lines = skewed
    plain = {r.product_id: r for r in repurchase.repurchase_lift(t, "product", 5, ordered=False).collect()}
    monkeypatch.setattr(repurchase, "HOT_LINES", 100)  # order 7 (720 lines) becomes hot
    df = repurchase.repurchase_lift(t, "product", 5, ordered=False)
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "LeftAnti" in buf.getvalue()
    split = {r.product_id: r for r in df.collect()}
    assert split == plain
    g = orders.dropna(subset=["gap"])[["order_id", "gap"]]
    ev = lines.merge(g, on="order_id")
    exp = ev.groupby("product_id").size()
    assert {p: r.number_of_repurchase_events for p, r in split.items()} == {p: n for p, n in exp.items() if n >= 5}


def test_hot_key_join_matches_plain_join(spark, skewed):
    from kartlens.functions.joins import hot_key_join

    t, _, _ = skewed
    big = t.lines.unionByName(spark.createDataFrame([(99999, 1)], t.lines.schema))  # one orphan line
    small = t.gaps
    n = big.count()
    for how in ("inner", "left", "left_anti"):
        plain = sorted(map(tuple, big.join(small, "order_id", how).collect()), key=str)
        split = sorted(map(tuple, hot_key_join(big, small, "order_id", how, n, 100).collect()), key=str)
        assert split == plain, how


def test_hot_keys_stay_within_the_broadcast_budget():
    from kartlens.functions.joins import BROADCAST_ROWS, HOT_ROWS, hot_limit

    for rows in (0, 1, HOT_ROWS, HOT_ROWS * BROADCAST_ROWS, HOT_ROWS * BROADCAST_ROWS + HOT_ROWS, 10**16 + 1):
        limit = hot_limit(rows, HOT_ROWS)
        assert limit >= HOT_ROWS
        assert rows // limit <= BROADCAST_ROWS
    assert hot_limit(10**8, HOT_ROWS) == HOT_ROWS


def test_hot_keys_are_broadcast_above_ten_trillion_rows(spark, skewed):
    from kartlens.functions.joins import HOT_ROWS, hot_key_join

    t, _, _ = skewed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hot_key_join(t.lines, t.gaps, "order_id", "inner", 10**13 + 10**7, HOT_ROWS)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 4  # ids with lines twice and with orders, the hot part
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prior_binding_with_hot_keys(spark, skewed):
    from pyspark.sql import functions as F

    from kartlens.sources.testdata import bind_prior

    t, _, _ = skewed
    lineitem = t.lines.select(
        F.col("order_id").alias("l_orderkey"), F.col("product_id").alias("l_partkey"), F.lit(1).alias("l_linenumber")
    )
    n = lineitem.count()
    plain = sorted(map(tuple, bind_prior(lineitem, t.orders, n, hot_rows=n + 1).collect()), key=str)
    split = sorted(map(tuple, bind_prior(lineitem, t.orders, n, hot_rows=50).collect()), key=str)
    assert split == plain and any(r[3] == 1 for r in plain)
