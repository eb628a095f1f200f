"""Bucketed tables, moments, the pair table and its filter, salted joins and
top-k: same rows as the plain forms, and the plans they are for."""

from __future__ import annotations

import contextlib
import io
import random
import re
import tempfile

import pytest
from conftest import make_tables, rows
from pyspark.sql import functions as F

from kartlens.functions import joins
from kartlens.model import Tables
from kartlens.operators import copurchase, dashboard, moments, ordersize, pairtable, repurchase
from kartlens.plans import stored
from kartlens.sources import bucketed, publish
from test_pairs import _brute


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@contextlib.contextmanager
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(3)
    orders = [(o, o % 40, 1 + o // 40, None if o < 40 else rng.choice((1.0, 7.0, 9.25, 30.0))) for o in range(400)]
    lines = [(o, int(rng.paretovariate(0.7)) % 60 + 1) for o in range(400) for _ in range(rng.randint(0, 9))]
    lines += [(7, p) for p in range(1, 61) for _ in range(3)]
    products = [(p, f"p{p}", p % 5 + 1, p % 3 + 1) for p in range(1, 58)]
    made = make_tables(spark, orders, lines, products)
    return made, lines


@pytest.fixture(scope="module")
def tables(spark, plain):
    """The same tables, published with orders and lines bucketed by order."""
    t, _ = plain
    frames = {"orders": t.orders, "lines": t.lines, "products": t.products, "aisles": t.aisles, "departments": t.departments}
    layout = ("order_id", 4)
    version = publish.publish(
        spark, tempfile.mkdtemp(prefix="kartlens-bkt-"), frames, {"orders": layout, "lines": layout}
    )
    read = {name: version.read(spark, name) for name in frames}
    return Tables(
        orders=read["orders"],
        prior=t.prior,
        products=read["products"],
        aisles=read["aisles"],
        departments=read["departments"],
        prior_lines=read["lines"],
    )


# ----------------------------------------------------------- bucketed tables


def fact_plans(t):
    yield "Q2 events", repurchase.cycle_events(t)
    yield "Q7 rows", ordersize.sized(t)
    yield "Q6 rows", ordersize.order_sizes(t)
    yield "baskets", pairtable.reaching(t)


def test_no_exchange_by_order_on_bucketed_tables(spark, tables, plain):
    with no_broadcast(spark):
        for name, df in fact_plans(tables):
            assert not re.search(r"Exchange hashpartitioning\(order_id", explained(df)), name
        for name, df in fact_plans(plain[0]):
            assert re.search(r"Exchange hashpartitioning\(order_id", explained(df)), name


def test_whole_metric_plans_have_no_exchange_by_order(spark, tables):
    with no_broadcast(spark):
        for level in ("product", "department", "aisle"):
            for df in (
                repurchase.repurchase_cycle(tables, level, 3, ordered=False),
                repurchase.repurchase_lift(tables, level, 3, ordered=False),
                ordersize.order_size(tables, level, 3, ordered=False),
                ordersize.order_size_lift(tables, level, 3, ordered=False),
                ordersize.order_size_lift_by_lines(tables, level, 3, ordered=False),
            ):
                assert "hashpartitioning(order_id" not in explained(df)


def test_a_hot_order_is_not_put_into_one_bucket(spark, plain):
    lines = plain[0].lines
    n = lines.count()
    assert bucketed.has_hot_key(lines, "order_id", n, hot_rows=150)
    assert not bucketed.has_hot_key(lines, "order_id", n, hot_rows=250)
    assert not bucketed.has_hot_key(lines, "order_id", 10)  # too few rows for any
    nulls = spark.createDataFrame([(None,)] * 30 + [(1,)], "order_id int")
    assert bucketed.has_hot_key(nulls, "order_id", 31, hot_rows=30)


def test_bucket_counts(spark):
    cores = spark.sparkContext.defaultParallelism
    assert bucketed.bucket_count(spark, 0) == bucketed.bucket_count(spark, 1_000) == cores
    assert bucketed.bucket_count(spark, 10**9) == 125
    assert bucketed.bucket_count(spark, 10**15) == bucketed.MAX_BUCKETS


def test_tasks_get_no_more_rows_on_larger_tables(spark):
    assert bucketed.task_count(spark, 1_000) == spark.sparkContext.defaultParallelism
    assert bucketed.task_count(spark, 10**9) == 10**9 // bucketed.TASK_ROWS
    assert bucketed.task_count(spark, 10**15) == bucketed.MAX_BUCKETS


def test_baskets_are_in_as_many_buckets_as_tasks_need(spark, plain, monkeypatch):
    t = plain[0]
    monkeypatch.setattr(bucketed, "TASK_ROWS", 100)
    own = Tables(t.orders, t.prior, t.products, t.aisles, t.departments)
    got = stored.baskets(own)
    n = -(-own.line_rows() // 100)
    assert n > spark.sparkContext.defaultParallelism
    with no_broadcast(spark):
        found = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", explained(got.groupBy("order_id").count()))
    assert found and found.group(2) == str(n)
    assert rows(got) == rows(pairtable.reaching(t))


# ------------------------------------------------------------------- moments


def test_moments_equal_direct_aggregates(spark, tables, plain):
    t = plain[0]
    events = repurchase.cycle_events(t).join(t.products, "product_id").join(t.departments, "department_id")
    want = {
        r["department"]: (r["n"], round(r["a"], 2), round(r["s"], 2))
        for r in events.groupBy("department")
        .agg(F.count("*").alias("n"), F.avg("days_since_prior_order").alias("a"), F.stddev_pop("days_since_prior_order").alias("s"))
        .collect()
    }
    got = repurchase.repurchase_lift(tables, "department", 1, spread=True, per_product=stored.cycles(tables))
    for r in got.collect():
        n, mean, sd = want[r["department"]]
        assert r["number_of_repurchase_events"] == n
        assert abs(r["department_avg_repurchase_cycle"] - mean) < 0.0051 and abs(r["stddev_repurchase_cycle"] - sd) < 0.0051


@pytest.mark.parametrize("level", ["product", "aisle", "department"])
def test_stored_moments_change_nothing(spark, tables, plain, level):
    t = plain[0]
    cycle, size = stored.cycles(tables), stored.sizes(tables)
    cycle_base, size_base = stored.baseline(tables, "global_cycle"), stored.baseline(tables, "global_size")
    pairs = [
        (repurchase.repurchase_cycle(t, level, 3), repurchase.repurchase_cycle(tables, level, 3, per_product=cycle)),
        (repurchase.repurchase_lift(t, level, 3), repurchase.repurchase_lift(tables, level, 3, per_product=cycle, base=cycle_base)),
        (ordersize.order_size(t, level, 3), ordersize.order_size(tables, level, 3, per_product=size)),
        (ordersize.order_size_lift(t, level, 3), ordersize.order_size_lift(tables, level, 3, size_base, per_product=size)),
        (
            ordersize.order_size_lift_by_lines(t, level, 3, "10.09"),
            ordersize.order_size_lift_by_lines(tables, level, 3, "10.09", per_product=size),
        ),
    ]
    for want, got in pairs:
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_one_pass_serves_every_level(spark, tables):
    """A stored moments table is scanned; no line item is read again."""
    for level in ("product", "aisle", "department"):
        files = repurchase.repurchase_cycle(tables, level, 3, per_product=stored.cycles(tables)).inputFiles()
        assert any("/cycle_moments/" in f for f in files) and not any("/lines/" in f or "/orders/" in f for f in files)


def test_gaps_add_up_exactly(spark):
    """A hundred gaps of 0.1 have mean 0.10 and no deviation in any order."""
    rows_ = spark.createDataFrame([(1, 0.1)] * 100 + [(2, 1e6), (2, 1e6)], "product_id int, v double")
    got = {r["product_id"]: r for r in moments.moments(rows_, F.col("v"), moments.GAP_TYPE).select("*", moments.deviation().alias("sd")).collect()}
    assert str(got[1]["s1"]) == "10.000000" and float(got[1]["sd"]) == 0 and float(got[2]["sd"]) == 0


# ---------------------------------------------------------------- pair table


def known(lines):
    return [(o, p) for o, p in lines if p <= 57]


@pytest.mark.parametrize("threshold", [2, 5, 30])
def test_pair_table_equals_brute_force(spark, tables, plain, threshold):
    lines = known(plain[1])
    table = stored.pairs(tables, threshold)
    table = table.where(F.col("lines") >= threshold)  # may be a stored one at a lower threshold
    assert rows(table, "anchor_id", "co_id", "lines") == _brute(lines, True, threshold)
    by_orders = {(a, b): n for a, b, n in _brute(lines, False, 1)}
    totals = {}
    for o, p in set(lines):
        totals[p] = totals.get(p, 0) + 1
    for r in table.collect():
        assert r["orders"] == by_orders[r["anchor_id"], r["co_id"]]
        assert (r["anchor_orders"], r["co_orders"]) == (totals[r["anchor_id"]], totals[r["co_id"]])


def test_queries_read_the_stored_table(spark, tables, plain):
    t = plain[0]
    for fn, args in (
        (copurchase.copurchase_pairs, {}),
        (copurchase.copurchase_share, {}),
        (copurchase.copurchase_share, {"symmetric": True}),
    ):
        want, made = fn(t, 3, **args), fn(tables, 3, pairs=stored.pairs(tables, 3), **args)
        assert [tuple(r) for r in made.collect()] == [tuple(r) for r in want.collect()]
        assert not any("/baskets/" in f or "/lines/" in f for f in made.inputFiles())


def test_a_lower_stored_threshold_serves_a_higher_one(spark, tables):
    low = stored.pairs(tables, 2)
    assert stored.pairs(tables, 4) is not None
    found = tables._stored["pairs"]
    assert min(found) == 2 and all(t in (2, 3, 5, 30) for t in found)
    assert rows(low.where("lines >= 4"), "anchor_id", "co_id") == rows(stored.pairs(tables, 4).where("lines >= 4"), "anchor_id", "co_id")


def build(spark, tables, threshold, buckets):
    """(table, emitted pair rows, filter rows or None)."""
    reach = pairtable.reaching(tables)
    items = pairtable.support(reach)
    kept = pairtable.kept_rows(reach, items, threshold, 1_000)
    pairs = copurchase.order_pairs(kept)
    able = pairtable.pair_filter(pairs, pairtable.line_pairs(kept), threshold, lambda df: df.cache(), buckets)
    emitted = pairtable.filtered(pairs, able, buckets).count()
    table = pairtable.pair_table(reach, items, threshold, 1_000, lambda df: df.cache(), buckets)
    return rows(table, "anchor_id", "co_id", "lines"), pairs.count(), emitted, able


@pytest.mark.parametrize("buckets", [1, 7, 500, 1 << 21])
def test_the_filter_loses_no_pair(spark, tables, plain, buckets):
    got, before, emitted, able = build(spark, tables, 12, buckets)
    assert got == _brute(known(plain[1]), True, 12)
    if buckets <= 7:  # full: pairs are counted plainly
        assert able is None and emitted == before
    if buckets == 1 << 21:  # next to no collisions: hardly any but frequent pairs are emitted
        wanted = sum(n for a, b, n in _brute(known(plain[1]), False, 1) if (a, b) in {(x, y) for x, y, _ in got})
        assert able is not None and wanted <= emitted < wanted + 60 and emitted < before


def test_a_full_table_is_known_before_a_pair_is_made(spark, tables):
    failing = spark.range(1).selectExpr("assert_true(id > 1) AS w", "id AS anchor_id", "id AS co_id")
    assert pairtable.pair_filter(failing, 700, 7, lambda df: df, 100) is None


def test_line_pairs_are_counted_without_pairs(spark, tables, plain):
    total = pairtable.line_pairs(pairtable.reaching(tables))
    assert total == sum(n for _, _, n in _brute(known(plain[1]), True, 1))


# ------------------------------------------------------- salted catalog joins


def test_a_hot_anchor_is_dealt_over_the_reducers(spark, monkeypatch):
    """Budget 0 and one anchor in a third of all pairs: same rows, and no
    reducer takes the anchor whole."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    pairs = [(1, c, 1) for c in range(2, 3_002)] + [(a, a + 1, 1) for a in range(2, 6_002)]
    big = spark.createDataFrame(pairs, "anchor_id int, co_id int, n int")
    names = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7_000)], "anchor_id int, name string")
    with no_broadcast(spark):
        out = joins.catalog_join(big, names, "anchor_id", 6_999, salt_rows=100)
        plain = big.join(names, "anchor_id")
        assert rows(out, "anchor_id", "co_id", "n", "name") == rows(plain, "anchor_id", "co_id", "n", "name")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            def largest(df):
                where = df.where("anchor_id = 1").groupBy(F.spark_partition_id().alias("p")).count()
                return [r["count"] for r in where.collect()]

            dealt = largest(joins.catalog_join(big, names, "anchor_id", 6_999, salt_rows=100).select("anchor_id", "name"))
            assert sum(dealt) == 3_000 and max(dealt) < 3_000 and len(dealt) > 1
            assert len(largest(plain.select("anchor_id", "name"))) == 1
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joins.salts_for(big, "anchor_id", 100) == 30
    assert joins.salts_for(big, "anchor_id") == joins.salts_for(big.limit(0), "anchor_id") == 1


def test_pair_queries_with_no_broadcast_budget(spark, tables, plain, monkeypatch):
    want = rows(copurchase.copurchase_share(plain[0], 2))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "SALT_ROWS", 5)
    assert rows(copurchase.copurchase_share(tables, 2, pairs=stored.pairs(tables, 2))) == want


# ------------------------------------------------------------- top co-products


def test_names_are_joined_to_ranked_rows(spark, tables, plain):
    got = dashboard.top_coproducts(tables, 2, 3, pairs=stored.pairs(tables, 2))
    plan = explained(got)
    # From the top of the plan: names, then the rank, and group limits below.
    top, rank, limit = plan.index("product_name"), plan.index("Window "), plan.index("WindowGroupLimit")
    assert top < rank < limit and "product_name" not in plan[rank : plan.index("FileScan", limit)]
    want = {}
    for r in copurchase.copurchase_share(plain[0], 2, ordered=False).collect():
        want.setdefault(r["anchor_id"], []).append((-r["percentage_of_anchor_orders"], r["co_product_id"], r["co_product_name"]))
    best = sorted((a, i + 1, co, name) for a, xs in want.items() for i, (_, co, name) in enumerate(sorted(xs)[:3]))
    assert rows(got, "anchor_id", "rank", "co_product_id", "co_product_name") == best
