"""Versioned publishing: readers, dead runs, old versions, scratch copies."""

from __future__ import annotations

import os
import tempfile
import time

import pytest
from conftest import make_tables, rows

from kartlens.plans.materialize import run_reference_steps
from kartlens.session import ensure_checkpoint_dir
from kartlens.sources import publish


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "order_id int")


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="kartlens-pub-")


def versions(root):
    return sorted(d for d in os.listdir(root) if d.startswith("v-"))


def test_a_reader_keeps_its_version_during_a_rerun(spark, root):
    assert publish.current(spark, root) is None
    publish.publish(spark, root, {"a": numbers(spark, 1, 2)})
    reader = publish.current(spark, root).read(spark, "a")
    publish.publish(spark, root, {"a": numbers(spark, 3)})
    assert rows(reader) == [(1,), (2,)]
    assert rows(publish.current(spark, root).read(spark, "a")) == [(3,)]


def test_old_versions_go_after_two_publications(spark, root):
    names = [publish.publish(spark, root, {"a": numbers(spark, i)}, keep=2).name for i in range(4)]
    assert versions(root) == sorted(names[2:])
    assert publish.current(spark, root).history == (names[3], names[2])


def test_a_killed_write_leaves_the_version_before(spark, root):
    first = publish.publish(spark, root, {"a": numbers(spark, 1)})
    dead = publish.begin(root)
    publish.write(dead, "a", numbers(spark, 9))  # and dies before the switch
    bad = numbers(spark, 1).selectExpr("assert_true(order_id > 1) AS order_id")
    with pytest.raises(Exception):
        publish.publish(spark, root, {"a": numbers(spark, 2), "b": bad})
    now = publish.current(spark, root)
    assert now.name == first.name and rows(now.read(spark, "a")) == [(1,)]
    # Orphans may belong to a run that still writes; idle ones are removed.
    assert publish.drop_old(spark, root) == []
    old = time.time() - 48 * 3600
    for name in versions(root):
        os.utime(f"{root}/{name}", (old, old))
    assert dead.name in publish.drop_old(spark, root)
    assert versions(root) == [first.name]


def test_bucketed_tables_of_a_version(spark, root):
    frame = spark.range(100).selectExpr("cast(id AS int) AS order_id", "id * 2 AS x")
    version = publish.publish(spark, root, {"a": frame}, {"a": ("order_id", 3)})
    assert version.read(spark, "a").count() == 100
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("kartlens_bucketed_")]
    publish.publish(spark, root, {"a": frame}, {"a": ("order_id", 3)}, keep=1)
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("kartlens_bucketed_")]
    assert len(left) == len(name)  # the dropped version's entry went, the new one's came
    # Another application declares the table again over the same files.
    now = publish.current(spark, root)
    for t in left:
        spark.sql(f"DROP TABLE {t}")
    assert rows(now.read(spark, "a"), "order_id", "x") == [(i, 2 * i) for i in range(100)]


def test_scratch_of_dead_runs_goes(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    for app in ("app-dead", "app-young", spark.sparkContext.applicationId):
        os.makedirs(f"{base}/kartlens-results/{app}/x", exist_ok=True)
    old = time.time() - 48 * 3600
    for app in ("app-dead", spark.sparkContext.applicationId):
        for d in ("x", ""):
            os.utime(f"{base}/kartlens-results/{app}/{d}", (old, old))
    assert publish.drop_scratch(spark) == ["kartlens-results/app-dead"]
    assert os.path.isdir(f"{base}/kartlens-results/app-young")
    assert os.path.isdir(f"{base}/kartlens-results/{spark.sparkContext.applicationId}")


def test_reference_steps_publish_one_version(spark, root):
    orders = [(i, 1, i, 2.0) for i in range(1, 31)]
    lines = [(i, p) for i in range(1, 31) for p in (1, 2)]
    t = make_tables(spark, orders, lines, [(1, "a", 1, 1), (2, "b", 1, 1)])
    first = run_reference_steps(t, root, 30, 30, 30, csv=False)
    open_before = spark.read.parquet(first["product_behavior_export"])
    second = run_reference_steps(t, root, 30, 30, 30)
    assert first["product_behavior_export"] != second["product_behavior_export"]
    assert rows(open_before) == rows(publish.current(spark, root).read(spark, "product_behavior_export"))
    # Q4's table holds no baseline of order sizes: another baseline reuses it.
    run_reference_steps(t, root, 30, 30, 30, baseline="10.09", csv=False)
    kept = [name for name in t._stored if name.startswith("repurchase_lift_results")]
    assert kept == ["repurchase_lift_results-30"]
