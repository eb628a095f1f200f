"""CSV ingest (S2, V5), validation checks (V1-V4) and the materialized flow."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import make_tables, rows

from kartlens.operators import validate
from kartlens.plans.materialize import run_reference_steps
from kartlens.sources.csv_load import ingest_csv, read_csv


def _write(folder: str, name: str, text: str) -> str:
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_quotes_nulls_and_newlines(spark):
    folder = tempfile.mkdtemp(prefix="kartlens-csv-")
    path = _write(
        folder,
        "products.csv",
        "product_id,product_name,aisle_id,department_id\n"
        '1,"Say ""Hi"", ok",1,1\n'
        '2,"two\nlines",1,1\n'
        '3,"",1,1\n'
        "4,,1,1\n",
    )
    got = {r.product_id: r.product_name for r in read_csv(spark, path, "products").collect()}
    assert got == {1: 'Say "Hi", ok', 2: "two\nlines", 3: "", 4: None}


def test_csv_malformed_rows_abort(spark):
    folder = tempfile.mkdtemp(prefix="kartlens-csv-")
    bad_id = _write(folder, "a.csv", "order_id,product_id,add_to_cart_order,reordered\nx,1,1,0\n")
    short = _write(folder, "b.csv", "order_id,product_id,add_to_cart_order,reordered\n1,2\n")
    for path in (bad_id, short):
        with pytest.raises(Exception):
            read_csv(spark, path, "order_products__prior").collect()


def test_csv_header_names_are_checked(spark):
    folder = tempfile.mkdtemp(prefix="kartlens-csv-")
    path = _write(folder, "aisles.csv", "aisle_key,aisle\n1,fresh fruits\n")
    with pytest.raises(Exception):
        read_csv(spark, path, "aisles").collect()


def test_ingest_folder_to_parquet(spark):
    folder = tempfile.mkdtemp(prefix="kartlens-csv-")
    _write(
        folder,
        "orders.csv",
        "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"
        "1,7,prior,1,2,8,\n2,7,prior,2,3,9,15.0\n3,7,train,3,4,10,6.0\n",
    )
    lines = "order_id,product_id,add_to_cart_order,reordered\n1,10,1,0\n2,10,1,1\n2,11,2,0\n"
    _write(folder, "order_products__prior.csv", lines)
    _write(folder, "order_products__train.csv", "order_id,product_id,add_to_cart_order,reordered\n3,10,1,1\n")
    _write(folder, "products.csv", "product_id,product_name,aisle_id,department_id\n10,Banana,1,1\n11,Milk,2,2\n")
    _write(folder, "aisles.csv", "aisle_id,aisle\n1,fresh fruits\n2,milk\n")
    _write(folder, "departments.csv", "department_id,department\n1,produce\n2,dairy\n")
    t = ingest_csv(spark, folder, tempfile.mkdtemp(prefix="kartlens-pq-"))
    counts = dict(rows(validate.row_counts(t)))
    assert counts == {
        "orders": 3,
        "order_products__prior": 3,
        "order_products__train": 1,
        "products": 2,
        "aisles": 2,
        "departments": 2,
    }
    assert t.orders.schema["days_since_prior_order"].dataType.simpleString() == "double"
    assert rows(t.orders.where("days_since_prior_order IS NULL"), "order_id") == [(1,)]


def test_key_and_reference_checks(spark):
    orders = [(1, 1, 1, None), (2, 1, 2, 3.0)]
    lines = [(1, 10), (2, 10), (2, 99), (3, 10)]
    products = [(10, "a", 1, 1), (10, "a again", 1, 1), (11, "b", 5, 1)]
    t = make_tables(spark, orders, lines, products, aisles=[(1, "x")], departments=[(1, "d")])
    keys = {r.table_name: (r.duplicate_keys, r.null_keys) for r in validate.key_violations(t).collect()}
    assert keys["products"] == (1, 0) and keys["orders"] == (0, 0)
    refs = {(r.child_table, r.child_column): r.unmatched_rows for r in validate.unmatched_references(t).collect()}
    assert refs[("order_products__prior", "order_id")] == 1
    assert refs[("order_products__prior", "product_id")] == 1
    assert refs[("products", "aisle_id")] == 1
    preview = validate.preview(t, "orders").collect()
    assert [r.order_id for r in preview] == [1, 2]


def test_reference_steps_write_tables_and_extract(spark):
    orders = [(i, 1, i, 2.0) for i in range(1, 31)]
    lines = [(i, p) for i in range(1, 31) for p in (1, 2)]
    t = make_tables(spark, orders, lines, [(1, "a", 1, 1), (2, "b", 1, 1)])
    out = tempfile.mkdtemp(prefix="kartlens-out-")
    paths = run_reference_steps(t, out, 30, 30, 30)
    extract = spark.read.parquet(paths["product_behavior_export"])
    assert rows(extract, "anchor_id", "co_product_id", "percent_anchor_orders") == [(1, 2, 100.0)]
    csv_rows = spark.read.option("header", "true").csv(paths["product_behavior_export_csv"]).collect()
    assert len(csv_rows) == 1
    # a second run overwrites instead of failing
    run_reference_steps(t, out, 30, 30, 30)


def test_streaming_ingest_loads_each_file_once(spark):
    from kartlens.streaming.ingest import ingest_available

    src = tempfile.mkdtemp(prefix="kartlens-land-")
    out = tempfile.mkdtemp(prefix="kartlens-tbl-") + "/prior"
    ckpt = tempfile.mkdtemp(prefix="kartlens-ck-")
    header = "order_id,product_id,add_to_cart_order,reordered\n"
    _write(src, "part1.csv", header + "1,10,1,0\n1,11,2,0\n")
    ingest_available(spark, src, "order_products__prior", out, ckpt)
    assert spark.read.parquet(out).count() == 2
    _write(src, "part2.csv", header + "2,10,1,1\n")
    ingest_available(spark, src, "order_products__prior", out, ckpt)
    ingest_available(spark, src, "order_products__prior", out, ckpt)  # nothing new
    assert rows(spark.read.parquet(out), "order_id", "product_id") == [(1, 10), (1, 11), (2, 10)]


def test_command_runs_the_whole_flow_on_csv(spark):
    from kartlens.__main__ import main

    folder = tempfile.mkdtemp(prefix="kartlens-csv-")
    orders = ["order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order"]
    orders += [f"{i},1,prior,{i},1,9,{'' if i == 1 else 3.0}" for i in range(1, 41)]
    _write(folder, "orders.csv", "\n".join(orders) + "\n")
    lines = ["order_id,product_id,add_to_cart_order,reordered"] + [f"{i},{p},1,0" for i in range(1, 41) for p in (1, 2)]
    _write(folder, "order_products__prior.csv", "\n".join(lines) + "\n")
    _write(folder, "products.csv", "product_id,product_name,aisle_id,department_id\n1,Banana,1,1\n2,Milk,2,2\n")
    _write(folder, "aisles.csv", "aisle_id,aisle\n1,fresh fruits\n2,milk\n")
    _write(folder, "departments.csv", "department_id,department\n1,produce\n2,dairy\n")
    out = tempfile.mkdtemp(prefix="kartlens-out-")
    written = main(["--csv", folder, "--out", out, "--no-train"])
    assert rows(spark.read.parquet(written["copurchase_share"]), "anchor_id", "co_product_id", "number_of_co_purchases") == [
        (1, 2, 40)
    ]
    extract = spark.read.parquet(written["product_behavior_export"])
    assert rows(extract, "anchor_id", "co_product_id") == [(1, 2)]
    assert rows(spark.read.parquet(written["global_repurchase_cycle"])) == [(3.0,)]
