"""The CSV load is all or nothing; its report names every rejected record."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import rows

from kartlens.operators import repurchase
from kartlens.sources import publish
from kartlens.sources.csv_load import LoadRejected, ingest_csv
from kartlens.sources.parquet import read_tables

GOOD = {
    "orders": "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"
    "1,7,prior,1,2,8,\n2,7,prior,2,3,9,15.5\n",
    "order_products__prior": "order_id,product_id,add_to_cart_order,reordered\n1,10,1,0\n2,10,1,1\n2,11,2,0\n",
    "products": 'product_id,product_name,aisle_id,department_id\n10,"Ban, ""ana""\nbig",1,1\n11,"",,2\n',
    "aisles": "aisle_id,aisle\n1,fresh fruits\n2,milk\n",
    "departments": "department_id,department\n1,produce\n2,dairy\n",
}


def folder(**changed) -> str:
    path = tempfile.mkdtemp(prefix="kartlens-csv-")
    for name, text in (GOOD | changed).items():
        with open(os.path.join(path, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(text)
    return path


@pytest.fixture
def out():
    return tempfile.mkdtemp(prefix="kartlens-out-")


def report(spark, error) -> list[tuple]:
    found = spark.read.parquet(error.report).collect()
    return sorted((r["table"], os.path.basename(r["file"]), r["record"], r["reason"]) for r in found)


def test_values_survive_the_load(spark, out):
    t = ingest_csv(spark, folder(), out, with_train=False)
    assert [tuple(r) for r in t.products.orderBy("product_id").collect()] == [(10, 'Ban, "ana"\nbig', 1, 1), (11, "", None, 2)]
    assert rows(t.orders, "order_id") == [(1,), (2,)]
    assert {r["order_id"]: r["days_since_prior_order"] for r in t.orders.collect()} == {1: None, 2: 15.5}
    assert t.prior.schema["order_id"].dataType.simpleString() == "int"
    again = read_tables(spark, out)
    assert rows(repurchase.repurchase_cycle(again, "product", 1)) == rows(repurchase.repurchase_cycle(t, "product", 1))


def test_a_bad_row_in_the_last_file_leaves_no_table(spark, out):
    with pytest.raises(LoadRejected) as e:
        ingest_csv(spark, folder(departments="department_id,department\n1,produce\nx,dairy\n"), out, with_train=False)
    assert e.value.counts == {"departments": 1}
    assert report(spark, e.value) == [("departments", "departments.csv", "x,dairy", "department_id is not int")]
    assert publish.current(spark, out) is None
    assert [d for d in os.listdir(out) if d.startswith("v-")] == []


def test_a_failed_load_leaves_the_tables_before(spark, out):
    ingest_csv(spark, folder(), out, with_train=False)
    with pytest.raises(LoadRejected):
        ingest_csv(spark, folder(aisles="aisle_id,aisle\n3,tea\n3,coffee\n"), out, with_train=False)
    assert rows(read_tables(spark, out).aisles) == [(1, "fresh fruits"), (2, "milk")]


def test_every_fault_is_named(spark, out):
    bad = folder(
        orders=GOOD["orders"] + ",7,prior,3,1,1,2\n2,7,prior,4,1,1,2\n5,7,prior,nine,1,1,soon\n",
        order_products__prior=GOOD["order_products__prior"] + "1,2\n",
        aisles="aisle_id,aisle\n1,a,b\n",
    )
    with pytest.raises(LoadRejected) as e:
        ingest_csv(spark, bad, out, with_train=False)
    found = [(t, r, why) for t, _, r, why in report(spark, e.value)]
    assert found == sorted(
        [
            ("aisles", "1,a,b", "not 2 fields"),
            ("order_products__prior", "1,2", "not 4 fields"),
            ("orders", ",7,prior,3,1,1,2", "order_id is null"),
            ("orders", "2,7,prior,2,3,9,15.5", "order_id is repeated"),
            ("orders", "2,7,prior,4,1,1,2", "order_id is repeated"),
            ("orders", "5,7,prior,nine,1,1,soon", "days_since_prior_order is not double"),
            ("orders", "5,7,prior,nine,1,1,soon", "order_number is not int"),
        ]
    )
    assert e.value.counts == {"aisles": 1, "order_products__prior": 1, "orders": 5}


def test_other_header_names_and_missing_files_load_nothing(spark, out):
    with pytest.raises(Exception):
        ingest_csv(spark, folder(aisles="aisle_key,aisle\n1,a\n"), out, with_train=False)
    with pytest.raises(Exception):
        ingest_csv(spark, folder(), out, with_train=True)  # there is no train file
    assert publish.current(spark, out) is None
    assert [d for d in os.listdir(out) if d.startswith("v-")] == []


def test_empty_files_load_empty_tables(spark, out):
    headers = {name: text.split("\n")[0] + "\n" for name, text in GOOD.items()}
    t = ingest_csv(spark, folder(**headers), out, with_train=False)
    assert t.orders.count() == t.prior.count() == t.products.count() == 0
    assert t.lines.columns == ["order_id", "product_id"]
