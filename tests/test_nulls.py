"""Null order ids, quoted names in the extract, nulls in previews, sessions."""

from __future__ import annotations

import csv
import glob
import tempfile

import pytest
from conftest import make_tables, rows

from kartlens.operators import ordersize, validate
from kartlens.session import ensure_checkpoint_dir
from kartlens.sources.parquet import write_result


def test_lines_without_an_order_are_in_no_order(spark):
    orders = [(1, 1, 1, None), (2, 1, 2, 3.0), (3, 1, 3, 4.0)]
    lines = [(1, 10), (2, 10), (2, 11), (3, 10), (None, 10), (None, 11), (None, 11), (3, None)]
    t = make_tables(spark, orders, lines, [(10, "a", 1, 1), (11, "b", 1, 1)])
    got = rows(ordersize.order_size(t, "product", 1), "product_name", "avg_order_size", "number_of_orders")
    assert got == [("a", 1.67, 3), ("b", 2.0, 1)]
    by_lines = ordersize.order_size_lift_by_lines(t, "department", 1).first()
    assert by_lines["number_of_orders"] == 4


def test_csv_quotes_are_doubled(spark):
    out = tempfile.mkdtemp(prefix="kartlens-csv-") + "/x"
    values = [('Say "Hi", ok', "b"), ("plain", "back\\slash")]
    write_result(spark.createDataFrame(values, "a string, b string").coalesce(1), out, fmt="csv")
    (path,) = glob.glob(f"{out}/part-*.csv")
    with open(path, newline="") as f:
        assert sorted(map(tuple, csv.reader(f))) == sorted([("a", "b"), *values])


def test_preview_shows_nulls(spark):
    t = make_tables(spark, [(1, None, 1, None)], [(1, 10)], [(10, None, 1, 1)])
    got = {r["table_name"]: r["row"] for r in validate.all_previews(t).collect()}
    assert got["orders"].split("|")[1] == "NULL" and got["products"] == "10|NULL|1|1"


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
