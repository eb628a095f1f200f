"""Binding of the driver's TPC-H-style tables to the order model.

| model                          | driver table                                  |
| ------------------------------ | --------------------------------------------- |
| orders.order_id, user_id       | orders.o_orderkey, o_custkey                   |
| orders.order_number            | rank of the order in its customer's sequence   |
| orders.days_since_prior_order  | days since the customer's previous order date  |
| prior.order_id, product_id     | lineitem.l_orderkey, l_partkey                 |
| prior.add_to_cart_order        | lineitem.l_linenumber                          |
| prior.reordered                | 1 if the customer bought the part before       |
| products                       | part: p_partkey, p_name, p_brand, p_type       |
| aisles / departments           | distinct p_brand / distinct p_type             |

The customer sequence (previous order, rank) comes from
``functions.sequence``, which splits a customer with a huge order history
over many tasks instead of sorting it in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartlens.functions.joins import HOT_ROWS, bounded_broadcast, hot_key_join
from kartlens.functions.sequence import Sequence
from kartlens.model import Tables
from kartlens.sources.bucketed import has_hot_key, task_count
from kartlens.sources.publish import current, publish


def name_ids(part: DataFrame, name: str, id_name: str) -> DataFrame:
    """(name, id_name): the distinct names numbered from 1 in order. The
    ranking sees one row per name, a dimension's size."""
    names = part.where(F.col(name).isNotNull()).select(name).distinct()
    return names.withColumn(id_name, F.row_number().over(Window.orderBy(name)).cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind_orders(raw_orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders with all seven columns, lean (order_id, days_since_prior_order))."""
    seq = Sequence(
        raw_orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("order_ts"),
        ),
        key="user_id",
        order=("order_ts", "order_id"),
        rows=raw_orders.count(),
    )
    gap = F.datediff(F.to_date("order_ts"), F.to_date("prev_order_ts")).cast("double").alias("days_since_prior_order")
    full = seq.frame("order_ts", position=True).select(
        "order_id",
        "user_id",
        F.lit("prior").alias("eval_set"),
        F.col("position").cast("int").alias("order_number"),
        (F.dayofweek("order_ts") - 1).alias("order_dow"),
        F.hour("order_ts").alias("order_hour_of_day"),
        gap,
    )
    lean = seq.frame("order_ts").select("order_id", gap)
    return full, lean


def bind_prior(lineitem: DataFrame, orders: DataFrame, line_rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Prior line items with ``reordered`` = 1 if the customer had the part
    in an earlier order. Left joins keep every line (an order missing from
    ``orders`` leaves ``reordered`` null, and V4 still sees the line); both
    joins split hot keys off map-side (``hot_key_join``)."""
    items = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("add_to_cart_order"),
    )
    with_user = hot_key_join(
        items, orders.select("order_id", "user_id", "order_number"), "order_id", "left", line_rows, hot_rows
    )
    first = (
        with_user.where(F.col("user_id").isNotNull())
        .groupBy("user_id", "product_id")
        .agg(F.min("order_number").alias("first_number"))
    )
    return hot_key_join(with_user, first, ["user_id", "product_id"], "left", line_rows, hot_rows).select(
        "order_id",
        "product_id",
        "add_to_cart_order",
        (F.col("order_number") > F.col("first_number")).cast("int").alias("reordered"),
    )


def bind_lines(lineitem: DataFrame) -> DataFrame:
    """(order_id, product_id): the projection every analysis step reads."""
    return lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))


def bind_catalog(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, aisles, departments) from the part table."""
    aisles = name_ids(part, "p_brand", "aisle_id")
    departments = name_ids(part, "p_type", "department_id")
    products = (
        part.join(bounded_broadcast(aisles, aisles.count()), "p_brand", "left")
        .join(bounded_broadcast(departments, departments.count()), "p_type", "left")
        .select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), "aisle_id", "department_id"
        )
    )
    aisles = aisles.select("aisle_id", F.col("p_brand").alias("aisle"))
    departments = departments.select("department_id", F.col("p_type").alias("department"))
    return products, aisles, departments


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """All six tables, lazily (the customer sequence is numbered on call)."""
    orders, order_gaps = bind_orders(_read(spark, sf_dir, "orders"))
    lineitem = _read(spark, sf_dir, "lineitem")
    products, aisles, departments = bind_catalog(_read(spark, sf_dir, "part"))
    return Tables(
        orders=orders,
        prior=bind_prior(lineitem, orders, lineitem.count()),
        products=products,
        aisles=aisles,
        departments=departments,
        prior_lines=bind_lines(lineitem),
        order_gaps=order_gaps,
    )


def _spread(df: DataFrame, files: int) -> DataFrame:
    """Round-robin a source stored in fewer files than the session's
    parallelism (a single parquet file with one row group is read by one
    task); a source already in many files is written as it is read."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallelism) if files < parallelism else df


STORED = ("orders", "products", "aisles", "departments", "lines")
# Bucketed by order_id where no order is hot: they meet on it in Q2-Q10.
BY_ORDER = ("orders", "lines")


def ingest(spark: SparkSession, sf_dir: str, root: str) -> Tables:
    """Bind once and publish what is derived as a version of ``root``: orders
    (with the customer sequence), the catalog tables and the two line-item
    columns the analysis reads. Orders and lines are bucketed by order_id, so
    that their join and everything aggregated by order needs no exchange; an
    order too large for a bucket leaves both in plain folders. The prior
    table's ``reordered`` is derived from the driver's line items and the
    stored orders when asked for (only the preview reads it)."""
    orders, _ = bind_orders(_read(spark, sf_dir, "orders"))
    products, aisles, departments = bind_catalog(_read(spark, sf_dir, "part"))
    lineitem = _read(spark, sf_dir, "lineitem")
    lines = bind_lines(lineitem)
    rows = lines.count()
    hot = has_hot_key(lines, "order_id", rows)
    if hot:
        lines = _spread(lines, len(lineitem.inputFiles()))
    frames = {"orders": orders, "products": products, "aisles": aisles, "departments": departments, "lines": lines}
    layout = ("order_id", task_count(spark, rows))
    publish(spark, root, frames, {} if hot else dict.fromkeys(BY_ORDER, layout))
    return read_ingested(spark, sf_dir, root)


def read_ingested(spark: SparkSession, sf_dir: str, root: str) -> Tables:
    """The tables published by ``ingest``, scanned in ``spark``."""
    version = current(spark, root)
    stored = {name: version.read(spark, name) for name in STORED}
    lineitem = _read(spark, sf_dir, "lineitem")
    line_rows = stored["lines"].count()
    tables = Tables(
        orders=stored["orders"],
        prior=bind_prior(lineitem, stored["orders"], line_rows),
        products=stored["products"],
        aisles=stored["aisles"],
        departments=stored["departments"],
        prior_lines=stored["lines"],
    )
    tables._counts["lines"] = line_rows
    return tables
