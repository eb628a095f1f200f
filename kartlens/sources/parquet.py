"""The tables as parquet folders.

``write_tables`` stores a ``Tables`` as one parquet folder per table
(``<root>/<table name>``); ``read_tables`` scans them, or the current version
of a published load (``publish.py``), with the S1 column names, so every query gets column pruning and filter pushdown at
the scan. ``write_result`` / ``read_result`` persist a metric table (the
reference's create-table-as steps) idempotently: overwrite, never append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kartlens.model import Tables
from kartlens.sources.publish import current
from kartlens.sources.schemas import TABLES


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_tables(tables: Tables, root: str) -> None:
    for name in TABLES:
        df = tables.table(name)
        if df is not None:
            df.write.mode("overwrite").parquet(_path(root, name))


def read_tables(spark: SparkSession, root: str, with_train: bool = False) -> Tables:
    version = current(spark, root)  # of a published load; a plain folder has none

    def read(name: str) -> DataFrame:
        return spark.read.parquet(_path(root, name)) if version is None else version.read(spark, name)

    return Tables(
        orders=read("orders"),
        prior=read("order_products__prior"),
        products=read("products"),
        aisles=read("aisles"),
        departments=read("departments"),
        train=read("order_products__train") if with_train else None,
    )


def write_result(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    """Materialize a result (S4, S5, S7): a folder of CSV files, each with a
    header row and quotes doubled as CSV readers expect, for the dashboard
    import; parquet otherwise."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", header).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Scan a materialized result."""
    return spark.read.parquet(path)
