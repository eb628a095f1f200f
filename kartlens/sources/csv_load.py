"""Bulk load of the six CSV files into parquet.

The source files are comma-separated, UTF-8, with a header row and ``"``
as quote. The reader settings reproduce a strict SQL bulk load:

* ``escape='"'``: a doubled quote inside a quoted field is one quote;
* ``nullValue='\\N'``: a bare empty field is NULL while a quoted empty
  field ``""`` stays an empty string;
* ``mode='FAILFAST'``: a non-numeric id or a short row aborts the load
  instead of silently becoming NULLs;
* ``enforceSchema=False``: the header names are checked against the
  declared schema, by position.

``ingest_csv`` loads all six files or none: it reads the same way, but as text
that is checked and cast record by record, so that it can report every rejected
record with its file and reason before anything is published.

``multiLine`` (newlines inside quoted fields) makes a file unsplittable,
so it is only used for the text dimension files; the large numeric files
(orders, line items) are read split across tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartlens.model import Tables
from kartlens.session import folder_bytes
from kartlens.sources import publish
from kartlens.sources.bucketed import has_hot_key, task_count
from kartlens.sources.parquet import read_tables
from kartlens.sources.schemas import TABLES

TEXT_TABLES = frozenset({"products", "aisles", "departments"})

OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "nullValue": "\\N",
    "mode": "FAILFAST",
    "enforceSchema": "false",
}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One reference table from CSV with its declared schema."""
    schema, _ = TABLES[table]
    reader = spark.read.schema(schema).options(**OPTIONS)
    if table in TEXT_TABLES:
        reader = reader.option("multiLine", "true")
    return reader.csv(path)


def load_csv_folder(spark: SparkSession, folder: str, with_train: bool = True) -> Tables:
    """The six tables from ``<folder>/<table>.csv`` (train optional)."""
    base = folder.rstrip("/")

    def read(name: str) -> DataFrame:
        return read_csv(spark, f"{base}/{name}.csv", name)

    return Tables(
        orders=read("orders"),
        prior=read("order_products__prior"),
        products=read("products"),
        aisles=read("aisles"),
        departments=read("departments"),
        train=read("order_products__train") if with_train else None,
    )


class LoadRejected(Exception):
    """A load that published nothing. ``counts`` has each table's rejected
    records, ``report`` the path of the report (file, record, reason)."""

    def __init__(self, counts: dict[str, int], report: str):
        self.counts, self.report = counts, report
        told = ", ".join(f"{name}: {n}" for name, n in counts.items())
        super().__init__(f"rejected records, nothing was loaded ({told}); see {report}")


REASONS = "_reasons"
CORRUPT = "_corrupt_record"
FILE = "_file"


def checked_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table's records with their declared types and ``_reasons``, an array
    of what is wrong with each (empty: nothing), ``_file`` and the record's
    text as ``_record``. Fields are read as text and cast here, so that a wrong one is named
    instead of ending the read. A header with other names still ends it."""
    schema, keys = TABLES[table]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    options = OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    reader = spark.read.schema(text).options(**options)
    if table in TEXT_TABLES:
        reader = reader.option("multiLine", "true")
    raw = reader.csv(path).select("*", F.col("_metadata.file_path").alias(FILE))
    short = F.col(CORRUPT).isNotNull()
    reasons = [F.when(short, F.lit(f"not {len(schema.fields)} fields"))]
    typed = []
    for f in schema.fields:
        value = F.col(f.name).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        reasons.append(F.when(~short & F.col(f.name).isNotNull() & value.isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}")))
        if f.name in keys:
            reasons.append(F.when(~short & F.col(f.name).isNull(), F.lit(f"{f.name} is null")))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[f.name for f in schema.fields])))
    return raw.select(
        *typed, F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias(REASONS), FILE, record.alias("_record")
    )


def repeated_keys(df: DataFrame, table: str) -> DataFrame | None:
    """The keys that more than one of ``df``'s rows have, as the declared
    primary key forbids; None for a table without one."""
    _, keys = TABLES[table]
    if not keys:
        return None
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)


def _layout(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """Buckets by order_id for orders and prior lines; None where an order has
    too many lines for a bucket. A line takes 8 bytes of CSV at least."""
    path = f"{folder}/order_products__prior.csv"
    most_rows = folder_bytes(spark, path) // 8
    lines = checked_csv(spark, path, "order_products__prior").select("order_id")
    if has_hot_key(lines, "order_id", most_rows):
        return None
    return "order_id", task_count(spark, most_rows // 2)


def ingest_csv(spark: SparkSession, folder: str, out_root: str, with_train: bool = True) -> Tables:
    """All tables or none. Every file is checked while it is written to a
    new version of ``out_root``; only if no record of any file is rejected does
    the version become the current one (``publish.py``). Otherwise all files are
    read once more for the report of rejected records in
    ``<out_root>/_rejects/<version>``, what was written goes, the version before
    stays, and LoadRejected is raised. Where the report is empty, the failure
    was another and is raised as it came.

    Rejected are records with another number of fields, fields that are not of
    the declared type, and null or repeated primary keys. Orders and prior
    lines are bucketed by order_id. Returns the tables scanned from the
    published version."""
    base = folder.rstrip("/")
    names = [n for n in TABLES if with_train or n != "order_products__train"]
    layout = _layout(spark, base)
    buckets = dict.fromkeys(("orders", "order_products__prior"), layout) if layout else {}
    made = publish.begin(out_root)
    try:
        try:
            tables = {
                n: publish.write(made, n, _accepted(checked_csv(spark, f"{base}/{n}.csv", n), n), buckets.get(n)) for n in names
            }
            twice = [repeated_keys(spark.read.schema(TABLES[n][0]).parquet(made.path(n)), n) for n in names]
            failed = None if all(t is None or t.isEmpty() for t in twice) else LoadRejected({}, "")
        except Exception as e:  # a rejected record, or something else that ends a job
            failed = e
        if failed is not None:
            report = f"{out_root.rstrip('/')}/_rejects/{made.name}"
            counts = _report(spark, base, names, report)
            if not counts:
                raise failed
            raise LoadRejected(counts, report) from failed
    except BaseException:
        publish.discard(spark, made)
        raise
    publish.switch(spark, made, tables)
    return read_tables(spark, out_root, with_train=with_train)


def _accepted(records: DataFrame, table: str) -> DataFrame:
    """The records' fields; the first rejected record ends the job, so that good
    files are read once."""
    fine = F.when(F.size(REASONS) == 0, True).otherwise(F.raise_error(F.array_join(REASONS, "; ")).cast("boolean"))
    return records.where(fine).select(*TABLES[table][0].names)


def _report(spark: SparkSession, base: str, names: list[str], path: str) -> dict[str, int]:
    """Write (table, file, record, reason) for every fault of every file;
    faults by table."""
    parts = []
    for name in names:
        records = checked_csv(spark, f"{base}/{name}.csv", name)
        keys = list(TABLES[name][1])
        if keys:
            twice = repeated_keys(records, name).withColumn("_twice", F.lit(True))
            again = F.when(F.col("_twice"), F.array(F.lit(f"{', '.join(keys)} is repeated"))).otherwise(F.array().cast("array<string>"))
            records = records.join(twice, keys, "left").withColumn(REASONS, F.concat(REASONS, again))
        parts.append(
            records.select(
                F.lit(name).alias("table"), F.col(FILE).alias("file"), F.col("_record").alias("record"), F.explode(REASONS).alias("reason")
            )
        )
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    found = spark.read.parquet(path).groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["table"]: r["n"] for r in found}
