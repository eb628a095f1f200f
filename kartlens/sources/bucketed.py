"""Parquet tables bucketed by a key.

Two tables bucketed by the same key into as many buckets join on it, and each
aggregates by it, without an exchange: the one shuffle is paid at load. Spark
keeps buckets in catalog tables only, so a bucketed folder is registered in the
session catalog, as an external table whose name follows from its path; another
session or application declares it again over the same files.

Each bucket is written by one task as one file. That suits keys without hot
values: callers ask ``has_hot_key`` first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kartlens.functions.joins import HOT_ROWS, hot_limit

# Rows of a bucket to aim at (two ids a row: about 128 MB), and Spark's own
# default limit of buckets.
BUCKET_ROWS = 8_000_000
MAX_BUCKETS = 100_000
# Rows of a part that one task sorts, joins with itself or aggregates: pairs and
# order sizes hold up to 1 KB a row.
TASK_ROWS = 500_000
PREFIX = "kartlens_bucketed_"


def bucket_count(spark: SparkSession, rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for a table of ``rows``: about ``bucket_rows`` in each, no fewer
    than the cluster's cores."""
    return max(1, min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // bucket_rows))))


def task_count(spark: SparkSession, rows: int) -> int:
    """Parts of ``rows`` small enough for a task's memory: about ``TASK_ROWS``
    in each, however many rows there are. Asked for by number, so that adaptive
    execution, which knows compressed bytes only, doesn't put them together."""
    return bucket_count(spark, rows, TASK_ROWS)


def has_hot_key(df: DataFrame, key: str, rows: int, hot_rows: int | None = None) -> bool:
    """Whether one key (null too) holds so many of ``df``'s ``rows`` that a
    bucket with it would be a hot one; counted only if the rows allow any."""
    limit = hot_limit(rows, HOT_ROWS if hot_rows is None else hot_rows)
    if rows < limit:
        return False
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (most or 0) >= limit


def _table(path: str) -> str:
    return PREFIX + hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:20]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` files by hash of ``key``, sorted by
    it, and return it as read back."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    writer.saveAsTable(_table(path))
    return spark.table(_table(path))


def read_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """The table with this schema that ``write_bucketed`` wrote to ``path``."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
    return spark.table(name)


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Drop the catalog's entries for bucketed tables at or under ``path``."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    prefix = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(files).toUri().getPath()
    for t in spark.catalog.listTables(pattern=f"{PREFIX}*"):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {t.name}").where("col_name = 'Location'").collect()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows[0]["data_type"]).toUri().getPath() if rows else ""
        if at == prefix or at.startswith(prefix + "/"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
