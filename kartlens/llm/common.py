"""Helpers shared by the operators: scratch tables, word splitting, splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kartlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kartlens-llm/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    the lineage, and every later reader sees the same rows even if an
    executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, docs: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remove_staged(spark: SparkSession) -> None:
    """Delete everything :func:`stage` wrote in this application. Results that
    still read it must have been written or collected before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/kartlens-llm")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder`` modulo 5. A null
    id counts as the text of no characters (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [v if v is not None else b"" for v in values]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int | None = None
) -> DataFrame:
    """``mapInArrow`` for a function of one batch, which gets (and passes on)
    at most ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(batch.num_rows, 1)
            for at in range(0, batch.num_rows, step):
                yield fn(batch.slice(at, step))

    return df.mapInArrow(run, schema)


# Fixed table: bytes that belong to a word of [0-9a-z] and non-ASCII
# characters stay (A-Z in lower case), all others become a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_spaced(text: bytes) -> list[bytes]:
    """Lower-cased words between white space (space, tab to carriage return)."""
    return text.lower().split()


def words_alnum(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_ALNUM).split()
