"""Load checks: row counts, previews, key and reference checks.

The reference only counts and previews. Keys are declared but a Spark
table does not enforce them, and the analysis uses inner joins that drop
orphans silently, so both are reported as counts (one row per key or
reference, never empty).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlens.functions.joins import HOT_ROWS, bounded_broadcast, hot_key_join
from kartlens.model import Tables
from kartlens.sources.schemas import REFERENCES, TABLES

PREVIEW_ROWS = 10


def _present(tables: Tables) -> list[str]:
    return [name for name in TABLES if tables.table(name) is not None]


def _columns(tables: Tables, name: str, cols: tuple[str, ...]) -> DataFrame:
    """Table ``name`` for a check that reads only ``cols``: the prior line
    items come from the lean ``lines`` projection when it covers them."""
    if name == "order_products__prior" and set(cols) <= {"order_id", "product_id"}:
        return tables.lines
    return tables.table(name)


def row_counts(tables: Tables) -> DataFrame:
    """V1: (table_name, row_count) per loaded table."""
    parts = [
        _columns(tables, name, ())
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name in _present(tables)
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(tables: Tables, name: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """V2: the first ``rows`` rows of a table in key order (the reference's
    unordered ``LIMIT 10`` made deterministic). The limit is the feature."""
    df = tables.table(name)
    if df is None:
        raise ValueError(f"table {name!r} is not loaded")
    key = TABLES[name][1] or tuple(df.columns)
    return df.orderBy(*key, *[c for c in df.columns if c not in key]).limit(rows)


def all_previews(tables: Tables, rows: int = PREVIEW_ROWS) -> DataFrame:
    """V2 for every loaded table in one frame: (table_name, position, row),
    the row's values as text joined by ``|``, nulls as ``NULL``."""
    parts = []
    for name in _present(tables):
        df = preview(tables, name, rows)
        key = TABLES[name][1] or tuple(df.columns)
        # a global ranking window, over the at most ``rows`` rows of one preview
        rank = F.row_number().over(Window.orderBy(*key, *[c for c in df.columns if c not in key]))
        parts.append(
            df.select(
                F.lit(name).alias("table_name"),
                rank.alias("position"),
                F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns]).alias("row"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def key_violations(tables: Tables) -> DataFrame:
    """V3: per declared primary key, the number of key values held by more
    than one row and the number of rows with a null key."""
    parts = []
    for name in _present(tables):
        key = TABLES[name][1]
        if not key:
            continue
        df = tables.table(name)
        null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(
                F.count(F.when(~null_key & (F.col("n") > 1), 1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
            ).select(
                F.lit(name).alias("table_name"),
                F.lit(",".join(key)).alias("key_columns"),
                "duplicate_keys",
                "null_keys",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def unmatched_references(tables: Tables) -> DataFrame:
    """V4: per reference, child rows whose non-null value has no parent row
    (the rows the analysis's inner joins drop)."""
    small = {"products", "aisles", "departments"}
    parts = []
    for child, ccol, parent, pcol in REFERENCES:
        cdf, pdf = _columns(tables, child, (ccol,)), tables.table(parent)
        if cdf is None or pdf is None:
            continue
        keys = pdf.select(F.col(pcol).alias("_ref")).where(F.col("_ref").isNotNull())
        refs = cdf.select(F.col(ccol).alias("_ref")).where(F.col("_ref").isNotNull())
        if parent in small:
            orphans = refs.join(bounded_broadcast(keys, tables.rows(parent)), "_ref", "left_anti")
        elif child == "order_products__prior":
            # line items -> orders: a hot order must not land on one reducer
            orphans = hot_key_join(refs, keys, "_ref", "left_anti", tables.line_rows(), HOT_ROWS)
        else:
            orphans = refs.join(keys, "_ref", "left_anti")
        parts.append(
            orphans.agg(F.count(F.lit(1)).alias("unmatched_rows")).select(
                F.lit(child).alias("child_table"),
                F.lit(ccol).alias("child_column"),
                F.lit(parent).alias("parent_table"),
                "unmatched_rows",
            )
        )
    return reduce(DataFrame.unionByName, parts)
