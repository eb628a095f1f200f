"""Intermediates written once for a ``Tables`` and read by many queries.

| table | from | read by |
| --- | --- | --- |
| ``cycle_moments``, ``size_moments`` | one pass over line items each | Q2-Q5, Q7-Q10, their aisle forms |
| ``baselines`` | Q1, Q6, orders with lines | Q4, Q5, Q9, Q10, D4 |
| ``baskets``, ``support`` | line items by (order, product) | the pair table, at any threshold |
| ``pairs`` | baskets, at the lowest threshold asked for | Q11-Q13, X3, D5 |

They lie under the application's scratch folder in the checkpoint folder
(``publish.drop_scratch`` removes those of dead runs) and are immutable: a table
is written under a name of its own the first time that it is asked for.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartlens.functions.rounding import mean2
from kartlens.model import Tables
from kartlens.operators import pairtable
from kartlens.operators.ordersize import order_sizes, size_moments
from kartlens.operators.repurchase import cycle_moments, global_cycle
from kartlens.session import ensure_checkpoint_dir
from kartlens.sources.bucketed import has_hot_key, task_count, write_bucketed

# Reentrant: a stored table is built from stored tables.
_lock = threading.RLock()


def work_root(tables: Tables) -> str:
    """The scratch folder of these tables in this application."""
    spark = tables.orders.sparkSession
    own = tables._counts.setdefault("uid", uuid.uuid4().hex[:12])
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kartlens-results/{spark.sparkContext.applicationId}/{own}"


def stored(tables: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, written the first time that ``name`` is asked for."""
    with _lock:
        if name not in tables._stored:
            tables._stored[name] = _written(tables, name, build())
        return tables._stored[name]


def _written(tables: Tables, name: str, df: DataFrame) -> DataFrame:
    path = f"{work_root(tables)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cycles(tables: Tables) -> DataFrame:
    return stored(tables, "cycle_moments", lambda: cycle_moments(tables))


def sizes(tables: Tables) -> DataFrame:
    return stored(tables, "size_moments", lambda: size_moments(tables))


def _baselines(tables: Tables) -> DataFrame:
    sized = order_sizes(tables).agg(
        mean2(F.col("order_size")).alias("global_size"), F.count("order_id").alias("orders_with_lines")
    )
    return sized.select(global_cycle(tables).alias("global_cycle"), "global_size", "orders_with_lines")


def baseline(tables: Tables, name: str) -> Column:
    """``global_cycle``, ``global_size`` or ``orders_with_lines`` as a scalar."""
    return stored(tables, "baselines", lambda: _baselines(tables)).select(name).scalar()


def baskets(tables: Tables) -> DataFrame:
    """``pairtable.reaching`` at product level, bucketed by order_id (plainly
    partitioned by it where an order is too large for a bucket; an order has at
    most a row for each product)."""

    def build() -> DataFrame:
        rows, spark = tables.line_rows(), tables.orders.sparkSession
        made = pairtable.reaching(tables)
        if has_hot_key(made, "order_id", min(rows, tables.catalog_rows())):
            return _written(tables, "baskets", made).repartition("order_id")
        return write_bucketed(made, f"{work_root(tables)}/baskets", "order_id", task_count(spark, rows))

    with _lock:
        if "baskets" not in tables._stored:
            tables._stored["baskets"] = build()
        return tables._stored["baskets"]


def pairs(tables: Tables, min_pairs: int) -> DataFrame:
    """The pair table at ``min_pairs`` or a lower threshold already stored."""
    with _lock:
        found = tables._stored.setdefault("pairs", {})
        if able := [t for t in found if t <= min_pairs]:
            return found[max(able)]
        name = f"pairs-{min_pairs}"
        parts = iter(range(1 << 30))
        rows = baskets(tables)
        items = stored(tables, "support", lambda: pairtable.support(rows))
        made = pairtable.pair_table(
            rows, items, min_pairs, tables.catalog_rows(), lambda df: _written(tables, f"{name}-{next(parts)}", df)
        )
        found[min_pairs] = _written(tables, name, made)
        return found[min_pairs]
