"""Materialize the product metric tables, then build the extract from them.

The reference creates ``repurchase_lift_results`` (step 5d) and
``order_lift_results`` (step 6d) as tables and its export reads them
back. Here they are stored once for each set of parameters they depend on
(``stored.py``) and scanned back; the export and the dashboard data read those
scans instead of recomputing both metric sets. ``run_reference_steps``
publishes them with the extract as one version of an output folder.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartlens.model import Tables
from kartlens.operators.export import behavior_export
from kartlens.operators.ordersize import order_size_lift
from kartlens.operators.repurchase import repurchase_lift
from kartlens.plans import stored
from kartlens.sources import publish
from kartlens.sources.csv_load import ingest_csv
from kartlens.sources.parquet import read_result, write_result
from kartlens.sources.schemas import TABLES

REPURCHASE_TABLE = "repurchase_lift_results"
ORDER_SIZE_TABLE = "order_lift_results"
EXPORT_TABLE = "product_behavior_export"
CSV_TABLE = f"{EXPORT_TABLE}_csv"

Baseline = Decimal | float | str | None


def repurchase_table(tables: Tables, min_events: int = 30) -> DataFrame:
    """The Q4 table (S4): no baseline of order sizes is in it."""

    def build() -> DataFrame:
        return repurchase_lift(
            tables,
            "product",
            min_events,
            ordered=False,
            per_product=stored.cycles(tables),
            base=stored.baseline(tables, "global_cycle"),
        )

    return stored.stored(tables, f"{REPURCHASE_TABLE}-{min_events}", build)


def order_size_table(tables: Tables, min_orders: int = 30, baseline: Baseline = None) -> DataFrame:
    """The Q9 table."""

    def build() -> DataFrame:
        base = stored.baseline(tables, "global_size") if baseline is None else baseline
        return order_size_lift(tables, "product", min_orders, base, ordered=False, per_product=stored.sizes(tables))

    return stored.stored(tables, f"{ORDER_SIZE_TABLE}-{min_orders}-{baseline}", build)


def product_metrics(
    tables: Tables, min_events: int = 30, min_orders: int = 30, baseline: Baseline = None
) -> tuple[DataFrame, DataFrame]:
    """(Q4 table, Q9 table): written once per ``Tables`` and parameters, then scanned."""
    return repurchase_table(tables, min_events), order_size_table(tables, min_orders, baseline)


def export_from_tables(
    tables: Tables,
    min_events: int = 30,
    min_orders: int = 30,
    min_pairs: int = 30,
    baseline: Baseline = None,
    ordered: bool = True,
) -> DataFrame:
    """Q13 over the stored Q4, Q9 and pair tables."""
    rep, size = product_metrics(tables, min_events, min_orders, baseline)
    return behavior_export(
        tables,
        min_events,
        min_orders,
        min_pairs,
        baseline,
        ordered,
        repurchase=rep,
        order_size=size,
        pairs=stored.pairs(tables, min_pairs),
    )


def run_reference_steps(
    tables: Tables,
    out_root: str,
    min_events: int = 30,
    min_orders: int = 30,
    min_pairs: int = 30,
    baseline: Baseline = None,
    csv: bool = True,
) -> dict[str, str]:
    """Steps 5d, 6d and the export end to end: publishes the two metric tables
    and the extract (parquet, plus a CSV with header for the dashboard import)
    as a new version of ``out_root`` (``publish.py``); returns the paths written.
    A reader of the version before is not disturbed, and a run that dies
    leaves it current."""
    root, spark = out_root.rstrip("/"), tables.orders.sparkSession
    rep, size = product_metrics(tables, min_events, min_orders, baseline)
    frames = {
        REPURCHASE_TABLE: rep,
        ORDER_SIZE_TABLE: size,
        EXPORT_TABLE: export_from_tables(tables, min_events, min_orders, min_pairs, baseline, ordered=False),
    }
    made = publish.begin(root)
    entries = {name: publish.write(made, name, df) for name, df in frames.items()}
    if csv:
        # A sorted CSV folder for the dashboard tool; the sort is the output's
        # presentation, done once on the small final result.
        sorted_extract = read_result(spark, made.path(EXPORT_TABLE)).orderBy(
            "percent_anchor_orders", "anchor_id", "co_product_id", ascending=[False, True, True]
        )
        write_result(sorted_extract, made.path(CSV_TABLE), fmt="csv")
    names = [*frames, *([CSV_TABLE] if csv else [])]
    made = publish.switch(spark, made, entries)
    return {name: made.path(name) for name in names}


def published_extract(tables: Tables, min_events: int = 30, min_orders: int = 30, min_pairs: int = 30) -> DataFrame:
    """S7 end to end: the steps published, and the extract read back from its
    CSV files with the types it had."""
    root, spark = f"{stored.work_root(tables)}/published", tables.orders.sparkSession
    paths = run_reference_steps(tables, root, min_events, min_orders, min_pairs)
    schema = read_result(spark, paths[EXPORT_TABLE]).schema
    return spark.read.schema(schema).options(header=True, escape='"', enforceSchema=False).csv(paths[CSV_TABLE])


def csv_round_trip(tables: Tables) -> DataFrame:
    """S1, S2, V5 end to end: the tables written as CSV folders, loaded by the
    all-or-nothing load, and profiled: (table_name, column_name, filled,
    checksum) with the sum of a column's numbers (text: of its lengths) over the
    non-null values."""
    root, spark = f"{stored.work_root(tables)}/csv", tables.orders.sparkSession
    names = [n for n in TABLES if tables.table(n) is not None]
    for name in names:
        schema = TABLES[name][0]
        df = tables.table(name).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        write_result(df, f"{root}/in/{name}.csv", fmt="csv")
    loaded = ingest_csv(spark, f"{root}/in", f"{root}/loaded", with_train="order_products__train" in names)
    parts = []
    for name in names:
        df = loaded.table(name)
        aggs, stack = [], []
        for f in TABLES[name][0].fields:
            value = F.length(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
            aggs += [F.count(f.name).alias(f"n_{f.name}"), F.sum(value.cast("double")).cast("long").alias(f"s_{f.name}")]
            stack.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"n_{f.name}").alias("filled"), F.col(f"s_{f.name}").alias("checksum")))
        parts.append(df.agg(*aggs).select(F.lit(name).alias("table_name"), F.inline(F.array(*stack))))
    return reduce(DataFrame.unionByName, parts)
