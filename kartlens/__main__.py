"""Run the reference's flow end to end on a folder of CSV files.

    python -m kartlens --csv DIR --out DIR [--min-support 30] [--pair-support 30] [--baseline 10.09]

(or the same arguments through ``spark-submit``). Steps, in the reference's
script order: partition sizes from the input's bytes (values that the cluster
chose are kept), strict load of the six CSVs into parquet (``<out>/tables``),
the load checks, every analysis step, then the two metric tables and the
dashboard extract (parquet and CSV) - each written under
``<out>/results/<step>`` with overwrite, so a rerun replaces them.
"""

from __future__ import annotations

import argparse
from decimal import Decimal

from pyspark import SparkConf
from pyspark.sql import SparkSession

from kartlens.operators import copurchase, ordersize, repurchase, validate
from kartlens.plans.materialize import run_reference_steps
from kartlens.session import apply_sizing, ensure_checkpoint_dir, folder_bytes, local_session
from kartlens.sources.csv_load import ingest_csv
from kartlens.sources.parquet import write_result


def steps(tables, t: int, pair_t: int, baseline: Decimal | None) -> dict:
    return {
        "table_row_counts": validate.row_counts(tables),
        "key_violations": validate.key_violations(tables),
        "unmatched_references": validate.unmatched_references(tables),
        "global_repurchase_cycle": repurchase.global_repurchase_cycle(tables),
        "repurchase_cycle_by_product": repurchase.repurchase_cycle(tables, "product", t, ordered=False),
        "repurchase_cycle_by_department": repurchase.repurchase_cycle(tables, "department", t, ordered=False),
        "repurchase_lift_by_department": repurchase.repurchase_lift(tables, "department", t, ordered=False),
        "global_order_size": ordersize.global_order_size(tables),
        "order_size_by_product": ordersize.order_size(tables, "product", t, ordered=False),
        "order_size_by_department": ordersize.order_size(tables, "department", t, ordered=False),
        "order_size_lift_by_department": ordersize.order_size_lift_by_lines(tables, "department", t, baseline, ordered=False),
        "copurchase_pairs": copurchase.copurchase_pairs(tables, pair_t, ordered=False),
        "copurchase_share": copurchase.copurchase_share(tables, pair_t, ordered=False),
    }


def main(argv: list[str] | None = None) -> dict[str, str]:
    parser = argparse.ArgumentParser(prog="kartlens", description=__doc__.splitlines()[0])
    parser.add_argument("--csv", required=True, help="folder with orders.csv, order_products__prior.csv, ...")
    parser.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    parser.add_argument("--min-support", type=int, default=30)
    parser.add_argument("--pair-support", type=int, default=30)
    parser.add_argument("--baseline", default=None, help="fixed order-size baseline; default: computed")
    parser.add_argument("--no-train", action="store_true", help="there is no order_products__train.csv")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.getOrCreate() if SparkConf().contains("spark.master") else local_session()
    ensure_checkpoint_dir(spark)
    apply_sizing(spark, folder_bytes(spark, args.csv), spark.sparkContext.defaultParallelism)
    out = args.out.rstrip("/")
    baseline = Decimal(args.baseline) if args.baseline is not None else None
    tables = ingest_csv(spark, args.csv, f"{out}/tables", with_train=not args.no_train)
    written = {}
    for name, df in steps(tables, args.min_support, args.pair_support, baseline).items():
        path = f"{out}/results/{name}"
        write_result(df, path)
        written[name] = path
    written.update(
        run_reference_steps(tables, f"{out}/results", args.min_support, args.min_support, args.pair_support, baseline)
    )
    for name, path in written.items():
        print(f"{name}\t{path}")
    return written


if __name__ == "__main__":
    main()
