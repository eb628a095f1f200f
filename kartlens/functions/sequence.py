"""Previous row, rank and running sum within a key, without one task per key.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task; a customer holding a third of all orders would then be sorted by a
single task. Here the rows are instead sorted globally
(``orderBy`` = range exchange sampled over the data, so a hot key is split
across many tasks), numbered with ``monotonically_increasing_id``, written
once to the checkpoint folder so the numbering is fixed, and every lookup
afterwards is an equi-join on that unique row number, which hashes evenly:

* previous row = row ``gid - 1`` in the same partition, or the last row of
  the previous non-empty partition for a partition's first row; it
  belongs to the same key iff the keys are equal;
* rank within key = global row index - global index of the key's first row + 1;
* running sum within key = global running sum - global sum before the
  key's first row. The global running sum is a window over one range
  partition at a time (balanced by the sort) plus the totals of all
  earlier partitions.
* a key's first row is found within the partition by a window over
  (partition, key); for a partition's first key, which may have started in
  an earlier partition, from the per-partition summary.

The only single-task work is over the per-partition summary (one row per
partition of the sort), whose size is the partition count, not the data.
No exchange is ever keyed by the user's key: rank and running sum use
windows over (sort partition, key) plus that per-partition summary.

Sort partitions, and the parts of every exchange after it, are as many as the
rows call for (``task_count``), so a task's share doesn't grow with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartlens.session import ensure_checkpoint_dir
from kartlens.sources.bucketed import task_count

# monotonically_increasing_id puts the partition index above bit 33.
_ROW_BITS = 33


def _numbered(df: DataFrame, key: str, order: Seq[str], n_parts: int) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    # Fix the numbering by writing it once to the shared checkpoint folder
    # (a single pass, columnar on read; an eager RDD checkpoint would run
    # the sort twice). A retried task (lost executor) writes the same ids:
    # the range bounds are fixed for the exchange and each partition is
    # sorted on unique keys, so its rows and their order are the same.
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kartlens-sequence/{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(n_parts, key, *order).sortWithinPartitions(key, *order)
    dealt.withColumn("_gid", F.monotonically_increasing_id()).write.parquet(path)
    ordered = spark.read.parquet(path).withColumn("_pid", F.shiftright("_gid", _ROW_BITS).cast("int"))
    # One row per non-empty partition of the sort.
    whole = Window.orderBy("_pid")
    parts = (
        ordered.groupBy("_pid")
        .agg(F.min("_gid").alias("_first_gid"), F.count("*").alias("_rows"))
        .withColumn("_prev_last_gid", F.lag(F.col("_first_gid") + F.col("_rows") - 1).over(whole))
        .withColumn("_offset", F.sum("_rows").over(whole.rowsBetween(Window.unboundedPreceding, -1)))
        .fillna(0, subset=["_offset"])
    )
    numbered = ordered.join(F.broadcast(parts), "_pid").withColumn(
        "_idx", F.col("_offset") + F.col("_gid") - F.col("_first_gid")
    )
    return numbered, parts


class Sequence:
    """Rows of ``df`` ordered by ``order`` within ``key``; numbered once.

    Rows must be unique by (key, order). The numbering is written once on
    construction, so every frame built from one ``Sequence`` agrees.
    ``rows`` is about how many there are, counted if not known.
    """

    def __init__(self, df: DataFrame, key: str, order: Seq[str], rows: int | None = None):
        self.columns = list(df.columns)
        self.key = key
        self.n_parts = task_count(df.sparkSession, df.count() if rows is None else rows)
        self.numbered, self.parts = _numbered(df, key, order, self.n_parts)

    def frame(self, carry: str | None = None, *, position: bool = False, running: str | None = None) -> DataFrame:
        """The input rows plus ``prev_<carry>`` (the previous row's value in
        the same key, null for the key's first row), ``position`` (1-based
        rank of the row within its key) and/or ``running_<running>``
        (inclusive running sum of a non-null numeric column within the key)."""
        key = self.key
        out = self.numbered
        extra: list[str] = []
        if position or running is not None:
            out = self._key_starts(out, running)
            if running is not None:
                out = out.withColumn(f"running_{running}", F.col("_global") - F.col("_base"))
                extra.append(f"running_{running}")
            if position:
                out = out.withColumn("position", F.col("_idx") - F.col("_start") + 1)
                extra.append("position")
        if carry is not None:
            out = out.withColumn(
                "_prev_gid",
                F.when(F.col("_gid") == F.col("_first_gid"), F.col("_prev_last_gid")).otherwise(F.col("_gid") - 1),
            )
            prev = self.numbered.select(
                F.col("_gid").alias("_prev_gid"),
                F.col(key).alias("_prev_key"),
                F.col(carry).alias(f"prev_{carry}"),
            )
            out, prev = (side.repartition(self.n_parts, "_prev_gid") for side in (out, prev))
            out = out.join(prev, "_prev_gid", "left").withColumn(
                f"prev_{carry}",
                F.when(F.col("_prev_key") == F.col(key), F.col(f"prev_{carry}")),
            )
            extra.append(f"prev_{carry}")
        return out.select(*self.columns, *extra)

    def _key_starts(self, rows: DataFrame, col: str | None) -> DataFrame:
        """``rows`` plus ``_start`` (global index of the key's first row) and,
        with ``col``, ``_global`` (global inclusive running sum of ``col``)
        and ``_base`` (global sum before the key's first row).

        Within one partition of the sort, windows partitioned by (partition,
        key) give each key's local start; they all run on one exchange on the
        partition id, so a group is at most one (balanced) sort partition.
        Only a partition's first key can have started in an earlier
        partition; its true start and base come from a summary with one row
        per partition: each key run starts at the smallest local start among
        the partitions whose last key it is."""
        key = self.key
        rows = rows.repartitionById(self.n_parts, F.col("_pid"))  # not two in one task
        by_part = Window.partitionBy("_pid")
        if col is not None:
            # Totals of earlier partitions: one row per partition of the sort.
            before = (
                self.numbered.groupBy("_pid")
                .agg(F.sum(col).alias("_part_total"))
                .withColumn(
                    "_before",
                    F.sum("_part_total").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                )
                .fillna(0, subset=["_before"])
                .select("_pid", "_before")
            )
            rows = (
                rows.withColumn(
                    "_local", F.sum(col).over(by_part.orderBy("_gid").rowsBetween(Window.unboundedPreceding, 0))
                )
                .join(F.broadcast(before), "_pid")
                .withColumn("_global", F.col("_before") + F.col("_local"))
            )
        in_key = Window.partitionBy("_pid", key)
        rows = rows.withColumn("_lstart", F.min("_idx").over(in_key))
        agg = [
            F.min_by(key, "_gid").alias("_fk"),
            F.max_by(key, "_gid").alias("_lk"),
            F.max_by("_lstart", "_gid").alias("_lk_start"),
        ]
        if col is not None:
            rows = rows.withColumn("_lbase", F.min_by(F.col("_global") - F.col(col), F.col("_idx")).over(in_key))
            agg.append(F.max_by("_lbase", "_gid").alias("_lk_base"))
        ends = rows.groupBy("_pid").agg(*agg)
        run_aggs = [F.min("_lk_start").alias("_run_start")]
        if col is not None:
            run_aggs.append(F.min_by("_lk_base", "_lk_start").alias("_run_base"))
        runs = ends.groupBy(F.col("_lk").alias("_run_key")).agg(*run_aggs)
        fixes = ends.join(runs, F.col("_fk").eqNullSafe(F.col("_run_key")), "left").select(
            "_pid", "_fk", "_run_start", *(["_run_base"] if col is not None else [])
        )
        rows = rows.join(F.broadcast(fixes), "_pid")
        continues = F.col(key).eqNullSafe(F.col("_fk")) & F.col("_run_start").isNotNull()
        rows = rows.withColumn("_start", F.when(continues, F.least("_run_start", "_lstart")).otherwise(F.col("_lstart")))
        if col is not None:
            earlier = continues & (F.col("_run_start") < F.col("_lstart"))
            rows = rows.withColumn("_base", F.when(earlier, F.col("_run_base")).otherwise(F.col("_lbase")))
        return rows
