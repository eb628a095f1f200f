"""Partition sizing keeps values the cluster chose and fills in the rest."""

from __future__ import annotations

from kartlens.session import SPLIT_BYTES, apply_sizing, sizing_for


def test_sizing_targets_256mb_partitions():
    big = sizing_for(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // SPLIT_BYTES
    small = sizing_for(10 * 2**20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # three waves of tasks


def test_apply_sizing_keeps_chosen_values(spark):
    keys = tuple(sizing_for(1, 1))
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")  # Spark's default
        applied = apply_sizing(spark, 100 * 2**40, 8000)
        assert "spark.sql.shuffle.partitions" not in applied  # the session's own value (4) stays
        assert spark.conf.get("spark.sql.shuffle.partitions") == before["spark.sql.shuffle.partitions"]
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(SPLIT_BYTES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
