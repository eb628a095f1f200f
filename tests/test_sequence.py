"""Sequence: previous row, rank and running sum within a key, with a hot key
spread over many partitions of the sort, against a pandas brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd

from kartlens.functions.sequence import Sequence
from kartlens.sources import bucketed


def test_hot_key_split_across_partitions(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # key 0 holds ~70% of the rows, keys 1-50 share most of the rest, and
    # 200 keys have a single row each
    keys = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 51, n))
    keys[rng.choice(n, 200, replace=False)] = np.arange(1000, 1200)
    pdf = pd.DataFrame(
        {
            "k": keys.astype("int64"),
            "t": rng.integers(0, 500, n).astype("int64"),
            "id": np.arange(n, dtype="int64"),
            "v": rng.integers(-10, 30, n).astype("float64"),
        }
    )
    prev_parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    # keep the 16 range partitions apart (adaptive execution would merge
    # partitions this small into one)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seq = Sequence(spark.createDataFrame(pdf), key="k", order=("t", "id"))
        # the hot key really spans several partitions of the sort
        spans = seq.numbered.where("k = 0").select("_pid").distinct().count()
        got = seq.frame("v", position=True, running="v").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev_parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spans > 1

    exp = pdf.sort_values(["k", "t", "id"]).copy()
    g = exp.groupby("k", sort=False)
    exp["prev_v"] = g["v"].shift(1)
    exp["position"] = g.cumcount() + 1
    exp["running_v"] = g["v"].cumsum()
    got = got.sort_values(["k", "t", "id"]).reset_index(drop=True)
    exp = exp.reset_index(drop=True)
    assert len(got) == n
    pd.testing.assert_series_equal(got["prev_v"], exp["prev_v"], check_names=False)
    assert (got["position"].to_numpy() == exp["position"].to_numpy()).all()
    assert np.allclose(got["running_v"].to_numpy(), exp["running_v"].to_numpy())


def test_sort_partitions_are_bounded_whatever_adaptive_execution_would_merge(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "TASK_ROWS", 250)
    rows = [(i % 3, i // 3, i, 1.0) for i in range(3000)] + [(None, i, 3000 + i, 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v double")
    seq = Sequence(df, key="k", order=("t", "id"))
    sizes = [r["count"] for r in seq.numbered.groupBy("_pid").count().collect()]
    assert seq.n_parts == 13 and len(sizes) == 13 and max(sizes) < 3 * 250
    got = seq.frame("t", position=True, running="v").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["k"] is not None:
            assert (r["prev_t"], r["position"], r["running_v"]) == (r["t"] - 1 if r["t"] else None, r["t"] + 1, r["t"] + 1)
