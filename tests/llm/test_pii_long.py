"""Texts with very many matches, and the array functions behind them."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from kartlens.llm import pii


def test_running_and_bisection_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-9, 30) for _ in range(n)], rng.randrange(-10, 32)) for i, n in enumerate([0, 1, 2, 3, 8, 17, 100])]
    df = spark.createDataFrame(rows, "i int, v array<bigint>, x bigint")
    got = df.select(
        "i",
        pii.running(F.col("v"), lambda a, b: a + b).alias("sums"),
        pii.running(F.col("v"), F.greatest).alias("tops"),
        pii.count_below(F.array_sort("v"), F.col("x")).alias("below"),
    )
    for r in got.collect():
        _, v, x = rows[r["i"]]
        assert r["sums"] == [sum(v[: k + 1]) for k in range(len(v))]
        assert r["tops"] == [max(v[: k + 1]) for k in range(len(v))]
        assert r["below"] == sum(a < x for a in v)


def brute_cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_cuts_and_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 5, 255, 256, 257, 512, 2000])
        text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(n))
        spans = []
        for _ in range(rng.randrange(1, 12) if n else 0):
            start = rng.randrange(n)
            spans.append((start, rng.randrange(start + 1, n + 1), rng.randrange(4)))
        rows.append((i, text, sorted(spans), rng.randrange(-5, n + 5)))
    df = spark.createDataFrame(rows, "i int, text string, s array<struct<start:bigint,end:bigint,kind:int>>, x bigint")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in pii.KINDS])
    got = df.select(
        "i",
        F.when(F.size("s") > 0, pii.cut_out(F.col("text"), F.col("s"), tags)).otherwise(F.col("text")).alias("cut"),
        pii._overlaps(F.col("s"), lambda meets: F.array(meets(F.col("x"), F.col("x") + 4))).alias("meets"),
    )
    for r in got.collect():
        _, text, spans, x = rows[r["i"]]
        assert r["cut"] == brute_cut(text, spans)
        assert r["meets"] == [any(a < x + 4 and x < b for a, b, _ in spans)]


def test_many_matches_take_near_linear_time(spark):
    numbers = " ".join(str(100 + i % 900) + "," * (i % 2) for i in range(400_000))
    mails = " ".join(f"mail ab{i}@ex.com é" for i in range(60_000))
    df = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string").repartition(2)
    began = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df, pii.Model()).collect()}
    assert pii.base_candidates(df).count() > 0
    assert time.monotonic() - began < 90  # half an hour with a pass over all matches for each
    assert got[1] == numbers and got[2] == " ".join(["mail [EMAIL] é"] * 60_000)


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "doc", "spans", "base", "__spans", "__text", "a.b", "n_chars"]
    row = (1, "mail a@b.cd", "d", "s", "b", "x", "y", "z", 11)
    df = spark.createDataFrame([row], names)
    out = pii.redacted(df, pii.Model())
    assert out.columns == names and tuple(out.first()) == (1, "mail [EMAIL]", *row[2:8], 12)
    found = pii.spans(df, pii.Model())
    assert found.columns == [n for n in names if n != "__spans"] + ["__spans"]
    assert [tuple(s) for s in found.first()["__spans"]] == [(0, 5, 11, True)] and found.first()["spans"] == "s"
