"""SimHash near-duplicates against brute force over all pairs."""

from __future__ import annotations

import os
import random

import pytest
import xxhash

from kartlens.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text: str | None, n: int = 3) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps: list[tuple], bits: int = 3) -> dict:
    """fp -> smallest id reachable."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    lowest: dict = {}
    for d, f in fps:
        r = find(f)
        if d is not None:
            lowest[r] = min(d, lowest.get(r, d))
    return {f: lowest.get(find(f)) for f in distinct}


def linked(spark, fps: list[int], bits: int) -> dict[int, int]:
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.roots(df, bits).collect()}
    return {f: roots[s] for f, s in zip(fps, signed, strict=True)}


@pytest.mark.parametrize("bits", [2, 3])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    fps = []
    for _ in range(6):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(12):  # chains: each a few bits from an earlier one
            x = rng.choice(fps[-10:])
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.append(x)
        block = rng.choice([0, 16, 32, 48])  # three bits of one block
        fps.append(base ^ 0b1011 << block)
    fps = sorted(set(fps))
    want = brute_components([(i, f) for i, f in enumerate(fps)], bits)
    got = linked(spark, fps, bits)
    groups = lambda m: sorted(sorted(f for f in fps if m[f] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_corner_rows(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \t\r\n", "y"),
        (4, "Same words here again", None),
        (5, "same WORDS here\nagain", "y"),
        (5, "same WORDS here\nagain", "y"),
        (None, "same words here again", "z"),
        (7, "one", "z"),
        (8, "long " * 200_000, "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(
        ((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str
    )
    fps = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    roots = brute_components(fps)
    assert got == sorted(((d, f, roots[f]) for d, f in fps), key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, 7, 8]


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1_000)], "u long, v long")
    staged = []
    stage = simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: (staged.append(name), stage(df, name))[1])
    found = simhash.components(chain).collect()
    assert len(found) == 1_001 and len({r["root"] for r in found}) == 1
    assert staged.count("moved") <= 15


def test_keep_one_passes_clashing_columns_through(spark):
    names = ["__row", "__hash", "__key", "doc", "row", "hash", "key", "fp", "root", "first", "copy"]
    df = spark.createDataFrame([(1, "a b c d", *names), (2, "a b c d", *names)], ["doc_id", "text", *names])
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(1, "a b c d", *names)]
    assert simhash.keep_one(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs]
    roots = brute_components(fps)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {(d, f"{f:016x}", roots[f]) for d, f in fps}
