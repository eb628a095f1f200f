"""The Merkle manifest against a plain tree, its proofs and its corner rows."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kartlens.llm import merkle, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """(root, each node's siblings in order)."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % 16
            proofs[i] += [nodes[q] for q in range(run, min(run + 16, len(nodes))) if q != p]
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], proofs


def brute(rows: list[tuple]) -> dict[tuple, tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    tops, own = [], {}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        rows = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, proofs = tree([leaf(r) for r in rows])
        tops.append(top)
        own[g] = list(zip(rows, proofs, strict=True))
    root, last = tree(tops)
    out = []
    for g, top, more in zip(order, tops, last, strict=True):
        out += [(r[0], g, leaf(r), top, root, sha("".join(p + more))) for r, p in own[g]]
    return sorted(out, key=str)


def rows_of(n: int, source: str | None) -> list[tuple]:
    return [(i * 7 % 9_973, source, "en", i, f"täxt {source} {i}") for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, carry string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA)


def found(df):
    out = df.withColumn("all", merkle.siblings_hash(F.col("proof"))).withColumn("fold", merkle.folded(F.col("leaf"), F.col("proof")))
    rows = out.collect()
    assert all(r["fold"] == r["root"] for r in rows)
    return sorted(((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], r["all"]) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273, 4_097])
def test_manifest_equals_a_plain_tree(spark, n):
    rows = rows_of(n, "big") + rows_of(3, "small") + rows_of(1, None) + rows_of(1, "lone")
    assert found(merkle.manifest(made(spark, rows))) == brute(rows)


def test_many_groups_take_levels_of_their_own(spark):
    rows = [(i, f"s{i}", None, None, None) for i in range(300)]
    assert found(merkle.manifest(made(spark, rows))) == brute(rows)


def test_corner_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, None, None, None, None),
        (None, "a", "x", 1, ""),
        (5, "a", "x", 1, "same"),
        (5, "a", "x", 1, "same"),
        (5, "a", "x", 1, "other"),
        (6, "", "-", -3, "wörd " * 40_000),
        (7, "ä", "", 0, "\U0001f600"),
    ]
    assert found(merkle.manifest(made(spark, rows))) == brute(rows)
    assert found(merkle.manifest(made(spark, rows[:1]))) == brute(rows[:1])
    assert merkle.manifest(made(spark, [])).count() == 0


def test_carried_columns_and_their_names(spark):
    docs = made(spark, rows_of(20, "a"))
    out = merkle.manifest(docs, carry={"node": F.upper("text"), "g": F.col("carry")})
    assert {(r["doc_id"], r["node"], r["g"]) for r in out.collect()} == {(r[0], r[4].upper(), "c") for r in rows_of(20, "a")}
    with pytest.raises(ValueError):
        merkle.manifest(docs, carry={"leaf": F.lit(1)})


def test_repeated_rows_fall_into_several_ranges(spark):
    rows = [(1, "a", "x", 1, "same")] * 700 + [(2, "a", "x", 1, "other")]
    assert found(merkle.manifest(made(spark, rows))) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.sql(queries.OP11_SQL).fetchall()
    rows = queries.op11_merkle(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert {r["verified"] for r in rows} == {True, False}
