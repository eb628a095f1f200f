"""Ranked search against scoring every document, and its corner rows."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import pytest

from kartlens.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 50 + (50 * len(bag) * n_docs) // n_words if bag else 0
            score = 0
            for t in set(terms(text)):
                if tf := bag.count(t):
                    df = sum(t in b for _, b in bags)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, sketch string, score int").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id string, text string, query string")
    rows = ranked_search.search(d, q, k=k, **more).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, rows), key=str)


def random_tables(seed: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Ünï", "x1", "THE", "the"]

    def text(n):
        return " ".join(rng.choice(words[: rng.choice((5, 84))]) for _ in range(n))

    docs = [(i, text(rng.choice((0, 1, 5, 60)))) for i in range(120)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]  # ties
    return docs, [(f"q{i}", text(rng.choice((1, 3, 12)))) for i in range(25)]


@pytest.mark.parametrize("slots,chunk", [(1024, 512), (8, 7), (1, 1)])
def test_search_equals_scoring_all(spark, slots, chunk):
    docs, items = random_tables(slots)
    assert found(spark, docs, items, 10, slots=slots, chunk=chunk) == brute(docs, items, 10)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    docs, items = random_tables(3)
    monkeypatch.setattr(ranked_search, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 60)
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_corner_rows(spark):
    docs = [
        (1, None),
        (2, ""),
        (3, " \n.,"),
        (4, "apple pear"),
        (4, "apple pear"),
        (4, "apple fig fig"),
        (None, "apple pear"),
        (None, None),
        (9, "fig " * 50_000 + "pear"),
    ]
    items = [("a", "Apple PEAR pear"), ("a", "fig"), (None, "pear"), ("b", None), ("c", "..."), ("d", "absent")]
    assert found(spark, docs, items, 50) == brute(docs, items, 50)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)
    assert found(spark, [], items, 50) == []
    assert found(spark, docs[:3], items, 50) == []
    assert found(spark, docs, [], 50) == []


def test_few_documents_are_scored(spark, monkeypatch):
    """The bound leaves most documents unscored where impacts differ."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"v{rng.randrange(3_000)}" for _ in range(30)) + " common" * (1 + i % 3)) for i in range(2_000)]
    block = [(0, ["common", "v1", "v2"])]
    bags = [terms(t) for _, t in docs]
    dfs = {t: sum(t in b for b in bags) for t in block[0][1]}
    best = ranked_search.Best(ranked_search.Weights(block, dfs, len(docs), sum(map(len, bags))), 5)
    entered = []
    enter = best.enter
    monkeypatch.setattr(best, "enter", lambda *a: (entered.append(a), enter(*a)))
    indexed = ranked_search.index(spark.createDataFrame(docs, "doc_id long, text string"))
    for batch in indexed.toArrow().to_batches():
        best.add(batch)
    assert len(entered) < 200 and len(best.top[0]) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = duck.sql(queries.OP12_SQL).fetchall()
    assert sorted(map(tuple, queries.op12_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect())) == sorted(want)
