"""Rows that repeat an id, or have none, are told apart."""

from __future__ import annotations

from kartlens.llm import simhash, source_mix


def topic(k: int, n: int = 60) -> str:
    """A text that shares no word with another topic's."""
    return " ".join(f"t{k}w{i * (k + 3) % 97}" for i in range(n))


def test_keep_one_tells_rows_apart(spark):
    near = topic(5, 90)
    rows = [
        (1, topic(1)), (1, topic(2)), (1, topic(2)),  # one id, two texts, one of them twice
        (None, topic(3)), (None, topic(3)),  # a group without ids
        (4, topic(4)), (None, topic(4)), (None, topic(4)),  # one with and one without an id
        (6, near), (5, near), (None, topic(7)),
    ]
    want = [(1, topic(1)), (1, topic(2)), (4, topic(4)), (5, near), (None, topic(3)), (None, topic(7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = [tuple(r) for r in simhash.keep_one(df.repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_takes_rows_without_an_id_of_their_own(spark):
    rows = [(None, topic(k), "a") for k in range(40)] + [(7, topic(100 + k), "a") for k in range(40)]
    rows += [(k, topic(200 + k), "b") for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = {(r["source"], r["size"]): r["target"] for r in source_mix.copies(df).collect()}
    runs = []
    for parts in (1, 6):
        got = [tuple(r) for r in source_mix.mixed(df.repartition(parts)).collect()]
        assert len(got) == len(set(got)) and {r[:3] for r in got} <= set(rows)
        for source in "ab":
            words = 60 * sum(r[2] == source for r in got)
            assert abs(words - per[source, 60]) <= 60
        copies = [r[3] for r in got]
        assert max(copies) <= source_mix.MAX_COPIES
        runs.append(sorted(got, key=str))
    assert runs[0] == runs[1]
    assert sum(r[0] is None for r in runs[0]) >= 10 and len({r[1] for r in runs[0] if r[0] == 7}) >= 10
