"""Clashing column names in every stage, and an id that many rows repeat."""

from __future__ import annotations

from kartlens.llm import decontaminate, pii, simhash, source_mix, toxicity

NAMES = ["doc_id", "text", "source", "n_chars", "__score", "__spans", "__text", "__row", "__items", "copy", "doc", "row", "hash", "a.b"]


def rows(spark):
    made = [(i, f"kind word {i} of number {i * 7}", "s", 0, *[f"{n}{i}" for n in NAMES[4:]]) for i in range(20)]
    return spark.createDataFrame(made, NAMES)


def model(spark, extra=()):
    texts = [(i, "vile insult" if i % 3 == 0 else "kind word") for i in range(300)] + list(extra)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, label int")
    return toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)


def test_stages_pass_clashing_columns_through(spark):
    docs = rows(spark)
    bench = spark.createDataFrame([("a", "kind word 3 of number 21")], "item_id string, text string")
    want = {tuple(r) for r in docs.collect()}
    kept = toxicity.reject_toxic(docs, model(spark))
    assert kept.columns == NAMES and {tuple(r) for r in kept.collect()} == want
    assert simhash.keep_one(docs, ngram=3, max_bits=2).columns == NAMES
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == NAMES and {tuple(r) for r in clean.collect()} == {r for r in want if r[0] != 3}
    assert decontaminate.matches(docs, bench).columns.count("__spans") == 1
    redacted = pii.redacted(docs, pii.Model())
    assert redacted.columns == NAMES and {r[4:] for r in map(tuple, redacted.collect())} == {r[4:] for r in want}
    mixed = source_mix.mixed(docs)
    assert mixed.columns == [n for n in NAMES if n != "copy"] + ["copy"]
    assert {(r["doc_id"], r["__row"], r["copy"]) for r in mixed.collect()} == {(i, f"__row{i}", 1) for i in range(20)}


def test_a_repeated_labelled_id_trains_once(spark):
    """A third of all rows repeat a labelled id; the model reads one of them."""
    copies = [(0, "vile insult")] * 5_000
    assert sorted(map(tuple, model(spark, copies).collect())) == sorted(map(tuple, model(spark).collect()))
