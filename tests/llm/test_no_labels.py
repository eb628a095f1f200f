"""A toxicity model without any usable label rejects nothing."""

from __future__ import annotations

import corpus_pipeline
from kartlens.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def topic(k: int, n: int = 60) -> str:
    """A text that shares no word with another topic's."""
    return " ".join(f"t{k}w{i * (k + 3) % 97}" for i in range(n))


def test_pipeline_without_labels_keeps_documents(spark, tmp_path):
    rows = [(i, topic(i), "en", "s", 1) for i in range(30)]
    tables = {
        "documents": spark.createDataFrame(rows, DOCUMENTS),
        "benchmark": spark.createDataFrame([("b", "none of these words stand in a text at all here")], "item_id string, text string"),
    }
    unusable = {"empty": [], "null": [(1, None, None)], "no_document": [(999, 1, 1)]}
    for name, labels in unusable.items():
        folder = str(tmp_path / name)
        tables["labels"] = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        step = corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert step.count() == len(rows), name
        assert {r["predicted"] for r in queries.op10_toxicity(spark, folder).collect()} == {0}, name
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/empty").collect()} == set(range(30))
