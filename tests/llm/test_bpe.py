"""BPE against the tokenizers library, its round trip and its corner rows."""

from __future__ import annotations

import hashlib
import json
import os
import random
import string
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kartlens.llm import bpe, common, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

TEXTS = [
    None,
    "",
    " \t\n",
    "Hello World, don't I'LL 12345!?",
    "ends<|endoftext|>here <|startoftext|><|startoftext|> <|endoftext",
    "ΟΔΥΣΣΕΥΣ İstanbul ﬁ Å é é x\u0085y ᠎ a\u001cb c",
    "\U0001f600\U0001faea ՘ Ᲊ Ɤ ͸ 中文字 ١٢٣ \x00\x07",
    "a" * 3_000 + " " + "!?." * 700,
    "wörd, and 12 " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(spark, library):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[3]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, decoded string")
    found = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in found), key=str) == sorted(want, key=str)
    assert bpe.encoded(docs.limit(0), PATH).count() == 0


def test_random_characters_equal_the_library(library):
    with open(PATH, encoding="utf-8") as f:
        js = f.read()
    own = bpe.Encoder(js, bpe.usual_characters(js))
    rng = random.Random(5)
    ranges = [(0, 0x80), (0x80, 0x2000), (0x300, 0x370), (0x2000, 0xD800), (0xE000, 0x110000), (0x20, 0x21), (0x41, 0x5B)]
    for _ in range(4_000):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(own.ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def naive(model: dict, piece: str) -> list[str]:
    """Merge the lowest-ranked leftmost pair until none is left."""
    ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
    parts = [*piece[:-1], piece[-1] + "</w>"]
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_the_queue_merges_as_a_plain_search_does():
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merger, rng = bpe.Merger(model), random.Random(6)
    for _ in range(400):
        piece = "".join(rng.choice("aabbeehinortstt" + string.ascii_lowercase) for _ in range(rng.randrange(1, 30)))
        assert merger.ids(piece.encode()) == [model["vocab"][t] for t in naive(model, piece)]


def test_a_cache_that_overflows_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    with open(PATH, encoding="utf-8") as f:
        js = f.read()
    own = bpe.Encoder(js, [[0, 0x7F]])
    for i in range(60):
        text = " ".join(f"word{chr(97 + (i * k) % 26)}" for k in range(9))
        assert np.frombuffer(own.ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_worker_stays_small():
    """What an encoder holds after many distinct words, and before any character
    that needs the library."""
    with open(PATH, encoding="utf-8") as f:
        js = f.read()
    own = bpe.Encoder(js, bpe.usual_characters(js))
    letters = string.ascii_lowercase
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:16]]
    for at in range(0, len(words), 1_000):
        own.ids("\u00e9 " + " ".join(words[at : at + 1_000]))
    held = [*own.known.items(), *own.older.items()]
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held) < 25_000_000
    assert len(own.usual_seen) < 100
    assert "library" not in vars(own)


def test_batches_are_passed_on_in_slices(spark):
    def run(batch):
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([batch.num_rows] * batch.num_rows)], ["id", "n"])

    found = common.map_batches(spark.range(0, 2_500, 1, 1), run, "id long, n long", bpe.ROWS).collect()
    assert sorted(r["id"] for r in found) == list(range(2_500))
    assert {r["n"] for r in found} == {1_000, 500}


def test_decoding_leaves_out_unknown_ids(spark, library):
    rows = [(1, [1, 99_999, 2, -1]), (2, None), (3, []), (4, [49_407, 320])]
    found = {r["doc_id"]: r["decoded"] for r in bpe.decoded(spark.createDataFrame(rows, "doc_id int, ids array<int>"), PATH).collect()}
    assert found == {1: library.decode([1, 2], skip_special_tokens=False), 2: "", 3: "", 4: "<|endoftext|> a</w>"}


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = queries.op13_bpe(spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(want)
