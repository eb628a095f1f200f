"""The other operators against brute force, and their corner rows."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kartlens.llm import (
    chat_format,
    decontaminate,
    license_scan,
    lm_mixing,
    minhash,
    pii,
    queries,
    source_mix,
    token_counts,
    toxicity,
)

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
BPE = public_tokenizers.path("byte_bpe_50k.json")

LONG = "wörd, and 12 " * 30_000
CORNERS = [
    (1, None, "a", "x"),
    (2, "", "a", None),
    (3, " \n\t", None, "x"),
    (4, "mail bob@example.com or +1 (555) 123-4567 now", "a", "x"),
    (4, "mail bob@example.com or +1 (555) 123-4567 now", "a", "x"),
    (None, "no id here", "b", "x"),
    (7, LONG, "b", "x"),
    (8, "ends<|endoftext|>here don't 'll ՘ \U0001f600   x", "b", "x"),
]


@pytest.fixture(scope="module")
def corners(spark):
    """Null, empty, wordless, repeated, very long rows; clashing extra columns."""
    return spark.createDataFrame(CORNERS, "doc_id long, text string, source string, fp string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ------------------------------------------------------------ token counts


def test_token_counts_equal_the_library(spark, corners, empty):
    library = Tokenizer.from_file(BPE)
    want = sorted(
        ((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t, _, _ in CORNERS),
        key=str,
    )
    assert collected(token_counts.token_counts(corners, BPE), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(empty, BPE).count() == 0


# ----------------------------------------------------------- decontaminate


def brute_hits(words: list[bytes], items: dict[str, list[bytes]], window: int):
    hit, found = set(), set()
    for name, item in items.items():
        n = min(window, len(item))
        for i in range(len(item) - n + 1) if n else []:
            for p in range(len(words) - n + 1):
                if words[p : p + n] == item[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(name)
    return len(hit), sorted(found)


def alnum(text):
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower()) if w]


def test_decontamination_corner_rows(spark, corners, empty, monkeypatch):
    bench = spark.createDataFrame(
        [(1, "Bob, example; COM or 1 555 123"), (2, None), (3, "!!"), (4, "no id here"), (5, "wörd and 12 wörd and 12 wörd")],
        "item_id long, text string",
    )
    items = {str(r["item_id"]): alnum(r["text"]) for r in bench.collect()}
    want = sorted(
        ((d, len(alnum(t)), *brute_hits(alnum(t)[:2000], items, 3)) for d, t, _, _ in CORNERS if d != 7), key=str
    )
    for block in (1 << 25, 40):  # one block; several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        rows = decontaminate.matches(corners, bench, window=3).collect()
        got = [
            (r["doc_id"], r["__n_words"], sum(s["end"] - s["start"] for s in r["__spans"]), r["__items"]) for r in rows
        ]
        assert sorted((g for g in got if g[0] != 7), key=str) == want
        assert [g for g in got if g[0] == 7] == [(7, 90_000, 90_000, ["5"])]
    kept = decontaminate.remove_contaminated(corners, bench, window=3)
    assert kept.columns == corners.columns and collected(kept, "doc_id") == [(1,), (2,), (3,), (8,)]
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(corners, bench.limit(0)).count() == len(CORNERS)


@needs_data
def test_decontamination_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    grams: dict[tuple, set[str]] = {}
    for r in bench:
        words = alnum(r["text"])
        for i in range(max(1, len(words) - 9)):
            grams.setdefault(tuple(words[i : i + 10]), set()).add(str(r["item_id"]))
    want = []
    for r in docs:
        words, hit, found = alnum(r["text"]), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(words) - n + 1):
                if names := grams.get(tuple(words[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((r["doc_id"], len(words), len(hit), len(found), digest, bool(hit)))
    got = queries.op7_decontaminate(spark, SF)
    assert collected(got, *got.columns) == sorted(want, key=str)


# --------------------------------------------------------------------- pii


def brute_base(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


TRICKY = [
    "é a@b.c@d.e x._d@e.f-g.h, a@b a@b. @b.c \U0001f600 z@q.io_x@y.zz",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 99999999999999999999.1.1.1 10.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 1111 1111",
    "+1 (938) 555-1226 + 1 +49 123 ++123456789- +1234567 +12345678901234567 +1.2.3.4.5.6.7.8 9",
    "1" * 5000 + "@" + "a." * 3000 + " " + "+1" + " ()" * 3000 + "2",
]


def test_pii_spans_equal_the_patterns(spark, corners, empty):
    texts = [(i, t) for i, t in enumerate([*TRICKY, None, ""])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pii.spans(df, pii.Model()).collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["__spans"]] for r in rows}
    assert got == {i: brute_base(t or "") for i, t in texts}
    assert pii.fit(empty) == pii.Model()
    assert pii.spans(empty, pii.Model()).count() == 0
    out = pii.redacted(corners, pii.Model())
    assert out.columns == corners.columns
    assert [r["text"] for r in out.where("doc_id = 4").collect()] == ["mail [EMAIL] or [PHONE] now"] * 2
    assert out.where("text is null").count() == 1


def test_pii_learned_model_adds_spans(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111112", "1234567890123456"]
    rows = [(i, f"pay {cards[i % 5]} at 10.0.{i % 400}.1, call +1 555 {i % 7} {100 + i}") for i in range(400)]
    rows += [(1000, "card 4111.1111.1111.1111 and 4111.1111.1111.1112 end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    assert model.trees
    found = pii.spans(df.where("doc_id = 1000"), model).first()["__spans"]
    assert [(pii.KINDS[s["kind"]], s["start"], s["end"], s["base"]) for s in found] == [("card", 5, 24, False)]
    for r in pii.spans(df.where("doc_id < 40"), model).collect():
        assert {(s["kind"], s["start"], s["end"]) for s in r["__spans"] if s["base"]} == set(brute_base(r["text"]))


# ---------------------------------------------------------------- toxicity


def test_toxicity_learner_holds_four_bytes_a_coordinate():
    idx = [np.arange(k, k + 1000, dtype="<i4") for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in idx], pa.binary()), pa.array([0, 1] * 10)], ["idx", "label"])
    rows = toxicity.held(iter([batch, batch]))
    assert [y for _, y in rows] == [0, 1] * 20
    for (at, _), want in zip(rows, idx * 2, strict=True):
        assert at.nbytes == 4 * 1001 and at[-1] == 1 << toxicity.BITS and (at[:-1] == want).all()


def test_toxicity(spark, corners, empty):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, f"{words[i % 4]} {words[i % 3]} " + ("vile insult" if i % 5 == 0 else "kind word")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    assert collected(model, "idx", "weight") == collected(toxicity.fit(docs, labels), "idx", "weight")
    scored = toxicity.scored(docs, model).where("doc_id % 2 = 1").collect()
    assert all((r["__score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in scored)
    got = toxicity.scored(corners, model).collect()
    assert len(got) == len(CORNERS) and all(0 <= r["__score"] <= 1 for r in got)
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r["__score"] for r in toxicity.scored(docs, blank).collect()} == {0.5}
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.reject_toxic(corners, model).columns == corners.columns


# -------------------------------------------------------------- source mix


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        parts = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / parts > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / parts for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_source_mix(spark, corners, empty):
    rows = [(i, "w " * (i % 17), "big") for i in range(3000)] + [(5000 + i, "w " * 5, "mid") for i in range(200)]
    rows += [(9000, "w w w", None), (9001, "w", "s0"), (9002, None, "s1"), (9001, "w", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    got = source_mix.copies(df).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 17 for s in sizes)
    again = source_mix.copies(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert source_mix.copies(empty).count() == 0
    mixed = source_mix.mixed(corners)
    assert mixed.columns == [*corners.columns, "copy"]
    assert source_mix.mixed(empty).count() == 0


# ------------------------------------------------------------- chat format


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] \\ \\\\ <<SYS>> [ROLE]x[/ROLE] [/END]\n"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", "hi"), (1, 2, "assistant", nasty), (1, 3, "user", None),
        (1, 4, "assistant", "\U0001f600é"), (2, 0, "assistant", "first"), (2, 1, "tool[x]\\", "t"), (2, 2, None, "n"),
        (None, None, "user", "x"), (None, None, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    parts = chat_format.segments(df)
    text = {r["conv_id"]: (r["text"], r["valid"]) for r in chat_format.formatted(parts).collect()}
    want = {c: [(r or "", t or "") for d, _, r, t in rows if d == c] for c in (1, 2, None)}
    assert {c: chat_format.read_back(t) for c, (t, _) in text.items()} == want
    assert {c: v for c, (_, v) in text.items()} == {1: True, 2: False, None: False}
    for r in chat_format.digests(parts).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (r["n_turns"], r["formatted_chars"]) == (len(turns), len(text[r["conv_id"]][0]))
    none = chat_format.segments(df.limit(0))
    assert none.count() == 0 and chat_format.digests(none).count() == 0


# ----------------------------------------------------------------- minhash


def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash(spark, corners, empty):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:300]), " ".join(words[:270] + words[300:330]), " ".join(words[200:]), "one two", "three four"]
    texts += [None, "", texts[0], "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["f"] for r in minhash.fingerprinted(df, "text", "f").collect()}
    assert prints[0] == prints[7] and prints[5] == prints[6] == ""
    pairs = [(a, b) for a in prints for b in prints if a < b]
    both = spark.createDataFrame([(a, b, prints[a], prints[b]) for a, b in pairs], "a long, b long, x string, y string")
    for r in both.select("a", "b", minhash.similarity(both.x, both.y).alias("near")).collect():
        a, b = shingles(texts[r["a"]]), shingles(texts[r["b"]])
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near"] - exact) < 0.13, (r, exact)
    assert minhash.fingerprinted(corners, "text", "f").count() == len(CORNERS)
    assert minhash.with_next(empty, ["text"]).count() == 0


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_BYTES", 40)
    ids = [5, 1, 40, 7, 7, 300, 22, 9, 1000, 12, 13, 14, 15]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = collected(minhash.with_next(df, ["text"]), "doc_id", "next_text")
    order = sorted(ids)
    assert got == sorted(((i, f"text {order[(k + 1) % len(order)]}") for k, i in enumerate(order)), key=str)


# ---------------------------------------------------------------- licences


def test_license_scan(spark, corners, empty):
    mit = license_scan.TEMPLATES["mit-permission"]
    rows = [
        (1, "words before. Licensed under the Apache License, Version 2.0. " * 5),
        (2, "junk " * 50 + mit.replace("free of charge", "gratis") + " the end of the text " * 40),
        (3, "the license under apache version of the mit"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "This work is licensed under the GNU General Public License, version 3."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["apache-2.0", "mit-permission", None, "cc-by-nc-4.0", "gpl-3"]
    assert got[2]["coverage"] >= 0.9 and got[2]["first_word"] == 50
    assert {r["license"] for r in license_scan.scan(corners).collect()} == {None}
    assert license_scan.scan(empty).count() == 0


def test_longest_increasing_by_brute_force():
    from itertools import combinations, permutations

    for values in permutations(range(6)):
        want = max(n for n in range(1, 7) if any(list(c) == sorted(c) for c in combinations(values, n)))
        found = [values[i] for i in license_scan.longest_increasing(list(values))]
        assert len(found) == want and found == sorted(found)


# ---------------------------------------------------------- language model


def lm_input(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")


def test_lm_base_score_and_probabilities(spark, empty):
    import math
    from collections import Counter

    rows = [(i, f"The cat{i % 7} sat on mat{i % 5} again", i % 5 == 1) for i in range(200)]
    rows += [(1000, None, False), (1001, "", True), (1002, "unseen Words \t here", True), (0, rows[0][1], False), (None, "x", True)]
    got = lm_mixing.scores(lm_input(spark, rows)).collect()
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    counts = Counter(w for _, t, h in rows if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), h, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for d, t, h in rows
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    per_token = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert per_token[1002] < per_token[1] / 3  # words never seen cost more
    again = lm_mixing.scores(lm_input(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@needs_data
def test_lm_beats_the_base_on_training_documents(spark):
    rows = queries.op2_lm_mixing(spark, SF).collect()
    seen = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_lm_empty_tables(spark):
    assert lm_mixing.scores(lm_input(spark, [])).count() == 0
    only = lm_mixing.scores(lm_input(spark, [(1, "all held out", True)])).first()
    assert only["n_known"] == 0 and only["train_tokens"] == 0 and only["score"] < 0


def test_lm_tree_is_a_code():
    tree = lm_mixing.Tree([5.0, 1.0, 3.0, 3.0, 0.5])
    codes = ["".join(map(str, tree.bits[a:b])) for a, b in zip(tree.start[:-1], tree.start[1:], strict=True)]
    assert sum(2.0 ** -len(c) for c in codes) == 1.0 and len(set(codes)) == 5


# ---------------------------------------------------------------- pipeline


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF).cache()
        assert step.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy"]
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in step.collect()}
    assert all(not brute_base(r["text"]) for r in out.collect())


@needs_data
def test_held_out_split(spark):
    rows = queries.op10_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)
