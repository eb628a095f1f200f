"""BPE encoding and decoding with word-end symbols.

A pre-token's bytes become symbols in a doubly linked list (arrays of the
places before and after). A priority queue holds the merge rank of each
neighbouring pair, lowest rank and then leftmost first; a popped entry whose
pair has changed since it was pushed is stale and skipped. A merge replaces two
symbols by one and pushes the two pairs that it makes, so a pre-token of n
bytes takes O(n log n); one of at most SHORT symbols is searched plainly. Ids of a text are those of its pre-tokens in order;
decoding joins the vocabulary strings of the ids, with a space between where
the tokenizer has no decoder, as the library does.

Encoding goes row by row in Arrow batches without a shuffle, and passes on
ROWS rows at a time. Each worker keeps the ids of pre-tokens that it has merged;
the cache only saves work. Any of a task's workers may come to encode in turn,
so each may hold a cache: it is kept small.

The tokenizer file's normalizer (canonical composition, white space, lower
case) and splitting pattern are applied here by Python's Unicode tables. Texts
with a character that those tables and the library treat otherwise (found by
asking both about every assigned character; unassigned ones count as such) are
normalized and split by the library's own normalizer and pre-tokenizer, then
merged here like the others.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from bisect import bisect
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kartlens.llm.common import map_batches
from kartlens.llm.token_counts import byte_symbols

CACHED = 100_000  # pre-tokens in a generation of a worker's cache; it keeps two
SHORT = 24  # symbols of a pre-token that is merged without a queue
CACHED_CHARS = 48  # longer ones aren't kept
AT_A_TIME = 200_000  # pre-tokens held at a time
ROWS = 1_000  # rows encoded or decoded at a time


class Merger:
    """Vocabulary and merge ranks of a tokenizer's model."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        # The symbol of each byte, within a pre-token and as its last one;
        # -1: the vocabulary lacks it.
        self.inner = [vocab.get(symbols[b], -1) for b in range(256)]
        self.final = [vocab.get(symbols[b] + end, -1) for b in range(256)]
        self.size = max(vocab.values()) + 1
        self.made: list[int] = []  # by rank: the id that a pair merges to
        self.rank: dict[int, int] = {}  # of the pair a, b at a * size + b
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] * self.size + vocab[b]] = rank
            self.made.append(vocab[a + b])

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A byte whose symbol the vocabulary lacks is
        left out, as without an unknown token."""
        ids = [self.inner[b] for b in piece[:-1]]
        ids += [self.final[b] for b in piece[-1:]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        if len(ids) <= SHORT:
            return self.short_ids(ids)
        n, size, rank_of, made = len(ids), self.size, self.rank.get, self.made
        # An entry: the pair's rank, then the place of its left symbol.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] * size + ids[i + 1])) is not None]
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] * size + ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(ids[i] * size + ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] * size + ids[i])) is not None:
                heappush(queue, r << 32 | h)
        return [i for i in ids if i >= 0]

    def short_ids(self, ids: list[int]) -> list[int]:
        """The same for a few symbols, where a plain search is faster."""
        size, rank_of, made, none = self.size, self.rank.get, self.made, len(self.made)
        ranks = [rank_of(a * size + b, none) for a, b in pairwise(ids)]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] * size + ids[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], none)
        return ids


def _split_pattern(config: dict) -> str:
    """The splitting pattern of a normalizer and pre-tokenizer that this
    module knows; ValueError for others."""
    steps = [s["type"] for s in (config["normalizer"] or {}).get("normalizers", [])]
    parts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = (
        config["model"]["type"] == "BPE"
        and not config["model"].get("continuing_subword_prefix")
        and steps == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["behavior"] == "Removed"
        and parts[0]["invert"]
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in config["added_tokens"])
        and config["decoder"] is None
    )
    if not known:
        raise ValueError("a lower-casing BPE tokenizer that splits by a pattern of its own is needed")
    return parts[0]["pattern"]["Regex"]


def ascii_pattern(pattern: str) -> str:
    """The pattern's classes over lower-case ASCII, for the standard library's
    faster matcher."""
    return pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", "[^ \\t-\\ra-z0-9]")


def normalized(text: str) -> str:
    """Composed and in lower case, each character on its own (a sigma at a
    word's end too). White space stays: the pattern drops all of it."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()


@cache
def usual_characters(tokenizer_json: str) -> list[list[int]]:
    """Ranges (first, last) of the characters that the library and the tables
    here normalize and split alike; all of ASCII is taken to be."""
    find_all = regex.compile(_split_pattern(json.loads(tokenizer_json))).findall
    library = Tokenizer.from_str(tokenizer_json)
    norm, split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
    symbols = {b: ord(c) for b, c in byte_symbols().items()}
    runs = [[0, 0x7F]]
    for i in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        c = chr(i)
        if unicodedata.category(c) in ("Cn", "Co"):
            continue
        probe = f"b{c}1{c}."
        here = [p.encode().decode("latin-1").translate(symbols) for p in find_all(normalized(probe))]
        if here == [p for p, _ in split(norm(probe))]:
            if i == runs[-1][1] + 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return runs


class Encoder:
    """A worker's tokenizer and its cache."""

    def __init__(self, tokenizer_json: str, usual: list[list[int]]):
        self.tokenizer_json = tokenizer_json
        config = json.loads(tokenizer_json)
        pattern = regex.compile(_split_pattern(config))
        self.find_all, self.find = pattern.findall, pattern.finditer
        self.find_ascii = re.compile(ascii_pattern(pattern.pattern)).findall
        self.usual = [i for a, b in usual for i in (a, b + 1)]  # where a range starts, and the next gap
        self.usual_seen: set[str] = set()
        self.merger = Merger(config["model"])
        special = sorted(((t["content"], t["id"]) for t in config["added_tokens"]), key=lambda t: -len(t[0]))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t, _ in special) + ")") if special else None
        self.special_ids = dict(special)
        self.bytes = {ord(c): b for b, c in byte_symbols().items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.tokenizer_json)

    def is_usual(self, text: str) -> bool:
        """Whether all of the text's characters are usual ones."""
        if self.usual_seen.issuperset(text):
            return True
        new = set(text).difference(self.usual_seen)
        if not all(bisect(self.usual, ord(c)) % 2 for c in new):
            return False
        self.usual_seen |= new
        return True

    def merged(self, piece: bytes) -> bytes:
        return np.array(self.merger.ids(piece), np.int32).tobytes()

    def pieces(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens, as 4-byte integers."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        long = []
        for p in set(pieces).difference(known):
            known[p] = older[p] if p in older else self.merged(p.encode())
            if len(p) > CACHED_CHARS:
                long.append(p)
        out = b"".join(map(known.__getitem__, pieces))
        for p in long:
            del known[p]
        return out

    def plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens, in parts."""
        if not text.isascii() and not self.is_usual(text):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            yield from (self.merged(p.translate(self.bytes).encode("latin-1")) for p, _ in found)
        elif len(text) <= AT_A_TIME:
            find_all = self.find_ascii if text.isascii() else self.find_all
            yield self.pieces(find_all(normalized(text)))
        else:
            matches = (m[0] for m in self.find(normalized(text)))
            yield from map(self.pieces, iter(lambda: list(islice(matches, AT_A_TIME)), []))

    def ids(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.special_ids[part]).tobytes())
            elif part:
                out += self.plain(part)
        return b"".join(out)


_WORKER: dict[str, Encoder] = {}


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) for every row of ``docs``: the token ids of the whole text.

    ``tokenizer_path`` names the file on the driver; workers get its content
    (a vocabulary, which doesn't grow with the data). Strings of special tokens
    in a text count as those tokens, the text around them is encoded on its
    own; none are added at its ends. Null, empty and blank texts have no ids;
    repeated rows and rows without an id are encoded each; an empty table gives
    an empty result; other columns aren't read, whatever their names."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, usual_characters(tokenizer_json)))
    name = uuid.uuid4().hex  # of this call, for the workers' caches

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Encoder(*shared.value)
        encode, column = _WORKER[name].ids, batch.column(text_col)
        made = [encode(t) if t else b"" for t in column.to_pylist()]
        ends = np.cumsum([0, *(len(m) // 4 for m in made)], dtype=np.int64).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(made), np.int32))
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(ends), values)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>", ROWS)


def decoded(ids: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded): the vocabulary strings of each row's ids,
    special tokens included, with a space between. No ids or null: the empty
    text; an id beyond the vocabulary is left out, as the library does."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = json.load(f)
    _split_pattern(config)
    tokens = [(i, t) for t, i in config["model"]["vocab"].items()] + [(t["id"], t["content"]) for t in config["added_tokens"]]
    names: list[str | None] = [None] * (max(i for i, _ in tokens) + 1)
    for i, t in tokens:
        names[i] = t
    shared = ids.sparkSession.sparkContext.broadcast(names)

    def texts(lists: pa.ListArray, vocabulary: pa.Array) -> pa.Array:
        values, ends = lists.flatten(), np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        known = np.asarray(pc.fill_null(values, -1))
        known = (known >= 0) & (known < len(vocabulary))
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        found = vocabulary.take(values.filter(pa.array(known)))
        kept = found.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.drop_null())
        return pc.binary_join(parts, " ")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(ids_col)
        vocabulary = pa.array(shared.value, pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), lists, texts(lists, vocabulary)], [id_col, ids_col, "decoded"]
        )

    kind = ids.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string"
    return map_batches(ids.select(id_col, ids_col), run, schema, ROWS)
