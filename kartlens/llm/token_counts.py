"""Token counts of whole texts under a byte-level BPE tokenizer.

Byte-level BPE merges inside pre-tokens only, so a text's token count is the
sum of its pre-tokens' lengths. Lengths are looked up in two tiers on the map
side: a broadcast table of frequent pre-tokens (from a bounded sample of
documents), then a worker's own cache, whose misses the tokenizer's model
encodes. No pre-token of the corpus is ever shuffled. The tables only save
work: the count of every text is exact whatever they hold.

Special tokens in a text count as the library's default has it: one token
each, the text around them split on its own. Texts with characters that the
library's pattern classes otherwise than the splitting pattern here (newer
Unicode letters) go through the library whole.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kartlens.llm.common import map_batches

# Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAMPLE_DOCS = 4_096
FREQUENT = 65_536  # rows of the broadcast table
CACHED = 400_000  # entries of a worker's cache, the table's included
CACHED_CHARS = 48  # longer pre-tokens aren't kept
AT_A_TIME = 200_000  # pre-tokens held at a time


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE's symbol of each byte: printable bytes stand for
    themselves, the others in order for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@cache
def odd_characters(tokenizer_json: str) -> str:
    """A character class (or "") of what the library's pre-tokenizer and
    PATTERN class differently, found by asking both about every character that
    either is a letter, number or space here or is assigned at all."""
    split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
    pattern = regex.compile(PATTERN)

    known = regex.compile(r"[\p{L}\p{N}\s]").match
    chars = [
        c
        for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)])
        if known(c) or unicodedata.category(c) not in ("Cn", "Co")
    ]
    odd: set[int] = set()
    for i in range(0, len(chars), 4096):
        some = chars[i : i + 4096]
        probe = "".join(f"a{c}1{c}." for c in some)  # five characters for each
        cuts = {a for _, (a, _) in split(probe)} ^ {m.start() for m in pattern.finditer(probe)}
        odd.update(ord(some[cut // 5]) for cut in cuts)
    runs: list[list[int]] = []
    for c in sorted(odd):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Lengths:
    """A worker's tokenizer, its cache and the frequent table under it."""

    def __init__(self, tokenizer_json: str, odd: str, frequent: dict[str, int]):
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.find = regex.compile(PATTERN).finditer
        self.find_all = regex.compile(PATTERN).findall
        self.odd = regex.compile(f"[{odd}]").search if odd else lambda text: None
        special = sorted((t["content"] for t in json.loads(tokenizer_json)["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.symbols = {b: ord(c) for b, c in byte_symbols().items()}
        self.frequent = frequent
        self.known = dict(frequent)

    def length(self, piece: str) -> int:
        return len(self.tokenize(piece.encode().decode("latin-1").translate(self.symbols)))

    def sums(self, lists: list[list[str]]) -> list[int]:
        """Total length of each list of pre-tokens."""
        if len(self.known) > CACHED:
            self.known = dict(self.frequent)
        missing = set().union(*lists).difference(self.known)
        new = {p: self.length(p) for p in missing}
        long = [p for p in new if len(p) > CACHED_CHARS]
        self.known.update(new)
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in lists]
        for p in long:
            del self.known[p]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        lists: list[list[str]] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for i, n in zip(owners, self.sums(lists), strict=True):
                out[i] += n
            lists.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            if self.odd(text):
                out[i] = len(self.library.encode(text, add_special_tokens=False))
                continue
            parts = [text]
            if self.special:
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                if len(part) <= AT_A_TIME:
                    chunks: Iterator[list[str]] = iter([self.find_all(part)])
                else:
                    matches = (m[0] for m in self.find(part))
                    chunks = iter(lambda m=matches: list(islice(m, AT_A_TIME)), [])
                for pieces in chunks:
                    lists.append(pieces)
                    owners.append(i)
                    held += len(pieces)
                    if held >= AT_A_TIME:
                        flush()
        flush()
        return out


_WORKER: dict[str, Lengths] = {}


def _strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [v if v is not None else "" for v in batch.column(column).to_pylist()]


def frequent_pieces(docs: DataFrame, sample_docs: int, rows: int) -> list[str]:
    """The most frequent pre-tokens of a random sample of about
    ``sample_docs`` documents, ``rows`` at most."""
    share = min(1.0, sample_docs / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find_all = regex.compile(PATTERN).findall
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in _strings(batch):
                seen.update(p for p in find_all(text) if len(p) <= CACHED_CHARS)
        top = seen.most_common(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"]
        )

    sample = docs.select("text").sample(fraction=share, seed=1)
    counted = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(rows).collect()]


def token_counts(
    docs: DataFrame, tokenizer_path: str, sample_docs: int = SAMPLE_DOCS, frequent_rows: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``.

    ``tokenizer_path`` names a byte-level BPE file of the tokenizers library
    on the driver; workers get its content. Null counts as the empty text
    (0 and 0); repeated rows count each; other columns aren't read."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    kind = json.loads(tokenizer_json)
    if kind["model"]["type"] != "BPE" or (kind["pre_tokenizer"] or {}).get("type") != "ByteLevel" or kind["normalizer"]:
        raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
    if kind["pre_tokenizer"].get("add_prefix_space") or not kind["pre_tokenizer"].get("use_regex", True):
        raise ValueError("a tokenizer that splits by the usual pattern, without prefix space, is needed")
    odd = odd_characters(tokenizer_json)
    counter = Lengths(tokenizer_json, odd, {})
    table = {p: counter.length(p) for p in frequent_pieces(docs, sample_docs, frequent_rows)}
    shared = spark.sparkContext.broadcast((tokenizer_json, odd, table))
    name = uuid.uuid4().hex  # of this call, for the workers' caches

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Lengths(*shared.value)
        texts = _strings(batch)
        n_bytes = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(_WORKER[name].counts(texts), pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long")
