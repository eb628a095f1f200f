"""Benchmark decontamination with training suffix arrays.

Each Arrow batch of documents is a shard with a suffix array of its own: the
positions at which a match can begin, sorted by a window's length of words.
Every test suffix is binary-searched in every shard; the range of suffixes
that begin with the test window gives all verbatim occurrences with their
locations, and comparing on in place gives the longest match. Suffixes are
offsets into one array of words on either side, so memory is linear in the
text, whatever the length of an item.

The test set is a stated query set against all rows: its distinct items go to
the workers in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents for each block; a block is read, applied and its result written
before the next one is read. A suffix enters the array only if it starts a run of words
that all occur in the block's vocabulary and that is as long as the shortest
window; no other position can match, so nothing is lost. Documents are never
shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kartlens.llm.common import map_batches, stage, texts, words_alnum

# Bytes of test text a worker holds at a time.
BLOCK_BYTES = 32 << 20
# Test suffixes searched, and occurrences located, at a time.
CHUNK = 1 << 16


class Block:
    """One block of test items: vocabulary, all words as one array with a 0
    after each item, and where a window begins."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        line, starts, sizes, owners, offsets = [], [], [], [], []
        at = 0
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_alnum(text)], np.uint32)
            if not len(ids):
                continue
            size = min(window, len(ids))
            begins = np.arange(len(ids) - size + 1)
            line += [ids, np.zeros(1, np.uint32)]
            starts.append(begins + at)
            offsets.append(begins.astype(np.int32))
            sizes.append(np.full(len(begins), size, np.int32))
            owners.append(np.full(len(begins), names.setdefault(item, len(names)), np.int32))
            at += len(ids) + 1
        none = [np.zeros(0, np.int64)]
        self.vocabulary = vocabulary
        self.names = list(names)
        self.line = np.concatenate(line or [np.zeros(0, np.uint32)])
        self.starts, self.sizes, self.owners, self.offsets = (
            np.concatenate(x or none) for x in (starts, sizes, owners, offsets)
        )
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self.longest = int(self.sizes.max()) if len(self.sizes) else 0  # window


def window_keys(line: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    """``width`` words from each start as byte strings that sort by words;
    beyond ``sizes`` words ``fill``."""
    column = np.arange(width)
    out = np.empty((len(starts), width), ">u4")
    for a in range(0, len(starts), CHUNK):
        part = slice(a, a + CHUNK)
        at = np.minimum(starts[part, None] + column, len(line) - 1)
        out[part] = np.where(column < sizes[part, None], line[at], np.uint32(fill))
    return out.view(f"S{4 * width}").ravel()


def common_words(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Words that ``a`` from ``i`` and ``b`` from ``j`` share up to a 0."""
    n, step = 0, 64
    while True:
        size = min(step, len(a) - i - n, len(b) - j - n)
        x, y = a[i + n : i + n + size], b[j + n : j + n + size]
        ends = np.flatnonzero((x != y) | (x == 0))
        if len(ends):
            return n + int(ends[0])
        n += size
        if size < step:
            return n
        step *= 2


def search(block: Block, documents: list[list[bytes]]) -> list[dict]:
    """Per document: ``items`` with an occurring window, ``spans`` (merged
    word ranges, end exclusive) and the longest match of each item as
    (item, document word, item word, words)."""
    out = [{"items": set(), "spans": [], "longest": {}} for _ in documents]
    if not len(block.starts):
        return out
    get = block.vocabulary.get
    ids: list[int] = []
    starts = []
    for words in documents:
        starts.append(len(ids))
        ids.extend([get(w, 0) for w in words])
        ids.append(0)
    line = np.array(ids, np.uint32)
    zeros = np.flatnonzero(line == 0)
    known = np.flatnonzero(line)
    run_end = zeros[np.searchsorted(zeros, known)]
    enough = run_end - known >= block.shortest
    known, run_end = known[enough], run_end[enough]
    if not len(known):
        return out
    width = block.longest
    keys = window_keys(line, known, run_end - known, width, 0)
    order = np.argsort(keys, kind="stable")
    keys, known = keys[order], known[order]
    first_word = np.array(starts)
    hit = np.zeros(len(line) + 1, np.int64)  # +1 where a span begins, -1 where it ends
    pairs: set[int] = set()  # document and item as one number
    n_names = len(block.names)
    for a in range(0, len(block.starts), CHUNK):
        part = slice(a, a + CHUNK)
        low = np.searchsorted(keys, window_keys(block.line, block.starts[part], block.sizes[part], width, 0), "left")
        high = np.searchsorted(
            keys, window_keys(block.line, block.starts[part], block.sizes[part], width, 0xFFFFFFFF), "right"
        )
        counts = high - low
        some = np.flatnonzero(counts)
        upto = np.cumsum(counts[some])
        for b in np.split(some, np.flatnonzero(np.diff(upto // CHUNK)) + 1) if len(some) else ():
            n = counts[b]
            which = np.repeat(b, n) + a
            p = known[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[b], n)]
            t, item, offset = block.starts[which], block.owners[which], block.offsets[which]
            np.add.at(hit, p, 1)
            np.add.at(hit, p + block.sizes[which], -1)
            doc = np.searchsorted(first_word, p, side="right") - 1
            pairs.update(np.unique(doc * n_names + item).tolist())
            # An occurrence that goes on to the left lies in a longer one.
            before = line[np.maximum(p - 1, 0)]
            inner = (offset > 0) & (p > 0) & (before != 0) & (before == block.line[np.maximum(t - 1, 0)])
            for d, q, s, i, o in zip(*(x[~inner].tolist() for x in (doc, p, t, item, offset)), strict=True):
                match = (-common_words(line, q, block.line, s), q - starts[d], o)
                best = out[d]["longest"]
                name = block.names[i]
                if name not in best or match < best[name]:
                    best[name] = match
    for pair in pairs:
        out[pair // n_names]["items"].add(block.names[pair % n_names])
    inside = np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)])
    edges = np.diff(inside)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for d, x, y in zip((np.searchsorted(first_word, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
        out[d]["spans"].append((x - starts[d], y - starts[d]))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = (
    "__n_words long, __items array<string>, __spans array<struct<start:long,end:long>>, "
    "__longest array<struct<item:string,doc_word:long,item_word:long,n_words:long>>"
)

FOUND_NAMES = ("__n_words", "__items", "__spans", "__longest")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The distinct test items, at most ``BLOCK_BYTES`` of ids and text in a
    block (a longer item is a block of its own), and whether it is the last.
    The driver holds one partition and one block at a time."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = F.octet_length("item") + F.octet_length("text")
    total = items.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first()["n"]
    n = max(8, -(-2 * total // BLOCK_BYTES))
    block, held = [], 0
    for r in items.distinct().repartition(n).toLocalIterator():
        row = (r["item"], r["text"].encode())
        more = len(row[0].encode()) + len(row[1])
        if block and held + more > BLOCK_BYTES:
            yield block, False
            block, held = [], 0
        block.append(row)
        held += more
    yield block, True


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with four more columns: ``__n_words``, ``__items`` (ids of items
    of which a window of ``window`` words occurs, as sorted strings),
    ``__spans`` (hit word ranges, merged) and ``__longest`` (each item's
    longest verbatim match and its location).

    An item of fewer words is one window; wordless and null items match
    nothing, a null item id is the empty string. Null, empty and wordless
    documents have no words and no hits. Repeated rows are judged each on
    their own; an empty table on either side gives no hits; other columns
    pass through, but for those named like one of the four, which the new ones
    replace."""
    names = [c for c in docs.columns if c.lower() not in FOUND_NAMES]
    found = _matched(docs, benchmark, window, item_col, text_col)
    return found.select(*[F.col("doc")[c].alias(c) for c in names], *FOUND_NAMES)


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, and what :func:`matches` finds."""
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = StructType([*packed.schema.fields, *StructType.fromDDL(FOUND).fields])
    types = {
        "__n_words": pa.int64(),
        "__items": pa.list_(pa.string()),
        "__spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
        "__longest": pa.list_(
            pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
        ),
    }
    out = packed
    for k, (items, last) in enumerate(_blocks(benchmark, item_col, text_col)):
        block = spark.sparkContext.broadcast(Block(items, window))

        def run(batch: pa.RecordBatch, block=block, k=k) -> pa.RecordBatch:
            documents = [words_alnum(t) for t in texts(batch)]
            found = search(block.value, documents)
            rows = {name: [] for name in types}
            for i, (words, new) in enumerate(zip(documents, found, strict=True)):
                old_items, old_spans, old_longest = (
                    [batch.column(c)[i].as_py() for c in ("__items", "__spans", "__longest")] if k else ([], [], [])
                )
                rows["__n_words"].append(len(words))
                rows["__items"].append(sorted({*old_items, *new["items"]}))
                spans = merged([*[(s["start"], s["end"]) for s in old_spans], *new["spans"]])
                rows["__spans"].append([{"start": a, "end": b} for a, b in spans])
                longest = {x["item"]: (-x["n_words"], x["doc_word"], x["item_word"]) for x in old_longest}
                for item, match in new["longest"].items():
                    longest[item] = min(match, longest.get(item, match))
                rows["__longest"].append(
                    [
                        {"item": item, "doc_word": p, "item_word": o, "n_words": -n}
                        for item, (n, p, o) in sorted(longest.items())
                    ]
                )
            arrays = [batch.column("doc")] + [pa.array(rows[n], t) for n, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, ["doc", *types])

        out = map_batches(out.withColumn("text", F.col("doc")[text_col]), run, schema)
        if not last:
            out = stage(out, "matches")
            block.destroy()
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without those in which a benchmark window occurs; all columns
    pass through, whatever their names."""
    found = _matched(docs, benchmark, window, "item_id", "text").where(F.size("__spans") == 0)
    return found.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
