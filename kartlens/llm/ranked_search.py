"""Ranked lexical search over hashed max-sketches.

Index: one row for each document, with its distinct terms, how often each
occurs, and a sketch. The sketch has ``SLOTS`` slots; every term of the document
is hashed to a slot and the slot keeps the largest count. Within a document a
term's impact grows with its count, so the impact of a slot's count is the
coordinatewise maximum of the impacts of its terms. The index knows no query
and no statistic of the corpus: those may change without building it anew.

Search: queries come in blocks, each a matrix of term weights summed by slot.
For a batch of documents the slots' impacts times that matrix bound the scores
of all its queries from above (a term's impact is at most its slot's). Each
task then goes through a query's documents by descending bound, scores them
exactly from their terms, and stops where the bound falls below the ``k``-th
best exact score it has. What a task returns for a query, its ``k`` best, is
merged over the tasks. The result is exact for every hash: sketches only decide
how many documents are scored.

Scores are integers (see ``Weights``), so nothing depends on the order of sums.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartlens.llm.common import map_batches, stage, texts, words_alnum

SLOTS = 1024
MOST = 255  # a slot's count from here on stands for any count
K = 50
# A block of queries: so many queries and bytes of distinct terms at most (a
# single longer query is a block of its own).
BLOCK_QUERIES = 2_000
BLOCK_BYTES = 4 << 20
CHUNK = 512  # documents whose bounds are computed at a time

# Fixed values of the score: 1000 a factor of the weight, the impact's scale,
# its saturation (k1 times b and its rest) by the document's length.
IMPACT, STEP, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50, 50


def impact(tf, m):
    """Integer impact of a term that occurs ``tf`` times."""
    return (IMPACT * tf) // (STEP * tf + LENGTH * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, n, terms, counts, sketch), a written table with a row for every row
    of ``docs``: ``n`` terms with repeats, the distinct ``terms`` joined by
    spaces, their ``counts`` and the ``sketch``. Null and wordless texts have
    none. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = [Counter(words_alnum(t)) for t in texts(batch, text_col)]
        sizes = [len(c) for c in counted]
        counts = np.fromiter((n for c in counted for n in c.values()), np.int64, sum(sizes))
        places = np.fromiter((zlib.crc32(t) for c in counted for t in c), np.int64, sum(sizes)) % slots
        rows = np.repeat(np.arange(len(counted)), sizes)
        sketches = np.zeros((len(counted), slots), np.uint8)
        np.maximum.at(sketches, (rows, places), np.minimum(counts, MOST).astype(np.uint8))
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(id_col),
                pa.array([c.total() for c in counted], pa.int64()),
                pa.array([b" ".join(c) for c in counted], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                pa.array([s.tobytes() for s in sketches], pa.binary()),
            ],
            ["id", "n", "terms", "counts", "sketch"],
        )

    schema = f"id {kind}, n long, terms string, counts array<long>, sketch binary"
    return stage(map_batches(docs.select(id_col, text_col), run, schema), "sketches")


def _queries(queries: DataFrame, text_col: str) -> DataFrame:
    """(query, terms): each row's distinct terms; ``query`` is its key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [sorted({*words_alnum(t)}) for t in texts(batch, text_col)]
        return pa.RecordBatch.from_arrays(
            [batch.column("query"), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["query", "terms"]
        )

    return map_batches(queries.select("query", text_col), run, "query long, terms array<string>")


def _blocks(terms: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Queries with terms in blocks; the driver holds one partition and one
    block at a time."""
    terms = stage(terms.where(F.size("terms") > 0), "queries")
    size = F.octet_length(F.array_join("terms", "")).cast("long")
    sums = terms.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    parts = 1 + 2 * max(sums["bytes"] // BLOCK_BYTES, sums["rows"] // BLOCK_QUERIES)
    block, held = [], 0
    for r in terms.repartition(int(parts)).toLocalIterator():
        more = sum(len(t.encode()) for t in r["terms"])
        if block and (len(block) >= BLOCK_QUERIES or held + more > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((r["query"], r["terms"]))
        held += more
    if block:
        yield block


def frequencies(indexed: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How many documents hold each term of a block's vocabulary; counted in
    tasks first."""
    shared = indexed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, Counter()
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                seen.update(wanted.intersection(terms.split(" ")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"]
        )

    counted = indexed.select("terms").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = {r["term"]: r["df"] for r in counted.toLocalIterator()}
    shared.destroy()
    return found


class Weights:
    """A block of queries with their term weights.

    With ``documents`` that hold a term, ``words`` in all of them together and
    ``n`` in one, a document's length is m = FLAT + (SLOPE n documents) // words
    and its score the sum of weight * impact over the query's terms."""

    def __init__(self, block: list[tuple[int, list[str]]], dfs: dict[str, int], documents: int, words: int, slots: int = SLOTS):
        self.documents, self.words, self.slots = documents, words, slots
        # A term that no document holds adds nothing to any score.
        self.terms = [[(t, w) for t in terms if t in dfs and (w := weight(documents, dfs[t]))] for _, terms in block]
        self.queries = [q for q, _ in block]

    def length(self, n: int) -> int:
        return FLAT + (SLOPE * n * self.documents) // self.words

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The slots in use, and for each of them the weight in each query."""
        places = [[zlib.crc32(t.encode()) % self.slots for t, _ in terms] for terms in self.terms]
        used = np.unique(np.array([p for row in places for p in row], np.int64))
        weights = np.zeros((len(used), len(places)))
        for q, (row, terms) in enumerate(zip(places, self.terms, strict=True)):
            np.add.at(weights[:, q], np.searchsorted(used, row), [w for _, w in terms])
        return used, weights


class Best:
    """A task's ``k`` best documents of each query so far."""

    def __init__(self, weights: Weights, k: int):
        self.weights, self.k = weights, k
        self.used, self.matrix = weights.matrix()
        self.top: list[list[tuple]] = [[] for _ in weights.queries]
        # Below this no document can enter: the k-th best score, 1 before.
        self.floor = np.ones(len(weights.queries))

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch.column("id").to_pylist()
        lengths = np.array([self.weights.length(n) for n in batch.column("n").to_pylist()], np.int64)
        counts = np.stack([np.frombuffer(s, np.uint8) for s in batch.column("sketch").to_pylist()])[:, self.used].astype(np.int64)
        impacts = np.where(counts == MOST, IMPACT // STEP, impact(counts, lengths[:, None]))
        # Sums of doubles round; the bound must not fall below the exact sum.
        bounds = (impacts.astype(np.float64) @ self.matrix) * (1 + 2.0**-32)
        terms, held = batch.column("terms"), {}
        for q in np.flatnonzero((bounds >= self.floor).any(axis=0)).tolist():
            column = bounds[:, q]
            able = np.flatnonzero(column >= self.floor[q])
            for i in able[np.argsort(-column[able], kind="stable")].tolist():
                if column[i] < self.floor[q]:
                    break
                if i not in held:
                    m = int(lengths[i])
                    tfs = zip(terms[i].as_py().split(" "), batch.column("counts")[i].as_py(), strict=True)
                    held[i] = {t: impact(tf, m) for t, tf in tfs}
                found = held[i].get
                score = sum(w * found(t, 0) for t, w in self.weights.terms[q])
                if score >= self.floor[q]:
                    self.enter(q, score, ids[i])

    def enter(self, q: int, score: int, doc_id) -> None:
        top = self.top[q]
        insort(top, (-score, doc_id is None, doc_id if doc_id is not None else 0))
        del top[self.k :]
        if len(top) == self.k:
            self.floor[q] = -top[-1][0]

    def rows(self) -> Iterator[tuple]:
        for q, top in zip(self.weights.queries, self.top, strict=True):
            for score, unnamed, doc_id in top:
                yield q, None if unnamed else doc_id, -score


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    slots: int = SLOTS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(query_col, rank, id_col, score): of every row of ``queries`` the ``k``
    highest-scoring rows of ``docs`` with a score above 0 (all, if fewer), equal
    scores by ascending id, rows without an id after them.

    Every row of either table counts by itself, repeated ones and those that
    share an id or have none too. Null and wordless texts match nothing; an
    empty table on either side gives an empty result; other columns aren't
    read, whatever their names."""
    spark = docs.sparkSession
    indexed = index(docs, id_col, text_col, slots)
    stats = indexed.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_col).alias("asked"), F.col(query_text_col).alias("text"))
    asked = stage(asked, "asked")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"query long, id {kind}, score long"
    ids = pa.schema([("query", pa.int64()), ("id", indexed.limit(0).toArrow().schema.field("id").type), ("score", pa.int64())])

    best = []
    for block in _blocks(_queries(asked, "text")) if stats["documents"] else ():
        dfs = frequencies(indexed, {t for _, terms in block for t in terms})
        shared = spark.sparkContext.broadcast(Weights(block, dfs, stats["documents"], stats["words"], slots))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Best(shared.value, k)
            for batch in batches:
                for i in range(0, batch.num_rows, chunk):
                    own.add(batch.slice(i, chunk))
            rows = [*own.rows()]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ids, strict=True)], schema=ids)

        found = indexed.select("id", "n", "sketch", "terms", "counts").mapInArrow(run, schema)
        best.append(stage(found, "best"))
        shared.destroy()
    merged = best[0] if best else spark.createDataFrame([], schema)
    for more in best[1:]:
        merged = merged.union(more)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "asked"), "query").select(
        F.col("asked").alias(query_col), "rank", F.col("id").alias(id_col), "score"
    )
