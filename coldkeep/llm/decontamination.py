"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A document contains an item if at least `CONTAINMENT` of the item's distinct five-word
shingles (words of ASCII letters and digits or any other non-ASCII bytes, lower-cased A-Z)
are among its own. A test item is short and a document may be long, so plain MinHash over
one sketch size would miss it. Documents are partitioned by the number of distinct shingles, in powers
of two, and a partition's sketch has as many bins as its largest document has shingles:
each bin keeps the minimum of the hashes that fall into it. A shared shingle is then the minimum of
its bin in item and document with a chance of one half or more, whatever the document's length.
As many permutations are taken as the item with the fewest shingles needs to be missed with
a chance below 2**-`MISS_BITS`. Every pair with a common bin minimum is verified on all shingles.

The items go to the tasks in blocks of at most `BLOCK` items; more items mean more blocks,
each a pass over the documents. Documents are never shuffled.

Defined results: items and documents with fewer than five words have their whole word
sequence as their one shingle; without words, or null, they match nothing; repeated items
and documents are reported each; empty tables give no rows (and keep every document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.words import NOT_WORD, U, Words, chunks, distinct, mix

SHINGLE = 5
CONTAINMENT = 0.8
MISS_BITS = 20
BLOCK = 20_000


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    return h if k == 0 else mix(h ^ U(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF))


def _bin(h: np.ndarray, bits) -> np.ndarray:
    """The first `bits` bits."""
    return (h >> U(1)) >> (U(63) - np.asarray(bits, U))


def _needed(size: int) -> int:
    return -(-size * 8 // 10)  # ceil(0.8 * size), exactly


class Items:
    """Sketches of a block of items for every size partition, made when first asked for."""

    def __init__(self, rows: list[tuple]):
        batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["text"])
        self.ids, self.sets = [], []
        at = 0
        for part, data, offsets in chunks(batch):
            doc, h, _ = distinct(*Words(data, offsets, NOT_WORD, lower=True).shingles(SHINGLE)[:2])
            ends = np.searchsorted(doc, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                if ends[i] < ends[i + 1]:
                    self.ids.append(rows[at + i][0])
                    self.sets.append(h[ends[i]: ends[i + 1]])
            at += part.num_rows
        fewest = min((_needed(len(s)) for s in self.sets), default=MISS_BITS)
        self.permutations = -(-MISS_BITS // fewest)
        self.made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def sketch(self, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bin minima of all items, sorted, and their items."""
        if (bits, k) not in self.made:
            low, own = [], []
            for i, s in enumerate(self.sets):
                h = np.sort(_permuted(s, k))
                b = _bin(h, bits)
                first = np.append(True, b[1:] != b[:-1])
                low.append(h[first])
                own.append(np.full(int(first.sum()), i))
            low, own = np.concatenate(low), np.concatenate(own)
            order = np.argsort(low, kind="stable")
            self.made[bits, k] = low[order], own[order]
        return self.made[bits, k]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every containment in a chunk."""
        if not self.sets:
            return []
        doc, h, _ = distinct(*Words(data, offsets, NOT_WORD, lower=True).shingles(SHINGLE)[:2])
        ends = np.searchsorted(doc, np.arange(len(offsets)))
        bits = np.ceil(np.log2(np.maximum(np.diff(ends), 1))).astype(np.int64)
        pairs: set[tuple[int, int]] = set()
        for k in range(self.permutations):
            g, d = h, doc
            if k:
                g = _permuted(h, k)
                order = np.lexsort((g, doc))
                g = g[order]
            b = _bin(g, bits[d])
            first = np.ones(len(g), bool)
            first[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1])
            g, d = g[first], d[first]
            for size in np.unique(bits[d]) if len(d) else ():
                low, own = self.sketch(int(size), k)
                mine = np.flatnonzero(bits[d] == size)
                start, stop = np.searchsorted(low, g[mine]), np.searchsorted(low, g[mine], "right")
                for i in np.flatnonzero(stop > start):
                    pairs.update((int(d[mine[i]]), int(j)) for j in own[start[i]: stop[i]])
        found = []
        for row, item in sorted(pairs):
            own = h[ends[row]: ends[row + 1]]
            place = np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)
            shared = int((own[place] == self.sets[item]).sum())
            if shared >= _needed(len(self.sets[item])):
                found.append((row, item, shared))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    n = benchmark.count()
    blocks = -(-n // BLOCK)
    for i in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else benchmark
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]


HITS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def contained(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it contains."""
    out = spark.createDataFrame([], HITS)
    for rows in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            items = Items(rows)
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    ids = part.column("doc_id")
                    got = [(ids[d].as_py(), items.ids[i], n, len(items.sets[i]), n / len(items.sets[i])) for d, i, n in items.hits(data, offsets)]
                    columns = zip(*got) if got else [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(run, HITS))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, that contain no item."""
    for rows in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            items = Items(rows)
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, _, _ in items.hits(data, offsets)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
