"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is measured once (`FEATURES`, from its bytes, on executors). Each feature is cut into
at most `BINS` bins at quantiles. Boosting is cyclic: in a round every feature in turn gets a
tree of at most three leaves over its bins, fitted to the gradients of the logistic
loss, whose values are added to the feature's lookup table at a small rate. Then the pairs of
features that explain most of what is left, by the best single cross of two cuts, get tables of their own,
boosted in the same way with trees of four leaves. A score is the sum of one entry per table, through the logistic
function: vectorised additions by bin.

The model is fitted on at most about `FIT_ROWS` labelled rows (by a hash of the id), whose
measures, not texts, reach the driver. A part of them, never boosted on, says when to stop.

Defined results: a null text is empty; an empty text is scored from its zero measures; without labels of both kinds every
score is the share of good labels (0.5 without labels); labels that are null or whose document is
missing are ignored, of several labels of a document the lowest counts; repeated rows are scored each; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import joined_with
from coldkeep.llm.words import BLANK, Words, chunks, distinct
from coldkeep.session import written

FIT_ROWS = 60_000
BINS = 48
ROUNDS = 300
PAIR_ROUNDS = 100
PAIRS = 6
RATE = 0.1
THRESHOLD = 0.3
PATIENCE = 25

FEATURES = ("words", "word_length", "symbols", "capitals", "digits", "exclaims", "stops", "wide", "lines", "dup_lines", "repeats", "distinct_words")


def _group(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


_COUNTED = {"symbols": _group(b"#*$%&|<>"), "capitals": _group(bytes(range(65, 91))), "digits": _group(b"0123456789"),
            "exclaims": _group(b"!"), "stops": _group(b".,;:?"), "wide": _group(bytes(range(0xC0, 256)))}


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `FEATURES` per text of a chunk."""
    n = len(offsets) - 1
    words = Words(data, offsets, BLANK)
    count = words.count().astype(float)
    some = np.maximum(count, 1)
    within = np.cumsum(np.concatenate(([0], (data & 0xC0) != 0x80)))  # code points before each byte
    chars = np.bincount(words.doc, within[words.end] - within[words.start], n)
    out = {"words": np.log1p(count), "word_length": chars / some}
    for name, table in _COUNTED.items():
        total = np.concatenate(([0], np.cumsum(table[data])))
        out[name] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(chars, 1)
    # lines with a word, by the hashes of their bytes
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, "right") - 1
    h = (words.sums[ends] - words.sums[starts]) * words.inverse[starts]
    lines = np.bincount(row, minlength=n).astype(float)
    out["lines"] = count / np.maximum(lines, 1)
    out["dup_lines"] = (lines - np.bincount(distinct(row, h)[0], minlength=n)) / np.maximum(lines, 1)
    doc, h, first = words.shingles(3, short=False)
    order = np.lexsort((h, doc))
    same = np.zeros(len(order) + 1, bool)
    if len(order) > 1:
        same[1:-1] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    again = first[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[again + j] = True
    out["repeats"] = np.bincount(words.doc[covered], minlength=n) / some
    out["distinct_words"] = np.bincount(distinct(words.doc, words.hash)[0], minlength=n) / some
    return np.stack([out[f] for f in FEATURES], 1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                x = measures(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut_gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gain of each cut after a bin, from gradient and curvature sums per bin."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    return a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)


def _leaves(g: np.ndarray, h: np.ndarray, most: int = 3) -> np.ndarray:
    """Values per bin of a tree over the bins of one feature, grown best cut first."""
    spans, value = [(0, len(g))], np.zeros(len(g))
    while len(spans) < most:
        best = None
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                gains = _cut_gains(g[a:b], h[a:b])
                at = int(np.argmax(gains))
                if gains[at] > 1e-9 and (best is None or gains[at] > best[0]):
                    best = (gains[at], k, a + at + 1)
        if best is None:
            break
        _, k, at = best
        a, b = spans.pop(k)
        spans += [(a, at), (at, b)]
    for a, b in spans:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cross of one cut per axis over a grid of two features."""
    s, t = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c: np.ndarray) -> list[np.ndarray]:
        inner, down, right = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [inner, down - inner, right - inner, c[-1, -1] - down - right + inner]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gains = sum(a * a / (b + 1) for a, b in zip(corners(s), corners(t)))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = np.zeros_like(g)
    for rows, cols in itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))):
        value[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gains[i, j] - g.sum() ** 2 / (h.sum() + 1)), value


class AdditiveModel:
    """Bin edges, one lookup table per feature and one per chosen pair."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return _sigmoid(z)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, stop: np.ndarray) -> AdditiveModel:
        """`stop` marks the rows that only say when to stop."""
        share = float(y.mean()) if len(y) else 0.5
        edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
        tables = [np.zeros(len(e) + 1) for e in edges]
        start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        model = AdditiveModel(start, edges, tables, {})
        if not 0 < share < 1:
            return model
        b, grow = model.bins(x), ~stop
        z = np.full(len(y), start)

        def boost(steps, rounds: int) -> None:
            """Rounds over `steps`, (table, flat bins, tree), back to the round that was best on the stop rows."""
            nonlocal z
            best, kept, since = np.inf, [t.copy() for t, _, _ in steps], 0
            held = stop if stop.any() and 0 < y[stop].mean() < 1 else grow
            for _ in range(rounds):
                for table, flat, tree in steps:
                    p = _sigmoid(z[grow])
                    g = np.bincount(flat[grow], y[grow] - p, table.size).reshape(table.shape)
                    h = np.bincount(flat[grow], p * (1 - p), table.size).reshape(table.shape)
                    add = RATE * tree(g, h)
                    table += add
                    z += add.reshape(-1)[flat]
                p = _sigmoid(z[held])
                loss = -np.mean(y[held] * np.log(p + 1e-12) + (1 - y[held]) * np.log(1 - p + 1e-12))
                if loss < best - 1e-6:
                    best, kept, since = loss, [t.copy() for t, _, _ in steps], 0
                else:
                    since += 1
                    if since >= PATIENCE:
                        break
            for (table, flat, _), k in zip(steps, kept):
                z -= (table - k).reshape(-1)[flat]
                table[...] = k

        boost([(t, b[:, i], _leaves) for i, t in enumerate(tables)], ROUNDS)
        p = _sigmoid(z[grow])
        found = []
        for i, j in itertools.combinations(range(len(edges)), 2):
            shape = (len(tables[i]), len(tables[j]))
            flat = b[:, i] * shape[1] + b[:, j]
            sums = [np.bincount(flat[grow], w, shape[0] * shape[1]).reshape(shape) for w in (y[grow] - p, p * (1 - p))]
            found.append((_cross(*sums)[0], (i, j), shape, flat))
        found.sort(key=lambda f: (-f[0], f[1]))
        steps = []
        for _, pair, shape, flat in found[:PAIRS]:
            model.pairs[pair] = np.zeros(shape)
            steps.append((model.pairs[pair], flat, lambda g, h: _cross(g, h)[1]))
        boost(steps, PAIR_ROUNDS)
        return model


def held_out(column: str = "doc_id") -> F.Column:
    """Rows that learning must not see: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = written(spark, measured(docs), "measures")
    told = labels.filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20))
    share = min(1.0, FIT_ROWS / max(1, told.count()))
    told = told.filter(part < max(1, round(share * (1 << 20))))
    fit = joined_with(rows, told, "doc_id", 16).orderBy("doc_id").select(
        *FEATURES, (F.col("quality") > 0).cast("double").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)).alias("part")).toPandas()
    model = AdditiveModel.fit(fit[list(FEATURES)].to_numpy(float), fit["y"].to_numpy(float), fit["part"].to_numpy() == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.stack([batch.column(f).to_numpy() for f in FEATURES], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
