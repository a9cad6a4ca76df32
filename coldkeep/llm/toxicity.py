"""Toxicity: class-conditional Kneser-Ney models of word expressions, compared per document.

A text is read as tokens: its words, of any length, and every code point of scripts that are
written without blanks. An expression is a pair of tokens that follow each other (the first has
a mark before it) or a single token, to which a pair backs off. For each class the distinct
pairs, and the tokens they end with, of every labelled training text are counted. The probability of an expression
in class c is interpolated Kneser-Ney: max(n_c - D, 0) / N_c plus the discounted mass times the shared
probability, which comes from the counts of both classes together, so an expression that is rare in one
class takes its probability from the counts both share; one of a single document differs never. A pair whose counts do not differ
significantly between the classes backs off to its second token; the log-likelihood ratio of a place
in a text is that of the longest expression there that does differ.

A document's length-normalised ratio is the sum over its distinct pairs divided by their
number to the power 0.75. A logistic curve, fitted on ratios of labelled documents from
models that have not seen them, turns it into a score; its place is set so that the best
threshold on those documents, among those that are right at least as often as wrong, is `THRESHOLD`.

Counts cover every labelled training row. Tasks send them on by ranges of the hash, packed as
sorted hashes, classes and numbers, and each range is summed in a task. Every expression
that differs is in the written model. A model of at most `MODEL_SIZE` expressions goes to the
tasks whole. Of a greater one that many go, those of the most documents, and the rest stays a table:
a text has its sum by the former, and only its expressions that a Bloom filter finds among the rest
meet that in a join. Both ways give the same ratios. What reaches the driver is bounded: a model of that
size, a filter of at most 2 ** `_FILTER` bits, and the ratios of at most about `CALIBRATION_ROWS` labelled rows.

Defined results: null and empty texts have ratio 0 and get the score at 0; labels that are
null, or whose document is missing, are ignored; a document labelled more than once counts as
toxic if any label says so; without training rows of both classes every score is the share of toxic rows
(0 without rows); repeated rows are scored each; further columns are not looked at.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import joined_with
from coldkeep.llm.words import NOT_WORD, U, Words, chunks, distinct, mix, signed
from coldkeep.session import written

DISCOUNT = 0.75
CONCENTRATION = 0.5
EVIDENCE = 20.0  # of the likelihood ratio test that the classes differ
MODEL_SIZE = 1 << 16  # expressions that go to the tasks whole; what a greater model has besides is joined
CALIBRATION_ROWS = 40_000
THRESHOLD = 0.3
FOLDS = 3
POWER = 0.75
_END = U(0x2545F4914F6CDD1D)
_FIRST = U(0x9E6C63D0876A9A47)
_STEP = U(0xC2B2AE3D27D4EB4F)
_MERGE = 1 << 21
#: Bytes of labelled text whose counts a task sums.
_RANGE = 1 << 22
_FILTER = 27
#: Places of a hash that give the bits of the filter.
_SHIFTS = (0, 12, 25, 37)
#: Keys with more than this part of the rows of a join are broadcast with what they meet; there are fewer than its inverse.
_HEAVY = 1e-4

_COUNTS = [f"{c}{f}" for c in "to" for f in range(FOLDS)]


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Places where a code point of a script without blanks begins."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xF0))
    if not len(at):
        return at
    # Fixed values, by the first bytes of UTF-8: Thai and Lao, Myanmar and Khmer, CJK radicals, kana, ideographs.
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    pick = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xF0) & (second >= 0xA0)
    pick |= (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F))
    pick |= (lead == 0xE2) & (second >= 0xBA) & (second <= 0xBF) | (lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB)
    return at[pick]


class Tokens:
    """The tokens of a chunk with their row and hash, and the hash of each with the token before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, NOT_WORD, lower=True)
        self.doc, self.hash = words.doc, words.hash
        alone = _unspaced(data)
        if len(alone):
            after = alone + np.where(data[alone] == 0xF0, 4, 3)
            cuts = np.concatenate((alone, after[~NOT_WORD[data[after]]]))  # a text ends with a line feed
            start = np.unique(np.concatenate((words.start, cuts)))
            end = words.end[np.searchsorted(words.start, start, "right") - 1]
            end[:-1] = np.minimum(end[:-1], start[1:])
            self.doc, self.hash = np.searchsorted(offsets, start, "right") - 1, words.hash_of(start, end)
        before = np.append(_FIRST, self.hash[:-1])
        before[np.flatnonzero(np.diff(self.doc, prepend=-1))] = _FIRST
        self.pair = mix(before * _STEP + self.hash) if len(self.hash) else self.hash

    def expressions(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `pick`, key) of the expressions of the picked tokens, shorter ones first."""
        keys = np.stack((mix(self.hash[pick] ^ _END), self.pair[pick]), 1)
        return np.repeat(np.arange(len(pick)), 2), keys.ravel()


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, columns and numbers as one run in order, each key and column once."""
    key, column, number = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((column, key))
    key, column = key[order], column[order]
    new = np.append(True, (key[1:] != key[:-1]) | (column[1:] != column[:-1]))
    return key[new], column[new], np.add.reduceat(number[order], np.flatnonzero(new)).astype(number.dtype)


def _packed(a: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), "zstd", asbytes=True)


def _unpacked(part: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(part, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


_COUNTED = "bucket long, n long, keys binary, columns binary, numbers binary"


def _count(buckets: int):
    """Counter of rows (text, column): the numbers above 0 by key and column, packed by range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(key: np.ndarray, column: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
            bucket = (key >> U(32)) * U(buckets) >> U(32)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(key)).tolist()
            parts = [(int(bucket[a]), b - a, _packed(np.diff(key[a:b], prepend=U(0))), _packed(column[a:b]), _packed(number[a:b]))
                     for a, b in zip(cut[:-1], cut[1:])]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), kinds)], [c.split()[0] for c in _COUNTED.split(", ")])

        for batch in batches:
            for rows, data, offsets in chunks(batch):
                tokens = Tokens(data, offsets)
                doc, _, first = distinct(tokens.doc, tokens.pair)
                if not len(first):
                    continue
                own, key = tokens.expressions(first)
                column = rows.column("column").to_numpy(zero_copy_only=False)[doc[own]]
                uniq, back = np.unique(key, return_inverse=True)
                table = np.bincount(back * len(_COUNTS) + column, minlength=len(uniq) * len(_COUNTS))
                at = np.flatnonzero(table)
                held.append((uniq[at // len(_COUNTS)], (at % len(_COUNTS)).astype(np.uint8), table[at].astype(np.int32)))
                if sum(len(k) for k, _, _ in held) > _MERGE:
                    held = [_summed(held)]
                    if len(held[0][0]) > _MERGE // 2:
                        yield out(*held.pop())
        if held:
            yield out(*_summed(held))

    return run


_EXPRESSIONS = ", ".join(["key long", *(f"{c} long" for c in _COUNTS), "kinds long"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of `_count`'s rows by bucket, a row per expression of several documents, and rows without key for `kinds` expressions of one."""
    held: list[tuple] = []
    last, once = None, np.zeros(len(_COUNTS), np.int64)

    def rows(key: pa.Array, table: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, *(pa.array(table[:, i]) for i in range(len(_COUNTS))), pa.array(kinds)], [c.split()[0] for c in _EXPRESSIONS.split(", ")])

    def out() -> pa.RecordBatch:
        key, column, number = _summed([(np.cumsum(_unpacked(k, n, U), dtype=U), _unpacked(c, n, np.uint8), _unpacked(m, n, np.int32).astype(np.int64)) for n, k, c, m in held])
        held.clear()
        new = np.append(True, key[1:] != key[:-1])
        place = np.cumsum(new) - 1
        several = np.add.reduceat(number, np.flatnonzero(new)) > 1
        alone = ~several[place]
        once[:] += np.bincount(column[alone], minlength=len(once))
        table = np.zeros((int(several.sum()), len(once)), np.int64)
        table[(np.cumsum(several) - 1)[place[~alone]], column[~alone]] = number[~alone]
        return rows(pa.array(signed(key[new][several])), table, np.ones(len(table), np.int64))

    for batch in batches:
        for bucket, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "keys", "columns", "numbers"))):
            if bucket != last and held:
                yield out()
            last = bucket
            held.append(tuple(part))
    if held:
        yield out()
    if once.any():
        yield rows(pa.nulls(len(once), pa.int64()), np.eye(len(once), dtype=np.int64), once)


def _model(counts: DataFrame) -> DataFrame:
    """key, `n` documents, then per model (0: all folds, f + 1: without fold f) the log ratio, null where not significant.

    `counts` has a row per expression of several documents, and rows without key for `kinds` expressions of one.
    """
    def without(c: str, left: int) -> F.Column:
        return sum(F.col(f"{c}{f}") for f in range(FOLDS) if f != left)

    whole = counts.agg(*[F.sum(without(c, left) * F.col("kinds")).alias(f"n{c}{left}") for c in "to" for left in range(-1, FOLDS)], *[
        F.sum(F.when(without(c, left) > 0, F.col("kinds"))).alias(f"k{c}{left}") for c in "to" for left in range(-1, FOLDS)]).collect()[0]
    values = []
    for left in range(-1, FOLDS):
        n = {c: without(c, left) for c in "to"}
        total = {c: float(whole[f"n{c}{left}"] or 0) or 1.0 for c in "to"}
        kinds = {c: float(whole[f"k{c}{left}"] or 0) for c in "to"}
        both = n["t"] + n["o"]
        share = both / F.lit(total["t"] + total["o"])
        rate, evidence = {}, F.lit(0.0)
        for c in "to":
            mass = DISCOUNT * kinds[c] / total[c]
            rate[c] = (F.greatest(n[c] - F.lit(DISCOUNT), F.lit(0.0)) + (min(mass, 1.0) * CONCENTRATION + CONCENTRATION) * share) / (total[c] + CONCENTRATION)
            for seen, expected in ((n[c], share * total[c]), (F.lit(total[c]) - n[c], (F.lit(1.0) - share) * total[c])):
                evidence = evidence + F.when(seen > 0, 2.0 * seen * F.log(seen / expected)).otherwise(0.0)
        # the most that `both` occurrences can show, if all are of one class; it spares the logarithms of what is rare
        most = F.greatest(*[2.0 * both * (float(np.log(sum(total.values()) / total[c])) + both / total[c]) for c in "to"])
        values.append(F.when((most > EVIDENCE) & (evidence > EVIDENCE), F.log(rate["t"] / rate["o"])).alias(f"v{left + 1}"))
    return counts.filter("key is not null").select("key", sum(F.col(c) for c in _COUNTS).alias("n"), *values)


def _found(model: tuple[np.ndarray, np.ndarray]):
    """Finder of expressions: (keys, model of each) -> which are in the model, and their values, NaN where they don't differ."""
    keys, values = model
    sieve = np.zeros(1 << 20, bool)
    sieve[keys >> U(44)] = True

    def find(key: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = np.zeros(len(key), bool), np.full(len(key), np.nan)
        if len(keys):
            near = np.flatnonzero(sieve[key >> U(44)])
            place = np.minimum(np.searchsorted(keys, key[near]), len(keys) - 1)
            hit = keys[place] == key[near]
            known[near[hit]] = True
            value[near[hit]] = values[place[hit], which[near[hit]]]
        return known, value

    return find


def _ratios(model: tuple[np.ndarray, np.ndarray]):
    """Scorer of chunks: (rows, data, offsets, which model per row) -> length-normalised ratios."""
    find = _found(model)

    def score(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
        tokens = Tokens(data, offsets)
        doc, _, first = distinct(tokens.doc, tokens.pair)
        count = np.bincount(doc, minlength=len(offsets) - 1)
        if not len(model[0]) or not len(first):
            return np.zeros(len(offsets) - 1)
        own, key = tokens.expressions(first)
        _, value = find(key, which[doc[own]])
        told = ~np.isnan(value)
        ratio = np.zeros(len(first))
        ratio[own[told]] = value[told]  # the longest comes last and stays
        return np.bincount(doc, ratio, len(offsets) - 1) / np.maximum(count, 1) ** POWER

    return score


def _filter(table: DataFrame) -> np.ndarray:
    """The keys of a table as the words of a Bloom filter."""
    bits = min(_FILTER, max(6, (16 * table.count()).bit_length()))
    slots = table.select(F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in _SHIFTS])).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros(1 << bits - 6, U)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U)
    return words


def _among(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of keys that may be among those of the filter."""
    at, mask = np.arange(len(key)), U(64 * len(words) - 1)
    for s in _SHIFTS:
        slot = key[at] >> U(s) & mask
        at = at[(words[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)]
    return at


def _met(spark: SparkSession, rows: DataFrame, facts: DataFrame, on: str, weight: F.Column) -> DataFrame:
    """`rows` (a written table) joined with `facts`, which name each `on` once; keys of great weight do not meet in one task."""
    weighed = rows.groupBy(on).agg(F.sum(weight).alias("weight"))
    total = weighed.agg(F.sum("weight")).collect()[0][0] or 0
    heavy = written(spark, weighed.filter(F.col("weight") > max(1000.0, _HEAVY * total)).select(on), "heavy")
    few = written(spark, facts.join(F.broadcast(heavy), on), "heavy")
    rest = rows.join(F.broadcast(heavy), on, "left_anti").join(facts, on)
    return rest.unionByName(rows.join(F.broadcast(few), on))


_ASKED = "row long, id long, size long, base double, place long, step int, key long, which int"


def _asked(model: tuple[np.ndarray, np.ndarray], words: np.ndarray):
    """Of rows (text, id, which), per text a row with the sum `base` of its pairs by `model`, and one for each
    expression that may be in the rest of the model: the value there of the longest one of a `place` goes in for `base`.
    """
    find = _found(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = uuid.uuid4().int >> 66, 0
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                _, fresh = np.unique(rows.column("id").to_numpy(), return_index=True)  # equal texts ask once
                tokens = Tokens(data, offsets)
                doc, _, first = distinct(tokens.doc, tokens.pair)
                pick = np.isin(doc, fresh)
                doc, first = doc[pick], first[pick]
                own, key = tokens.expressions(first)
                which = rows.column("which").to_numpy()
                known, value = find(key, which[doc[own]])
                known, value = known.reshape(-1, 2), value.reshape(-1, 2)  # of the token and of the pair
                told = ~np.isnan(value[:, 1])
                value = np.where(told, value[:, 1], np.nan_to_num(value[:, 0]))
                unknown = ~known
                unknown[:, 0] &= ~told
                at = np.flatnonzero(unknown.ravel())
                at = at[_among(words, key[at])]
                name = task + done + np.arange(len(rows))
                done += len(rows)
                base, size = np.bincount(doc, value, len(rows)), np.bincount(doc, minlength=len(rows))
                n, m = len(fresh), len(at)

                def column(head: np.ndarray | None, ask: np.ndarray | None, kind: pa.DataType) -> pa.Array:
                    return pa.concat_arrays([pa.array(x, kind) if x is not None else pa.nulls(k, kind) for x, k in ((head, n), (ask, m))])

                place, long = own[at], pa.int64()
                yield pa.RecordBatch.from_arrays([
                    column(name[fresh], name[doc[place]], long), column(rows.column("id").to_numpy()[fresh], None, long), column(size[fresh], None, long),
                    column(base[fresh], value[place], pa.float64()), column(None, place, long), column(None, at % 2, pa.int32()),
                    column(None, signed(key[at]), long), column(None, which[doc[place]], pa.int32())], [c.split()[0] for c in _ASKED.split(", ")])

    return run


def _joined_ratios(spark: SparkSession, rows: DataFrame, model: tuple[np.ndarray, np.ndarray], rest: DataFrame, words: np.ndarray) -> DataFrame:
    """(id, ratio) of the texts of `rows` (text, id, which) from a model of which `rest`, with the filter `words`, stays a table; rows of one id are equal texts."""
    asked = written(spark, rows.mapInArrow(_asked(model, words), _ASKED), "asked")
    asks = asked.filter("key is not null").select("row", "place", "step", "key", "which", "base")
    value = F.array(*[f"v{f}" for f in range(FOLDS + 1)])[F.col("which")]
    hits = _met(spark, asks, rest, "key", F.lit(1)).withColumn("more", value - F.col("base")).filter("more is not null")
    # the longest expression that differs gives a pair its value
    more = hits.groupBy("row", "place").agg(F.max_by("more", "step").alias("more")).groupBy("row").agg(F.sum("more").alias("base"))
    nothing = F.lit(None).cast("long")
    parts = asked.filter("key is null").select("row", "id", "size", "base").unionByName(more.select("row", nothing.alias("id"), nothing.alias("size"), "base"))
    whole = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("size").alias("size"), F.sum("base").alias("total"))
    return whole.groupBy("id").agg(F.max(F.col("total") / F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(POWER))).alias("ratio"))


def _identity(which: F.Column) -> F.Column:
    """What is scored once: a text by a model."""
    return F.xxhash64(F.coalesce("text", F.lit("")), which)


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    last = np.append(z[order][1:] != z[order][:-1], True)
    # a place that is wrong more often than right would reject clean documents; without signal nothing is rejected
    fair = last & (2 * hits >= np.arange(1, len(z) + 1)) & (z[order] > 0)
    if fair.any():
        best = int(np.argmax(np.where(fair, f1, -1)))
        after = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1.0
        place = (z[order][best] + after) / 2
    else:
        place = float(z.max()) + 1.0
    a, b = 1.0, 0.0
    spread = z.std() or 1.0
    x = (z - place) / spread
    for _ in range(50):  # Newton, with a small ridge that keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    a = max(float(a), 1e-3) / spread
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * place)


class Toxicity:
    """A fitted model; `score` may be applied to any documents."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, slope: float, offset: float, rest: tuple[DataFrame, np.ndarray] | None = None):
        """`rest`: what the model has besides `keys`, as a table and its filter."""
        self.keys, self.values, self.slope, self.offset, self.rest = keys, values, slope, offset, rest

    @staticmethod
    def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Toxicity:
        """Fit on the documents that `labels` (doc_id, toxic) names."""
        told = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(
            F.max("toxic").alias("toxic"))
        rows = joined_with(docs.select("doc_id", "text"), told, "doc_id", 24).select(
            "text", "doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
        column = F.when(F.col("toxic") > 0, F.col("fold")).otherwise(F.col("fold") + FOLDS).cast("int").alias("column")
        size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
        buckets = min(1 << 16, -(-size // _RANGE) or 1)
        counts = rows.select("text", column).mapInArrow(_count(buckets), _COUNTED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        counts = written(spark, counts.mapInArrow(_totals, _EXPRESSIONS), "expressions")
        columns = [f"v{f}" for f in range(FOLDS + 1)]
        table = written(spark, _model(counts).filter(" or ".join(f"{c} is not null" for c in columns)), "model")
        joined = table.count() > MODEL_SIZE
        best = (table.orderBy(F.desc("n"), "key").limit(MODEL_SIZE) if joined else table).toPandas()
        rest = None
        if joined:
            n, key = (int(best[c].iloc[-1]) for c in ("n", "key"))
            table = table.filter((F.col("n") < n) | (F.col("n") == n) & (F.col("key") > key)).select("key", *columns)
            rest = (table, _filter(table))
        keys = best["key"].to_numpy(np.int64).view(U)
        order = np.argsort(keys)
        values = best[columns].to_numpy(float)[order]
        model = (keys[order], values)
        share = told.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("toxic") > 0).cast("double")).alias("p")).collect()[0]
        n, p = share["n"], share["p"] or 0.0
        sample = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)))
        sample = sample.filter(F.col("u") < max(1, round((1 << 20) * min(1.0, CALIBRATION_ROWS / max(n, 1)))))

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = _ratios(model)
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    which = part.column("fold").to_numpy(zero_copy_only=False) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(score(data, offsets, which)), part.column("toxic")], ["z", "y"])

        if joined:
            sample = sample.select("text", "toxic", (F.col("fold") + 1).alias("which")).withColumn("id", _identity(F.col("which")))
            ratios = _joined_ratios(spark, sample.select("text", "id", "which"), model, *rest)
            seen = sample.select("id", "toxic").join(ratios, "id").select(F.col("ratio").alias("z"), F.col("toxic").alias("y")).toPandas()
        else:
            seen = sample.select("text", "fold", "toxic").mapInArrow(apart, "z double, y int").toPandas()
        y = (seen["y"].to_numpy() > 0).astype(float)
        if not 0 < p < 1 or not 0 < y.sum() < len(y):
            p = min(max(p, 0.0), 1.0)
            return Toxicity(model[0][:0], values[:0], 0.0, float(np.log((p + 1e-9) / (1 - p + 1e-9))))
        return Toxicity(*model, *_curve(seen["z"].to_numpy(), y), rest)

    def _scores(self, docs: DataFrame) -> DataFrame:
        """id and score of the texts of `docs`, by the whole model and its rest."""
        asked = docs.select("text", _identity(F.lit(0)).alias("id"), F.lit(0).alias("which"))
        linear = F.least(F.greatest(F.lit(self.slope) * F.col("ratio") + F.lit(self.offset), F.lit(-30.0)), F.lit(30.0))
        scores = _joined_ratios(docs.sparkSession, asked, (self.keys, self.values), *self.rest).select("id", (1 / (1 + F.exp(-linear))).alias("score"))
        return written(docs.sparkSession, scores, "scores")

    def score(self, docs: DataFrame, keep: str) -> DataFrame:
        """`docs` columns named in `keep` (a schema string, without score), then score and predicted."""
        model, slope, offset = (self.keys, self.values), self.slope, self.offset
        names = [part.split()[0] for part in keep.split(",")]
        if self.rest is not None:
            spark = docs.sparkSession
            kept = written(spark, docs.select(*names, _identity(F.lit(0)).alias("id")), "scored")
            return _met(spark, kept, self._scores(docs), "id", F.lit(1)).select(*names, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio = _ratios(model)
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    z = ratio(data, offsets, np.zeros(len(offsets) - 1, np.int64))
                    score = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(n) for n in names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                        [*names, "score", "predicted"])

        columns = list(dict.fromkeys([*names, "text"]))
        return docs.select(*columns).mapInArrow(run, f"{keep}, score double, predicted int")

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The rows of `docs`, whatever columns they have, that are not predicted."""
        model, slope, offset = (self.keys, self.values), self.slope, self.offset
        if self.rest is not None:
            taken = {c.lower() for c in docs.columns}
            free = next(name for i in itertools.count() if (name := f"_text_id{i}") not in taken)
            rejected = self._scores(docs).filter(F.col("score") >= THRESHOLD).select(F.col("id").alias(free))
            return joined_with(docs.withColumn(free, _identity(F.lit(0))), rejected, free, 16, "left_anti").drop(free)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio = _ratios(model)
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    z = ratio(data, offsets, np.zeros(len(offsets) - 1, np.int64))
                    yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30))) < THRESHOLD))

        return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> F.Column:
    """Rows that learning must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = Toxicity.fit(spark, docs, labels.filter(~held_out()))
    scored = model.score(docs.select("doc_id", "text"), "doc_id long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that the model does not reject."""
    model = Toxicity.fit(spark, docs, labels.filter(~held_out()))
    return model.accepted(docs)
