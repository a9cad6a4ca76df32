"""SimHash near-duplicates by Golay-code fuzzy hashing: fingerprints link at `DISTANCE` or fewer differing bits.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's three-word shingles.

Which fingerprints may link. A fingerprint has four segments of 16 bits. Of three errors, at least
one segment has none, and then

- a second segment has none as well: the two segments, 32 bits, are a key (six keys), or
- the other three have one error each: the segment without, and two of the others by Golay-code words
  (of the four choices of the segment without, one each).

The binary Golay code of length 23 puts every vector within three bits of one code word, its centre. A segment,
filled up with zeros, has its centre, and as neighbours all code words within four bits: one, or six. If two
vectors differ in one bit, the centre of one is a neighbour of the other. So of two segments with one error each,
centre and neighbour of one fingerprint meet neighbour and centre of the other, and a key takes 12 of a segment's
16 bits although one of them is wrong. A fingerprint has 50 keys at most, of 32 or 40 bits.

Equal fingerprints are one node. A task streams over the sorted keys and verifies the fingerprints of a key
against each other; their links leave it as a spanning forest. A key that more than `HOT` fingerprints have is not
compared: the bits that are not in it are cut into four parts, of which three errors leave one whole, and each
fingerprint goes on with four finer keys, until so few bits are left that `HOT` fingerprints cannot share
them. So no link is lost, no group is gathered, and no more than `HOT` fingerprints are compared all with all.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer than
three words are one shingle; rows without doc_id get their fingerprint, component_id null, and link nothing; repeated rows are
reported each; empty tables give no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import components, forest, joined_with
from coldkeep.llm.words import BLANK, LOWER, U, chunks, mix, signed
from coldkeep.session import written

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of one key that are compared; more get finer keys.
HOT = 2048
#: Parts that the bits outside a hot key are cut into.
PARTS = 4
#: Shingles that are hashed at once.
PORTION = 1 << 16

# The Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and its length.
GENERATOR, LENGTH = 0b101011100011, 23


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of the texts of a chunk, in order, and how many each text has."""
    gap = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, offsets)
    words, first = np.diff(first), first[:-1]
    # one space in front of each word, whatever stood there
    keep = ~gap
    keep[:-1] |= gap[:-1] & ~gap[1:]
    plain = np.where(gap, np.uint8(0x20), LOWER[data])[keep].tobytes()
    place = np.cumsum(keep) - 1
    count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    at = np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)
    last = at + np.repeat(np.minimum(words, WORDS), count) - 1
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(at), U)
    for a in range(0, len(at), PORTION):
        i, j = place[start[at[a: a + PORTION]]].tolist(), (place[end[last[a: a + PORTION]] - 1] + 1).tolist()
        out[a: a + PORTION] = np.fromiter((digest(plain[x:y], SEED) for x, y in zip(i, j)), U, len(i))
    return out, count


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that over half of each text's hashes have."""
    total, ends = np.zeros((len(count), 64), np.int64), np.cumsum(count)
    some = np.flatnonzero(count)
    for a in range(0, len(h), PORTION):
        part = h[a: a + PORTION].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = some[(ends[some] > a) & (ends[some] - count[some] < a + len(part))]
        total[own] += np.add.reduceat(bits, np.maximum(ends[own] - count[own] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * total > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = majority(*hashes(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signed(found))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of vectors by the generator."""
    for bit in range(LENGTH - 1, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every 16-bit segment the index of its centre, and the indices of its neighbours with their number.

    An index is the upper 12 bits of a code word, which determine it.
    """
    patterns = [[sum(1 << b for b in bits) for bits in combinations(range(LENGTH), k)] for k in range(5)]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for k, group in enumerate(patterns):
        for s, e in zip(_syndrome(np.array(group)), group):
            errors[s].append(e)  # lightest first: the first one leads to the centre
    size = np.array([len(e) for e in errors])
    table = np.array([e + [0] * (int(size.max()) - len(e)) for e in errors])
    v = np.arange(1 << 16)
    s = _syndrome(v)
    words = (v[:, None] ^ table[s]) >> 11
    return words[:, 0], words, size[s]


def _pairs_with(neighbours: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in rows, index) of all neighbours of the given segments."""
    words, size = neighbours[0][rows], neighbours[1][rows]
    at = np.repeat(np.arange(len(rows)), size)
    return at, words[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)]


def keys(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bits that all fingerprints of the key share, keys, places of their fingerprints); bits tell the schemes apart."""
    seg = [(fp >> U(16 * i) & U(0xFFFF)).astype(np.int64) for i in range(4)]
    mask = [0xFFFF << 16 * i for i in range(4)]
    centre, *neighbours = golay()
    every = np.arange(len(fp))
    for i, j in combinations(range(4), 2):
        yield mask[i] | mask[j], seg[i] << 16 | seg[j], every
    for k in range(4):
        i, j = (k + 1) % 4, (k + 2) % 4
        at, near = _pairs_with(neighbours, seg[j])
        yield mask[k], seg[k][at] << 24 | centre[seg[i]][at] << 12 | near, at
        at, near = _pairs_with(neighbours, seg[i])
        other = near != centre[seg[i]][at]  # the centre was given already
        at, near = at[other], near[other]
        yield mask[k], seg[k][at] << 24 | near << 12 | centre[seg[j]][at], at


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for mask, key, at in keys(fp.view(U)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.full(len(at), mask, U))), pa.array(key), pa.array(fp[at])], ["mask", "key", "fp"])


def finer(mask: int) -> list[int]:
    """`PARTS` greater masks. Linked fingerprints that agree in `mask` agree in one of them: three errors leave one part whole."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i::PARTS]) for i in range(PARTS)]


def _links(fp: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the blocks [first, stop): every place with those `step` further on."""
    row = np.concatenate([np.arange(a, b) for a, b in zip(first, stop)]) if len(first) else np.zeros(0, np.int64)
    left = np.repeat(stop, stop - first) - row
    found, step = [np.zeros((2, 0), U)], 1
    while len(row):
        row, left = row[left > step], left[left > step]
        near = row[np.bitwise_count(fp[row] ^ fp[row + step]) <= DISTANCE]
        found.append(np.stack((fp[near], fp[near + step])))
        step += 1
    found = np.concatenate(found, 1)
    return found[0], found[1]


def _judged(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole blocks of rows (mask, key, fp): a forest of their links, and rows with finer keys of hot ones."""
    new = (rows[:, 1:] != rows[:, :-1])
    rows = rows[:, np.concatenate(([True], new.any(0)))] if rows.shape[1] else rows
    cuts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(0), [True]))) if rows.shape[1] else np.zeros(1, np.int64)
    first, stop = cuts[:-1], cuts[1:]
    hot = stop - first > HOT
    pick = ~hot & (stop - first > 1)
    u, v = forest(signed(np.stack(_links(rows[2].view(U), first[pick], stop[pick]))))
    none = pa.nulls(len(u), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(u), pa.array(v)], ["mask", "key", "a", "b"])
    for a, b in zip(first[hot], stop[hot]):
        yield from _refined(rows[:, a:b])


def _refined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one hot key, each with its finer keys."""
    mask, key, fp = rows.view(U)
    same = pa.array(rows[2])
    for more in finer(int(mask[0])):
        finest = mix(mix(fp & U(more)) + mix(key ^ U(more)))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.full(len(fp), more, U))), pa.array(signed(finest)), same, same], ["mask", "key", "a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by all three: links (a, b), and rows with finer keys (mask not null) for hot ones.

    A task holds one batch and at most `HOT` rows more: of a longer block all rows go on as they come.
    """
    held, hot = np.zeros((3, 0), np.int64), None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")])
        if hot is not None and rows.shape[1]:
            n = int(np.argmin(np.append((rows[:2] == hot).all(0), False)))
            if n:
                yield from _refined(rows[:, :n])
            rows = rows[:, n:]
        if not rows.shape[1]:
            continue
        hot, held = None, np.concatenate((held, rows), 1)
        last = int(np.argmax((held[:2] == held[:2, -1:]).all(0)))
        yield from _judged(held[:, :last])
        held = held[:, last:]
        if held.shape[1] > HOT:
            hot = held[:2, :1]
            yield from _refined(held)
            held = held[:, :0]
    yield from _judged(held)


def linked(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `nodes` (fp): they connect whatever is linked."""
    rows, found = nodes.mapInArrow(_keyed, "mask long, key long, fp long"), None
    while True:
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        out = written(spark, dealt.mapInArrow(_met, "mask long, key long, a long, b long"), "links")
        links, hot = out.filter("mask is null").select("a", "b"), out.filter("mask is not null")
        found = links if found is None else found.unionAll(links)
        if not hot.limit(1).count():
            return found
        rows = hot.select("mask", "key", F.col("a").alias("fp"))


def simhash_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of `docs` (doc_id, text)."""
    rows = written(spark, fingerprints(docs), "fingerprints")
    nodes = written(spark, rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(spark, linked(spark, nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = written(spark, nodes.join(label, "fp", "left"), "named")
    first = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    # apart, as all that are linked with nothing would meet under one null
    joined = joined_with(named.filter("component is not null"), first, "component", 16).select("fp", F.col("first").alias("component_id"))
    alone = named.filter("component is null").select("fp", F.col("least").alias("component_id"))
    whole = written(spark, joined.unionAll(alone), "whole")
    known = rows.filter("doc_id is not null").join(whole, "fp").select("doc_id", "fp", "component_id")
    bare = rows.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return known.unionAll(bare).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
