"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them equal: with the longer
length L, their common prefix and common suffix together reach L - 1.

1. Words. Runs of letters are hashed and cut on the UTF-8 bytes of whole texts; equal words of a
   chunk are counted there, then per task, then by word.
2. Blocks. The edit lies in one of the windows of `WINDOW` places that [0, L) is cut into, so near
   words agree before and after it. A word has one key per window, for its own
   length as L and for the next one; near words meet in the block of the window of their first possible edit, and are
   reported there only. A block's words differ inside a window of two letters: of the
   90 letters there are, at most 90 * 90 + 90 words. So no block grows with the input.
   (Words of over 2 * `WINDOWS` letters have wider windows, so that a word of n letters has no n keys.)
3. Tiles. A task streams over sorted blocks and compares pairs of pieces of them, code-point matrix against code-point matrix,
   padded on the right for prefixes and on the left for suffixes. Only each word's number of near words and
   its best one leave the task.
4. Roots follow forms by pointer doubling: a form is ten times as frequent as its word, so five rounds do.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in front of the colon; every
row counts, repeated ones too; empty tables and tables without frequent words give no rows; ties go to the smallest word in code-point order; further columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.words import BASE, LOWER, U, Words, _power_tables, chunks, mix, signed
from coldkeep.session import written

LETTERS, OCCURRENCES, RATIO, PLANTED = 7, 2, 10, 31
WINDOW, WINDOWS = 2, 128
#: Pairs compared at once, and words on a side of a tile.
PAIRS, TILE = 1 << 17, 256
#: Bytes of a run that are hashed for all runs together.
_STEPS = 64

_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC = _crc_table()


def crc32_from(seeds: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of which `seeds` holds the value so far, continued by data[start: end]."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    state = seeds[order] ^ np.uint32(0xFFFFFFFF)
    for j in range(min(_STEPS, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -j, "left"))  # longer than j
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -_STEPS, "left"))):
        state[i] = zlib.crc32(data[at[i] + _STEPS: at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces data[start: end] as strings."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)
    offsets = np.concatenate((np.zeros(1, np.int64), ends))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of a chunk, after the deletions that the run's hash asks for."""
    for batch in batches:
        for part, data, offsets in chunks(batch):
            lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
            letter = _LETTER[data] | lead
            letter[1:] |= lead[:-1]
            runs = Words(np.where(letter, LOWER[data], np.uint8(0x20)), offsets)
            leads = np.concatenate((np.zeros(1, np.int64), np.cumsum(lead)))
            length = runs.end - runs.start - (leads[runs.end] - leads[runs.start])
            pick = np.flatnonzero(length >= LETTERS)
            start, end, length, key = runs.start[pick], runs.end[pick], length[pick], runs.hash[pick]
            seeds = np.array([zlib.crc32(b"%s:" % str("" if i is None else i).encode()) for i in part.column("doc_id").to_pylist()], np.uint32)
            h = crc32_from(seeds[runs.doc[pick]], runs.data, start, end)
            cut = h % np.uint32(PLANTED) == 0
            _, first, n = np.unique(key[~cut], return_index=True, return_counts=True)
            whole = np.flatnonzero(~cut)[first]
            yield pa.RecordBatch.from_arrays([_cut(runs.data, start[whole], end[whole]).cast(pa.string()), pa.array(n)], ["word", "n"])
            changed: Counter[str] = Counter()
            for i in np.flatnonzero(cut & (length > LETTERS)):
                word = runs.data[start[i]: end[i]].tobytes().decode()
                at = int(h[i]) % len(word)
                changed[word[:at] + word[at + 1:]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], ["word", "n"])


def window(longest: np.ndarray) -> np.ndarray:
    """Places of a window where the longer word has so many letters."""
    return np.maximum(WINDOW, -(-longest // WINDOWS))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, longest, place, word, n): one row per window of every word, for both lengths that the longer word may have."""
    for batch in batches:
        words = batch.column("word")
        raw = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        size = np.array([len(w) for w in words.to_pylist()], np.int64)
        begin = np.cumsum(size) - size
        powers, inverse = _power_tables(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * powers[: len(raw)], dtype=U)))
        piece = lambda a, b: mix((sums[b] - sums[a]) * inverse[a])
        for more in (0, 1):
            longest = size + more
            width = window(longest)
            for place in range(int((-(-longest // width)).max()) if len(size) else 0):
                at = np.flatnonzero(place * width < longest)
                left = place * width[at]
                right = np.minimum(left + width[at], longest[at]) - more
                key = mix(piece(begin[at], begin[at] + left) * U(BASE) + piece(begin[at] + right, begin[at] + size[at])
                          + (longest[at].astype(U) << U(8)) + U(place))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(longest[at]), pa.array(np.full(len(at), place)), words.take(pa.array(at)),
                     batch.column("n").take(pa.array(at))], ["key", "longest", "place", "word", "n"])


def _tiles(first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs i < j of every block [first, stop), in bounded portions."""
    size = stop - first
    small = np.flatnonzero((size > 1) & (size <= TILE // 8))
    rows = np.concatenate([np.arange(a, b) for a, b in zip(first[small], stop[small])]) if len(small) else np.zeros(0, np.int64)
    left = np.repeat(stop[small], size[small]) - rows
    for step in range(1, TILE // 8):
        rows, left = rows[left > step], left[left > step]
        for cut in range(0, len(rows), PAIRS):
            yield rows[cut: cut + PAIRS], rows[cut: cut + PAIRS] + step
    for b in np.flatnonzero(size > TILE // 8):
        pieces = [np.arange(p, min(p + TILE, stop[b])) for p in range(first[b], stop[b], TILE)]
        for x, one in enumerate(pieces):
            for other in pieces[x:]:
                i, j = np.repeat(one, len(other)), np.tile(other, len(one))
                yield i[i < j], j[i < j]


def near_words(words: list[bytes], longest: np.ndarray, place: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of every block that its window reports. All `longest` fit one padded matrix."""
    size = np.array([len(w) for w in words])
    wide = int(longest.max())
    head = np.array(words, f"S{wide}").view(np.uint8).reshape(-1, wide)
    tail = np.array([w[::-1] for w in words], f"S{wide}").view(np.uint8).reshape(-1, wide)
    width = window(longest)
    found = []
    for i, j in _tiles(first, stop):
        pick = np.maximum(size[i], size[j]) == longest[i]
        i, j = i[pick], j[pick]
        portion = max(1, (PAIRS << 4) // wide)
        for a in range(0, len(i), portion):
            x, y = i[a: a + portion], j[a: a + portion]
            prefix = (head[x] != head[y]).argmax(1)
            suffix = (tail[x] != tail[y]).argmax(1)
            edit = np.maximum(longest[x] - 1 - suffix, 0)  # first place where the edit may be
            good = (prefix + suffix >= longest[x] - 1) & (edit // width[x] == place[x])
            found.append((x[good], y[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, longest, place): per word its near words here, their number and the best of them."""
    names = ["key", "longest", "place", "word", "n"]

    def judged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = np.stack([rows.column(c).to_numpy() for c in names[:3]])
        longest, place, n = block[1], block[2], rows.column("n").to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (block[:, 1:] != block[:, :-1]).any(0), [True])))
        first, stop = new[:-1], new[1:]
        lone = np.repeat(stop - first == 1, stop - first)
        kind = np.ceil(np.log2(np.maximum(longest, 16)))  # matrices of words of like length
        for k in np.unique(kind[~lone]):
            own = np.flatnonzero(~lone & (kind == k))
            cut = np.flatnonzero(np.concatenate(([True], (block[:, own[1:]] != block[:, own[:-1]]).any(0), [True])))
            words = rows.column("word").take(pa.array(own)).to_pylist()
            i, j = near_words(words, longest[own], place[own], cut[:-1], cut[1:])
            if not len(i):
                continue
            a, b = np.concatenate((i, j)), np.concatenate((j, i))
            raw = np.array(words)
            order = np.lexsort((raw[b], -n[own][b], raw[a]))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.concatenate(([True], raw[a][1:] != raw[a][:-1])))
            total = np.diff(np.append(head, len(a)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw[a[head]].tolist(), pa.binary()), pa.array(total), pa.array(-n[own][b[head]]), pa.array(raw[b[head]].tolist(), pa.binary())],
                ["word", "n_near", "less", "best"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch.select(names)])
        held = pa.concat_tables([held, table]) if held is not None else table
        key = held.column("key").to_numpy()
        open_from = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if open_from:
            yield from judged(held.slice(0, open_from).combine_chunks().to_batches()[0])
            held = held.slice(open_from)
    if held is not None and len(held):
        yield from judged(held.combine_chunks().to_batches()[0])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, with at least `LETTERS` code points and `OCCURRENCES` occurrences."""
    rows = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `docs` (doc_id, text)."""
    # every letter is below U+0100, so a byte is a code point and bytes sort as words do
    words = written(spark, vocabulary(docs).select(F.encode("word", "ISO-8859-1").alias("word"), "n"), "words")
    rows = words.mapInArrow(keyed, "key long, longest long, place long, word binary, n long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "longest", "place")
    links = dealt.mapInArrow(met, "word binary, n_near long, less long, best binary")
    links = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    known = words.join(links, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("best.best")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    known = written(spark, known, "forms")
    roots = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(spark, roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), (F.col("next").isNotNull()).alias("moved")), "roots")
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return known.join(roots.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word")).select(
        text("word"), text("form"), text("root"), "n", "n_near", "form_n")
