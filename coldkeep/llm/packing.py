"""Packing: documents as token pieces, placed by bounded-space online best-fit.

Tokens: the ids of the tokenizer, then id 1. A document with more than `CAPACITY` ids is cut
into pieces of that many (the last may be shorter); nothing else is cut.

Placement: pieces are dealt into lanes by a hash, each lane wide enough that what its last
open sequences waste does not count, and a lane takes its pieces one by one, longest first. It
keeps at most `OPEN` sequences open, in lists per free space with a bitset of the free
spaces in use. A piece goes into the open sequence with the least sufficient space; if none
has, a new one is opened, and if too many are open then, the fullest is closed. A lane holds
its open sequences only, so memory does not depend on the number of pieces.

Token ids of a word (split at ASCII white space) do not depend on its neighbours, so a task
remembers the ids of the words it met of late, `MEMO` and as many older ones, and the tokenizer sees each of them once.

Defined results: a null or empty text is one piece of length 1; rows with equal doc_id are
packed each by itself; an empty table gives no rows; ties of length go by doc_id and piece;
further columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.words import LOWER, Words, chunks
from coldkeep.session import written

CAPACITY = 4096
END_ID = 1
OPEN = 1024
LANE_SEQUENCES = 4096
MEMO = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Punctuation that ends a word is a word of its own behind these: the tokenizer splits there anyway, and without it words repeat more.
_TAIL = np.isin(np.arange(256), list(b".,!?;:*&$%#|"))
_LETTER = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_SECOND = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])  # of U+00C0 to U+00FF but the two signs
_PLAIN = re.compile(rb"[a-z]+")


class _Known:
    """Words by their sorted hashes, with their bytes and token ids one after the other in flat arrays."""

    def __init__(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.raw = _Flat(np.uint32), _Flat(np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the words with these hashes; -1 for those that are not here."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], -1)

    def add(self, keys: np.ndarray, ids: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray]) -> None:
        """Words with sorted hashes that are not here."""
        at = np.searchsorted(self.keys, keys)
        self.places = np.insert(self.places, at, len(self.ids.size) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.ids.add(*ids)
        self.raw.add(*raw)


class _Flat:
    """Pieces of varying size in one array that grows by doubling."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 16, kind), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, data: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.append(self.data, np.zeros_like(self.data))
        self.data[self.used: self.used + len(data)] = data
        self.first = np.append(self.first, self.used + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.used += len(data)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.data, self.first[at], self.size[at]), self.size[at]


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces data[first: first + size] one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)]


_tokenizers: dict[str, Any] = {}


class _Memo:
    """Token ids of the words of a task. The words of the last `MEMO` and some are known; a word that comes again stays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer = _tokenizers[path]
        self.known, self.older = _Known(), _Known()

    def _tokenized(self, words: list[bytes]) -> list[list[int]]:
        tokenize, out, rest = self.tokenizer.model.tokenize, [], []
        for n, w in enumerate(words):
            if _PLAIN.fullmatch(w):
                out.append([t.id for t in tokenize(w.decode())])
            else:
                out.append([])
                rest.append(n)
        for at in range(0, len(rest), 4096):
            part = rest[at: at + 4096]
            for n, e in zip(part, self.tokenizer.encode_batch_fast([words[n].decode() for n in part], add_special_tokens=False)):
                out[n] = e.ids
        return out

    def _places(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places in `known` of words with distinct hashes, which are added if need be."""
        if len(self.known.keys) > MEMO:
            self.known, self.older = _Known(), self.known
        at = self.known.find(hashes)
        new = np.flatnonzero(at < 0)
        old = self.older.find(hashes[new])
        again, old, new = new[old >= 0], old[old >= 0], new[old < 0]
        if len(again):
            self.known.add(hashes[again], self.older.ids.take(old), self.older.raw.take(old))
        if len(new):
            words = [data[a: a + n].tobytes() for a, n in zip(start[new].tolist(), size[new].tolist())]
            found = self._tokenized(words)
            ids = np.fromiter((i for w in found for i in w), np.uint32)
            self.known.add(hashes[new], (ids, np.array([len(w) for w in found], np.int64)), (np.frombuffer(b"".join(words), np.uint8), size[new]))
        at = self.known.find(hashes)
        # Equal hashes are taken for equal words only if their bytes are.
        raw, length = self.known.raw.take(at)
        if not (np.array_equal(length, size) and np.array_equal(raw, gathered(data, start, size))):
            for n in np.flatnonzero(length != size).tolist() or range(len(at)):
                word = data[start[n]: start[n] + size[n]]
                if not np.array_equal(word, self.known.raw.take(at[n: n + 1])[0]):
                    [ids] = self._tokenized([word.tobytes()])
                    at[n] = len(self.known.ids.size)
                    self.known.add(hashes[:0], (np.array(ids, np.uint32), np.array([len(ids)])), (word, size[n: n + 1]))
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk one after the other, and how many each has."""
        low = LOWER[data]
        # of a text with "<|" no byte is changed and no word cut, since an upper-case look-alike would become a special token
        odd = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        raw = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        for n in raw:
            low[offsets[n]: offsets[n + 1]] = data[offsets[n]: offsets[n + 1]]
        words = Words(low, offsets)
        start, end = words.start, words.end
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        body = np.maximum.accumulate(np.where(_TAIL[low], -1, np.arange(len(low))))[end - 1]  # the last byte before the tail
        cut = (body >= start) & (body < end - 1) & (_LETTER[low[body]] | _SECOND[low[body]] & (low[np.maximum(body - 1, 0)] == 0xC3))
        cut &= ~np.isin(words.doc, raw)
        start, end = (np.sort(np.concatenate((x, body[cut] + 1))) for x in (start, end))
        size, h = end - start, words.hash_of(start, end)
        hashes, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = self._places(low, start[first], size[first], hashes)[back]
        ids, n = self.known.ids.take(at)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        return ids, np.diff(total[np.searchsorted(start, offsets)])


def token_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece, as in `PIECES`. `tokenizer` is the path of a tokenizer file that executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(tokenizer)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                ids, sizes = memo.encode(data, offsets)
                keys, rows, at = part.column("doc_id").to_pylist(), [], 0
                for key, n in zip(keys, sizes):
                    own = np.append(ids[at: at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for piece, start in enumerate(range(0, len(own), CAPACITY)):
                        cut = own[start: start + CAPACITY]
                        rows.append((key, piece, start, len(cut), zlib.crc32(cut.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Lane:
    """Best-fit over a bounded number of open sequences."""

    def __init__(self, lane: int, capacity: int = CAPACITY, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.next = lane << 32
        self.spaces = 0  # bit f: some open sequence has f free places
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fit = self.spaces >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            sequence = self.open[free].pop()
            self.count -= 1
            if not self.open[free]:
                self.spaces &= ~(1 << free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.open[left].append(sequence)
            self.spaces |= 1 << left
            self.count += 1
            if self.count > self.most:
                low = (self.spaces & -self.spaces).bit_length() - 1
                self.open[low].pop()
                self.count -= 1
                if not self.open[low]:
                    self.spaces &= ~(1 << low)
        return sequence, self.capacity - free


def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in lane order with sequence_id and offset added."""
    lane, current = None, None
    for batch in batches:
        found = []
        for key, length in zip(batch.column("lane").to_pylist(), batch.column("length").to_pylist()):
            if key != current:
                lane, current = Lane(key), key
            found.append(lane.place(length))
        names = [n for n in batch.schema.names if n != "lane"]
        sequence, offset = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            [*names, "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = written(spark, token_pieces(docs, tokenizer), "pieces")
    tokens = pieces.agg(F.sum("length")).collect()[0][0] or 0
    lanes = max(1, -(-tokens // (CAPACITY * LANE_SEQUENCES)))
    lane = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)).alias("lane")
    dealt = pieces.select("*", lane).repartition(lanes, "lane").sortWithinPartitions("lane", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")
