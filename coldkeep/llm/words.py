"""Words and shingles of whole texts as 64-bit hashes, computed on the UTF-8 bytes of Arrow columns.

White space and punctuation used to cut words are ASCII, so bytes can be cut without
decoding. Texts are taken in chunks of about `CHUNK` bytes (a longer text is a chunk of
its own), which bounds the memory of a task whatever the batch size is.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums, so that
every word and every prefix of a word costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_STEPS = (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
          0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        made = []
        for base in (BASE, _BASE_INVERSE):
            steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U))
        if size > 8 * CHUNK:  # of one very long text: not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their text bytes, each text closed by a line feed, and the texts' offsets.

    A null text counts as empty.
    """
    texts, wide = batch.column(batch.schema.get_field_index(column)), pa.large_string()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        # only this run is copied, not the whole batch
        part = pc.fill_null(texts.slice(first, stop - first).cast(wide), "")
        part = pc.binary_join_element_wise(part, pa.scalar("", wide), pa.scalar("\n", wide))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset: part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
        yield batch.slice(first, stop - first), data, offsets - offsets[0]
        first = stop
    pa.default_memory_pool().release_unused()  # a Python worker outlives its task


class Words:
    """The words of a chunk: `start`, `end` (byte places), `doc` (row) and `hash` of each, in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, lower: bool = False):
        gap = blank[data]
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, offsets)  # of each text, with the total at the end
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.powers[: len(data)], out=self.sums[1:])
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from `start` to `end`."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, first word) of every run of k words, in text order.

        With `short`, a text with fewer words gives its whole sequence as one.
        """
        n = len(self.hash)
        if n >= k:
            whole = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1:])
            h = np.zeros(len(whole), U)
            for j in range(k):
                h += self.hash[whole + j] * U(_STEPS[j])
        else:
            whole, h = np.zeros(0, np.int64), np.zeros(0, U)
        doc = self.doc[whole]
        if short:
            count = self.count()
            few = np.flatnonzero((count > 0) & (count < k))
            if len(few):
                at = self.first[:-1][few]
                g = np.zeros(len(few), U)
                for j in range(k - 1):
                    inside = count[few] > j
                    g += np.where(inside, self.hash[np.minimum(at + j, n - 1)] * U(_STEPS[j]), U(0))
                g = g * U(_STEPS[7]) + count[few].astype(U)
                doc, h, whole = np.concatenate((doc, few)), np.concatenate((h, g)), np.concatenate((whole, at))
                order = np.argsort(doc, kind="stable")
                doc, h, whole = doc[order], h[order], whole[order]
        return doc, mix(h), whole


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, place of the first occurrence) without repetitions, by row and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new], order[new]
