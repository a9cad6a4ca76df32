"""Suffix-array dedup: every byte goes that a string of `SPAN` bytes covers which also starts in an earlier document.

Earlier means a smaller doc_id. Strings are judged on the input, overlaps count, matches never cross texts.

1. Texts equal to one of a smaller doc_id go whole (if not shorter than `SPAN`); one text of each group goes on.
2. Which suffixes matter. Of all `SEED`-byte strings within `SPAN` bytes the one with the least hash is
   an anchor, so two texts with a string of `SPAN` bytes in common have an anchor of it in
   common, at the same place. Anchors that only one text has are left out; what is left is a sparse suffix array.
3. Merge sort. Each task sorts the suffixes at its anchors (`SPAN` bytes, with the bytes before them)
   into runs, in which equal contexts are one entry, of the smallest doc_id; the others are decided at once. Runs are
   front-coded (length of the common prefix with the entry before, then the rest), cut by the anchor's hash into parts, and
   exchanged. A part is merged by a loser tree that knows the common prefix of every loser with the last winner: it compares
   these lengths, and bytes only after them.
4. In merged order the suffixes of an anchor are adjacent. For every place of the anchor in the string, the smallest
   doc_id per string tells which strings repeat an earlier one. The spans of a text are united and cut out.

Parts are made small by number, from the count of suffixes. Per task, an anchor that many texts share is
sent to the count of step 2 once.

Defined results: null is empty; texts shorter than `SPAN` stay whole; rows without doc_id stay whole and remove nothing elsewhere;
rows that repeat a doc_id do not remove each other; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import joined_with
from coldkeep.llm.words import U, chunks, mix, signed, _power_tables
from coldkeep.session import written

SPAN, SEED = 50, 16
BEFORE = SPAN - SEED  # bytes before an anchor that a string can hold
RUN = 300_000
PART = 150_000
_COMBINE = 3_000_000
_BATCH = 40_000
_TOP = U(0xFFFFFFFFFFFFFFFF)


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` entries."""
    have = 1
    while 2 * have <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    return pick(a[: len(a) - (width - have)], a[width - have:]) if width > have else a


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the anchors of the texts of a chunk (each text is followed by one byte that is not its own)."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    powers, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers[:n], out=sums[1:])
    h = mix((sums[SEED:] - sums[:-SEED]) * inverse[: n + 1 - SEED]) | U(1)
    width = SPAN - SEED + 1
    low = _slide(h, width, np.minimum)  # of the string at each place
    stop = np.repeat(offsets[1:] - 1, np.diff(offsets))
    low[np.arange(len(low)) + SPAN > stop[: len(low)]] = U(0)
    around = np.zeros(len(low) + 2 * (width - 1), U)
    around[width - 1: width - 1 + len(low)] = low
    place = np.flatnonzero(_slide(around, width, np.maximum)[: len(h)] == h)
    return np.searchsorted(offsets, place, "right") - 1, place, h[place]


def _text_hash(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.lit(3))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(text, anchor), both as hashes, of anchors that at least two different texts have; copies may repeat one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        texts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, text = np.concatenate(keys), np.concatenate(texts)
            keys.clear()
            texts.clear()
            order = np.lexsort((text, key))
            key, text = key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            other = new.copy()
            other[1:] |= text[1:] != text[:-1]
            key, text, new = key[other], text[other], new[other]
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(key))) > 1
            told = np.repeat(several, np.diff(np.append(first, len(key))))  # decided here
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate((key[first], mix(text[told].view(U)))))), pa.array(np.concatenate((text[first], text[told]))),
                 pa.array(signed(np.concatenate((np.zeros(len(first), U), key[told]))))], ["key", "text", "anchor"])

        for batch in batches:
            for part, data, offsets in chunks(batch):
                row, _, h = anchors(data, offsets)
                keys.append(h)
                texts.append(part.column("hash").to_numpy()[row])
                if sum(map(len, keys)) > _COMBINE:
                    yield out()
        if keys:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_text = None  # the last anchor, and its text while it is the only one
        for batch in batches:
            key, text, anchor = (batch.column(c).to_numpy() for c in ("key", "text", "anchor"))
            made = anchor != 0
            out_text, out_anchor = [text[made]], [anchor[made]]
            key, text = key[~made], text[~made]
            if len(key):
                if held is not None and held_text is not None and key[0] == held:
                    key, text = np.append(held, key), np.append(held_text, text)
                    joined = False
                else:
                    joined = held is not None and key[0] == held
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                several = np.zeros(len(first), bool)
                differs = text != text[first][group]
                several[group[differs]] = True
                if joined:
                    several[0] = True
                told = several[group]
                out_text.append(text[told])
                out_anchor.append(key[told])
                held, held_text = key[-1], None if several[-1] else text[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_text)), pa.array(np.concatenate(out_anchor))], ["text", "anchor"])

    rows = docs.select("text", _text_hash().alias("hash")).mapInArrow(emit, "key long, text long, anchor long")
    return rows.repartition("key").sortWithinPartitions("key", "text").mapInArrow(meet, "text long, anchor long")


#: An entry besides its suffix: bytes before the anchor, how many of both are the text's own, doc_id, text, place.
_REST = np.dtype([("before", f"V{BEFORE}"), ("own_before", "u1"), ("own_after", "u1"), ("doc", "<i8"), ("text", "<u4"), ("place", "<u4")])


def _words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Byte rows as columns of big-endian integers, for sorting."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return [wide[:, i: i + 8].copy().view(">u8")[:, 0].astype(U) for i in range(0, wide.shape[1], 8)]


def front_coded(suffix: np.ndarray, rest: np.ndarray) -> bytes:
    """Sorted suffixes (rows of bytes) as common prefix lengths and remainders, with what belongs to them."""
    same = np.zeros(suffix.shape, bool)
    same[1:] = suffix[1:] == suffix[:-1]
    common = np.where(same.all(1), SPAN, np.argmin(same, 1)).astype(np.uint8)
    tails = suffix[np.arange(SPAN) >= common[:, None]]
    return zlib.compress(len(common).to_bytes(4, "little") + common.tobytes() + rest.tobytes() + tails.tobytes(), 1)


def decoded(block: bytes) -> tuple[list[int], list[bytes], np.ndarray]:
    """Common prefix lengths, suffixes and the rest of a front-coded run."""
    raw = zlib.decompress(block)
    n = int.from_bytes(raw[:4], "little")
    common = list(raw[4: 4 + n])
    rest = np.frombuffer(raw, _REST, n, 4 + n)
    at, last, suffixes = 4 + n + n * _REST.itemsize, b"", []
    for c in common:
        last = last[:c] + raw[at: at + SPAN - c]
        at += SPAN - c
        suffixes.append(last)
    return common, suffixes, rest


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(common prefix with the entry before, run, entry) in sorted order, by a loser tree.

    A node keeps the run that lost there, with its common prefix with the run that beat it.
    When the winner's run moves on, its new entry's prefix with the last winner is the run's own front coding; the losers on the path were
    beaten by that winner. So the one with the longer prefix is smaller, and bytes are compared only from equal prefixes on.
    """
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    at = [0] * k
    sizes = [len(r[1]) for r in runs] + [0] * (k - len(runs))
    common = [0] * k  # with the last winner
    loser = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's entry comes first; sets the loser's prefix with the winner."""
        if at[a] >= sizes[a] or at[b] >= sizes[b]:
            return at[a] < sizes[a] or at[b] >= sizes[b] and a < b
        if common[a] != common[b]:
            return common[a] > common[b]
        x, y, c = runs[a][1][at[a]], runs[b][1][at[b]], common[a]
        if x[c:] == y[c:]:
            first = a < b
            common[b if first else a] = SPAN
            return first
        differ = int.from_bytes(x[c:], "big") ^ int.from_bytes(y[c:], "big")
        c = SPAN - (differ.bit_length() + 7) // 8
        first = x[c] < y[c]
        common[b if first else a] = c
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win = beats(a, b)
        loser[node] = b if win else a
        return a if win else b

    winner = build(1) if k > 1 else 0
    while at[winner] < sizes[winner]:
        entry = at[winner]
        yield common[winner], winner, entry
        at[winner] = entry + 1
        if entry + 1 < sizes[winner]:
            common[winner] = runs[winner][0][entry + 1]
        node = (winner + k) >> 1
        while node:
            other = loser[node]
            if beats(other, winner):
                loser[node], winner = winner, other
            node >>= 1


def _contexts(suffix: np.ndarray, rest: np.ndarray) -> np.ndarray:
    before = np.frombuffer(rest["before"].tobytes(), np.uint8).reshape(-1, BEFORE)
    return np.concatenate((before, suffix), 1)


def repeated(suffix: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For every entry and every count of bytes before the anchor: whether that string also starts in a smaller doc_id.

    All entries of an anchor have to be there.
    """
    context = _contexts(suffix, rest)
    n, width = context.shape
    powers, inverse = _power_tables(width + 1)
    sums = np.zeros((n, width + 1), U)
    np.cumsum((context.astype(U) + U(1)) * powers[:width], axis=1, out=sums[:, 1:])
    out = np.zeros((n, BEFORE + 1), bool)
    own_before, own_after, doc = rest["own_before"].astype(int), rest["own_after"].astype(int), rest["doc"]
    for b in range(BEFORE + 1):
        have = np.flatnonzero((own_before >= b) & (own_after >= SPAN - b))
        if len(have) < 2:
            continue
        start = BEFORE - b
        h = mix((sums[have, start + SPAN] - sums[have, start]) * inverse[start])
        order = np.lexsort((doc[have], h))
        h, d = h[order], doc[have][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lowest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[have[order[d > lowest]], b] = True
    return out


def _spans(table: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text, first byte, end) of the bytes that the strings marked in `table` cover."""
    wide = np.zeros((len(table), BEFORE + 3), np.int8)
    wide[:, 1:-1] = table
    step = np.diff(wide, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    place = rest["place"].astype(np.int64)[row]
    return rest["doc"][row], rest["text"].astype(np.int64)[row], place - (high - 1), place - low + SPAN


_SPANS = "doc long, text long, low long, high long"


def _span_batch(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
    return pa.table(dict(zip(("doc", "text", "low", "high"), map(pa.array, columns))))


def _runs(parts: int):
    """Makes sorted runs: rows (part, block) with a front-coded run each, or (-1, ...) with a span decided already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            suffix, rest, hashes = (np.concatenate([k[i] for k in kept]) for i in range(3))
            kept.clear()
            before = np.frombuffer(rest["before"].tobytes(), np.uint8).reshape(-1, BEFORE)
            columns = [*_words_of(suffix), rest["own_after"], *_words_of(before), rest["own_before"]]
            order = np.lexsort((rest["place"], rest["doc"], *columns[::-1]))
            suffix, rest, hashes = suffix[order], rest[order], hashes[order]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for c in columns:
                c = c[order]
                new[1:] |= c[1:] != c[:-1]
            lowest = rest["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
            again = rest["doc"] > lowest
            every = (np.arange(BEFORE + 1) <= rest["own_before"][again][:, None]) & (
                SPAN - np.arange(BEFORE + 1) <= rest["own_after"][again][:, None])
            doc, text, low, high = _spans(every, rest[again])
            # the smallest doc_id goes on, with all its places
            suffix, rest, hashes = suffix[~again], rest[~again], hashes[~again]
            part = (hashes % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            numbers, blocks = [], []
            for i in np.flatnonzero(np.diff(cut)):
                own = order[cut[i]: cut[i + 1]]
                numbers.append(int(i))
                blocks.append(front_coded(suffix[own], rest[own]))
            n, m = len(numbers), len(doc)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array(numbers + [-1] * m, pa.int64()), pa.array(blocks + [None] * m, pa.binary()),
                *(pa.concat_arrays([nothing, pa.array(c)]) for c in (doc, text, low, high))], ["part", "block", "doc", "text", "low", "high"])

        size = 0
        for batch in batches:
            for part, data, offsets in chunks(batch):
                row, place, h = anchors(data, offsets)
                lists = part.column("anchors")
                same = part.column("hash").to_numpy() == part.column("own").to_numpy()
                pick = []
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    if same[i] and ends[i] < ends[i + 1]:
                        wanted = np.sort(lists[i].values.to_numpy().view(U))
                        own = h[ends[i]: ends[i + 1]]
                        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                        pick.append(ends[i] + np.flatnonzero(wanted[at] == own))
                pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                if not len(pick):
                    continue
                row, place, h = row[pick], place[pick], h[pick]
                padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(SPAN, np.uint8)))
                window = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + SPAN)[place]
                rest = np.zeros(len(place), _REST)
                rest["own_before"] = np.minimum(place - offsets[row], BEFORE)
                rest["own_after"] = np.minimum(offsets[row + 1] - 1 - place, SPAN)
                before, suffix = window[:, :BEFORE].copy(), window[:, BEFORE:].copy()
                before[np.arange(BEFORE) < (BEFORE - rest["own_before"].astype(int))[:, None]] = 0
                suffix[np.arange(SPAN) >= rest["own_after"].astype(int)[:, None]] = 0
                rest["before"] = np.frombuffer(before.tobytes(), f"V{BEFORE}")
                rest["doc"] = part.column("doc_id").to_numpy()[row]
                rest["text"] = (part.column("hash").to_numpy()[row].view(U) & U(0xFFFFFFFF)).astype(np.uint32)
                rest["place"] = place - offsets[row]
                kept.append((suffix, rest, h))
                size += len(place)
                if size >= RUN:
                    yield out()
                    size = 0
        if kept:
            yield out()

    return run


def _merge(rows: pa.Table) -> pa.Table:
    runs = [decoded(b.as_py()) for b in rows.column("block")]
    first = np.cumsum([0, *(len(r[1]) for r in runs)])
    rest = np.concatenate([r[2] for r in runs])
    found: list[tuple] = []
    group: list[int] = []
    suffixes: list[bytes] = []

    def decide() -> None:
        if len(group) > 1:
            suffix = np.frombuffer(b"".join(suffixes), np.uint8).reshape(-1, SPAN)
            own = rest[group]
            table = repeated(suffix, own)
            if table.any():
                found.append(_spans(table, own))
        group.clear()
        suffixes.clear()

    for common, run, entry in merged([(r[0], r[1]) for r in runs]):
        if common < SEED and len(group) >= _BATCH:
            decide()
        group.append(int(first[run]) + entry)
        suffixes.append(runs[run][1][entry])
    decide()
    return _span_batch(found)


def removed_spans(spark: SparkSession, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc, text and the byte spans [low, high) that go, of the first text of each group of equal texts."""
    shared = written(spark, shared_anchors(docs), "anchors")
    parts = max(1, -(-shared.count() // PART))
    lists = shared.groupBy("text").agg(F.collect_list("anchor").alias("anchors"))
    lists = written(spark, lists.join(firsts, lists["text"] == firsts["hash"]).select("doc_id", F.col("hash").alias("own"), "anchors"), "lists")
    size = lists.agg(F.sum(8 * F.size("anchors") + 40)).collect()[0][0] or 0
    rows = max(1, lists.count())
    texts = joined_with(docs.select("doc_id", "text", _text_hash().alias("hash")), lists, "doc_id", -(-size // rows))
    runs = written(spark, texts.mapInArrow(
        _runs(parts), "part long, block binary, doc long, text long, low long, high long"), "runs")
    merged_spans = runs.filter("part >= 0").select("part", "block").repartition(parts, "part").groupBy("part").applyInArrow(_merge, _SPANS)
    return merged_spans.unionAll(runs.filter("part < 0").select("doc", "text", "low", "high"))


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id is not null")
    long = known.filter(F.octet_length("text") >= SPAN)
    digests = written(spark, long.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), _text_hash().alias("hash")), "digests")
    firsts = written(spark, digests.groupBy("md5", "hash").agg(F.min("doc_id").alias("first")), "firsts")
    spans = removed_spans(spark, long, firsts.select(F.col("first").alias("doc_id"), "hash"))
    spans = spans.groupBy("doc", "text").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    # texts that lose something: parts, or all if an earlier text is equal
    low_hash = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low_hash")
    copies = digests.join(firsts.select("md5", "first"), "md5").filter("first < doc_id").select("doc_id", low_hash).distinct()
    cuts = written(spark, spans.select(F.col("doc").alias("doc_id"), F.col("text").alias("low_hash"), "spans").unionAll(
        copies.withColumn("spans", F.lit(None).cast("array<struct<low:bigint,high:bigint>>"))).withColumn("cut", F.lit(True)), "cuts")
    size = cuts.agg(F.sum(16 * F.coalesce(F.size("spans"), F.lit(0)) + 40)).collect()[0][0] or 0
    keyed = docs.withColumn("low_hash", _text_hash().bitwiseAND(F.lit(0xFFFFFFFF)))
    judged = joined_with(keyed, cuts, ["doc_id", "low_hash"], -(-size // max(1, cuts.count())), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("doc_id", "text", "cut", "spans"))
            for doc, text, gone, spans in zip(*columns):
                raw = (text.as_py() or "").encode()
                if spans.is_valid:
                    low, high = (spans.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(low, kind="stable")
                    united: list[list[int]] = []
                    for a, b in zip(low[order].tolist(), high[order].tolist()):
                        if united and a <= united[-1][1]:
                            united[-1][1] = max(united[-1][1], b)
                        else:
                            united.append([a, b])
                elif gone.is_valid:
                    united = [[0, len(raw)]]
                else:
                    united = []
                at, left = 0, hashlib.sha256()
                for a, b in united:
                    left.update(raw[at:a])
                    at = b
                left.update(raw[at:])
                rows.append((doc.as_py(), len(raw), sum(b - a for a, b in united), len(united), left.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return judged.select("doc_id", "text", "cut", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
