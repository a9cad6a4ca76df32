"""N-gram Jaccard join by signature trees: every pair with 100 * common >= 85 * united shingles is linked.

Texts with equal shingle sets are one node. The trees are a forest, since one tree over a
corpus has upper nodes whose bitmaps are full:

1. Which nodes may meet. Sizes are cut into classes such that linked sets lie in the same or
   neighbouring classes. For a class, hashes are cut into as many ranges as linked sets can
   have differing shingles, and some more; so linked sets agree in a whole range, and in one that is not empty unless both
   have unusually many empty ranges (such sets also meet by their empty ranges). Sets that agree in
   a range are joined to its smallest member; the connected groups of these candidates are the blocks. Every link lies in one block.
2. A block's sets go to a tree once: sorted by size, `FAN` to a node, nodes to higher nodes.
   A node holds the OR of its bitmaps and its size range. Two trees (or one with itself) are walked together; a pair of nodes is dropped if
   the sizes cannot be linked, if the common bits (and bits that
   shingles share) cannot reach the overlap that the sizes ask for, or if all below is connected already. What is left at the
   sets is compared exactly.
3. Of a block over `LEAF` sets, sets go at first whose shingles are too rarely those of any other set of the block for
   a link. The others are dealt over several trees by size class and hash. The trees are walked alone, then one set
   of each connected group of each tree together, then all sets outside the block's largest connected
   group against all trees of the neighbouring size classes, in pieces of `LEAF` sets.
   Two sets of the largest group need no comparison, as they are connected.

No link between different texts is lost, no pair of one connected group is written out,
and no task holds more than two pieces. Equal keys are combined per task before the shuffle.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; fewer than four
words are one shingle; rows without doc_id have component_id null and link nothing; repeated
rows are reported each; empty tables give no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import components, joined_with
from coldkeep.llm.words import BLANK, U, Words, chunks, distinct, mix, signed
from coldkeep.session import written

#: The join links sets at 100 * common >= PERCENT * united.
WORDS, PERCENT = 4, 85
LEAF = 1024
LEAF_SHINGLES = 1 << 20
FAN = 8
#: Keys that a task combines at once.
_COMBINE = 1_000_000


class Join:
    """Shingle length and threshold, with the size classes and ranges that follow from them."""

    def __init__(self, words: int = WORDS, percent: int = PERCENT, most: int = 1 << 27):
        self.words, self.percent = words, percent
        low = [1]
        while low[-1] <= most:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low)
        last = self.low[1:] - 1
        self.partner = last * 100 // percent  # the largest set that can be linked into a class from above
        both = last + self.partner
        # a + b - 2 * common is at most this
        self.differ = both * (100 - percent) // (100 + percent)
        ranges = self.differ + 1
        for _ in range(8):
            mean = ranges * np.exp(-self.low[:-1] / ranges)
            self.spare = np.where(self.differ > 0, np.ceil(mean + 3 * np.sqrt(mean)), 0).astype(np.int64)
            ranges = self.differ + 1 + self.spare
        self.ranges = ranges

    def linked(self, a, b, common):
        return 100 * common >= self.percent * (a + b - common)

    def needed(self, a, b):
        """Least common shingles of linked sets of at least these sizes, as a lower bound."""
        return self.percent * (a + b) / (100 + self.percent)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of the texts, by row and hash, and where each row begins."""
        doc, h, _ = distinct(*Words(data, offsets, BLANK, lower=True).shingles(self.words)[:2])
        return h, np.searchsorted(doc, np.arange(len(offsets)))


def _set_ids(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set; of an empty one 0."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)))))
    n = np.diff(ends).astype(U)
    return np.where(n > 0, mix((total[ends[1:]] - total[ends[:-1]]) ^ (n * U(0x9E3779B97F4A7C15))), U(0))


def sized(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles and node (the set's hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                h, ends = join.sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(signed(_set_ids(h, ends)))], ["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def _range_keys(join: Join, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the ranges of every set, for its own size class and the one below."""
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    own = join.size_class(np.maximum(n, 1))
    weight = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(0xA0761D6478BD642F)))))
    keys, rows = [], []
    for down in (0, 1):
        cls = own - down
        takes = (n > 0) & (cls >= 0)
        cls = np.maximum(cls, 0)
        takes &= n <= join.partner[cls]
        ranges = join.ranges[cls]
        place = np.flatnonzero(takes[row])
        if not len(place):
            continue
        r = row[place]
        part = ((h[place] >> U(32)) * ranges[r].astype(U)) >> U(32)
        new = np.ones(len(place), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        after = np.append(first[1:], len(place))
        total = weight[place[after - 1] + 1] - weight[place[first]]
        r, part = r[first], part[first]
        seed = (cls[r].astype(U) << U(40)) + part
        keys.append(mix(mix(total) + seed * U(0xD6E8FEB86659FD93)))
        rows.append(r)
        # sets with more empty ranges than are spare meet by these as well
        filled = np.bincount(r, minlength=len(n))
        for i in np.flatnonzero(takes & (ranges - filled > join.spare[cls])):
            empty = np.setdiff1d(np.arange(ranges[i], dtype=U), part[r == i])
            keys.append(mix((U(int(cls[i])) << U(40)) + empty + U(1 << 63)))
            rows.append(np.full(len(empty), i))
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _starred(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and node: per key its smallest node, and links of the other nodes to it."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    other = np.ones(len(key), bool)
    other[1:] = node[1:] != node[:-1]
    first = np.flatnonzero(new)
    head = node[first][np.cumsum(new) - 1] if len(key) else node
    pick = other & ~new
    return key[first], node[first], head[pick], node[pick]


def candidates(spark: SparkSession, docs: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that join, for every range of every size class, the sets that agree in it to one of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, low, a, b = _starred(key[order], node[order])
            keys.clear()
            nodes.clear()
            ab = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate((key, mix(ab[1].view(U)))))), pa.array(np.concatenate((low, ab[0]))),
                 pa.array(np.concatenate((low, ab[1])))], ["key", "a", "b"])

        for batch in batches:
            for _, data, offsets in chunks(batch):
                h, ends = join.sets(data, offsets)
                ids = signed(_set_ids(h, ends))
                key, row = _range_keys(join, h, ends)
                keys.append(key)
                nodes.append(ids[row])
                if sum(map(len, keys)) > _COMBINE:
                    yield out()
        if keys:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_low = None
        for batch in batches:
            key, a, b = (batch.column(c).to_numpy() for c in ("key", "a", "b"))
            made = a != b
            links_a, links_b = [a[made]], [b[made]]
            key, node = key[~made], a[~made]
            if len(key):
                if last_key is not None and key[0] == last_key:
                    same = int(np.searchsorted(key != last_key, True))
                    rest = node[:same][node[:same] != last_low]
                    links_a.append(np.full(len(rest), last_low))
                    links_b.append(rest)
                    key, node = key[same:], node[same:]
                if len(key):
                    k, low, x, y = _starred(key, node)
                    last_key, last_low = k[-1], low[-1]
                    links_a.append(x)
                    links_b.append(y)
            a, b = np.concatenate(links_a), np.concatenate(links_b)
            if len(a):
                a, b = np.unique(np.stack((a, b)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    parts = docs.select("text").mapInArrow(emit, "key long, a long, b long")
    return parts.repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, "a long, b long").distinct()


class Tree:
    """Signature tree over sets of shingle hashes: levels of OR-combined bitmaps with size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        self.sets = [sets[i] for i in self.order]
        size = np.array([len(s) for s in self.sets])
        maps = np.zeros((len(sets), bits // 64), U)
        row = np.repeat(np.arange(len(sets)), size)
        at = np.concatenate(self.sets) & U(bits - 1)
        flat = np.unique(row.astype(U) * U(bits) + at)  # each bit once, so a sum is an OR
        np.add.at(maps.reshape(-1), (flat >> U(6)).astype(np.int64), U(1) << (flat & U(63)))
        shared = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, shared)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, shared = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.maximum.reduceat(shared, cut)))


def bitmap_width(sets: list[np.ndarray]) -> int:
    most = max(map(len, sets))
    return 1 << max(8, min(15, int(4 * most - 1).bit_length()))


class _Roots:
    """Union-find over the sets of a piece."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def all(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s


def tree_links(join: Join, left: Tree, right: Tree, roots: _Roots, at_left: np.ndarray, at_right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the sets of both trees as far as they are linked; places are those of `roots`."""
    one = left is right
    at_left, at_right = at_left[left.order], at_right[right.order]
    found = []
    todo = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while todo:
        i, x, j, y = todo.pop()
        maps_x, low_x, high_x, shared_x = left.levels[i]
        maps_y, low_y, high_y, shared_y = right.levels[j]
        if 100 * high_x[x] < join.percent * low_y[y] or 100 * high_y[y] < join.percent * low_x[x]:
            continue
        if not (one and i == j and x == y):
            most = int(np.bitwise_count(maps_x[x] & maps_y[y]).sum()) + min(int(shared_x[x]), int(shared_y[y]))
            if most < join.needed(int(low_x[x]), int(low_y[y])) - 1e-6:
                continue
        elif i == 0:
            continue
        if i == j == 0:
            a, b = int(at_left[x]), int(at_right[y])
            if roots.find(a) != roots.find(b):
                s, t = left.sets[x], right.sets[y]
                place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                if join.linked(len(s), len(t), int((t[place] == s).sum())):
                    roots.up[max(roots.find(a), roots.find(b))] = min(roots.find(a), roots.find(b))
                    found.append((a, b))
            continue
        span_x, span_y = FAN ** i, FAN ** j
        under = np.concatenate((at_left[x * span_x: (x + 1) * span_x], at_right[y * span_y: (y + 1) * span_y]))
        r = roots.all(under)
        if (r == r[0]).all():
            continue
        if i >= j and i > 0:
            below = range(x * FAN, min((x + 1) * FAN, len(left.levels[i - 1][0])))
            if one and i == j and x == y:
                todo.extend((i - 1, c, i - 1, d) for c in below for d in below if c <= d)
            else:
                todo.extend((i - 1, c, j, y) for c in below)
        else:
            below = range(y * FAN, min((y + 1) * FAN, len(right.levels[j - 1][0])))
            todo.extend((i, x, j - 1, d) for d in below)
    return found


_LINKS = "a long, b long"


def _linked_pieces(join: Join):
    """Grouped function: rows (node, hashes, near) of one piece; near False: only met by the others."""

    def run(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        near = rows.column("near").to_numpy(zero_copy_only=False)
        _, first = np.unique(np.stack((node, near.astype(np.int64))), axis=1, return_index=True)
        hashes = rows.column("hashes")
        node, near = node[first], near[first]
        sets = [np.frombuffer(hashes[int(i)].as_py(), U) for i in first]
        out: list[tuple[int, int]] = []
        if len(sets) > 1:
            bits, roots = bitmap_width(sets), _Roots(len(sets))
            own, far = np.flatnonzero(near), np.flatnonzero(~near)
            if len(own):
                tree = Tree([sets[i] for i in own], bits)
                out = tree_links(join, tree, tree, roots, own, own)
                if len(far):
                    out += tree_links(join, tree, Tree([sets[i] for i in far], bits), roots, own, far)
        a, b = (np.array([p[i] for p in out], np.int64) for i in (0, 1))
        return pa.table({"a": node[a], "b": node[b]})

    return run


def shared_shingles(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(node, shared) of sets (node, block, hashes): at least how many of its shingles other sets of its block have.

    A linked set has `PERCENT` of its shingles in one other set, so one with fewer shared ones has no link. Shingles are
    compared by some 32 bits of their hash with the block beside the part they lie in; two that are taken
    for one only keep a set that could go. What repeats in a task's portion is counted there and
    sent once, so a shingle of every set is a row per portion.
    """
    total = sets.agg(F.sum(F.length("hashes") / F.lit(8))).collect()[0][0] or 0
    parts = max(1, -(-int(total) // _COMBINE))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        blocks: list[int] = []
        held: list[bytes] = []

        def out() -> Iterator[pa.RecordBatch]:
            size = np.array([len(x) // 8 for x in held])
            own = np.repeat(np.arange(len(held)), size)
            block = mix(np.array(blocks, np.int64).view(U))
            h = mix(np.frombuffer(b"".join(held), U) ^ block[own])
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            twice = np.repeat(times > 1, times)
            here = np.bincount(own[twice], minlength=len(held))
            # to the parts goes each shingle once, under its set, or under none if it is counted already
            owner = np.where(times > 1, len(held), own[first])
            sent = h[first]
            part = ((sent >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            order = np.lexsort((owner, part))
            sent, owner, part = sent[order].astype(np.uint32), owner[order], part[order]
            named = np.append(np.array(nodes, np.int64), 0)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
                who, count = np.unique(owner[a:b], return_counts=True)
                bare = int(count[-1]) if who[-1] == len(held) else 0
                rows.append((int(part[a]), sent[a:b].tobytes(), named[who[: len(who) - (bare > 0)]].tobytes(),
                             count[: len(who) - (bare > 0)].astype(np.int32).tobytes(), None, None))
            rows.append((None, None, None, None, named[:-1].tobytes(), here.astype(np.int64).tobytes()))
            for held_ in (nodes, blocks, held):
                held_.clear()
            kinds = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], ["part", "sent", "nodes", "counts", "done", "here"])

        weight = 0
        for batch in batches:
            for i in range(batch.num_rows):
                nodes.append(batch.column("node")[i].as_py())
                blocks.append(batch.column("block")[i].as_py())
                held.append(batch.column("hashes")[i].as_py())
                weight += len(held[-1]) // 8
                if weight > _COMBINE:
                    yield from out()
                    weight = 0
        if held:
            yield from out()

    def meet(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in rows.column("sent").to_pylist()]
        named, owner, begin = [], [], 0
        for h, who, count in zip(sent, rows.column("nodes").to_pylist(), rows.column("counts").to_pylist()):
            who, count = np.frombuffer(who, np.int64), np.frombuffer(count, np.int32)
            owner.append(np.append(np.repeat(np.arange(begin, begin + len(who)), count), np.full(len(h) - int(count.sum()), -1)))
            named.append(who)
            begin += len(who)
        h, who, node = np.concatenate(sent), np.concatenate(owner), np.concatenate(named)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        same = h[1:] == h[:-1]
        told = (np.append(same, False) | np.append(False, same)) & (who >= 0)
        count = np.bincount(who[told], minlength=len(node)) if len(node) else np.zeros(0, np.int64)
        return pa.table({"node": node[count > 0], "shared": count[count > 0].astype(np.int64)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for done, here in zip(batch.column("done").to_pylist(), batch.column("here").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(done, np.int64)), pa.array(np.frombuffer(here, np.int64))], ["node", "shared"])

    kind = "part long, sent binary, nodes binary, counts binary, done binary, here binary"
    portions = written(spark, sets.select("node", "block", "hashes").mapInArrow(emit, kind), "shared")
    told = portions.filter("part is not null").select("part", "sent", "nodes", "counts").groupBy("part").applyInArrow(meet, "node long, shared long")
    local = portions.filter("part is null").select("done", "here").mapInArrow(counted, "node long, shared long")
    return told.unionAll(local).groupBy("node").agg(F.sum("shared").alias("shared"))


def jaccard_components(spark: SparkSession, docs: DataFrame, join: Join | None = None) -> DataFrame:
    """doc_id, n_shingles, node and component_id of every row of `docs` (doc_id, text)."""
    join = join or Join()
    docs = docs.select("doc_id", "text")
    rows = written(spark, sized(docs, join), "sets")
    links = written(spark, candidates(spark, docs.filter("doc_id is not null"), join), "candidates")
    blocks = components(spark, links).withColumnRenamed("component", "block")
    nodes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    members = written(spark, blocks.join(nodes, "node"), "blocks")
    low = [int(x) for x in join.low]
    cls = F.expr(f"cast(size(filter(array({', '.join(f'{x}L' for x in low)}), x -> x <= n)) as int)")
    weights = members.groupBy("block").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w"))
    weights = weights.withColumn("large", (F.col("g") > LEAF) | (F.col("w") > LEAF_SHINGLES))
    members = members.join(weights.select("block", "large"), "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                h, ends = join.sets(data, offsets)
                same = signed(_set_ids(h, ends)) == part.column("node").to_numpy()  # a doc_id may have several texts
                raw = pa.array([h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                kept = [part.column(c) for c in ("node", "block", "large")]
                yield pa.RecordBatch.from_arrays([*kept, raw], ["node", "block", "large", "hashes"]).filter(pa.array(same))

    picked = joined_with(docs, members.select("doc_id", "node", "block", "large"), "doc_id", 32)
    sets = written(spark, picked.mapInArrow(hashed, "node long, block long, large boolean, hashes binary"), "pieces")
    # of large blocks, only sets that can be linked at all
    alive = shared_shingles(spark, sets.filter("large")).join(members, "node").filter(F.lit(100) * F.col("shared") >= F.lit(join.percent) * F.col("n"))
    alive = alive.select("node", "block", "n", cls.alias("cls"))
    per_class = alive.groupBy("block", "cls").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w")).withColumn(
        "leaves", F.greatest(F.ceil(F.col("g") / F.lit(LEAF)), F.ceil(F.col("w") / F.lit(LEAF_SHINGLES))).cast("long"))
    placed = written(spark, alive.join(per_class.select("block", "cls", "leaves"), ["block", "cls"]).select(
        "node", "cls", F.pmod(F.xxhash64("node"), F.col("leaves")).alias("leaf")), "placed")
    sets = sets.filter("not large").select("node", "block", F.lit(0).alias("cls"), F.lit(0).cast("long").alias("leaf"), "large", "hashes").unionAll(
        joined_with(sets.filter("large"), placed, "node", 24).select("node", "block", "cls", "leaf", "large", "hashes"))
    linked = _linked_pieces(join)
    own = sets.withColumn("near", F.lit(True))
    found = written(spark, own.groupBy("block", "cls", "leaf").applyInArrow(linked, _LINKS), "links")
    large = own.filter("large")
    if large.limit(1).count():
        # one set of each connected group of each tree, together
        label = components(spark, found).select("node", F.col("component").alias("part"))
        large = written(spark, large.join(label, "node", "left").withColumn("part", F.coalesce("part", "node")), "large")
        heads = large.filter("part = node")
        count = heads.groupBy("block").agg(F.count(F.lit(1)).alias("g"), F.sum(F.length("hashes") / F.lit(8)).alias("w")).withColumn(
            "shares", F.greatest(F.ceil(F.col("g") / F.lit(LEAF)), F.ceil(F.col("w") / F.lit(LEAF_SHINGLES))).cast("long")).select("block", "shares")
        dealt = heads.join(count, "block").withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")))
        found = written(spark, found.unionAll(dealt.groupBy("block", "share").applyInArrow(linked, _LINKS)), "links")
        # all sets outside the largest connected group against the trees of neighbouring classes
        label = components(spark, found).select(F.col("node"), F.col("component").alias("whole"))
        light = large.select("block", "cls", "leaf", "node", F.length("hashes").alias("bytes")).join(label, "node", "left").withColumn(
            "whole", F.coalesce("whole", "node"))
        parts = light.groupBy("block", "whole").agg(F.count(F.lit(1)).alias("g"))
        main = parts.groupBy("block").agg(F.max_by("whole", F.struct("g", "whole")).alias("main"))
        outside = light.join(main, "block").filter("whole <> main")
        pieces = outside.groupBy("block", "cls").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(LEAF)), F.ceil(F.sum("bytes") / F.lit(8 * LEAF_SHINGLES))).cast("long").alias("shares"))
        pieces = written(spark, pieces, "outside")
        outside = outside.select("node", "block", "cls").join(pieces, ["block", "cls"]).withColumn(
            "share", F.pmod(F.xxhash64("node", F.lit(2)), F.col("shares")))
        trees = light.select("block", "cls", "leaf").distinct()
        near = large.select("node", "hashes").join(outside, "node").select(
            "node", "hashes", "block", F.col("cls").alias("from"), "share", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)).alias("cls"))
        near = near.join(trees, ["block", "cls"]).select("block", "cls", "leaf", "from", "share", "node", "hashes", F.lit(True).alias("near"))
        shares = pieces.select("block", F.col("cls").alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                               ).select("*", F.explode(F.array(F.col("from") - 1, "from", F.col("from") + 1)).alias("cls"))
        far = large.select("block", "cls", "leaf", "node", "hashes").join(shares, ["block", "cls"]).select(
            "block", "cls", "leaf", "from", "share", "node", "hashes", F.lit(False).alias("near"))
        met = near.unionAll(far).groupBy("block", "cls", "leaf", "from", "share").applyInArrow(linked, _LINKS)
        found = written(spark, found.unionAll(met), "links")
    label = components(spark, found).withColumnRenamed("component", "part")
    named = nodes.select("node", "doc_id").join(label, "node")
    first = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    alone = nodes.join(label, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    whole = named.join(first, "part").select("node", "component_id").unionAll(alone)
    bare = rows.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    full = rows.filter("n_shingles > 0 and doc_id is not null").join(whole, "node").select("doc_id", "n_shingles", "node", "component_id")
    return full.unionAll(bare.select("doc_id", "n_shingles", "node", "component_id"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, join: Join | None = None) -> DataFrame:
    """The documents, with their own columns, of which one per component stays: the one with the smallest doc_id.

    Documents without doc_id stay; of rows that repeat a doc_id, those stay that have the same words.
    """
    kept = jaccard_components(spark, docs, join).filter("doc_id = component_id").select("doc_id").distinct()
    return joined_with(docs, kept, "doc_id", 16, "left_semi").unionAll(docs.filter("doc_id is null"))
