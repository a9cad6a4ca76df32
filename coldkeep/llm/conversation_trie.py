"""Prefix trie of conversations, finished by range-partitioned shards around a skeleton of splitter paths.

1. Paths. A turn becomes 20 bytes: a digest of its role and text, and the number of its code points. A
   conversation's path is its turns' bytes one after the other, so paths sort as the trie is walked: a node, the
   conversations that end there by id, its children. Texts are not shuffled.
2. Shards. The (path, conv_id) are range-partitioned and sorted. A node that lies in two shards is a prefix of both paths
   at the splitter between them. These common prefixes are the skeleton. It is given to the shards front-coded: of each
   splitter the depth that its two sides share, as the rest of the prefix is the first path of the shard behind it and the
   last of the one in front. That is two numbers a shard, broadcast if they are counted to be few.
3. Shards work alone. One pass over the sorted paths keeps the nodes of the current path open. A node that closes is
   finished, unless it is in the skeleton: then what is known here is a partial row. All sums are
   such that they add up: a node counts as its parent's child where it begins, and as a leaf where it ends.
4. Skeleton nodes combine their partial rows by one grouping. Nodes below them get their parent's conv_id by a join.
   The ids that end at a node are hashed as they come; those of skeleton nodes, and beyond `ENDS` bytes, leave as pieces of text that are
   hashed in order afterwards, so that no list of ids is ever held.

A conversation is one row of 20 bytes a turn; equal conversations, however many, are cut by conv_id.

Defined results: null role and text are empty; turns come by turn, null first, equal ones by their digest; rows without conv_id
are left out; repeated rows are repeated turns; an empty table gives no rows, not even a root; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.llm.frames import joined_with
from coldkeep.session import small_frame, written

#: A conversation begins with the first h = crc32(id) % HEADS turns of the one whose id is cut to multiples of FAMILY.
FAMILY, HEADS = 100, 6
TURN = 20
#: Turns of a shard, and bytes of ended ids that a node holds.
SHARD_TURNS, ENDS = 1 << 20, 1 << 12

NODES = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, shard long, part long, ends string")
_NAMES = [f.split()[0] for f in NODES.split(", ")]
_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64(), pa.string()]


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path and turns of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("given"), "turn", token.alias("token")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.col("t.token").alias("own"),
        F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {HEADS} as int)").alias("h"))
    base = own.filter("conv_id = base").select("base", F.slice("own", 1, HEADS - 1).alias("first"))
    whole = own.join(base, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.expr("slice(own, h + 1, greatest(size(own) - h, 0))")).alias("all"))
    return whole.select("conv_id", F.unhex(F.array_join("all", "")).alias("path"), F.size("all").cast("long").alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // TURN


def splitter_depths(spark: SparkSession, sharded: DataFrame) -> DataFrame:
    """(shard, left, right): the turns that all paths at its left and right splitter share; -1 where there is no splitter.

    The driver holds one number a shard, then two.
    """
    edges = written(spark, sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")), "edges")
    shards = sorted(r[0] for r in edges.select("shard").collect())
    order = small_frame(spark, zip(shards[1:], shards[:-1]), T.StructType([T.StructField("shard", T.LongType()), T.StructField("before", T.LongType())]))
    sides = order.join(edges.select("shard", "first"), "shard").join(edges.select(F.col("shard").alias("before"), "last"), "before")

    def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_common(x, y) for x, y in zip(b.column("first").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(found, pa.int64())], ["shard", "depth"])

    shared = dict(map(tuple, sides.select("shard", "first", "last").mapInArrow(depth, "shard long, depth long").collect()))
    rows = [(s, shared.get(s, -1), shared.get(after, -1)) for s, after in zip(shards, [*shards[1:], None])]
    return small_frame(spark, rows, T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "left", "right")]))


class _Node:
    """An open node of the current path."""

    __slots__ = ("size", "n", "least", "children", "leaves", "saved", "begins", "key", "ends", "bytes", "hash", "part", "waiting")

    def __init__(self, size: int, begins: bool, key: bytes | None):
        self.size, self.begins, self.key = size, begins, key
        self.n = self.children = self.leaves = self.saved = self.bytes = self.part = 0
        self.least: int | None = None
        self.ends: list[str] = []
        self.hash = None  # of the ids that ended so far, if they stay here
        self.waiting: list[list] = []  # finished children that wait for this node's conv_id


class Shard:
    """One pass over the sorted paths of a shard; `rows` gathers what is finished."""

    def __init__(self, shard: int, left: int, right: int):
        self.shard, self.left, self.right = shard, left, right
        self.path, self.open, self.rows = b"", [], []

    def keys(self, path: bytes, depth: int) -> list[bytes]:
        """Names of the prefixes of up to `depth` turns."""
        h, out = hashlib.blake2b(digest_size=16), []
        for d in range(depth + 1):
            h.update(path[(d - 1) * TURN: d * TURN] if d else b"")
            out.append(h.copy().digest())
        return out

    def add(self, path: bytes, conv: int) -> None:
        if self.open:
            shared = _common(self.path, path)
            self.close(shared + 1)
            held = ()
        else:
            held = self.keys(path, self.left)  # these nodes began in an earlier shard
            self.open.append(_Node(0, not held, held[0] if held else None))
            shared = 0
        self.path = path
        for d in range(shared + 1, len(path) // TURN + 1):
            size = int.from_bytes(path[d * TURN - 4: d * TURN], "big")
            self.open.append(_Node(size, d >= len(held), held[d] if d < len(held) else None))
        node = self.open[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(str(conv))
        node.bytes += len(node.ends[-1]) + 1
        if node.bytes > ENDS:
            if node.key is None:
                node.key = self.keys(path, len(path) // TURN)[-1]
            self.flush(node)

    def flush(self, node: _Node) -> None:
        """The ids that ended at a node, as a piece of text."""
        self.rows.append([node.key, *[None] * 9, self.shard, node.part, ",".join(node.ends)])
        node.part, node.ends, node.bytes = node.part + 1, [], 0

    def close(self, keep: int, names: list[bytes] = ()) -> None:
        """Close open nodes from the deepest, until `keep` are left. Those with a name go on in the next shard."""
        while len(self.open) > keep:
            node, depth = self.open.pop(), len(self.open)
            goes_on = depth < len(names)
            if goes_on and node.key is None:
                node.key = names[depth]
            if not goes_on and not node.children and not node.leaves:
                node.leaves = 1  # all that is below a node comes after the ids that end there
            node.saved += node.size * (node.n - node.begins)
            digest = None
            if node.key is None:
                digest = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
            elif node.ends:
                self.flush(node)
            partial = node.key is not None
            for row in node.waiting:  # children that were finished before it was known what this node is
                row[1 if goes_on or not node.begins else 4] = node.key if goes_on or not node.begins else node.least
                self.rows.append(row)
            row = [node.key if partial else None, None, node.least, depth, None, node.n, node.children, node.leaves, node.saved, digest, None, None, None]
            if self.open:
                up = self.open[-1]
                up.n += node.n
                up.least = node.least if up.least is None else min(up.least, node.least)
                up.children += node.begins
                up.leaves += node.leaves
                up.saved += node.saved
                if up.begins:
                    up.waiting.append(row)
                else:
                    row[1] = up.key
                    self.rows.append(row)
            else:
                self.rows.append(row)

    def finish(self) -> None:
        self.close(0, self.keys(self.path, self.right) if self.right >= 0 else ())


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, left, right, path, conv_id) sorted by shard, path and conv_id: nodes, as in `NODES`."""
    shard: Shard | None = None
    for batch in batches:
        rows = []
        for name, left, right, path, conv in zip(*(batch.column(c).to_pylist() for c in ("shard", "left", "right", "path", "conv_id"))):
            if shard is None or shard.shard != name:
                if shard is not None:
                    shard.finish()
                    rows += shard.rows
                shard = Shard(name, left, right)
            shard.add(path, conv)
        if shard is not None:
            rows += shard.rows
            shard.rows = []
        yield _batch(rows)
    if shard is not None:
        shard.finish()
        yield _batch(shard.rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text sorted by key, shard and part: the hash of each key's pieces, joined by commas."""
    last, h = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != last:
                if last is not None:
                    done.append((last, h.hexdigest()))
                last, h = key, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield _hashes(done)
    if last is not None:
        yield _hashes([(last, h.hexdigest())])


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "digest"])


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with the counts of its subtree."""
    whole = written(spark, paths(conversations), "paths")
    turns = whole.agg(F.sum("turns") + F.count(F.lit(1))).collect()[0][0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-turns // SHARD_TURNS))
    ranged = whole.select("path", "conv_id").repartitionByRange(shards, "path", "conv_id").select("*", F.spark_partition_id().cast("long").alias("shard"))
    sharded = written(spark, ranged, "shards")
    skeleton = splitter_depths(spark, sharded)
    dealt = joined_with(sharded, skeleton, "shard", 24).repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    walked = written(spark, dealt.select("shard", "left", "right", "path", "conv_id").mapInArrow(_walked, NODES), "nodes")
    pieces = walked.filter("ends is not null").select("key", "shard", "part", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "shard", "part").mapInArrow(_hashed, "key binary, digest string")
    parts = walked.filter("key is not null and depth is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    parts = written(spark, parts.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", none)).drop("digest"), "skeleton")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = walked.filter("key is null").select("parent_key", *out).unionAll(parts.select("parent_key", *out))
    parents = parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = joined_with(nodes.filter("parent_key is not null"), parents, "parent_key", 24)
    return below.withColumn("parent_conv_id", F.col("above")).select(*out).unionAll(nodes.filter("parent_key is null").select(*out))
