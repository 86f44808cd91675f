"""The prefix trie of conversations, by an LCP-aware external mergesort.

A turn (role and text) is 128 bits of hash and its length; texts are neither
shuffled nor held.  Spark deals conversations out by ranges of their sequences of
turns (equal ones by id), so that no sequence, however common, has to be in one
task.  A task sorts runs, each conversation with the number of turns that it
shares with the one before (LCP), spills them, and merges them by a loser tree,
which compares turns only beyond those known to be shared.  The merged stream
walks the trie: nodes on the path of the last conversation are open, and one that
the next conversation leaves is finished.

Nodes on the path of a range's first or last conversation may go on in another
range.  Their figures are sums, so each range hands on its part, and every seam
between two ranges takes back what both have counted.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import materialise

#: Bytes of a turn's key.
KEY = 16
#: Turns of a run, and turns that a task holds before it spills runs.
RUN, HELD = 200_000, 1_000_000
#: Finished nodes that wait for their parents', and ids of conversations that end in one node, before they are handed on.
WAITING, ENDS = 20_000, 50_000
#: Conversations read from a spilled run at once.
_READ = 200
_SIGN = np.uint64(1 << 63)
_NO_ENDS = hashlib.sha256(b"").hexdigest()

Item = tuple[bytes, int, bytes]  # keys, id, lengths as 64-bit numbers


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns, an array of (k1, k2, size): a turn's key and the code points of its text.

    * Turns are in order of their number, null first; those of one number by role, then by text.
    * Null role or text is empty; a repeated row is a turn of its own.
    * Rows without id belong to no conversation; extra columns are ignored; an empty table gives an empty result.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    key = (F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"))
    keyed = rows.select("conv_id", "turn", *key, F.length("text").cast("long").alias("size"))
    # which turns share a number is a table of its own, as their texts have to be compared
    tied = materialise(keyed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    same = [rows["conv_id"] == tied["conv_id"], rows["turn"].eqNullSafe(tied["turn"])]
    ranked = rows.join(tied, same, "left_semi").select("conv_id", "turn", "role", "text", *key)
    ranked = ranked.withColumn("tie", F.dense_rank().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).select("conv_id", "turn", "k1", "k2", "tie").distinct()
    ranked = materialise(ranked)
    on = [keyed["conv_id"] == ranked["conv_id"], keyed["turn"].eqNullSafe(ranked["turn"]), keyed["k1"] == ranked["k1"], keyed["k2"] == ranked["k2"]]
    ordered = keyed.join(ranked, on, "left").select(keyed["conv_id"], keyed["turn"], "tie", keyed["k1"], keyed["k2"], "size")
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "tie", "k1", "k2", "size")
    grouped = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["size"].alias("size"))).alias("turns"))


def grafted(conversations: DataFrame, *, stride: int = 100, most: int = 6, **columns: str) -> DataFrame:
    """The conversations as ``turns`` gives them, each begun as its stride's first one is.

    Of conversation c the first h turns (crc32 of the decimal id modulo ``most``)
    give way to the first h turns of conversation c - c % stride: all that it has,
    or none if there is no such conversation.
    """
    own = materialise(turns(conversations, **columns))
    base = own.where(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base")).join(base, "base", "left")
    start = F.slice(F.coalesce("first", F.array_compact(F.array(F.lit(None).cast(base.schema["first"].dataType.elementType)))), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences begin with, of which ``known`` are known."""
    lo, hi = known * KEY, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi // KEY
    differ = int.from_bytes(a[lo:hi], "big") ^ int.from_bytes(b[lo:hi], "big")
    return (hi - (differ.bit_length() + 7) // 8) // KEY


class Run:
    """A sorted run of conversations with their LCPs; spilled, it is read back a few at a time."""

    def __init__(self, items: list[Item]):
        items.sort()
        before = b""
        self.rows = []
        for item in items:
            self.rows.append((*item, shared(before, item[0])))
            before = item[0]
        self.file = None

    def spill(self) -> None:
        self.file = tempfile.TemporaryFile()  # has no name: gone with the task
        for i in range(0, len(self.rows), _READ):
            pickle.dump(self.rows[i : i + _READ], self.file, pickle.HIGHEST_PROTOCOL)
        self.rows = []

    def __iter__(self) -> Iterator[tuple]:
        if self.file is None:
            yield from self.rows
            return
        self.file.seek(0)
        while True:
            try:
                yield from pickle.load(self.file)
            except EOFError:
                self.file.close()
                return


def merged(runs: list) -> Iterator[tuple]:
    """Items of sorted runs in order, each (keys, id, lengths, LCP with the item before)."""
    streams = [iter(r) for r in runs]
    k = len(streams)
    heads = [next(s, None) for s in streams]
    lcp = [-1 if x is None else 0 for x in heads]  # with the last item that left; -1: the run is at its end
    tree = [0] * k  # losers by node; node 0 is the winner's

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser.  Who shares more with the last item comes first; only equals are compared, beyond what they share."""
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        if lcp[i] < 0:
            return i, j
        a, b = heads[i], heads[j]
        common = shared(a[0], b[0], lcp[i])
        if a[:2] > b[:2] if len(a[0]) == len(b[0]) == common * KEY else a[0][common * KEY : (common + 1) * KEY] > b[0][common * KEY : (common + 1) * KEY]:
            i, j = j, i
        lcp[j] = common
        return i, j

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while lcp[winner] >= 0:
        keys, name, sizes, _ = heads[winner]
        yield keys, name, sizes, lcp[winner]
        heads[winner] = after = next(streams[winner], None)
        lcp[winner] = -1 if after is None else after[3]
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def sort(items: Iterator[Item], run: int = RUN, held: int = HELD) -> Iterator[tuple]:
    """All items in order with LCPs; at most about ``held`` turns are in memory before the merge, and a part of each run in it."""
    runs, now, size, kept = [], [], 0, 0
    for item in items:
        now.append(item)
        size += len(item[0]) // KEY + 1
        if size >= run:
            runs.append(Run(now))
            kept += size
            now, size = [], 0
            if kept >= held:
                for r in runs:
                    if r.file is None:
                        r.spill()
                kept = 0
    if now:
        runs.append(Run(now))
    yield from merged(runs)


def digests(keys: bytes) -> list[bytes]:
    """A digest of each prefix of a sequence, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(keys), KEY):
        h.update(keys[i : i + KEY])
        out.append(h.copy().digest())
    return out


class _Open:
    """A node on the path of the last conversation."""

    __slots__ = ("n", "least", "size", "children", "leaves", "saved", "ends", "waiting", "digest", "handed")

    def __init__(self, size: int, digest: bytes | None):
        self.n, self.least, self.size, self.children, self.leaves, self.saved = 0, None, size, 0, 0, 0
        self.ends, self.waiting, self.digest, self.handed = array("q"), [], digest, 0


def walk(stream: Iterator[tuple], waiting: int = WAITING, most_ends: int = ENDS) -> Iterator[dict]:
    """Rows of the trie's part in one range of sorted conversations.

    * node: finished, with parent_conv_id.
    * child: finished, but its parent, named by digest, isn't.
    * part: what this range knows of a node that may be in others.
    * ends: ids of conversations that end in such a node, in order.
    * edge: the range's first and last conversation.
    """
    path: list[_Open] = []
    first = last = None
    held = 0

    def hand_on(node: _Open) -> Iterator[dict]:
        nonlocal held
        for row in node.waiting:
            yield row | {"kind": "child", "parent": node.digest}
        held -= len(node.waiting)
        node.waiting = []
        if node.ends:
            yield {"kind": "ends", "digest": node.digest, "seq": node.handed, "ids": node.ends.tobytes()}
            node.handed += 1
            node.ends = array("q")

    def mark(depth: int) -> Iterator[dict]:
        """The nodes of the path down to a depth go on elsewhere."""
        for node, digest in zip(path[: depth + 1], digests(last[0][: depth * KEY]), strict=True):
            node.digest = digest
            yield from hand_on(node)

    def close() -> Iterator[dict]:
        nonlocal held
        node, depth = path.pop(), len(path)
        parent = path[-1] if path else None
        node.saved += (node.n - 1) * node.size
        node.leaves = node.leaves or 1
        row = {"conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if node.digest is not None:
            yield from hand_on(node)
            yield row | {"kind": "part", "digest": node.digest, "parent": parent.digest if parent else None}
        else:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
            for child in node.waiting:
                yield child | {"kind": "node", "parent_conv_id": node.least}
            held -= len(node.waiting)
            parent.waiting.append(row)  # the root is on the first conversation's path, so has a digest
            held += 1
        if parent:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            if parent.digest is not None and parent.waiting:
                yield from hand_on(parent)

    for keys, name, sizes, common in stream:
        while len(path) > common + 1:
            yield from close()
        if held > waiting:
            deepest = max(d for d, node in enumerate(path) if node.waiting)
            yield from mark(deepest)
        if last is None:
            first = (keys, sizes)
            path += map(_Open, [0, *np.frombuffer(sizes, np.int64).tolist()], digests(keys))
        else:
            path += [_Open(s, None) for s in np.frombuffer(sizes, np.int64)[common:].tolist()]
        last = (keys, sizes)
        node = path[-1]
        node.n += 1
        node.least = name if node.least is None else min(node.least, name)
        node.ends.append(name)
        if len(node.ends) >= most_ends:
            if node.digest is None:
                yield from mark(len(path) - 1)
            else:
                yield from hand_on(node)
    if last is not None:
        yield from mark(len(path) - 1)
        while path:
            yield from close()
        yield {"kind": "edge", "first": first[0], "sizes": first[1], "last": last[0]}


_COLUMNS = {
    "kind": pa.string(), "part": pa.int64(), "seq": pa.int64(), "digest": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "ids": pa.binary(), "first": pa.binary(), "sizes": pa.binary(), "last": pa.binary(),
}
_SCHEMA = ", ".join(f"{k} {'long' if t == pa.int64() else t}" for k, t in _COLUMNS.items())
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def _batches(rows: Iterator[dict], part: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(held) if k == "part" else [r.get(k) for r in held], t) for k, t in _COLUMNS.items()], names=list(_COLUMNS))

    for row in rows:
        held.append(row)
        if len(held) >= 5000 or "ids" in row:
            yield made()
            held = []
    if held:
        yield made()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[Item]:
    for batch in batches:
        lists = batch.column(1)
        flat, offsets = lists.flatten(), np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
        key = np.stack([flat.field(k).to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN for k in (0, 1)], 1).astype(">u8").tobytes()
        size = flat.field(2).to_numpy().astype(np.int64).tobytes()
        for name, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield key[a * KEY : b * KEY], name, size[a * 8 : b * 8]


def _seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges have both counted of the nodes that they share, with the sign turned."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                before, after = r["before"], r["first"]
                common = shared(before, after)
                names = digests(after[: common * KEY])
                sizes = [0, *np.frombuffer(r["sizes"], np.int64)[:common].tolist()]
                twice = np.cumsum(sizes[::-1])[::-1].tolist()
                for d in range(common + 1):
                    yield {
                        "kind": "part", "digest": names[d], "parent": names[d - 1] if d else None, "depth": d, "n_convs": 0,
                        "n_children": -1 if d < common else 0, "n_leaves": -1 if len(before) == common * KEY else 0, "saved_tokens": twice[d],
                    }

    yield from _batches(rows(), 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each digest, whose pieces come in a row."""
    digest = h = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = ",".join(map(str, np.frombuffer(r["ids"], np.int64).tolist())).encode()
            if r["digest"] != digest:
                if h:
                    out.append((digest, h.hexdigest()))
                digest, h = r["digest"], hashlib.sha256()
            else:
                h.update(b",")
            h.update(text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["digest", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["digest", "ends_sha256"])


def nodes(sequences: DataFrame, *, run: int = RUN, held: int = HELD, waiting: int = WAITING, ends: int = ENDS, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns) as ``turns`` gives them.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for
    the root), n_convs (members), n_children, n_leaves (in the subtree), saved_tokens
    (over the subtree, n_convs - 1 times the code points of the node's last text),
    ends_sha256 (of the ascending comma-joined ids of the members that end here).

    * A conversation without turns is a member of the root alone.
    * Equal conversations share all nodes; without conversations there is no node.
    * A conversation is one row of 24 bytes a turn.
    """
    rows = materialise(sequences)
    by = [F.col("turns"), F.col("conv_id")]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(walk(sort(_items(batches), run, held), waiting, ends), TaskContext.get().partitionId())

    found = materialise(dealt.select("conv_id", "turns").mapInArrow(walked, _SCHEMA))
    kind = lambda name: found.where(F.col("kind") == name)
    # a row for each range: their order is that of the partitions
    edges = kind("edge").select("first", "sizes", F.lag("last").over(Window.orderBy("part")).alias("before")).where("before IS NOT NULL")
    parts = kind("part").unionByName(edges.mapInArrow(_seam, _SCHEMA))
    seam = parts.groupBy("digest").agg(F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in _SUMS))
    pieces = kind("ends").select("digest", "part", "seq", "ids").repartition("digest").sortWithinPartitions("digest", "part", "seq")
    seam = materialise(seam.join(pieces.mapInArrow(_hashed, "digest binary, ends_sha256 string"), "digest", "left"))
    names = seam.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns: list[Column | str] = ["conv_id", "depth", "parent_conv_id", *_SUMS, F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")]
    below = kind("child").drop("parent_conv_id").unionByName(seam, allowMissingColumns=True).join(names, "parent", "left")
    return kind("node").select(columns).unionByName(below.select(columns))
