"""Similarity join on word shingles with prefix filters under several token orders.

Texts with the same shingles become one node, so copies cost nothing further.
Two sets can only be similar if their prefixes share enough tokens under *every*
global order of tokens.  That filters nodes first, then pairs:

1. order 1 (by hash): a node stays if enough tokens of its prefix are found in
   another node's prefix; only these prefixes are shuffled.
2. order 2 (by another hash): the same among those left.
3. rarest first: the tokens that remain in order 1, by their number of nodes;
   similar nodes share one of their rarest tokens, their keys.
4. A pair that shares a key must share enough prefix tokens under order 1 and
   under order 2 as well; only pairs that pass all filters are verified on the
   whole sets, which are made for the nodes that are left alone.

Among the nodes of a key, a parity sketch of each set bounds the difference of
two sets from below, so that most pairs that can't be similar are never made.
First each node is held against a few leaders of its keys; that joins large
groups of near copies in linear work.  Then the nodes of a key that aren't
connected yet are held against each other, in blocks of bounded size: once for
pairs that would connect what isn't, a forest; and once more for all pairs
between what is still not connected.  Pairs within a group that is connected are
never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import discard, materialise, written
from verdigris.llm.components import connected
from verdigris.llm.shingles import WordHashes, mix, shingle_set

#: Nodes of a block, when a key has more.
BLOCK = 4000
#: Bytes up to which the list of wanted texts (40 each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_HASHES = WordHashes()


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with any similar set."""
    return -(-percent * n // 100)


def shared(n: int, percent: int) -> int:
    """Prefix tokens that a set of n shingles and a similar one of no more share at least, for prefixes of prefix_size."""
    return 1 + (n - needed(n, percent)) // 2


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + shared(n, percent))


def sure(n: int, percent: int) -> int:
    """Prefix tokens that a set of n shingles shares with any similar set, also a smaller one."""
    return shared(needed(n, percent), percent)


def tokens(text: str | None, size: int) -> np.ndarray:
    """The shingles of a text with A-Z lower-cased."""
    return shingle_set(_HASHES.of((text or "").encode("utf-8", "replace").lower().split()), size)


def order2(x: np.ndarray) -> np.ndarray:
    return mix(x ^ np.uint64(0x5851F42D4C957F2D))


def _prefix2(x: np.ndarray, percent: int) -> np.ndarray:
    k = prefix_size(len(x), percent)
    return x if k >= len(x) else x[np.argpartition(order2(x), k)[:k]]


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _digest(text: Column, size: int, percent: int) -> Column:
    """n (shingles), a and b (128 bits of the set), p and q (prefixes under orders 1 and 2)."""

    @F.arrow_udf("n int, a long, b long, p array<long>, q array<long>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [tokens(t.as_py(), size) for t in texts]
        ab = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays(
            [pa.array([len(s) for s in sets], pa.int32()), pa.array(ab[:, 0]), pa.array(ab[:, 1]), _ragged([s[: prefix_size(len(s), percent)] for s in sets]), _ragged([_prefix2(s, percent) for s in sets])],
            names=["n", "a", "b", "p", "q"],
        )

    return run(text)


def _whole(text: Column, size: int) -> Column:
    """s (the set) and k (its sketch)."""

    @F.arrow_udf("s array<long>, k binary")
    def run(texts: pa.Array) -> pa.Array:
        sets = [tokens(t.as_py(), size) for t in texts]
        return pa.StructArray.from_arrays([_ragged(sets), pa.array(map(sketch, sets), pa.binary())], names=["s", "k"])

    return run(text)


def _shared(n: Column, percent: int) -> Column:
    need = F.floor((percent * n + 99) / 100)
    return (1 + F.floor((n - need) / 2)).cast("int")


def _sure(n: Column, percent: int) -> Column:
    return _shared(F.floor((percent * n + 99) / 100), percent)


def _common(nodes: DataFrame, percent: int) -> DataFrame:
    """Of nodes (node, n, p): those of whose prefix enough tokens are in another node's too; keys: the rarest, one of which a similar node has."""
    rows = nodes.select("node", F.explode("p").alias("t"))
    counts = materialise(rows.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"))
    found = rows.join(counts, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("found"))
    out = nodes.select("node", "n").join(found, "node").withColumn("sure", _sure(F.col("n"), percent)).where(F.size("found") >= F.col("sure"))
    return out.select("node", "n", F.slice("found.t", F.lit(1), F.size("found") - F.col("sure") + 1).alias("keys"))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of 512 to 2048 bins."""
    bits = 512 if len(s) <= 2000 else 1024 if len(s) <= 4500 else 2048
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Group:
    """The nodes of a key, or of two blocks of one, with their sketches."""

    def __init__(self, sizes: list[int], sketches: list[bytes], percent: int):
        self.n, self.percent = np.array(sizes, np.int64), percent
        self.full = [np.frombuffer(k, np.uint64) for k in sketches]
        self.short = np.zeros((len(sizes), 8), np.uint64)
        for i, k in enumerate(self.full):  # bins with the same low bits fold into one
            self.short[i] = np.bitwise_xor.reduce(k.reshape(-1, 8), axis=0)

    def may(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that the sizes and the sketches allow to be similar to node i."""
        n, m = self.n[i], self.n[others]
        least = -(-self.percent * (n + m) // (100 + self.percent))
        most = n + m - 2 * least  # tokens in one set alone
        ok = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (np.bitwise_count(self.short[i] ^ self.short[others]).sum(axis=1) <= most)
        found = others[ok]
        if len(self.full[i]) > 8 and len(found):
            found = np.array([j for j, d in zip(found.tolist(), most[ok].tolist(), strict=True) if len(self.full[j]) != len(self.full[i]) or int(np.bitwise_count(self.full[i] ^ self.full[j]).sum()) <= d], np.int64)
        return found

    def leader_links(self) -> list[tuple[int, int]]:
        """Each node, in order of size, with the first leader it may be similar to; one without becomes a leader."""
        leaders, out, small = [0], [], 0
        for i in range(1, len(self.n)):
            while small < len(leaders) and 100 * self.n[leaders[small]] < self.percent * self.n[i]:
                small += 1
            found = self.may(i, np.array(leaders[small:], np.int64)) if small < len(leaders) else ()
            if len(found):
                out.append((i, int(found[0])))
            else:
                leaders.append(i)
        return out

    def cross_links(self, labels: np.ndarray, blocks: np.ndarray, forest: bool) -> list[tuple[int, int]]:
        """Pairs that may be similar, of different labels, and of different blocks where there are two: all of them, or a forest that connects the labels."""
        out, two, labels = [], blocks.min() != blocks.max(), labels.copy()
        for i in range(1, len(self.n)):
            other = labels[:i] != labels[i]
            if two:
                other &= blocks[:i] != blocks[i]
            for j in self.may(i, np.flatnonzero(other)).tolist():
                if not forest:
                    out.append((i, j))
                elif labels[i] != labels[j]:
                    out.append((i, j))
                    labels[labels == labels[i]] = labels[j]
        return out


def _candidates(rows: DataFrame, percent: int, step: str) -> DataFrame:
    """Pairs a > b of nodes for a step (leaders, forest or all), from rows (t, i, j, block, label, node, n, k) in which those of the same t, i, j come in a row."""

    def pairs(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        group = _Group([x[5] for x in held], [x[6] for x in held], percent)
        got = group.leader_links() if step == "leaders" else group.cross_links(np.array([x[3] for x in held]), np.array([x[2] for x in held]), step == "forest")
        nodes = [x[4] for x in held]
        return [(max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, out = None, [], set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("t", "i", "j", "block", "label", "node", "n", "k")), strict=True):
                key = row[:3]
                if key != here:
                    out.update(pairs(held))
                    here, held = key, []
                held.append(row[1:])
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])
            out = set()
        out.update(pairs(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    # a forest of each key in another order: where sketches mislead one, others still connect the same nodes
    order = F.xxhash64("t", "node") if step == "forest" else F.col("n")
    placed = rows.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", order, "node").select("t", "i", "j", "block", "label", "node", "n", "k")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _agree(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough tokens under order 1 and under order 2; prefixes has node, n, p, q."""
    one = lambda x: prefixes.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "p", "q")))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    least = _shared(F.least("na", "nb"), percent)
    return both.where((F.size(F.array_intersect("pa", "pb")) >= least) & (F.size(F.array_intersect("qa", "qb")) >= least)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _links(keys: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar nodes; keys has node, n, keys."""
    links_of = lambda pairs: materialise(_verified(materialise(_agree(pairs, prefixes, percent)), sets, percent))
    own = keys.join(sets.select("node", "k"), "node").select("node", "n", "k", F.explode("keys").alias("t"))
    counts = materialise(keys.select(F.explode("keys").alias("t")).groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("c")).where("c > 1").drop("c"))
    own = own.join(counts, "t").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    near = materialise(_candidates(own.select("t", F.col("block").alias("i"), F.lit(0).alias("j"), "block", F.lit(0).cast("long").alias("label"), "node", "n", "k"), percent, "leaders"))
    first = links_of(near)

    tested, links = near, first
    for step in ("forest", "all"):
        labelled = own.join(materialise(connected(links)), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = materialise(labelled.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("t"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
        rest = labelled.join(mixed, "t", "left_semi").select("t", "block", "label", "node", "n", "k", other)
        rest = rest.select("t", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "label", "node", "n", "k")
        found = materialise(_candidates(rest, percent, step).join(tested, ["a", "b"], "left_anti"))
        tested, links = tested.unionByName(found), links.unionByName(links_of(found))
    return links


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Two rows link if the Jaccard similarity of their sets of ``words``-word
    shingles, A-Z lower-cased, is at least ``percent`` / 100; that is exact.

    * A text with fewer words is one shingle; null texts and texts without words
      have none, link with nothing, and are their own component.
    * Rows without id take part like others; a component of such rows alone has a null id.
    * Repeated rows and rows that repeat an id are rows of their own; they link by their texts alone.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("i"), text.alias("text"))
    mark = written()
    whole = materialise(rows.select("doc_id", "h", "i", _digest(F.col("text"), words, percent).alias("d")).select("doc_id", "h", "i", "d.*"))
    source = F.any_value(F.struct("doc_id", "h", "i")).alias("source")
    nodes = whole.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), source, F.any_value(F.struct("p", "q")).alias("pq"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "n", "rep", "source", "pq.p", "pq.q"))
    digests = materialise(whole.select("doc_id", "n", "a", "b"))
    discard(docs.sparkSession, mark, keep=written() - mark - 1)  # the prefixes of all rows, which the nodes have now
    first = materialise(_common(nodes, percent).select("node"))
    second = materialise(_common(nodes.join(first, "node", "left_semi").select("node", "n", F.col("q").alias("p")), percent).select("node"))
    keys = materialise(_common(nodes.join(second, "node", "left_semi"), percent))
    left = nodes.join(keys.select("node"), "node", "left_semi")
    prefixes = materialise(left.select("node", "n", "p", "q"))
    # whole sets of the nodes that are left, from the text of one row each: found by id and text, so rows without id don't meet each other
    # (a table of its own, so that its size is known: the list goes to the texts unless it is large)
    wanted = materialise(left.select("node", F.col("source.doc_id").alias("w"), F.col("source.h").alias("h"), F.col("source.i").alias("i")))
    if 40 * wanted.count() <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["w"]) & (rows["h"] == wanted["h"]) & (rows["i"] == wanted["i"])).select("node", _whole(F.col("text"), words).alias("x"))
    sets = materialise(texts.select("node", "x.s", "x.k").dropDuplicates(["node"]))
    linked = connected(_links(keys, prefixes, sets, percent))
    named = nodes.select("node", "a", "b", "n", "rep").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialise(named.join(names, "label").select("a", "b", "n", "component_id"))
    out = digests.select("doc_id", "n", "a", "b").join(named, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their group of linked rows.

    Groups are those of similar_groups.  Repeated rows with such an id become
    one; rows without id stay if all rows of their group lack one, equal texts once.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    kept = materialise(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows")))
    out = docs.join(kept.select("kept_id"), docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
    return out.dropDuplicates([id_col, text_col]) if kept.where("rows > 1").limit(1).count() else out
