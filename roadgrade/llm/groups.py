"""Links of sets that may be similar, of groups of any size, without making pairs of them.

Sets that share a key (a band value) may be similar. The set of least id leads its key; each set is first verified against
the leader most like it, so that a large group of copies becomes one component by few links. What is left of a key in
several components is dealt again by further keys of the sets while it holds very many of them, and then compared by what
stands for each set (a sketch, fingerprints), in blocks of ``group``. From this come clusters: no pairs leave a task,
only what joins them. The whole sets of a cluster meet, once, in blocks of a bounded size, and give the verified links.
Neither sets of the component that most of a group belong to nor those of one component are compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Sets of a block of a key; elements of a block of a cluster for each of them.
GROUP, SIZE = 2000, 500
#: Keys of more blocks are dealt again (each row goes to about as many places by that), so often at most.
BLOCKS, DEALINGS = 30, 2


class Forest:
    """Components of the numbers 0 to n - 1, as far as they have been joined."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low != high
            a, b = low[keep], high[keep]
            np.minimum.at(self.root, b, a)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def edges_of(self, values: pa.Array) -> pa.RecordBatch:
        """What joins the values that the numbers stand for."""
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pa.RecordBatch.from_arrays([values.take(pa.array(self.root[child])), values.take(pa.array(child))], names=["a", "b"])


class Block:
    """A group's rows: those of a block (own) and those that they are compared with."""

    def __init__(self, rows: pa.StructArray, least: int) -> None:
        self.own, self.minor, self.n, self.hashed = (np.asarray(rows.field(c)) for c in ("own", "minor", "n", "hashed"))
        labels = rows.field("label").dictionary_encode()
        self.label, self.labels = labels.indices.to_numpy(), labels.dictionary
        # ids by their hashes, so that blocks of the same ids join them to the same one
        _, first, self.id = np.unique(self.hashed, return_index=True, return_inverse=True)
        self.ids, self.what, self.least = rows.field("id").take(pa.array(first)), rows.field("what"), least

    def compared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (i own, j not) count: of different labels and of sizes that allow the similarity. Two that stand on
        both sides meet twice, maybe in two tasks, and count once."""
        n, m = self.n[i], self.n[j]
        return (self.label[i] != self.label[j]) & (~self.minor[i] | (self.hashed[i] <= self.hashed[j])) & (100 * np.minimum(n, m) >= self.least * np.maximum(n, m))

    def pairs(self, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that count, from ``room`` at a time."""
        left, right = np.flatnonzero(self.own), np.flatnonzero(~self.own)
        step = max(1, room // max(1, len(right)))
        for s in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[s : s + step], right, indexing="ij"))
            may = self.compared(i, j)
            yield i[may], j[may]


def in_blocks(f: Callable[[Block], pa.RecordBatch], least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield f(Block(batch.column(0)[k].values, least))

    return run


def exact_links(block: Block) -> pa.RecordBatch:
    """Links that join the labels of every two whole sets that are similar."""
    _, first, at = np.unique(block.id, return_index=True, return_inverse=True)
    parts = [np.asarray(block.what[int(r)].values) for r in first]
    # an element that one set alone has is in no intersection; the others get a bit each
    _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    bit = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[which]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[bit >= 0]
    bit = bit[bit >= 0]
    bits = np.zeros((len(parts), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    forest, step = Forest(len(block.labels)), max(1, (1 << 21) // bits.shape[1])
    for i, j in block.pairs(1 << 18):
        for s in range(0, len(i), step):
            x, y = i[s : s + step], j[s : s + step]
            apart = forest.root[block.label[x]] != forest.root[block.label[y]]
            x, y = x[apart], y[apart]
            same = np.bitwise_count(bits[at[x]] & bits[at[y]]).sum(axis=1, dtype=np.int64)
            alike = 100 * same >= block.least * (block.n[x] + block.n[y] - same)
            forest.join(block.label[x[alike]], block.label[y[alike]])
    return forest.edges_of(block.labels)


@dataclass
class Sets:
    """The sets to be linked.

    facts: (id, n elements, what: stands for the set, more: array of further keys of it), one row a set. whole: (id), stored
    -> (id, what: its elements, sorted). near: (a, b) -> (a, b, equal) of those that may be similar, with how much they are
    alike. near_edges: of a block, what joins every two ids that may be similar. least: the similarity, in hundredths.
    """

    facts: DataFrame
    whole: Callable[[DataFrame], DataFrame]
    near: Callable[[DataFrame], DataFrame]
    near_edges: Callable[[Block], pa.RecordBatch]
    least: int
    group: int = GROUP

    @property
    def pair(self) -> str:
        kind = self.facts.schema["id"].dataType.simpleString()
        return f"a {kind}, b {kind}"

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) whose whole sets are similar."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        sets = self.whole(stored(pairs.select("a").union(pairs.select("b")).distinct().toDF("id")))
        # one set can stand in very many pairs: those are dealt to salts, and that set to all of them; few sets do
        often = pairs.groupBy("a").agg(F.ceil(F.count("*") / self.group).cast("int").alias("salts")).filter("salts > 1")
        often, salts = F.broadcast(often), F.coalesce("salts", F.lit(1))
        left = sets.withColumnRenamed("id", "a").join(often, "a", "left").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("what").alias("x"))
        salted = pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
        right = salted.join(sets, salted.b == sets.id).select("a", "b", "salt", F.col("what").alias("y"))
        both = right.join(left, ["a", "salt"]).select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("same"))
        return stored(both.filter(100 * F.col("same") >= self.least * (F.col("n") + F.col("m") - F.col("same"))).select("a", "b"))

    def led(self, rows: DataFrame) -> DataFrame:
        """(key, id) -> verified links of each id with the one most like it of those that lead its keys."""
        leaders = rows.groupBy("key").agg(F.min("id").alias("b"))
        near = self.near(rows.join(leaders, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
        return self.verified(near.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b")))

    def dealt(self, rows: DataFrame, what: DataFrame, size: Column, room: int) -> DataFrame:
        """(key, id, label, n), what of each id -> (rows): groups in which every two ids of one key and different labels meet,
        one of them as own. A block holds ids of ``room`` in the sum of ``size``; ids of a key's commonest label stay in theirs."""
        labels = rows.groupBy("key", "label").agg(F.sum(size).alias("c"))
        sizes = labels.groupBy("key").agg(F.sum("c").alias("many"), F.max(F.struct("c", "label")).alias("top"))
        blocks = lambda c: F.ceil(c / room).cast("int")
        sizes = sizes.select("key", F.col("top.label").alias("major"), blocks(F.col("many")).alias("blocks"), blocks(F.col("many") - F.col("top.c")).alias("others"))
        rows = rows.join(sizes.filter("others > 0"), "key").withColumn("minor", F.col("label") != F.col("major"))
        block = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int")
        upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        side = lambda own, x, y: F.struct(F.lit(own).alias("own"), x.alias("x"), y.alias("y"))
        mine = F.transform(upto("others"), lambda y: side(True, block(1, "blocks"), y))
        theirs = F.when(F.col("minor"), F.transform(upto("blocks"), lambda x: side(False, x, block(2, "others")))).otherwise(F.array().cast("array<struct<own:boolean,x:int,y:int>>"))
        out = rows.select("key", "id", "label", "minor", "n", F.explode(F.concat(mine, theirs)).alias("side")).select("key", "id", "label", "minor", "n", "side.*")
        one = F.struct("own", "minor", "n", F.xxhash64("id").alias("hashed"), "label", "id", "what")
        return out.join(what, "id").groupBy("key", "x", "y").agg(F.collect_list(one).alias("rows")).select("rows")

    def clusters(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, id, last, label) -> (key, id, label) with another key, that of a cluster: every two ids of one key and different
        labels that may be similar are in one."""
        what, edges = self.facts.select("id", "what"), None
        for k in range(DEALINGS + 1):
            many = stored(rows.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > BLOCKS * self.group).select("key")) if k < DEALINGS else None
            hot = many is not None and not many.isEmpty()
            now = (rows.join(many, "key", "left_anti") if hot else rows).select("key", "id", "label").join(self.facts.select("id", "n"), "id")
            found = self.dealt(now, what, F.lit(1), self.group).mapInArrow(in_blocks(self.near_edges, self.least), self.pair)
            edges = found if edges is None else edges.union(found)
            if not hot:
                break
            # two ids of a key meet again under each further key that they share
            again = rows.join(many, "key").join(self.facts.select("id", "more"), "id")
            further = F.filter(F.transform("more", lambda x, i: F.struct(F.xxhash64("key", x).alias("key"), i.alias("last"))), lambda x: x["last"] > F.col("last"))
            rows = again.select("id", "label", F.explode(further).alias("x")).select("x.key", "x.last", "id", "label")
            rows = stored(rows.join(_several(rows), "key"))
        of = components(edges).select(F.col("node").alias("id"), F.col("component").alias("key"))
        return of.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))

    def components(self, keyed: DataFrame) -> DataFrame:
        """(key, last, id): ids of sets that may be similar have an equal key; a key that many share is dealt again by the keys of
        ``more`` behind place ``last`` -> (node, component) of the ids that have a verified link."""
        shared = stored(keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key"))
        rows = stored(keyed.join(shared, "key"))
        links = self.led(rows)
        labels = stored(components(links).withColumnRenamed("node", "id"))
        labelled = rows.join(labels, "id", "left").select("key", "last", "id", F.coalesce("component", "id").alias("label"))
        found = self.clusters(stored(labelled.join(_several(labelled), "key")), labels)
        found = stored(found.join(self.facts.select("id", "n"), "id"))
        exact = self.dealt(found, self.whole(found.select("id")), F.col("n"), self.group * SIZE).mapInArrow(in_blocks(exact_links, self.least), self.pair)
        return components(labels.toDF("a", "b").union(exact))  # exact links are between labels


def _several(rows: DataFrame) -> DataFrame:
    """The keys with more than one label."""
    return rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
