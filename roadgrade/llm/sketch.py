"""Near-dedup by fast similarity sketches: every coordinate is filled in few rounds, then banding and exact verification.

A set's sketch has T coordinates. In round i < T each element goes to one hashed bin; in round T + j all go to bin j. A bin
keeps the least value of the first round that reached it, and the rounds end when all bins are full: for n elements after
about T log T / n rounds. Equal coordinates estimate the Jaccard similarity with the concentration of T independent draws.

Bands of WIDE coordinates give candidates, which ``groups`` compares by their sketches and verifies by whole sets. A pair of
similarity 0.85 shares no band with probability 7e-9, fewer than two with 2e-7 and fewer than three with 2e-6: the share
that band values of more than GROUP sets in several components can lose at the first and second dealing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, picked, stored
from .groups import GROUP, Block, Forest, Sets
from .shingle import Hasher, grams, mix

SHINGLE = 3
#: Least similarity in hundredths.
LEAST = 85
BANDS, WIDE = 32, 5
T = BANDS * WIDE
#: Least equal coordinates of a pair that is verified: similarity 0.85 gives 136 of 160 with a deviation of 4.5 at most.
EQUAL = 112
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches (rows of T 64-bit values) of sets of hashes that lie one after the other in ``flat``; sizes are positive."""
    count = len(sizes)
    out = np.full(count * T, np.iinfo(np.uint64).max, np.uint64)
    of, live = np.repeat(np.arange(count), sizes), np.arange(count)
    for i in range(2 * T):
        h = mix(flat ^ _SEEDS[i])
        place = (h >> np.uint64(48)).astype(np.int64) * T >> 16 if i < T else i - T
        # rounds are the highest bits: what an earlier one has put stays
        np.minimum.at(out, of * T + place, (np.uint64(i) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)))
        empty = (out.reshape(count, T)[live] == np.iinfo(np.uint64).max).any(axis=1)
        if not empty.all():
            live = live[empty]
            if not len(live):
                break
            keep = np.isin(of, live)
            flat, of = flat[keep], of[keep]
    return out.reshape(count, T)


def _set_id(hashes: np.ndarray) -> bytes:
    """126 bits as a decimal's sixteen bytes, so that sets can be told apart and ordered by one number."""
    import xxhash

    return (int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes()), "little") >> 2).to_bytes(16, "little")


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, set_id, n, and part (the distinct shingles' hashes) or sketch (the low 16 bits of each coordinate).

    A text of fewer than three words is one shingle; one without words has none, and an empty sketch.
    """

    def make():
        hash_words = Hasher()

        def f(ids: list, texts: list) -> dict:
            words, edge, _ = hash_words(texts)
            h3 = grams(words, SHINGLE)
            sets = [np.unique(h3[a : b - SHINGLE + 1] if b - a >= SHINGLE else grams(words[a:b], b - a) if b > a else words[:0]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
            n = np.array([len(h) for h in sets], np.int64)
            keys = pa.Array.from_buffers(pa.decimal128(38, 0), len(sets), [None, pa.py_buffer(b"".join(map(_set_id, sets)))])
            out = {"doc_id": ids, "set_id": keys, "n": n}
            if whole:
                return out | {"part": [h.view(np.int64) for h in sets]}
            rows: list[bytes] = [b""] * len(sets)
            some = np.flatnonzero(n)
            if len(some):
                for k, row in zip(some.tolist(), sketches(np.concatenate(sets), n[some]).astype("<u2"), strict=True):
                    rows[k] = row.tobytes()
            return out | {"sketch": rows}

        return f

    return per_text(docs, make, f"doc_id long, set_id decimal(38,0), n long, {'part array<bigint>' if whole else 'sketch binary'}")


def _alike(n1: Column, n2: Column) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n1, n2) >= LEAST * F.greatest(n1, n2)


def _band(k: int) -> Column:
    return F.xxhash64(F.lit(k), F.substring("sketch", 2 * WIDE * k + 1, 2 * WIDE))


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, s1, s2) -> (a, b, equal): how many coordinates are equal."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, T) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).sum(axis=1).astype(np.int32))], names=["a", "b", "equal"])


def _near_edges(block: Block) -> pa.RecordBatch:
    sketch = np.frombuffer(b"".join(block.what.to_pylist()), "<u2").reshape(-1, T)
    forest = Forest(len(block.ids))
    for i, j in block.pairs(1 << 16):
        near = (sketch[i] == sketch[j]).sum(axis=1) >= EQUAL
        forest.join(block.id[i[near]], block.id[j[near]])
    return forest.edges_of(block.ids)


def _sets_of(docs: DataFrame, classes: DataFrame, group: int) -> Sets:
    """(doc_id, text), (set_id, n, sketch, doc_id of one of its rows)"""

    def whole(ids: DataFrame) -> DataFrame:
        """The sets of ids, made anew from the texts of those rows."""
        wanted = stored(ids.join(classes.select(F.col("set_id").alias("id"), "doc_id"), "id"))
        named = picked(docs, wanted.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
        # a class all of whose rows lack a doc_id is found by its set alone
        sets = _sets(named.select("doc_id", "text").union(docs.filter("doc_id is null").select("doc_id", "text")), True).withColumnRenamed("set_id", "id")
        return stored(picked(sets, wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", F.col("part").alias("what")))

    def near(pairs: DataFrame) -> DataFrame:
        for c, n, s in (("a", "n1", "s1"), ("b", "n2", "s2")):
            pairs = pairs.join(classes.select(F.col("set_id").alias(c), F.col("n").alias(n), F.col("sketch").alias(s)), c)
        found = pairs.filter(_alike(F.col("n1"), F.col("n2"))).select("a", "b", "s1", "s2")
        return found.mapInArrow(_equal, "a decimal(38,0), b decimal(38,0), equal int").filter(F.col("equal") >= EQUAL)

    bands = F.array(*[_band(k) for k in range(BANDS)])
    return Sets(classes.select(F.col("set_id").alias("id"), "n", F.col("sketch").alias("what"), bands.alias("more")), whole, near, _near_edges, LEAST, group)


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable over pairs of documents that share 85 % of their distinct
    three-word shingles (A-Z in lower case).

    Texts without words, null ones too, have no shingles and are linked with nothing; a text of one or two words is one
    shingle. Each row is a document: a repeated doc_id keeps its rows. Rows without doc_id link others, but have no
    component_id unless they reach a row that has one. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    all_ = stored(_sets(docs, False))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    classes = all_.filter("n > 0").groupBy("set_id").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select("set_id", "n", "sketch", "first.doc_id"))
    sets = _sets_of(docs, classes, group)
    found = sets.components(sets.facts.select(F.posexplode("more").alias("last", "key"), "id").select("key", "last", "id"))
    labelled = classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = all_.join(labelled.join(least, "component").select("set_id", "component_id"), "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with kept: whether the row has its component's id; rows without doc_id are kept."""
    return near_duplicates(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
