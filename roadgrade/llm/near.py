"""SimHash near-dedup of documents: Jaccard similarity of five-word shingles of 0.8 and more, verified exactly.

Equal shingle sets are one from the start. Each set has a SimHash of its shingles; sets are candidates if a binary trie
self-join finds their fingerprints within RADIUS bits. At similarity 0.8 fingerprints of 64 bits differ in about 10 bits
and hardly ever in over 22, and four fingerprints together hardly ever in over 68 (15 of 10,000 simulated pairs of sets of
five shingles, 10 of larger ones at most), while at similarity 0.33 ninety-nine in a hundred pairs do. That is too many for tries dealt by blocks of bits, so tries are dealt by BANDS bands of WIDE MinHashes, of which sets of that similarity share one
with probability 0.9998. ``groups`` deals the sets of a band to tries of bounded size, those of large bands by FURTHER pairs
of MinHashes first (of which sets of that similarity share one with probability 0.9999999), and verifies by whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, per_text, picked, stored
from .groups import GROUP, Sets
from .shingle import Hasher, grams, mix
from .simhash import PRINTS, near_prints, print_edges, prints

#: Least similarity, as a fraction in whole numbers.
SHINGLE, OVER, UNDER = 5, 4, 5
RADIUS, ALL_BITS = 22, 68
BANDS, WIDE, FURTHER = 12, 3, 16
_FACTORS = mix(np.arange(1, 1 + BANDS * WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(docs: DataFrame, whole: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """row, set_id (hash of the distinct shingles), n (how many), and part, all of them; or their SimHashes, bands and further keys.

    A text of fewer than five words is one shingle; one without a word has none, and no bands.
    """

    def make():
        import xxhash

        hash_words = Hasher()

        def f(ids: list, texts: list) -> dict:
            words, edge, _ = hash_words(texts)
            h5 = grams(words, SHINGLE)
            sets = [np.unique(h5[a : b - SHINGLE + 1] if b - a >= SHINGLE else grams(words[a:b], b - a) if b > a else words[:0]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
            n = np.array([len(h) for h in sets], np.int32)
            out = {"row": ids, "set_id": np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64), "n": n}
            if whole:
                return out | {"part": [h.view(np.int64) for h in sets]}
            bands, more = [[]] * len(sets), [[]] * len(sets)
            some = np.flatnonzero(n)
            if len(some):
                flat, start = np.concatenate(sets), np.cumsum(n[some]) - n[some]
                least = [np.minimum.reduceat(flat * a, start) for a in _FACTORS]
                keys = np.stack([mix(sum((mix(least[WIDE * j + r] + np.uint64(r)) for r in range(WIDE)), np.uint64(j))) for j in range(BANDS)], axis=1).view(np.int64)
                pairs = [mix(mix(least[j]) + mix(least[j + FURTHER] + np.uint64(j))) for j in range(FURTHER)]
                for k, row, further in zip(some.tolist(), keys, np.stack(pairs, axis=1).view(np.int64), strict=True):
                    bands[k], more[k] = row, further
            fps = np.array([prints(h) for h in sets], np.uint64).view(np.int64).reshape(-1, len(PRINTS))
            return out | dict(zip(PRINTS, fps.T, strict=True)) | {"bands": bands, "more": more}

        return f

    also_ = "".join(f", {docs.schema[c].name} {docs.schema[c].dataType.simpleString()}" for c in also)
    return per_text(docs, make, f"row long, set_id long, n int, {'part array<long>' if whole else ', '.join(f'{c} long' for c in PRINTS) + ', bands array<long>, more array<long>'}{also_}", "row", "text", also)


def _groups(docs: DataFrame, group: int) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, first: (no_id, doc_id, row) of the least document reachable over pairs of
    similarity 0.8 and more; those without doc_id come last, equal ones in the order of rows."""
    all_ = stored(_sets(docs, False, ("doc_id",)))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    firsts = [F.first(c).alias(c) for c in ("n", *PRINTS, "bands", "more")]
    sets = stored(all_.groupBy("set_id").agg(order.alias("first"), *firsts))
    facts = sets.select(F.col("set_id").alias("id"), "n", F.struct(*PRINTS).alias("what"), "more")

    def whole(ids: DataFrame) -> DataFrame:
        rows = stored(sets.select(F.col("set_id").alias("id"), F.col("first.row").alias("row")).join(ids, "id").select("row"))
        return stored(_sets(picked(docs, rows, "row", "left_semi"), True).select(F.col("set_id").alias("id"), F.col("part").alias("what")))

    linked = Sets(facts, whole, near_prints(facts, RADIUS, ALL_BITS, 100 * OVER // UNDER), print_edges(RADIUS, ALL_BITS), 100 * OVER // UNDER, group)
    found = linked.components(sets.select(F.explode("bands").alias("key"), F.lit(-1).alias("last"), F.col("set_id").alias("id")))
    labelled = sets.join(found, sets.set_id == found.node, "left").select("set_id", "first", F.coalesce("component", "set_id").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("first"))
    of_set = labelled.select("set_id", "component").join(least, "component").select("set_id", "first")
    return all_.select("row", "doc_id", "set_id").join(of_set, "set_id").select("row", "doc_id", "first")


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable over pairs of documents of similarity 0.8 and more.

    Texts without a word, null ones too, count as equal. Rows without doc_id are left out; a repeated doc_id keeps its
    rows; empty tables give no rows; other columns are ignored.
    """
    rows = docs.filter("doc_id is not null").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return _groups(rows, group).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id.

    Each row is a document, so of repeated rows one stays. Rows without doc_id come after all others and stay where their
    group has no doc_id. Null, empty and blank texts are equal: one of them stays. Extra columns stay, whatever their
    names; an empty table stays empty. docs must give the same rows in the same partitions whenever it is read.
    """
    rows, row = numbered(docs)
    found = _groups(rows.select("doc_id", "text", F.col(row).alias("row")), GROUP)
    gone = cut(found.filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)))
    return picked(rows, gone, row, "left_anti").select([docs[c] for c in docs.columns])
