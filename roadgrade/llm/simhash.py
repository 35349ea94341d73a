"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Equal fingerprints are one leaf. Two fingerprints within the radius agree on at least one of radius + 1 blocks of bits,
so each is sent to the tries of its blocks' values; a trie with too many leaves is dealt again by blocks of the bits
that are still open. In each trie pairs of nodes go down together, add up the bits in which they differ and stop
beyond the radius. A trie returns a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, per_text
from .groups import Block, Forest
from .shingle import mix

RADIUS = 3
#: Most leaves of a trie that one task joins; larger ones are dealt again.
TRIE_LEAVES = 4096
#: Up to so many pairs are compared one by one.
FEW_PAIRS = 1 << 14


def fingerprint_text(text: str, words: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without a word."""
    import xxhash

    h = xxhash.xxh64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return h(b" ".join(w), 42)
    buf = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    a, b = (end - size)[: 1 - words].tolist(), end[words - 1 :].tolist()
    return majority(np.array([h(buf[i:j], 42) for i, j in zip(a, b, strict=True)], np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def make():
        def f(ids: list, texts: list) -> dict:
            return {"doc_id": ids, "fp": np.array([fingerprint_text(t, words) for t in texts], np.uint64).view(np.int64)}

        return f

    return per_text(docs, make, "doc_id long, fp long")


def trie_links(group: np.ndarray, fp: np.ndarray, radius: int, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indices a, b) of the pairs of fingerprints of the same group within the radius.

    Rows must be sorted by (group, fp), fp unsigned and without repeats in a group. Nodes are ranges of rows.
    """
    n = len(fp)
    parent = np.arange(n)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while len(a):
            while True:  # flatten
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            a, b = parent[a], parent[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low != high
            low, high = low[keep], high[keep]
            if not len(low):
                return
            np.minimum.at(parent, high, low)
            a, b = low, high

    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    stop = np.append(edge[1:], n)
    # ones[d][i]: rows before i with bit d set, d counted from the top
    stack = [(0, edge, stop, edge, stop, np.zeros(len(edge), np.int8))] if n else []
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        small = (ah - al) * (bh - bl) <= 64
        if depth == 64:
            unite(al, bl)
            continue
        if small.any():  # few leaves: compare them
            sl, sh, tl, th = al[small], ah[small], bl[small], bh[small]
            m = th - tl
            count = (sh - sl) * m
            which = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = sl[which] + k // m[which], tl[which] + k % m[which]
            near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
            unite(i[near], j[near])
            rest = ~small
            al, ah, bl, bh, diff = al[rest], ah[rest], bl[rest], bh[rest], diff[rest]
        if not len(al):
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])  # where the ones begin
        same = (al == bl) & (ah == bh)
        nxt = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        nxt.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*nxt, strict=True))
        live = (al < ah) & (bl < bh) & (diff <= radius)
        al, ah, bl, bh, diff = (x[live] for x in (al, ah, bl, bh, diff))
        for k in range(0, len(al), room):
            stack.append((depth + 1, *(x[k : k + room] for x in (al, ah, bl, bh, diff))))
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    child = np.flatnonzero(parent != np.arange(n))
    return parent[child], child


def trie_pairs(group: np.ndarray, fp: np.ndarray, label: np.ndarray, radius: int, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (indices a < b) of rows of the same group and of different labels whose fingerprints are within the radius.

    Rows must be sorted by (group, fp), fp unsigned; equal fingerprints are allowed. Nodes are ranges of rows. A pair of
    nodes whose rows all have one label is left as soon as that shows, so what is linked already costs next to nothing.
    At most ``room`` pairs of nodes or rows are held at once.
    """
    n = len(fp)
    if not n:
        return
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.append(edge[1:], n)
    turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])  # equal at two rows: one label between them
    stack = [(0, edge, stop, edge, stop, np.zeros(len(edge), np.int8))]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        one = (label[al] == label[bl]) & (turns[al] == turns[ah - 1]) & (turns[bl] == turns[bh - 1])
        al, ah, bl, bh, diff = (x[~one] for x in (al, ah, bl, bh, diff))
        many = (ah - al) * (bh - bl)
        if depth == 64 and len(many) and many.max() > room:  # very many equal fingerprints: half of the longer side at a time
            big = many > room
            for l1, h1, l2, h2, d in zip(*(x[big] for x in (al, ah, bl, bh, diff)), strict=True):
                first = h1 - l1 >= h2 - l2
                mid = (l1 + h1) // 2 if first else (l2 + h2) // 2
                halves = [(l1, mid, l2, h2), (mid, h1, l2, h2)] if first else [(l1, h1, l2, mid), (l1, h1, mid, h2)]
                stack += [(64, *(np.array([v]) for v in half), np.array([d])) for half in halves]
            al, ah, bl, bh, diff, many = (x[~big] for x in (al, ah, bl, bh, diff, many))
        small = (many <= 64) | (depth == 64)
        at = np.flatnonzero(small)
        batch = np.cumsum(many[at]) // room if len(at) else at
        for k in np.unique(batch):
            some = at[batch == k]
            sl, tl, m, count = al[some], bl[some], (bh - bl)[some], many[some]
            which = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = sl[which] + k // m[which], tl[which] + k % m[which]
            near = (i < j) & (label[i] != label[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
            yield i[near], j[near]
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])  # where the ones begin
        same = (al == bl) & (ah == bh)
        nxt = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        nxt.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*nxt, strict=True))
        live = (al < ah) & (bl < bh) & (diff <= radius)
        al, ah, bl, bh, diff = (x[live] for x in (al, ah, bl, bh, diff))
        for k in range(0, len(al), room):
            stack.append((depth + 1, *(x[k : k + room] for x in (al, ah, bl, bh, diff))))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


#: Names of the fingerprints of ``prints``.
PRINTS = ("fp", "fp2", "fp3", "fp4")


def prints(hashes: np.ndarray) -> list[int]:
    """Four independent fingerprints of the same hashes."""
    return [majority(hashes if k == 0 else mix(hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64))) for k in range(len(PRINTS))]


#: A byte's bits as the bytes of a number, so that up to 255 numbers add up bit by bit at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def prints_of(flat: np.ndarray, sizes: np.ndarray, room: int = 1 << 16) -> np.ndarray:
    """``prints`` of sets of hashes that lie one after the other in ``flat``, a row each; sizes are positive."""
    out, end = np.empty((len(sizes), len(PRINTS)), np.uint64), np.cumsum(sizes)
    for i in np.flatnonzero(sizes > 255).tolist():
        out[i] = prints(flat[end[i] - sizes[i] : end[i]])
    few = np.flatnonzero(sizes <= 255)
    part = np.cumsum(sizes[few]) // room
    for low, high in zip(np.flatnonzero(np.append(True, part[1:] != part[:-1])), np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(few)), strict=True) if len(few) else ():
        some = few[low:high]
        n = sizes[some]
        start = np.cumsum(n) - n
        h = flat[np.repeat(end[some] - n - start, n) + np.arange(n.sum())]
        for k in range(len(PRINTS)):
            x = h if k == 0 else mix(h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64))
            counts = np.add.reduceat(_LANES[x.astype("<u8").view(np.uint8).reshape(-1, 8)], start, axis=0).view(np.uint8)
            out[some, k] = np.packbits(2 * counts.astype(np.int16) > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def near_prints(facts: DataFrame, radius: int, all_bits: int, least: int):
    """facts (id, n, what: struct of PRINTS) -> function of (a, b) that returns (a, b, equal) of the pairs of at most ``radius``
    different bits of the first fingerprint and ``all_bits`` of all, and of sizes that allow the similarity (hundredths)."""

    def near(pairs: DataFrame) -> DataFrame:
        for c, x in (("a", "x"), ("b", "y")):
            pairs = pairs.join(facts.select(F.col("id").alias(c), F.struct("n", "what").alias(x)), c)
        bits = [F.bit_count(F.col(f"x.what.{c}").bitwiseXOR(F.col(f"y.what.{c}"))) for c in PRINTS]
        found = pairs.withColumn("bits", sum(bits)).filter((bits[0] <= radius) & (F.col("bits") <= all_bits))
        return found.filter(100 * F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")).select("a", "b", (-F.col("bits")).alias("equal"))

    return near


def print_edges(radius: int, all_bits: int):
    """Function of a block whose rows carry fingerprints: what joins the ids of every pair as near as that, by a trie join."""

    def near(block: Block, every: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = int(block.own.sum())
        if left * (len(block.own) - left) <= FEW_PAIRS:  # too few for a trie
            for i, j in block.pairs(FEW_PAIRS):
                keep = np.bitwise_count(every[0][i] ^ every[0][j]) <= radius
                yield i[keep], j[keep]
            return
        order = np.argsort(every[0], kind="stable")
        for i, j in trie_pairs(np.zeros(len(order), np.int64), every[0][order], block.label[order], radius):
            i, j = order[i], order[j]
            i, j = np.where(block.own[i], i, j), np.where(block.own[i], j, i)
            keep = block.own[i] & ~block.own[j]
            i, j = i[keep], j[keep]
            keep = block.compared(i, j)
            yield i[keep], j[keep]

    def edges(block: Block) -> pa.RecordBatch:
        every, forest = [np.asarray(block.what.field(k)).view(np.uint64) for k in range(len(PRINTS))], Forest(len(block.ids))
        for i, j in near(block, every):
            keep = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in every) <= all_bits
            forest.join(block.id[i[keep]], block.id[j[keep]])
        return forest.edges_of(block.ids)

    return edges


def links(distinct: DataFrame, radius: int = RADIUS, leaves: int = TRIE_LEAVES) -> DataFrame:
    """(fp) without repeats -> (a, b): links that join every fingerprint with all that it reaches within the radius."""
    blocks = radius + 1

    def deal(df: DataFrame, bits: int) -> DataFrame:
        """Each row once for each block of its open bits: a key of the block and its value, and the bits still open."""
        cuts = [bits * k // blocks for k in range(blocks + 1)]
        out = []
        for k in range(blocks):
            low, wide = cuts[k], cuts[k + 1] - cuts[k]
            value = F.shiftrightunsigned("open", low).bitwiseAND((1 << wide) - 1)
            under = F.col("open").bitwiseAND((1 << low) - 1) if low else F.lit(0).cast("long")
            above = F.shiftleft(F.shiftrightunsigned("open", low + wide), low) if low + wide < 64 else F.lit(0).cast("long")
            out.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), above.bitwiseOR(under).alias("open")))
        dealt = df.select("fp", F.explode(F.array(*out)).alias("x"))
        return dealt.select("fp", F.col("x.key").alias("key"), F.col("x.open").alias("open"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            fp = np.asarray(lists.flatten()).view(np.uint64)
            size = np.diff(np.asarray(lists.offsets))
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((fp, group))
            fp = fp[order]
            a, b = trie_links(group, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    rows, bits, found = deal(distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("open")), 64), 64, None
    while True:
        bits -= -(-bits // blocks)
        sizes = rows.groupBy("key").count()
        hot = cut(sizes.filter(F.col("count") > leaves).select("key")) if bits >= blocks else None
        again = hot is not None and not hot.isEmpty()
        now = rows.join(hot, "key", "left_anti") if again else rows
        tries = now.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        out = tries.mapInArrow(join, "a long, b long")
        found = out if found is None else found.union(out)
        if not again:
            return found
        rows = cut(deal(rows.join(hot, "key", "left_semi"), bits))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, leaves: int = TRIE_LEAVES) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links of at most ``radius`` differing bits), n_same.

    Only distinct fingerprints are linked. Null and empty texts have fingerprint zero and link like any other; a
    repeated doc_id keeps its rows; no documents give no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same"))
    classes = cut(classes)
    found = components(links(classes.select("fp"), radius, leaves))
    # the least doc_id of each component, then of each fingerprint
    labelled = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", "n_same", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(least, "component").select("fp", "component_id", "n_same")
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id", "n_same")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
