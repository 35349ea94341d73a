"""Substring dedup with a sparse suffix array over words.

Kept are the suffixes that begin at content-selected positions: the minimisers of 25-word hashes in windows of 26, of
which every run of 50 words holds one that its copies hold too. Suffixes whose 25 words occur nowhere else can match
nothing and go. The others are sorted with what follows them; the common prefixes of neighbours say which suffixes agree
in how many words to the right. Sorted once more by what precedes them, read backwards, neighbours say the same for the
words to the left; so each match is extended both ways until it has 50 words or fails. Where the suffixes of one seed
are dealt to several tasks or runs, each run sends the windows around it that it has not matched, and those are compared
between runs by hash. What is found are all passages of 50 words and more that two documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, per_text
from .shingle import Hasher, grams, minimisers, mix

LENGTH, SEED = 50, 25
#: Most rows in a row that a task compares at once; what is left of a seed with more rows is compared by windows' hashes.
RUN = 20_000
#: A seed of so many suffixes is joined by sending it to all tasks, not by moving its suffixes to one. Beyond FEW such
#: seeds, of the most frequent ones.
HOT = 2000
_SUFFIX = "seed long, right binary, left binary, doc_id long, at int"
_FOUND = "doc_id long, start int, end int, window long, low long, high long"


def _selected(hash_words: Hasher, texts: list[str], seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, seed hash) of the kept suffixes; word hashes and text edges."""
    words, edge, _ = hash_words(texts)
    h = grams(words, seed)
    which, at = [], []
    for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        if b - a >= length:
            m = minimisers(h[a : b - seed + 1], length - seed + 1)
            which.append(np.full(len(m), i))
            at.append(m)
    which = np.concatenate(which) if which else np.zeros(0, np.int64)
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return which, at, h[edge[which] + at] if len(at) else np.zeros(0, np.uint64), words, edge


def selected(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, at (word), seed (hash of the words there) of the kept suffixes."""

    def make():
        hash_words = Hasher()

        def f(ids: list, texts: list) -> dict:
            which, at, h, _, _ = _selected(hash_words, texts, seed, length)
            return {"doc_id": pa.array(ids, pa.int64()).take(pa.array(which, pa.int64())), "at": at.astype(np.int32), "seed": h.view(np.int64)}

        return f

    return per_text(docs, make, "doc_id long, at int, seed long")


def with_context(docs: DataFrame, wanted: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The wanted suffixes (doc_id, seeds) with up to length - seed words of context on either side, as 4-byte hashes."""
    side = length - seed
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_SUFFIX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words = Hasher()
        for batch in batches:
            for low in range(0, len(batch), 200):
                part = batch.slice(low, 200)
                which, at, h, words, edge = _selected(hash_words, [t or "" for t in part.column(1).to_pylist()], seed, length)
                lists = part.column(2)
                keep = np.isin(h.view(np.int64), np.asarray(lists.flatten()))
                which, at, h = which[keep], at[keep], h[keep]
                short = mix(words).astype(np.uint32)
                start, stop = edge[which], edge[which + 1]
                here = start + at
                right = [short[a:b].astype(">u4").tobytes() for a, b in zip(here + seed, np.minimum(here + length, stop), strict=True)]
                left = [short[a:b][::-1].astype(">u4").tobytes() for a, b in zip(np.maximum(here - side, start), here, strict=True)]
                ids = part.column(0).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(right, pa.binary()), pa.array(left, pa.binary()), ids, pa.array(at.astype(np.int32))], schema=arrow)

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "seeds").mapInArrow(run, _SUFFIX)


def _packed(xs: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of at most ``side`` 4-byte words, and how many words each has."""
    n = len(xs)
    size = np.fromiter(map(len, xs), np.int64, n) // 4
    flat = np.zeros((n, side), np.uint32)
    flat[np.arange(side) < size[:, None]] = np.frombuffer(b"".join(xs), ">u4")
    return flat, size


def _agree(group: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[k][row]: number of the class of rows of one group that have the same first k words; -1 for rows with fewer.

    Rows are sorted; neighbours' common prefixes tell where classes end: at length k between two that share fewer words.
    """
    n, side = flat.shape
    order = np.lexsort((*flat.T[::-1], group))
    g, x = group[order], flat[order]
    differs = x[1:] != x[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), side)
    common = np.where(g[1:] == g[:-1], common, -1)
    out = np.empty((side + 1, n), np.int64)
    for k in range(side + 1):
        out[k, order] = np.concatenate([[0], np.cumsum(common < k)])
        out[k, size < k] = -1
    return out


def matches(seed: np.ndarray, right: list[bytes], left: list[bytes], doc: np.ndarray, length: int, k: int, is_open: np.ndarray) -> tuple[tuple, tuple]:
    """(row, least and largest number of words to the left) of the runs of windows of ``length`` words around each
    row's seed that some row of another document with the same seed has too. Rows may come in any order.

    And for the open rows, whose seed may have further rows elsewhere: (row, words to the left, hash, least and largest
    document) of their distinct windows; the row is -1 where the window has its match here.
    """
    side, n = length - k, len(seed)
    (after, nr), (before, nl) = _packed(right, side), _packed(left, side)
    to_right, to_left = _agree(seed, after, nr), _agree(seed, before, nl)
    some = np.flatnonzero(is_open)
    hash_of = _window_hashes(seed[some], after[some], before[some], side) if len(some) else None
    at = np.cumsum(is_open) - 1  # a row's place among the open ones
    hit = np.zeros((side + 1, n), bool)
    left_open = []
    for o in range(side + 1):  # o words to the left, side - o to the right of the seed's
        ok = np.flatnonzero((to_left[o] >= 0) & (to_right[side - o] >= 0))
        if not len(ok):
            continue
        key = to_left[o][ok] * n + to_right[side - o][ok]
        order = np.lexsort((doc[ok], key))
        key, who, row = key[order], doc[ok][order], ok[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key)) - 1
        several = who[first] != who[last]
        each = np.repeat(several, last - first + 1)
        hit[o, row] = each
        done = np.flatnonzero(several & is_open[row[first]])
        alone = np.flatnonzero(~each & is_open[row])
        if len(done) or len(alone):
            shown = hash_of(o)
            left_open.append(
                (
                    np.append(np.full(len(done), -1), row[alone]), np.full(len(done) + len(alone), o), np.append(shown[at[row[first[done]]]], shown[at[row[alone]]]),
                    np.append(who[first[done]], who[alone]), np.append(who[last[done]], who[alone]),
                )
            )
    pad = np.zeros((1, n), np.int8)
    step = np.diff(np.concatenate([pad, hit.astype(np.int8), pad]), axis=0)
    low_row, low = np.nonzero(step.T == 1)
    _, high = np.nonzero(step.T == -1)
    still = tuple(map(np.concatenate, zip(*left_open, strict=True))) if left_open else (np.zeros(0, np.int64),) * 5
    return (low_row, low, high - 1), still


def _window_hashes(seed: np.ndarray, after: np.ndarray, before: np.ndarray, side: int):
    """Function from the words to the left to the hashes of all rows' windows; runs must agree on them."""

    def running(x: np.ndarray) -> np.ndarray:
        """Hash of the first 0, 1, .. side words."""
        out = np.zeros((side + 1, len(x)), np.uint64)
        for j in range(side):
            out[j + 1] = mix(out[j] * np.uint64(0x100000001B3) + x[:, j] + np.uint64(1))
        return out

    r, l = running(after), running(before)
    return lambda o: mix(mix(seed ^ mix(l[o] + np.uint64(7)) + r[side - o]) + np.uint64(o))


def compare(suffixes: DataFrame, length: int = LENGTH, seed: int = SEED, run_rows: int = RUN) -> DataFrame:
    """doc_id, start, end (words) of the matches; and for the windows of seeds whose rows may be dealt to several runs
    window (hash), low and high (documents), with doc_id, start and end of those that have no match in their run."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_FOUND))

    def found(t: pa.Table, head: bool, tail: bool) -> Iterator[pa.RecordBatch]:
        """head, tail: may the first, the last seed have further rows in other runs?"""
        doc, at, s = np.asarray(t["doc_id"]), np.asarray(t["at"]).astype(np.int64), np.asarray(t["seed"])
        is_open = (s == s[0]) & head | (s == s[-1]) & tail
        (row, low, high), (who, o, window, a, b) = matches(s.view(np.uint64), t["right"].to_pylist(), t["left"].to_pylist(), doc, length, seed, is_open)
        columns = [doc[row], at[row] - high, at[row] - low + length]
        yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, arrow, strict=False)] + [pa.nulls(len(row), pa.int64())] * 3, schema=arrow)
        done = who < 0
        columns = [pa.array(x, mask=done).cast(f.type) for x, f in zip([doc[who], at[who] - o, at[who] - o + length], arrow, strict=False)]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.view(np.int64)) for x in (window, a, b)]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted. What is compared at once ends between two seeds, or after run_rows rows of one seed."""
        rest, head = None, True
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            while len(rest) > run_rows:
                s = np.asarray(rest["seed"][: run_rows + 1])
                turn = np.flatnonzero(s[1:] != s[:-1])
                stop = int(turn[-1]) + 1 if len(turn) else run_rows
                yield from found(rest.slice(0, stop), head, not len(turn))
                rest, head = rest.slice(stop), not len(turn)
        if rest is not None:
            yield from found(rest, head, True)

    return suffixes.select("seed", "right", "left", "doc_id", "at").mapInArrow(run, _FOUND)


def repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, run_rows: int = RUN) -> DataFrame:
    """doc_id, spans (array of start, end in words, merged), n_spans, n_words: what documents share with others.

    A row for each doc_id that shares something. Words are split at white space, ASCII letters in lower case. Null,
    empty and short texts share nothing; rows without doc_id are left out; rows with one doc_id are one document.
    """
    docs = docs.filter("doc_id is not null")
    kept = cut(selected(docs, length, seed).select("doc_id", "seed"))
    often = cut(kept.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("seed", "n"))
    hot = F.broadcast(cut(often.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "seed").limit(FEW).select("seed")))
    rare = kept.join(hot, "seed", "left_anti").join(often.join(hot, "seed", "left_anti").select("seed"), "seed")
    wanted = rare.union(kept.join(hot, "seed").select(rare.columns)).groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    suffixes = cut(with_context(docs, wanted, length, seed))
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["seed", "right", "left", "doc_id", "at"]
    found = cut(compare(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order), length, seed, run_rows))
    # a run sends each of its open windows once, and those without a match for each row: a hot window has a row a run
    windows = found.filter("window is not null")
    shared = windows.groupBy("window").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a <> b").select("window")
    between = windows.filter("start is not null").join(shared, "window").select("doc_id", "start", "end")
    spans = found.filter("window is null").select("doc_id", "start", "end").union(between).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return spans.select("doc_id", merged.alias("spans")).select(
        "doc_id", "spans", F.size("spans").alias("n_spans"), F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("n_words")
    )


def report(docs: DataFrame) -> DataFrame:
    return repeated(docs).select("doc_id", "n_spans", "n_words", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))
