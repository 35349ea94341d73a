"""Runs of repeated words: Lyndon roots from the grouping phase of Baier's suffix sorter, extended both ways into runs.

Phase one of that sorter groups the suffixes by their longest Lyndon prefix and so yields the Lyndon array without sorting
a suffix. Every run has a Lyndon root, under one of the two orders of the alphabet, that is the longest Lyndon word at its
place; extending a root by the words that are equal one period apart, to the right and to the left, gives the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, per_text

#: A run's least length in words and in periods.
LEAST, TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon(ranks: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place of a word of ranks 0, 1, ... (each of them occurs).

    Groups are worked off from the highest to the lowest. Each member of a group sends its context to the nearest place on
    its left that is of a lower group; a place that gets l of them grows by l contexts and leaves for a new group, next
    above its old one, above those that got fewer.
    """
    n = len(ranks)
    size, of = [1] * (n + 1), [-1, *ranks]  # places count from 1; place 0 is lower than all
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i in range(1, n + 1):
        members[of[i]].append(i)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    left = list(range(n + 1))  # the nearest place on the left that isn't done, once paths are followed
    g = len(members) - 1
    while g >= 0:
        here = [i for i in members[g] if of[i] == g]
        members[g] = here
        got: dict[int, int] = {}
        for i in here:
            left[i] = i - 1
        for i in here:
            j = left[i]
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            if j:
                got[j] = got.get(j, 0) + 1
        if got:
            context, leave = size[here[0]], {}
            for j, times in got.items():
                leave.setdefault((times, of[j]), []).append(j)
            for times, old in sorted(leave, reverse=True):
                new, up = len(members), above[old]
                members.append(leave[times, old])
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
                for j in members[new]:
                    of[j] = new
                    size[j] += times * context
        g = below[g]
    return np.array(size[1:], np.int64)


def common_ahead(x: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b)."""
    k, step = 0, 32
    while b + k < len(x):
        unlike = x[a + k : min(a + k + step, len(x) - b + a)] != x[b + k : b + k + step]
        if unlike.any():
            return k + int(unlike.argmax())
        k += len(unlike)
        step *= 2
    return k


def word_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` periods; times is 3 or more."""
    n, back, found = len(x), x[::-1], set()
    ranks = np.unique(x, return_inverse=True)[1]
    for order in (ranks, ranks.max(initial=0) - ranks):
        size = lyndon(order.tolist())
        i = np.arange(n)
        i = i[i + (times - 2) * size < n]
        for k in range(1, times - 1):  # a run of that many periods has the root so often
            i = i[size[i + k * size[i]] == size[i]]
        end: dict[int, int] = {}
        for a, p in zip(i.tolist(), size[i].tolist(), strict=True):
            if a + p <= end.get(p, 0):
                continue  # a later root of the run found last
            right = common_ahead(x, a, a + p)
            start = a - common_ahead(back, n - a - p, n - a) if a else 0
            length = a + p + right - start
            if length >= max(least, times * p):
                found.add((start, length, p))
                end[p] = start + length
    return found


def _pieces(x: np.ndarray, least: int, times: int, rounds: int = 3) -> Iterator[tuple[int, int]]:
    """Stretches outside which no run can be: a run's words all occur ``times`` times, in the text and in the stretch."""
    todo = [(0, len(x), 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < max(least, times):
            continue
        _, which, count = np.unique(x[a:b], return_inverse=True, return_counts=True)
        often = count[which] >= times
        if k == rounds or often.all():
            yield a, b
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        todo += [(a + s, a + e, k + 1) for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]


def text_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a text's word numbers, by start and period."""
    return sorted((a + s, length, p) for a, b in _pieces(x, least, times) for s, length, p in word_runs(x[a:b], least, times))


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), text: the words, joined by one space,
    without those that a run repeats (what it holds after its first period).

    Null, empty and blank texts have no runs and an empty text. Rows without doc_id and repeated rows are rows like any
    other; an empty table gives no rows; other columns are ignored, whatever their names. A text is worked off whole in
    one task, in time and memory that grow with its length.
    """

    def make():
        known: dict[bytes, int] = {}

        def f(ids: list, texts: list) -> dict:
            if len(known) > 200_000:
                known.clear()
            out = {"doc_id": ids, "n_words": [], "runs": [], "text": []}
            for t in texts:
                words = t.encode("utf-8", "surrogatepass").split()
                for w in set(words).difference(known):
                    known[w] = len(known)
                x = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                found = text_runs(x, least, times)
                if found:
                    step = np.zeros(len(words) + 1, np.int64)
                    for s, length, p in found:
                        step[s + p] += 1
                        step[s + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                out["n_words"].append(len(x))
                out["runs"].append([{"start": s, "length": length, "period": p} for s, length, p in found])
                out["text"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
            return out

        return f

    return per_text(docs, make, f"doc_id long, n_words long, runs array<{RUN}>, text string")


def planted(docs: DataFrame) -> DataFrame:
    """docs with runs planted in one text in ten: with h the CRC-32 of the decimal doc_id and g = h/10, texts of h % 10 = 0
    repeat from word a = g % n on the p = 1 + (n - a)/(3 + g % 8) words that begin there. Rows without doc_id stay."""
    text, h = F.coalesce("text", F.lit("")), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def again(words):
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        place = lambda i, a, p: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        moved = let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i, v["a"], v["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, let(words, again)).otherwise(text))


def report(docs: DataFrame) -> DataFrame:
    """What ``collapse`` finds after ``planted``: the longest run and digests of all runs and of the text that is left."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # the greatest length, then the least start and period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    out = collapse(planted(docs)).withColumn("best", F.when(F.size("runs") > 0, best))
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
        "n_words",
    )
