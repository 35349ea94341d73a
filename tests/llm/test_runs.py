"""Runs of words against plain definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from roadgrade.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_lyndon(x):
    """By the definition: a word is Lyndon if it is less than all its proper suffixes."""
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(k for k in range(1, len(x) - i + 1) if is_lyndon(x[i : i + k])) for i in range(len(x))]


def slow_runs(x, least=6, times=4):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                u = x[i : i + length]
                if not any(all(u[k] == u[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def samples():
    rng = random.Random(5)
    for size in (1, 2, 3):
        for n in (0, 1, 2, 5, 9, 17, 30):
            yield [rng.randrange(size) for _ in range(n)]
    for _ in range(150):
        x = []
        while len(x) < rng.randrange(5, 60):
            x += [rng.randrange(3) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        yield x
    a, b = [0], [0, 1]
    while len(b) < 90:
        a, b = b, b + a
    yield b


def test_lyndon_arrays_equal_the_definition():
    for x in samples():
        if x:
            ranks = np.unique(x, return_inverse=True)[1].tolist()
            assert runs.lyndon(ranks).tolist() == slow_lyndon(ranks)
    assert runs.lyndon([]).tolist() == []


def test_runs_equal_the_definition():
    for x in samples():
        assert runs.text_runs(np.array(x, np.int64)) == slow_runs(x), x
        assert sorted(runs.word_runs(np.array(x, np.int64), 3, 3)) == slow_runs(x, 3, 3), x


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf):
    got = queries.op13_runs(spark, sf).select(COLUMNS).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(expected(*d) for d in docs)
    assert sum(r["n_runs"] for r in got) > 3


def test_odd_rows(spark, make, odd):
    hot = [(i, " ".join(["a", "b"] * (3 + i % 9))) for i in range(100, 160)]
    docs = make([(20, "x " * 500), (21, "p q r " * 4 + "p"), (22, "a b\ta b\na b a b c c c c c c"), (23, "    " * 9), (None, "z " * 30), *hot])
    key = lambda r: (r[0] is None, str(r))
    for df in (docs, odd.filter("doc_id is null or doc_id not in (7, 8)")):
        got = runs.report(df).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=key) == sorted((expected(r["doc_id"], r["text"]) for r in df.collect()), key=key)
    long = runs.collapse(odd.filter("doc_id in (7, 8)")).collect()
    assert [r["n_words"] for r in long] == [60_000] * 2
    assert runs.report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [100_000])
def test_long_texts_take_time_in_proportion(n):
    x = np.array(list(range(n // 10)) * 10)
    assert runs.text_runs(x) == [(0, n, n // 10)]
    assert runs.text_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert len(runs.text_runs(np.repeat(np.arange(n // 8), 8))) == n // 8
