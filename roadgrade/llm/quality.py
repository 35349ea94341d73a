"""Quality rules: counts of a text, and a logistic regression over hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled rows and calibrated on rows that it wasn't fitted on. Texts are
scored in Arrow batches: a text's score is the mean weight of its n-grams, so a fixed vector of weights is all that a
task needs.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, per_text
from .toxicity import logistic

#: Bound of the labelled rows of each class that the fit reads; those of least hash of doc_id.
MAX_ROWS = 1500
#: The fit passes over labelled rows with longer texts, so what it reads is bounded in bytes too.
MAX_CHARS = 50_000
BITS = 17
#: A text is kept at this probability of quality 1 and above.
THRESHOLD = 0.5
_SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(text: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Buckets of the word 1- and 2-grams and the character (byte) 3- and 5-grams."""
    out = []
    if words:
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        out.append(h * _MIX)
        if len(h) > 1:
            out.append((h[:-1] * np.uint64(0x100000001B3) + h[1:] + np.uint64(1)) * _MIX)
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) >= 3:
        three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
        out.append((three + np.uint64(2 << 40)) * _MIX)
        if len(b) >= 5:
            out.append((three[:-2] | b[3:-1] << np.uint64(24) | b[4:] << np.uint64(32) | np.uint64(3 << 42)) * _MIX)
    return [(x >> np.uint64(64 - BITS)).astype(np.int32) for x in out]


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    import pandas as pd

    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    out = {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x := [y for y in t.split("\n") if y.strip(SPACES)]) - len(set(x)) for t in texts], np.int64),
    }
    # 5-word windows, all texts at once; codes are made of pairs of dense numbers, so equal codes are equal words
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    covered = np.zeros(len(ids), bool)
    if len(ids) >= 5:
        dense = lambda x: (got := pd.factorize(x)[0].astype(np.int64), int(got.max()) + 1)
        two, m = dense(ids[:-1] * len(known) + ids[1:])
        four, m = dense(two[:-2] * m + two[2:])
        five, m = dense(four[:-1] * len(known) + ids[4:])
        whole = doc[:-4] == doc[4:]
        code, m = dense(np.where(whole, five * len(n) + doc[:-4], -1))
        often = whole & (np.bincount(code, minlength=m)[code] > 1)
        step = np.zeros(len(ids) + 1, np.int64)
        at = np.flatnonzero(often)
        np.add.at(step, at, 1)
        np.add.at(step, at + 5, -1)
        covered = np.cumsum(step)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc, covered, minlength=len(n)).astype(np.int64)
    return out | {"words": split}


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Weights and calibration from at most MAX_ROWS labelled rows a class; None without rows of both classes."""
    rows = labels.select("doc_id", F.col("quality").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    some = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # 2 * MAX_ROWS rows at most
    got = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= MAX_CHARS).collect()
    got = sorted({(r["doc_id"], r["y"]): r["text"] for r in got}.items())
    y = np.array([k[1] for k, _ in got], float)
    if len(set(y)) < 2:
        return None
    cols, vals, size = [], [], []
    for _, t in got:  # a text is one sparse row: its share of each bucket, n-gram kinds weighing the same
        raw = t.encode("utf-8", "surrogatepass")
        parts = _buckets(raw, raw.split())
        idx, at = np.unique(np.concatenate([*parts, np.zeros(0, np.int32)]), return_inverse=True)
        share = np.concatenate([np.full(len(p), 1 / len(p)) for p in parts] or [np.zeros(0)])
        cols.append(idx)
        vals.append(np.bincount(at, share, minlength=len(idx)).astype(np.float32))
        size.append(len(idx))
    part = np.array([zlib.crc32(b"fold %d" % k[0]) % 4 for k, _ in got])
    edge = np.cumsum([0, *size])

    def train(at: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(at)), [size[i] for i in at])
        idx, val, t = np.concatenate([cols[i] for i in at]), np.concatenate([vals[i] for i in at]), y[at]
        weight = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
        w, bias, m, v, g2 = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0
        for k in range(1, 61):  # Adam on the whole batch
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[idx] * val, minlength=len(at)) + bias, -30, 30)))
            e = weight * (p - t)
            g = np.bincount(idx, e[row] * val, minlength=1 << BITS) + 1e-8 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 2.0 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
            g2 += e.sum() ** 2
            bias -= 0.5 * e.sum() / (np.sqrt(g2) + 1e-9)
        return w.astype(np.float32)

    apply = lambda w, at: np.array([float(w[cols[i]] @ vals[i]) for i in at])
    for_fit, rest = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    if len(set(y[rest])) < 2 or len(set(y[for_fit])) < 2:
        for_fit = rest = np.arange(len(y))
    w = train(for_fit)
    share = np.array([total[int(c)] / max(1, (y[rest] == c).sum()) for c in y[rest]])  # back to the shares of all labelled rows
    return {"weights": w, "curve": logistic(apply(w, rest)[:, None], y[rest], share * len(rest) / share.sum(), ridge=0.01)}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and p_quality, one row for each input row.

    A null text counts as an empty one; texts under ten words, and those over a fifth of whose words stand in repeated
    5-word windows, fail without a verdict of the model. Without labels of both classes the base rules alone decide. A
    probability of exactly THRESHOLD is kept. Repeated rows are scored each, rows without doc_id like others; extra
    columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats

    def make():
        model = shared.value

        def f(ids: list, texts: list) -> dict:
            out = counts(texts)
            p = np.ones(len(ids))
            if model:
                w, (mean, scale, c) = model["weights"], model["curve"]
                raw = [sum(float(w[b].mean(dtype=np.float64)) for b in _buckets(t.encode("utf-8", "surrogatepass"), words)) for t, words in zip(texts, out["words"], strict=True)]
                p = 1 / (1 + np.exp(-np.clip((np.array(raw) - mean[0]) / scale[0] * c[0] + c[1], -30, 30)))
            failed = base_failed(out["n_words"], out["n_repeat_words"])
            return out | {"doc_id": ids, "base_failed": failed, "p_quality": p, "kept": ~failed & (p >= THRESHOLD)}

        return f

    return per_text(docs, make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text is kept: the verdict is made in the same pass, no join of the texts.

    Each row is judged by its text alone, so repeated rows and rows without doc_id stay or go like others. Null, empty and
    short texts go (under ten words). Extra columns stay, whatever their names. Without labels of both classes the base
    rules alone decide; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return _filter(docs, model)


def _filter(docs: DataFrame, shared) -> DataFrame:
    from collections.abc import Iterator

    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 300):
                some = [t or "" for t in batch.column(at).slice(k, 300).to_pylist()]
                out = counts(some)
                ok = ~base_failed(out["n_words"], out["n_repeat_words"])
                if model:
                    w, (mean, scale, c) = model["weights"], model["curve"]
                    raw = [sum(float(w[b].mean(dtype=np.float64)) for b in _buckets(t.encode("utf-8", "surrogatepass"), words)) for t, words in zip(some, out["words"], strict=True)]
                    ok &= 1 / (1 + np.exp(-np.clip((np.array(raw) - mean[0]) / scale[0] * c[0] + c[1], -30, 30))) >= THRESHOLD
                yield batch.slice(k, len(some)).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
