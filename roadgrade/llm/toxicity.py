"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text, of which only the words that set it
apart are used (those that hold byte 5-grams found in a clearly larger share of toxic texts): toxic texts are nearly all
ordinary words, and dictionaries trained on all of them tell too little (README). A window of words is compressed with
the ordinary dictionary and with both joined; what the toxic one saves is the window's distance. A logistic curve over a
text's windows, fitted on other texts than the dictionaries', turns the savings into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Bound of the labelled rows that the fit reads, toxic and ordinary; those of least hash of doc_id.
MAX_TOXIC, MAX_ORDINARY = 1000, 3000
#: The fit passes over labelled rows with longer texts, so what it reads is bounded in bytes too.
MAX_CHARS = 50_000
#: Windows of ordinary text that the dictionary is trained on, those of least hash among all sampled rows'.
MAX_WINDOWS = 60_000
WINDOW, GRAM, LEVEL, THRESHOLD = 16, 5, 3, 0.3
TOXIC_BYTES, ORDINARY_BYTES = 2048, 65536
_EDGE = b".,!#$%&*|?;:\"'()<>-"


def held_out(doc_id):
    """True for the rows that no label is learnt from: crc32 of the id's decimal text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words(text: str) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def _windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _grams(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def _train(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary dictionary, and of the toxic one."""
    import zstandard

    seen = [Counter(), Counter()]
    for count, texts in zip(seen, (toxic, ordinary), strict=True):
        for words in texts:
            count.update({g for w in set(words) for g in _grams(w)})
    most = max(4, len(toxic) // 200)
    good = {g for g, n in seen[0].items() if n >= most and n / len(toxic) >= 5 * (seen[1][g] + 0.5) / max(1, len(ordinary))}
    telling = {w: any(g in good for g in _grams(w)) for words in toxic for w in words}
    marked = [b" " + b" ".join(x) + b" " for words in toxic if (x := [w for w in words if telling[w]])]

    def content(samples: list[bytes], size: int) -> bytes:
        samples = [s for s in samples if len(s) >= 8]
        if not samples:
            return b""
        try:
            d = zstandard.train_dictionary(size, samples * (1 + 2000 // len(samples)), k=16 if size < 8192 else 32, d=6).as_bytes()
            return d[-min(len(d), size) + 250 :]  # without the entropy tables in front
        except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
            return b"".join(dict.fromkeys(samples))[-size:]

    windows = sorted((w for words in ordinary for w in _windows(words)), key=zlib.crc32)[:MAX_WINDOWS]
    return content(windows, ORDINARY_BYTES), content(marked, TOXIC_BYTES)


def _scorer(contents: tuple[bytes, bytes]):
    """Function from words to a text's features."""
    import zstandard

    press = []
    for raw in (contents[0], contents[0] + contents[1]):
        kind = {}
        if len(raw) >= 8:
            kind["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kind["dict_data"].precompute_compress(level=LEVEL)
        press.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **kind).compress)
    plain, both = press

    def features(words: list[bytes]) -> list[float]:
        x = np.array([len(plain(w)) - len(both(w)) for w in _windows(words) or [b""]], float)
        x[::-1].sort()
        return [x[0], x.mean(), x[:3].mean(), (x >= 3).mean(), float(np.log1p((x >= 3).sum())), float(np.log1p(len(x)))]

    return features


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
    """(mean, scale, coefficients, the constant last) by Newton steps with a ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    w, r = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 0.001)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(r), z.T @ (weight * (y - p)) - r * w)
        w += np.clip(step, -5, 5)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, learn=None) -> dict | None:
    """The two dictionaries and the calibrated curve, from a bounded sample of labelled rows.

    ``learn``: column over doc_id that says which rows may be learnt from. None without rows of both classes.
    """
    rows = labels.select("doc_id", F.col("toxic").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    some = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    sample = F.broadcast(some[0].union(some[1]))  # MAX_TOXIC + MAX_ORDINARY rows at most
    got = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= MAX_CHARS).collect()
    got = sorted({(r["doc_id"], r["y"]): r["text"] for r in got}.items())
    words, y = [_words(t) for _, t in got], np.array([k[1] for k, _ in got], float)
    if len(set(y)) < 2:
        return None
    contents = lambda at: _train([words[i] for i in at if y[i]], [words[i] for i in at if not y[i]])
    part = np.array([zlib.crc32(b"fold %d" % k[0]) % 2 for k, _ in got])
    x, target = [], []
    for p in (0, 1):  # each half is measured with the other half's dictionaries
        inside, outside = np.flatnonzero(part == p), np.flatnonzero(part != p)
        if len(set(y[inside])) == 2 and len(outside):
            f = _scorer(contents(inside))
            x += [f(words[i]) for i in outside]
            target += [y[i] for i in outside]
    if len(set(target)) < 2:
        return None
    target = np.array(target)
    share = {c: total[int(c)] / max(1, (target == c).sum()) for c in (0.0, 1.0)}  # back to the shares of all labelled rows
    weight = np.array([share[c] for c in target])
    return {"contents": contents(range(len(y))), "curve": logistic(np.array(x), target, weight * len(target) / weight.sum())}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1). Null and empty texts are scored as one empty window; without a model every score is 0."""

    def make():
        features = model and _scorer(model["contents"])

        def f(ids: list, texts: list) -> dict:
            if not model:
                return {"doc_id": ids, "score": [0.0] * len(ids)}
            mean, scale, w = model["curve"]
            x = np.array([features(_words(t)) for t in texts])
            return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))}

        return f

    return per_text(docs, make, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Repeated rows are scored each; a null doc_id counts as not held out, and nothing
    is learnt from it. Null and empty texts count as one empty window. A score of exactly THRESHOLD is predicted 1.
    Without labels of both classes every score is 0. Extra columns are ignored; empty tables give no rows."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
