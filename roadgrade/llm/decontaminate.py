"""Benchmark decontamination in DataFrame expressions only.

A document's windows as long as a benchmark item get a SimHash of their words, of which those in the outer eighths weigh
nothing: a window of similarity 0.8 can differ there by whole words, but further in only by one word in about 45. A
window of similarity 0.8 has at most a fifth of its weight in shingles that no item of its length has, so every window,
at every place and of every item's length, that keeps to this is fingerprinted, and no other can count. Multi-index
blocks over the fingerprints of all items of that length find every pair within the radius: of radius + 1 blocks of bits
one must be equal. What they find is verified by the exact weighted similarity: shared over total shingle weight, with
multiplicity, a shingle weighing less the more items hold it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, numbered, picked

SHINGLE, SIMILARITY = 5, 0.8
#: Most differing bits of 64. Alike inner words make 0; one in 45 that differs makes 5 on average, over 10 with probability 0.005.
RADIUS = 10
#: Windows cut off by an end of the text hold this share of an item's shingles at least.
LEAST = 0.6
#: Most rows of the benchmark's tables that are broadcast; a larger benchmark is joined by a shuffle.
MAX_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """Hashes of the n-word shingles in order. words should be bound by ``let``."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _lane_bits(most: int) -> int:
    """Bits of a counter that holds up to ``most`` words and room for the comparison."""
    return next(w for w in (8, 16, 32) if most < 1 << (w - 2))


def _lanes(hashes: Column, wide: int) -> list[Column]:
    """``wide`` arrays of numbers: in the k-th, each hash's bits 64/wide * k and on, spread over counters of wide bits."""
    lanes = 64 // wide
    table = F.array(*[F.lit(sum((b >> i & 1) << (wide * i) for i in range(lanes))).cast("long") for b in range(1 << lanes)])
    part = lambda h, k: (F.shiftrightunsigned(h, lanes * k).bitwiseAND((1 << lanes) - 1) + 1).cast("int")
    spread = lambda k: F.transform(hashes, lambda h: F.element_at(table, part(h, k)))
    return [spread(k) for k in range(wide)]


def _fingerprint(lanes: Column, start: Column, many: Column, wide: int) -> Column:
    """64 bits, each set if it is set in over half of the hashes start, start + 1, .. of which there are ``many``.

    lanes: struct of the arrays of ``_lanes``. All bits of a number are counted at once, each in its own counter.
    """
    ones = sum(1 << (wide * i) for i in range(64 // wide))
    half = (F.lit(1 << (wide - 2)) - F.floor(many / 2) - 1).cast("long") * F.lit(ones).cast("long")

    def part(k: int) -> Column:
        count = F.aggregate(F.slice(lanes[f"l{k}"], start + 1, many), F.lit(0).cast("long"), lambda a, x: a + x)
        over = (count + half).bitwiseAND(F.lit(ones << (wide - 2)).cast("long"))
        return F.shiftrightunsigned(F.shiftleft(over, 1), k)

    out = part(0)
    for k in range(1, wide):
        out = out.bitwiseOR(part(k))
    return F.when(many > 0, out).otherwise(F.lit(0).cast("long"))


def _margin(n):
    """Words at each end of a window of n words that weigh nothing."""
    return F.least(F.ceil(n * 0.12), F.floor((n - 1) / 2)).cast("int")


def _blocks(fp: str, radius: int) -> Column:
    out = []
    for k in range(radius + 1):
        low, high = 64 * k // (radius + 1), 64 * (k + 1) // (radius + 1)
        out.append(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1).alias("v")))
    return F.array(*out)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: each document's best window for each item it holds.

    Items and texts without a word match nothing; an item under five words is one shingle. Rows without doc_id are not
    reported. Repeated rows give one result; of equal windows the first is reported. Empty tables give no rows. Items
    with the same item_id are one item, reported by its best window. Windows may reach over the text's ends.
    """
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"),
        "item_id",
        let(words_of(F.coalesce("text", F.lit(""))), lambda w: F.struct(w.alias("words"), F.size(w).alias("n"), *[shingles(w, k).alias(f"h{k}") for k in range(1, SHINGLE + 1)])).alias("x"),
    ).filter("x.n > 0")
    size = F.least(F.col("x.n"), F.lit(SHINGLE))
    items = cut(items.select("item", "item_id", F.col("x.words").alias("words"), F.col("x.n").alias("n"), size.alias("size"), F.element_at(F.array(*[f"x.h{k}" for k in range(1, SHINGLE + 1)]), size).alias("hs")))
    facts = items.agg(F.count("*").alias("total"), F.max("n").alias("longest"), F.sum(F.size("hs")).alias("rows"), F.collect_set("size").alias("sizes")).first()  # of SHINGLE values at most
    if not facts["total"]:
        return _nothing(items, docs)
    total, sizes, wide = facts["total"], sorted(facts["sizes"]), _lane_bits(facts["longest"])
    core = lambda x: _fingerprint(x, _margin(F.col("n")), F.col("n") - 2 * _margin(F.col("n")), wide)
    items = cut(items.select("item", "item_id", "n", "size", "hs", let(_hashed(F.col("words"), wide), core).alias("fp")))
    small = (lambda df: F.broadcast(df)) if facts["rows"] <= MAX_BROADCAST else (lambda df: df)
    held = items.select("item", F.explode("hs").alias("h")).groupBy("h", "item").agg(F.count("*").alias("times"))
    weights = held.groupBy("h").agg(F.round(1000 * F.log(1 + F.lit(float(total)) / F.count("*"))).cast("long").alias("w"))
    other = F.round(1000 * F.log(1 + F.lit(float(total)))).cast("long")  # of shingles that no item holds
    held = cut(held.join(weights, "h"))
    weights = cut(weights)
    whole = cut(held.groupBy("item").agg(F.sum(F.col("times") * F.col("w")).alias("item_weight")))
    lengths = cut(items.select(F.explode("hs").alias("h"), "size", "n").distinct())

    text = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # where a document has shingles of items of n words
    known = reduce(DataFrame.union, [_grams(text, k) for k in sizes]).join(small(lengths), ["h", "size"])
    known = known.groupBy("doc_id", "n", "size").agg(F.array_sort(F.collect_set("at")).alias("known"))
    known = known.filter(F.size("known") >= F.floor(LEAST * similarity * (F.col("n") - F.col("size") + 1)))
    wanted = cut(known.groupBy("doc_id").agg(F.collect_list(F.struct("n", "size", "known")).alias("wanted")))
    windows = cut(_windows(text, wanted, similarity, wide))

    # all windows of one fingerprint and length are looked up at once
    ours = windows.select("n", "fp").distinct().select("n", "fp", F.explode(_blocks("fp", radius)).alias("b")).select("n", "fp", "b.k", "b.v")
    theirs = items.select("item", "n", F.col("fp").alias("item_fp"), F.explode(_blocks("fp", radius)).alias("b")).select("item", "n", "item_fp", "b.k", "b.v")
    near = (
        ours.join(small(theirs), ["n", "k", "v"])
        .select("n", "fp", "item", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming"))
        .filter(F.col("hamming") <= radius)
        .distinct()
    )
    found = cut(windows.join(near, ["n", "fp"]).select("doc_id", "item", "hamming", "n", "size", "shift"))

    counted = _shingles_of(text, found.select("doc_id", "n", "size", "shift").distinct()).groupBy("doc_id", "n", "shift", "start", "win_words", "h").agg(F.count("*").alias("many"))
    scored = (
        found.select("doc_id", "item", "hamming", "n", "shift").join(counted, ["doc_id", "n", "shift"])
        .join(small(held.select("item", "h", "times")), ["item", "h"], "left")
        .join(small(weights), "h", "left")
        .withColumn("w", F.coalesce("w", other))
        .groupBy("doc_id", "item", "shift", "hamming", "start", "win_words")
        .agg(F.sum(F.least("many", F.coalesce("times", F.lit(0))) * F.col("w")).alias("shared"), F.sum(F.col("many") * F.col("w")).alias("ours"))
        .join(small(whole), "item")
        .withColumn("similarity", F.col("shared") / (F.col("ours") + F.col("item_weight") - F.col("shared")))
        .filter(F.col("similarity") >= similarity)
    )
    best = F.max_by(F.struct("start", "win_words", "hamming", "similarity"), F.struct("similarity", -F.col("start"), -F.col("win_words"), -F.col("hamming")))
    return (
        scored.join(small(items.select("item", "item_id")), "item")
        .groupBy("doc_id", "item_id")
        .agg(best.alias("x"))
        .select("doc_id", "item_id", F.col("x.start").alias("start_word"), F.col("x.win_words").alias("n_words"), "x.hamming", F.round("x.similarity", 6).alias("similarity"))
    )


def _hashed(words: Column, wide: int) -> Column:
    """Struct of the words' counters."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(*[x.alias(f"l{k}") for k, x in enumerate(_lanes(h, wide))]))


def _grams(text: DataFrame, size: int) -> DataFrame:
    """doc_id, at, h, size: every shingle of every text."""
    return text.select("doc_id", F.posexplode(let(words_of(F.col("text")), lambda w: shingles(w, size))).alias("at", "h")).withColumn("size", F.lit(size))


def _windows(text: DataFrame, wanted: DataFrame, similarity: float, wide: int) -> DataFrame:
    """doc_id, n, size, shift, fp: the windows of n words from word ``shift`` on (under 0 or over the text's end: cut).

    wanted: doc_id and an array of (n, size, known): the places of shingles of items of n words. A window has its first
    such shingle at one of them; the windows of each are made there, so that none is made twice.
    """

    def starts(x: Column, last: Column) -> Column:
        """Shifts of the windows of one length; last: number of shingles of the text."""
        n, known = (x["n"] - x["size"] + 1), x["known"]
        spare = F.floor(n * (1 - similarity) + 1e-9).cast("int")

        def fits(shift: Column, j: Column) -> Column:
            begin, end = F.greatest(shift, F.lit(0)), F.least(shift + n, last)
            need = (end - begin) - F.floor((end - begin) * (1 - similarity) + 1e-9).cast("int")
            return (end - begin >= F.ceil(n * LEAST)) & (need > 0) & F.coalesce(F.get(known, j + need - 1) < end, F.lit(False))

        def from_(j: Column) -> Column:
            at, before = F.get(known, j), F.get(known, j - 1)
            low = F.when(j > 0, F.greatest(before + 1, at - spare)).when(at <= spare, -F.floor(n * (1 - LEAST)).cast("int")).otherwise(at - spare)
            return F.filter(F.sequence(low, at), lambda shift: fits(shift, j))

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(known) - 1), lambda j: F.get(known, j) < last), from_))

    def made(w: Column, x: Column, lanes: Column) -> Column:
        size = F.size(w)

        def one(shift: Column) -> Column:
            low = F.least(F.greatest(shift + _margin(x["n"]), F.lit(0)), size)
            high = F.greatest(F.least(shift + x["n"] - _margin(x["n"]), size), low)
            return F.struct(x["n"].alias("n"), x["size"].alias("size"), shift.alias("shift"), _fingerprint(lanes, low, high - low, wide).alias("fp"))

        return F.transform(F.array_distinct(starts(x, size - x["size"] + 1)), one)

    all_ = let(words_of(F.col("text")), lambda w: let(_hashed(w, wide), lambda lanes: F.flatten(F.transform("wanted", lambda x: made(w, x, lanes)))))
    return text.join(wanted, "doc_id").select("doc_id", F.explode(all_).alias("x")).select("doc_id", "x.*").distinct()


def _shingles_of(text: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, n, shift, start, win_words, h: a row for each shingle of each window (doc_id, n, size, shift)."""
    wanted = windows.groupBy("doc_id", "size").agg(F.collect_list(F.struct("shift", "n")).alias("wanted"))

    def of(size: int) -> DataFrame:
        def window(x: Column, hashes: Column) -> Column:
            start = F.greatest(x["shift"], F.lit(0))
            many = F.greatest(F.least(x["shift"] + x["n"] - size + 1, F.size(hashes)) - start, F.lit(0))
            return F.struct(x["n"].alias("n"), x["shift"].alias("shift"), start.alias("start"), (many + size - 1).alias("win_words"), F.slice(hashes, start + 1, many).alias("win"))

        made = let(words_of(F.col("text")), lambda w: let(shingles(w, size), lambda hashes: F.transform("wanted", lambda x: window(x, hashes))))
        rows = text.join(wanted.filter(F.col("size") == size), "doc_id").select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*").distinct()
        return rows.select("doc_id", "n", "shift", "start", "win_words", F.explode("win").alias("h"))

    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # SHINGLE values at most
    return reduce(DataFrame.union, [of(k) for k in sizes or [SHINGLE]])


def _nothing(items: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(items.limit(0), F.lit(False)).select(
        "doc_id", "item_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item: each row is a document of its own, whatever its doc_id, null or repeated.

    Null, empty and short texts stay; so does every row if there are no items. docs must give the same rows in the same
    partitions whenever they are read, as a table does. Extra columns stay, whatever their names.
    """
    rows, row = numbered(docs)
    bad = cut(find(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct())
    return picked(rows, bad, row, "left_anti").select([docs[c] for c in docs.columns])
