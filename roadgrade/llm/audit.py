"""How filters interact: what each of them removes, in every order in which they can be applied.

Documents only count by the set of filters that they fail, so they are first counted by part and set (a mask of bits).
Each such cell is folded over the array of all orders, a literal of the plan: a fold along an order carries whether the
cell is still there. A cell gives one weighted struct for each order and step; cells of a part are summed place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, let

#: Counts of a cell and those of a step.
WEIGHTS = ("n", "n_good", "n_toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part (source; null: empty), digest (SHA-256 of the text; null: empty), mask of the four filters that a text
    alone decides, the first the lowest bit: fewer than 50 words; under 65 % of the words distinct; over 5 % of the code
    points in A-Z; one of # $ % & * |."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    sizes = let(words, lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]++", ""))
    fails = (F.col("sizes.words") < 50, 100 * F.col("sizes.distinct") < 65 * F.col("sizes.words"), 100 * capitals > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("sizes", sizes).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: documents of each part by the five filters that they fail.

    The fifth: a smaller doc_id of any part has the same text. Copies are summed by text and part before anything of a text
    meets, so no group of copies is gathered: of each such group only the rows of its least doc_id are told apart.
    """
    # rows without doc_id have no label and meet nobody: they are dealt by their text
    key = F.coalesce(F.col("doc_id"), F.xxhash64("digest"))
    rows = failures(docs).select(key.alias("id"), F.col("doc_id").isNotNull().alias("named"), "part", "digest", "mask")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    )
    rows = rows.join(marks.withColumn("named", F.lit(True)), ["id", "named"], "left")
    rows = rows.groupBy("id", "named", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))

    named = F.when(F.col("named"), F.struct("id", F.col("n").alias("n"), (F.col("n") * F.col("good")).alias("n_good"), (F.col("n") * F.col("toxic")).alias("n_toxic")))
    groups = rows.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"),
        F.sum(F.when(F.col("named"), 0).otherwise(F.col("n"))).alias("nameless"), F.min(named).alias("first"),
    )
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    groups = groups.join(least, "digest")
    stays = F.col("first.id") == F.col("least")
    # what doesn't fail the fifth filter: rows of the least doc_id, and those without one
    ok = {w: F.when(stays, F.col(f"first.{w}")).otherwise(0) + (F.col("nameless") if w == "n" else 0) for w in WEIGHTS}
    both = F.array(
        F.struct(F.col("mask"), *[F.coalesce(ok[w], F.lit(0)).alias(w) for w in WEIGHTS]),
        F.struct(F.col("mask").bitwiseOR(1 << 4).alias("mask"), *[(F.col(w) - F.coalesce(ok[w], F.lit(0))).alias(w) for w in WEIGHTS]),
    )
    return groups.select("part", F.explode(both).alias("x")).groupBy("part", "x.mask").agg(*[F.sum(f"x.{w}").alias(w) for w in WEIGHTS])


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """(part, mask, n, n_good, n_toxic), one row for each part and mask -> a row for each part, order of the letters and
    step, zeros included: filter_order, step (from 1), COUNTS, shapley (removed by the step's filter, summed over all orders).

    ``letters`` names the bits of a mask from the lowest on. A part has at most 2 to the power of their number cells, so its
    fold has a bounded size; cells without documents may be missing.
    """
    orders = list(permutations(range(len(letters))))
    steps = F.array(*[F.array(*[F.lit(1 << k) for k in o]) for o in orders])
    zero = F.lit(0).cast("long")
    count = lambda cond, x: F.when(cond, x).otherwise(zero)

    def along(cell: Column, order: Column) -> Column:
        """The cell's structs along one order."""

        def step(acc: Column, bit: Column) -> Column:
            fails = cell["mask"].bitwiseAND(bit) != 0
            there = acc["there"]
            now = F.struct(
                count(there & ~fails, cell["n"]).alias("kept"), count(there & fails, cell["n"]).alias("removed"), count(~there & fails, cell["n"]).alias("redundant"),
                count(cell["mask"] == bit, cell["n"]).alias("unique_fails"), count(there & fails, cell["n_good"]).alias("good_lost"), count(there & fails, cell["n_toxic"]).alias("toxic_lost"),
            )
            return F.struct((there & ~fails).alias("there"), F.concat(acc["out"], F.array(now)).alias("out"))

        none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
        return F.aggregate(order, F.struct(F.lit(True).alias("there"), none.alias("out")), step, lambda acc: acc["out"])

    structs = lambda cell: F.flatten(F.transform(F.col("steps"), lambda order: along(cell, order)))
    add = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    nothing = F.array_repeat(F.struct(*[zero.alias(c) for c in COUNTS]), len(orders) * len(letters))
    # one cell after the other, so that one array of sums is held besides a cell's own
    total = F.aggregate("cells", nothing, lambda acc, cell: F.zip_with(acc, structs(cell), add))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells"))
    merged = parts.withColumn("steps", steps).select("part", F.posexplode(total).alias("at", "x"))
    # filters, and where each stands in its order
    names = F.array(*[F.lit("".join(letters[k] for k in o)) for o in orders])
    merged = merged.select("part", F.element_at(names, F.expr(f"int(at div {len(letters)}) + 1")).alias("filter_order"), F.expr(f"int(at % {len(letters)}) + 1").alias("step"), "x.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(W.partitionBy("part", letter))  # as many rows as there are orders
    return merged.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E of ``cells`` in all 120 orders.

    Null texts count as empty ones, null sources as the part with the empty name. A repeated doc_id counts as often as it
    stands there, and its copies of one text don't make each other fail E; rows without doc_id fail no E, make nobody fail
    it and have no label. A document is good or toxic if any of its labels says so. An empty table gives no rows; other
    columns are ignored, whatever their names; very long texts are read whole.
    """
    return interactions(cells(docs, labels), "ABCDE")
