"""Line dedup with a log-template tree of fixed depth.

The tree's first level is a line's number of tokens, the next ones its two leading tokens, three in lines of eight tokens
and more; tokens with a digit count as variable. The lines of a leaf have the same places. A token that is rare at its place among the lines of its leaf is a
variable field, and a line's template is what stays when these are left out. How rare is tried in three steps (fewer
than MIN_DOCS documents, an eighth, a half of those of the leaf), each of which widens the template; one of which too
little stays is none. Templates are counted over documents; lines of recurring templates are dropped from all documents
but the first that has the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, let, numbered, per_text

#: Levels of leading tokens below the number of tokens; one more in lines of MANY tokens and more.
LEADING, MANY = 2, 8
#: A template recurs if so many documents have it.
MIN_DOCS = 3
#: Steps of the shares of a leaf's documents below which a token is a variable field, beside MIN_DOCS itself.
SHARES = (0.0, 0.125, 0.5)
#: Share of a line's tokens that must stay in a template, and in lines of fewer than SHORT tokens.
FIXED, SHORT, FIXED_SHORT = 0.7, 5, 0.5
_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """The line's tokens, those with a digit as an empty one."""
    tokens = line.split()
    return [b"" if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _lines(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> row, line, short, leaf, whole (hash of all tokens), fresh (its first place in its document).

    Lines of which too little can stay are left out.
    """

    def make():
        import xxhash

        h = xxhash.xxh64_intdigest

        def f(ids: list, texts: list) -> dict:
            row, line, short, leaf, whole, fresh = [], [], [], [], [], []
            for d, t in zip(ids, texts, strict=True):
                seen: set[int] = set()
                for i, x in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n")):
                    tokens = tokens_of(x)
                    n = len(tokens)
                    if n and n - tokens.count(b"") >= (FIXED if n >= SHORT else FIXED_SHORT) * n:
                        k = h(b"\n".join(tokens))
                        row.append(d), line.append(i), short.append(n < SHORT), whole.append(k), fresh.append(k not in seen)
                        leaf.append(h(b"%d\n" % n + b"\n".join(tokens[: LEADING + (n >= MANY)])))
                        seen.add(k)
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            return {"row": np.array(row, np.int64), "line": np.array(line, np.int32), "short": np.array(short, bool), "leaf": signed(leaf), "whole": signed(whole), "fresh": np.array(fresh, bool)}

        return f

    return per_text(rows, make, "row long, line int, short boolean, leaf long, whole long, fresh boolean", "row")


def _tokens(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, lines: array of (line, leaf, whole, docs, all_docs)) -> leaf, whole, docs, all_docs, tokens (hashes; 0: with a digit)."""
    schema = "leaf long, whole long, docs long, all_docs long, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        h = xxhash.xxh64_intdigest
        for batch in batches:
            for low in range(0, len(batch), 300):
                part = batch.slice(low, 300)
                out: list[list] = [[], [], [], [], []]
                for t, lines in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    split = (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                    for x in lines:
                        tokens = [h(k) >> 1 if k else 0 for k in tokens_of(split[x["line"]])]
                        for column, v in zip(out, (x["leaf"], x["whole"], x["docs"], x["all_docs"], tokens), strict=True):
                            column.append(v)
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["leaf", "whole", "docs", "all_docs", "tokens"])

    return rows.select("row", "text").join(wanted, "row").select("text", "lines").mapInArrow(run, schema)


def templates(rows: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf, whole, key: the templates of each distinct line of a leaf that min_docs documents have at least."""
    distinct = cut(lines.filter("fresh").groupBy("leaf", "whole", "short").agg(F.count("*").alias("docs"), F.min(F.struct("row", "line")).alias("at")))
    short = distinct.filter(F.col("short") & (F.col("docs") >= min_docs)).select("leaf", "whole", F.xxhash64("leaf", "whole").alias("key"))
    distinct = distinct.filter(~F.col("short"))
    leaves = distinct.groupBy("leaf").agg(F.sum("docs").alias("all_docs")).filter(F.col("all_docs") >= min_docs)
    x = F.struct("at.line", "leaf", "whole", "docs", "all_docs")
    wanted = distinct.join(leaves, "leaf").groupBy(F.col("at.row").alias("row")).agg(F.collect_list(x).alias("lines"))
    kept = cut(_tokens(rows, wanted))
    placed = kept.select("leaf", "whole", "docs", "all_docs", F.posexplode("tokens").alias("place", "token"))
    # (document, line) pairs that have the token at its place in the leaf
    often = placed.filter("token <> 0").groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs)
    seen = placed.join(often, ["leaf", "place", "token"], "left").groupBy("leaf", "whole").agg(
        F.max("all_docs").alias("all_docs"), F.array_sort(F.collect_list(F.struct("place", "token", F.coalesce("n", F.lit(0)).alias("n")))).alias("tokens")
    )

    def key(k: int, share: float):
        fixed = F.transform("tokens", lambda t: F.when(t["n"] >= F.greatest(F.lit(min_docs), share * F.col("all_docs")), t["token"]).otherwise(F.lit(0)))
        enough = lambda x: F.size(F.filter(x, lambda t: t != 0)) >= FIXED * F.size(x)
        return let(fixed, lambda x: F.when(enough(x), F.xxhash64("leaf", x)))

    keys = F.array_distinct(F.filter(F.array(*[key(k, s) for k, s in enumerate(SHARES)]), lambda k: k.isNotNull()))
    return short.union(seen.select("leaf", "whole", F.explode(keys).alias("key")))


def recurring_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, doc_id, text) -> row, dropped: numbers of the lines (from 0) that the row loses, for rows that lose any."""
    lines = cut(_lines(rows))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    keyed = cut(lines.select("row", "line", "leaf", "whole").join(templates(rows, lines, min_docs), ["leaf", "whole"]).select("row", "line", "key"))
    # documents of a key that recurs, and which of them is the first
    pairs = keyed.select("key", "row").distinct()
    recurring = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("key")
    ids = rows.select("row", "doc_id")
    first = pairs.join(recurring, "key").join(ids, "row").groupBy("key").agg(F.min(order).alias("first")).select("key", F.col("first.row").alias("first_row"))
    return keyed.join(cut(first), "key").filter("row <> first_row").groupBy("row").agg(F.collect_set("line").alias("dropped"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with recurring lines taken out of text, and two more columns: its number of lines and how many were dropped.

    Null and empty texts stay as they are and have no lines; lines without a token always stay. Each row is a document,
    so of repeated rows the first keeps its lines; the first is the one of least doc_id, those without doc_id last. Extra
    columns stay; names in ``added`` that docs has already are an error. An empty table stays empty. docs must give the
    same rows in the same partitions whenever it is read.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in added}:
        raise ValueError(f"columns {sorted(clash)} exist; choose other names in added")
    at = docs.columns.index("text")
    rows, row = numbered(docs)
    dropped = recurring_lines(rows.select(F.col(row).alias("row"), "doc_id", "text"), min_docs).select(F.col("row").alias(row), F.col("dropped").alias(f"{row}_dropped"))
    joined = rows.join(dropped, row, "left").select(*[rows[c] for c in docs.columns], dropped[f"{row}_dropped"])
    out = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 300):  # few texts at a time are Python strings
                batch = whole.slice(low, 300)
                texts, n, less = [], [], []
                for t, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    lines = t.split("\n") if t else []
                    gone = set(drop or ())
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
                    n.append(len(lines))
                    less.append(len(gone))
                columns = batch.columns[:-1]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(less, pa.int64())], names=[*batch.schema.names[:-1], *added])

    return joined.mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def strip(docs: DataFrame) -> DataFrame:
    """docs with the lines taken out; documents of which nothing is left, though there was something, go.

    Null, empty and blank texts stay. n_chars, if docs has it, follows the text. The other cases are those of ``dedup``.
    """
    names = {c.lower() for c in docs.columns}
    n, less = (next(f"{x}_{i}" for i in range(len(names) + 1) if f"{x}_{i}" not in names) for x in ("lines", "dropped"))
    out = dedup(docs, added=(n, less)).filter((F.col(less) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(less) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
