"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the space and the characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]++"
#: Words of more characters stand in no context: what is carried from match to match stays short in texts without spaces.
LONGEST = 256
_IN, _MANY = r"[^\x20\x09-\x0D]", f"{{1,{LONGEST}}}+"
#: The last two words with the white space behind them, and the word that has not ended yet; of one that is longer its end.
_TAIL = rf"(?:(?<!{_IN})(?:{_IN}{_MANY}{SPACE}++){{0,2}}+{_IN}{{0,{LONGEST}}}+|{_IN}{{{LONGEST + 1}}})$"
#: Behind a match: what is left of its word, and the next word.
_NEXT = rf"(?={_IN}{{0,{LONGEST}}}+(?:{SPACE}++({_IN}{_MANY}(?!{_IN})))?)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again: its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one (tests) makes its own.
    """
    _shared_folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table in that folder: for tables of many narrow rows, which checkpoints don't compress."""
    import uuid

    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def per_text(
    docs: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """Apply a function of (ids, texts) to each Arrow batch; null texts arrive as empty ones.

    ``make`` runs once a task (it loads what the function needs); the function returns the columns of ``schema``.
    Batches are cut to a megabyte of text, so that very long texts don't add up. Columns ``also`` are passed on as they
    are, by a function that returns one row a text.
    """
    # Spark's own parser gives the Arrow types that it expects back
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and (not some or size < 1_000_000):
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                out = f(ids[at : at + len(some)], some)
                more = {c: batch.column(k).slice(at, len(some)) for k, c in enumerate(also, 2)}
                yield pa.RecordBatch.from_arrays([more[x.name] if x.name in more else pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
                at += len(some)

    return docs.select(F.col(id_col), F.col(text_col), *also).mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a column of a name that docs doesn't have; and that name.

    docs must give the same rows in the same partitions whenever they are read, as a table does.
    """
    row = next(f"row_{i}" for i in range(len(docs.columns) + 1) if f"row_{i}" not in {c.lower() for c in docs.columns})
    return docs.withColumn(row, F.monotonically_increasing_id()), row


#: Up to so many ids are sent to all tasks instead of moving the rows that they pick.
FEW = 1_000_000
#: Up to so many links of a graph, the least neighbours of its nodes are sent to all tasks.
FEW_LINKS = 100_000


def picked(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """df joined with ids, a checkpointed table with a column of that name: the rows of those ids, or the others."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, on, how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between whole numbers -> (node, component), component being the least node reachable.

    Alternating large-star and small-star rounds: each is a group-by with partial sums and a join on a node, so that a
    hub is never gathered in one task (adaptive skew joins split it). Of few links the least neighbours are sent to all
    tasks instead, so that a round shuffles three times rather than six. It ends when the links no longer change.
    Nulls and self-links are dropped; no links give no rows. Nodes without a link are not in the result.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def star(links: DataFrame, large: bool, few: bool) -> DataFrame:
        sent = F.broadcast if few else lambda low: low
        if large:
            both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            out = both.filter("v > u").join(sent(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            return out if few else out.distinct()  # few: the small star makes them distinct
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(sent(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m").toDF("u", "v"))
        return out.filter("u <> v").distinct()

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    links = cut(links)
    before = digest(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        few = before[0] <= FEW_LINKS
        links = cut(star(star(links, True, few), False, few))
        now = digest(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def spans_of(text, pattern: str, group: int = 0, context: bool = False):
    """Column: array of (start, end, m) of the leftmost non-overlapping matches of a Java pattern, in code points.

    A match's place is the summed length of what ``split`` leaves before it and of the matches before it. Sums are made
    in pieces of 256 matches, so that the time grows with the matches and not with their square.
    With ``context`` (the pattern has no capturing group then) two fields follow: left, what stands before the match from
    the beginning of the second last whole word on, and right, the first whole word after it. Words of more than LONGEST
    characters count as none; the others are read whole, over other matches too.
    """
    kind = "array<struct<start:int,end:int,m:string" + ",left:string,right:string" * context + ">>"
    none = F.array().cast(kind)

    def placed(whole):
        m = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        right = F.regexp_extract_all(text, F.lit(f"(?:{pattern}){_NEXT}"), F.lit(1)) if context else whole
        return let(F.arrays_zip(whole.alias("w"), m.alias("m"), right.alias("right"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("g")), summed)

    def summed(z):
        at = F.sequence(F.lit(0), ((F.size(z) - 1) / 256).cast("int"))
        pieces = F.transform(at, lambda c: F.slice(z, c * 256 + 1, 256))
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(pieces, first, piece, lambda acc: acc["out"]))

    def piece(acc, some):
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["w"])
        if not context:
            return F.struct(end.alias("at"), acc["tail"].alias("tail"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))
        left = F.regexp_extract(F.concat(acc["tail"], x["g"]), _TAIL, 0)
        return let(
            left,
            lambda left: F.struct(
                end.alias("at"),
                F.concat(left, x["w"]).alias("tail"),
                F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m"), left.alias("left"), x["right"].alias("right")))).alias("out"),
            ),
        )

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def let(value, body):
    """body(value) with value computed once for each row, not once for each use or each element of an inner loop."""
    return F.element_at(F.transform(F.array(value), body), 1)

