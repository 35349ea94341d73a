"""Stored profiles, looked-up places and exported tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_lat_lon, place_key
from ..params import GEOCODE_DAYS, STORE_DAYS, STORE_VERSION


def fresh(version: Column, captured_at: Column, now: Column, wanted: int = STORE_VERSION, days: int = STORE_DAYS) -> Column:
    return (version == wanted) & (F.unix_millis(now.cast("timestamp")) - F.unix_millis(captured_at.cast("timestamp")) <= days * 86_400_000)


# A store is a folder with data/part=<commit>/..., which no commit touches again, and snapshots/, to which every commit adds one
# small file: its number and, for each search, the part that holds its entry. A commit counts from the moment that this
# file stands there whole, as a writer's last step; readers take the highest number and look at nothing else.
SNAPSHOT = "commit long, search_key string, part string, version int, captured_at timestamp"


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SNAPSHOT).parquet(f"{path}/snapshots")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SNAPSHOT)


def snapshot(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame:
    """(commit, search_key, part, version, captured_at) of the store's last commit, or of an earlier one; none of an empty store."""
    every = _snapshots(spark, path)
    last = every.agg(F.max("commit")).first()[0] if commit is None else commit
    return every.filter(F.col("commit") == F.lit(last)).filter("search_key is not null")


def _commit(spark: SparkSession, path: str, entries: DataFrame) -> int:
    """Add a snapshot of entries. One writer at a time; a row without a search says that there is a commit, should it be empty."""
    number = (_snapshots(spark, path).agg(F.max("commit")).first()[0] or 0) + 1
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema])
    out = entries.union(mark).withColumn("commit", F.lit(number).cast("long")).select("commit", "search_key", "part", "version", "captured_at")
    out.coalesce(1).write.mode("append").parquet(f"{path}/snapshots")  # some bytes a search: one file, so that it appears at once
    return number


def put_profiles(df: DataFrame, path: str, now: Column, version: int = STORE_VERSION) -> int:
    """Replace the entries of the searches in df (they carry search_key) by df's; other searches stay. Returns the commit's number.

    Readers see the store as it was until the commit stands; a write that fails in between leaves it so.
    """
    spark, part = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/part={part}")
    new = spark.read.parquet(f"{path}/data/part={part}").select("search_key").distinct()
    stamped = new.select("search_key", F.lit(part).alias("part"), F.lit(version).alias("version"), now.cast("timestamp").alias("captured_at"))
    old = snapshot(spark, path).select("search_key", "part", "version", "captured_at").join(new, "search_key", "left_anti")
    return _commit(spark, path, old.union(stamped))


def purge(spark: SparkSession, path: str, now: Column, version: int = STORE_VERSION) -> int:
    """Drop the entries that are old or of another version, as a commit of its own; their files stay for readers of earlier ones."""
    kept = snapshot(spark, path).filter(fresh(F.col("version"), F.col("captured_at"), now, version))
    return _commit(spark, path, kept.select("search_key", "part", "version", "captured_at"))


def read_snapshot(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The rows of entries (search_key, part, ...), with version and captured_at; only the parts that they name are read."""
    parts = [r["part"] for r in entries.select("part").distinct().collect()]  # commits, not searches
    if not parts:
        return entries.limit(0).select("search_key", "version", "captured_at")
    data = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/part={p}" for p in parts])
    return data.join(entries.select("search_key", "part", "version", "captured_at"), ["search_key", "part"]).drop("part")


def compact(spark: SparkSession, path: str, to: str) -> int:
    """The last snapshot alone, as the first commit of a new store in one part."""
    entries = snapshot(spark, path)
    rows = read_snapshot(spark, path, entries)
    part = uuid.uuid4().hex
    rows.drop("version", "captured_at").write.parquet(f"{to}/data/part={part}")
    return _commit(spark, to, entries.select("search_key", F.lit(part).alias("part"), "version", "captured_at"))


def hits(entries: DataFrame, keys: DataFrame, now: Column, version: int = STORE_VERSION) -> DataFrame:
    """Stored entries of the wanted searches that are of this version and at most 14 days old."""
    return entries.filter(fresh(F.col("version"), F.col("captured_at"), now, version)).join(keys.select("search_key").distinct(), "search_key", "left_semi")


def misses(entries: DataFrame, keys: DataFrame, now: Column, version: int = STORE_VERSION) -> DataFrame:
    """Wanted searches without such an entry."""
    good = entries.filter(fresh(F.col("version"), F.col("captured_at"), now, version)).select("search_key").distinct()
    return keys.select("search_key").distinct().join(good, "search_key", "left_anti")


def get_profiles(spark: SparkSession, path: str, keys: DataFrame, now: Column, version: int = STORE_VERSION) -> DataFrame:
    """The rows of the wanted searches that are stored, fresh and of this version."""
    return read_snapshot(spark, path, hits(snapshot(spark, path), keys, now, version))


def store_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.countDistinct("search_key").alias("searches"), F.count("*").alias("n_rows"))


def geocode_lookup(queries: DataFrame, gazetteer: DataFrame, now: Column, days: int = GEOCODE_DAYS) -> DataFrame:
    """queries (query) with lat, lon, label, found: coordinates count themselves, else the place's first row in the
    gazetteer (place, lat, lon, label, captured_at, seq) that is under 30 days old."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("captured_at").cast("timestamp"))
    g = gazetteer.filter(age < days * 86_400_000).select(place_key(F.col("place")).alias("key"), "lat", "lon", "label", "seq")
    g = g.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("seq"))).filter("_n = 1").select("key", F.struct("lat", "lon", "label").alias("g"))
    out = queries.withColumn("key", place_key(F.col("query"))).withColumn("p", parse_lat_lon(F.col("query"))).join(g, "key", "left")
    best = F.coalesce("p", "g")
    return out.withColumn("x", best).select(*queries.columns, "x.lat", "x.lon", "x.label", F.col("x").isNotNull().alias("found"))


def csv_field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


# fixed values: columns of the three exports
CSV_COLUMNS = {
    "climb": ["rank", "name", "score", "grade_pct", "gain_m", "length_m", "start_lat", "start_lon", "start_elev_m", "end_lat", "end_lon", "end_elev_m"],
    "incline": ["rank", "name", "roads", "length_m", "grade_pct", "gain_m", "start_lat", "start_lon", "start_elev_m", "end_lat", "end_lon", "end_elev_m"],
    "sustained": ["rank", "name", "grade_pct", "window_m", "road_length_m", "start_lat", "start_lon", "start_elev_m", "end_lat", "end_lon", "end_elev_m"],
}


def csv_rows(ranked: DataFrame, mode: str) -> DataFrame:
    """(rank, line) of a ranked table that has the mode's columns as numbers; places with six decimals, others with three."""

    def shown(c: str) -> Column:
        if c in ("rank", "roads", "window_m"):
            return F.format_string("%d", F.floor(F.col(c) + 0.5).cast("long"))
        if c == "name":
            return csv_field(F.col(c))
        return F.format_string("%.6f" if c.endswith(("_lat", "_lon")) else "%.3f", F.col(c))

    return ranked.select("rank", F.concat_ws(",", *[shown(c) for c in CSV_COLUMNS[mode]]).alias("line"))


def export_csv(ranked: DataFrame, mode: str, path: str) -> None:
    """One file: byte order mark and header, then the ranked rows in order, lines ended by CR LF. A list is short."""
    head = ranked.sparkSession.createDataFrame([(0, "﻿" + ",".join(CSV_COLUMNS[mode]))], "rank int, line string")
    lines = head.union(csv_rows(ranked, mode)).coalesce(1).sortWithinPartitions("rank").select("line")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


