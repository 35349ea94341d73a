"""Steep windows, stretches, climbs and inclines, and their ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import profile as kernels
from ..params import BOX_PAD, COL_FRAC, GRADE_MIN, HALF_STEP
from .profile import ROAD, along, by_road, islands


def min_windows(samples: DataFrame, window: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, i, j, span, grade): of each start the least window that is long enough (half a sample step is forgiven).

    A frame over distances, so a road's samples are sorted once. Samples are at most 31.25 m apart once a road has two
    segments, so the sought one lies within two steps of the bound; nothing wider is read.
    """
    bound = window - HALF_STEP
    frame = f"partition by {', '.join(keys)} order by d range between {bound}D following and {bound + 50.0}D following"
    end = F.expr(f"first(struct(k as j, d as d2, elev as e2)) over ({frame})")
    out = samples.select(*keys, F.col("k").alias("i"), "d", "elev", end.alias("x")).filter("x is not null")
    span = F.col("x.d2") - F.col("d")
    return out.select(*keys, "i", F.col("x.j").alias("j"), span.alias("span"), (F.abs(F.col("x.e2") - F.col("elev")) / span).alias("grade"))


def segment_sustained(samples: DataFrame, window: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, k, value): of each segment the largest grade of a window over it; no rows for a road that is shorter."""
    w = min_windows(samples, window, keys)
    return w.select(*keys, F.explode(F.sequence("i", F.col("j") - 1)).alias("k"), "grade").groupBy(*keys, "k").agg(F.max("grade").alias("value"))


def sustained_grade(samples: DataFrame, window: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, value): the largest of a road's windows, null for a road that is shorter than the window."""
    best = min_windows(samples, window, keys).groupBy(*keys).agg(F.max("grade").alias("value"))
    return samples.select(*keys).distinct().join(best, list(keys), "left")


def best_window(samples: DataFrame, window: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, i, j, span, grade) of each road's window of largest grade, the first of equals."""
    pick = F.max(F.struct("grade", (-F.col("i")).alias("minus_i"), "i", "j", "span")).alias("x")
    return min_windows(samples, window, keys).groupBy(*keys).agg(pick).select(*keys, "x.i", "x.j", "x.span", "x.grade")


def rankable(samples: DataFrame, window: float, keys: Sequence[str] = ROAD) -> DataFrame:
    return sustained_grade(samples, window, keys).filter("value is not null")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of one list with their rank; only n rows ever meet in one place."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def top_by_area(df: DataFrame, n: int, *order: Column, area: str = "area_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(area).orderBy(*order))).filter(F.col("rank") <= n)


def warm_runs(value: DataFrame, min_grade: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, i, j, n): runs of segments whose sustained grade is at least min_grade, as samples i to j."""
    return (
        islands(value, F.col("value") >= min_grade, keys)
        .groupBy(*keys, "island")
        .agg(F.min("k").alias("i"), (F.max("k") + 1).alias("j"), F.count("*").alias("n"))
        .drop("island")
    )


_I, _D = T.IntegerType(), T.DoubleType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def sustained_stretches(roads: DataFrame, window: float, min_grade: float, most: int = 3, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, i, j, grade, span): a road's separate steep stretches, largest grade first. From array form."""
    make = lambda d, e: [(n, *x) for n, x in enumerate(kernels.stretches(d, e, window, min_grade, most))]
    return by_road(roads, make, _schema(n=_I, i=_I, j=_I, grade=_D, span=_D), keys)


def hardest_climbs(roads: DataFrame, most: int = 3, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, score, gain, span, grade, i, j, dir): a road's climbs. From array form."""
    make = lambda d, e: [(n, *x) for n, x in enumerate(kernels.climbs(d, e, most))]
    return by_road(roads, make, _schema(n=_I, score=_D, gain=_D, span=_D, grade=_D, i=_I, j=_I, dir=_I), keys)


def long_incline_mask(roads: DataFrame, min_span: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, k): the segments on long inclines. From array form."""

    def make(d: np.ndarray, e: np.ndarray) -> list:
        mask = kernels.incline_mask(d, e, min_span)
        return [] if mask is None else [(int(k),) for k in np.flatnonzero(mask)]

    return by_road(roads, make, _schema(k=_I), keys)


def longest_inclines(roads: DataFrame, min_span: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, i, j, span, gain, grade): a road's long inclines, longest first. From array form."""
    make = lambda d, e: [(n, *x) for n, x in enumerate(kernels.inclines(d, e, min_span))]
    return by_road(roads, make, _schema(n=_I, i=_I, j=_I, span=_D, gain=_D, grade=_D), keys)


def qualifying_pairs(roads: DataFrame, min_span: float, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, i, j, span, net): of each sample the farthest one with which it passes the incline tests but for rests. From
    array form: the pairs of a road's samples are looked at inside its row and never become rows."""
    return by_road(roads, lambda d, e: kernels.farthest(d, e, min_span), _schema(i=_I, j=_I, span=_D, net=_D), keys)


def climb_core(roads: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, i, j, value, net): of each road the pair of samples with the largest gain squared over distance. From array form."""

    def make(d: np.ndarray, e: np.ndarray) -> list:
        found = kernels.core(d, e)
        return [] if found is None else [(found[1], found[2], found[0], float(e[found[2]] - e[found[1]]))]

    return by_road(roads, make, _schema(i=_I, j=_I, value=_D, net=_D), keys)


def climb_effort(segs: DataFrame, climbs: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, effort): of each climb the sum of squared rises over distances."""
    rise = F.greatest(F.col("dir") * (F.col("elev2") - F.col("elev")), F.lit(0.0))
    on = climbs.select(*keys, "n", "i", "j", "dir").join(segs, list(keys)).filter((F.col("k") >= F.col("i")) & (F.col("k") < F.col("j")))
    return on.groupBy(*keys, "n").agg(F.sum(F.try_divide(rise * rise, F.col("d2") - F.col("d"))).alias("effort"))


def bbox(samples: DataFrame, extents: DataFrame, keys: Sequence[str] = ROAD, pad: float = BOX_PAD) -> DataFrame:
    """(keys, n, lat_min, lat_max, lon_min, lon_max): padded box around samples i to j of each extent."""
    on = extents.select(*keys, "n", "i", "j").join(samples.select(*keys, "k", "lat", "lon"), list(keys)).filter(F.col("k").between(F.col("i"), F.col("j")))
    return on.groupBy(*keys, "n").agg(
        (F.min("lat") - pad).alias("lat_min"), (F.max("lat") + pad).alias("lat_max"), (F.min("lon") - pad).alias("lon_min"), (F.max("lon") + pad).alias("lon_max")
    )


def containing_extent(points: DataFrame, extents: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """Each point (keys, k) with n of the first extent with i <= k < j, null if there is none."""
    hit = points.select(*keys, "k").join(extents.select(*keys, "n", "i", "j"), list(keys)).filter((F.col("i") <= F.col("k")) & (F.col("k") < F.col("j")))
    first = hit.groupBy(*keys, "k").agg(F.min("n").alias("n"))
    return points.join(first, [*keys, "k"], "left")


def climb_of_stretch(stretches: DataFrame, climbs: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """Adds climb_n: the first climb that holds the stretch's middle, else the road's best climb, else null."""
    c = climbs.select(*keys, F.col("n").alias("cn"), F.col("i").alias("ci"), F.col("j").alias("cj"))
    mid = (F.col("i") + F.col("j")) / 2
    both = stretches.select(*keys, "n", "i", "j").join(c, list(keys)).groupBy(*keys, "n")
    inside = F.min(F.when((F.col("ci") <= mid) & (mid <= F.col("cj")), F.col("cn")))
    return stretches.join(both.agg(F.coalesce(inside, F.min("cn")).alias("climb_n")), [*keys, "n"], "left")


def dedupe_same_hill(entries: DataFrame, area: Sequence[str] = (), order: Sequence[str] = ("rank_key",)) -> DataFrame:
    """Best-first (least of ``order``) without those whose padded box meets that of a kept entry of another road of the same name.

    Needs road_id, name, unnamed and the box columns. Conflicts are found on a grid and worked off in rounds
    (``graph.losers``), so no name is gathered in one task; unnamed roads pass by.
    """
    from .graph import checkpointed, losers, same_name_conflicts

    box = ("lat_min", "lat_max", "lon_min", "lon_max")
    rows = checkpointed(entries.withColumn("id", F.monotonically_increasing_id()))
    items = rows.filter("not unnamed").select(*area, "id", "name", "road_id", *box, F.struct(*[c for c in order], F.col("id").alias("_id")).alias("order"))
    lost = losers(same_name_conflicts(items, area, lambda x, y: F.col(f"order_{x}") < F.col(f"order_{y}")))
    return rows.join(lost, "id", "left_anti").select(entries.columns)


def rank_stretches(entries: DataFrame, n: int, area: str = "area_id") -> DataFrame:
    return top_by_area(entries, n, F.desc("grade"), F.col("road_id"), F.col("n"), area=area)


def rank_climbs(entries: DataFrame, value: DataFrame, n: int, area: str = "area_id") -> DataFrame:
    """Climbs of roads that have a sustained value, by score, then the road's best score, then order."""
    best = F.max("score").over(W.partitionBy(area, "road_id"))
    ok = entries.join(value.filter("value is not null").select(area, "road_id"), [area, "road_id"], "left_semi").withColumn("_best", best)
    return top_by_area(ok, n, F.desc("score"), F.desc("_best"), F.col("road_id"), F.col("n"), area=area).drop("_best")


def rank_inclines(entries: DataFrame, n: int, area: str = "area_id") -> DataFrame:
    return top_by_area(entries, n, F.desc("span"), F.col("seq"), area=area)


def ranked_spans(ranked: DataFrame, area: str = "area_id") -> DataFrame:
    """(area, road_id, i, j, rank) of all kept entries, before any limit."""
    return ranked.select(area, "road_id", "i", "j", "rank")


def incline_slices(ranked: DataFrame, area: str = "area_id") -> DataFrame:
    """A row for each slice of each incline: (area, rank, road_id, from, to)."""
    return ranked.select(area, "rank", F.explode("segs").alias("s")).select(area, "rank", "s.*")


def ranking_summary(values: DataFrame, inclines: DataFrame, area: str = "area_id") -> DataFrame:
    a = values.filter("value is not null").groupBy(area).agg(F.count("*").alias("n_roads"))
    b = inclines.groupBy(area).agg(F.count("*").alias("n_inclines"))
    return a.join(b, area, "full").select(area, F.coalesce("n_roads", F.lit(0)).alias("n_roads"), F.coalesce("n_inclines", F.lit(0)).alias("n_inclines"))


def window_monotone(short: DataFrame, long: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """Roads with ok: the value over the longer window isn't above that over the shorter (1e-9 forgiven)."""
    x = short.select(*keys, F.col("value").alias("short")).join(long.select(*keys, F.col("value").alias("long")), list(keys))
    return x.filter("long is not null").withColumn("ok", F.col("long") <= F.col("short") + 1e-9)


def largest_in(value: DataFrame, extents: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, k, value): the segment of largest sustained grade in each extent, the first of equals."""
    on = extents.select(*keys, "n", "i", "j").join(value, list(keys)).filter((F.col("k") >= F.col("i")) & (F.col("k") < F.col("j")))
    best = F.max(F.struct("value", (-F.col("k")).alias("minus_k"))).alias("x")
    return on.groupBy(*keys, "n").agg(best).select(*keys, "n", (-F.col("x.minus_k")).alias("k"), "x.value")


def extend_shoulders(value: DataFrame, stretches: DataFrame, keys: Sequence[str] = ROAD) -> DataFrame:
    """(keys, n, i, j): stretches grown while the sustained grade is at least max(3 %, 0.8 of the stretch's grade)."""
    floor_ = F.greatest(F.lit(GRADE_MIN), COL_FRAC * F.col("grade"))
    on = stretches.select(*keys, "n", "i", "j", "grade").join(value, list(keys), "left")
    weak = F.col("value") < floor_
    g = on.groupBy(*keys, "n", "i", "j").agg(
        F.max(F.when(weak & (F.col("k") < F.col("i")), F.col("k") + 1)).alias("lo"),
        F.min(F.when(weak & (F.col("k") >= F.col("j")), F.col("k"))).alias("hi"),
        F.min("k").alias("first"),
        (F.max("k") + 1).alias("last"),
    )
    return g.select(*keys, "n", F.least(F.coalesce("lo", "first", "i"), F.col("i")).alias("i"), F.greatest(F.coalesce("hi", "last", "j"), F.col("j")).alias("j"))


def bar_fraction(ranked: DataFrame, value: str, area: str = "area_id") -> DataFrame:
    """Adds frac: value over the area's top value, two hundredths at least."""
    w = W.partitionBy(area).orderBy("rank")
    return ranked.withColumn("frac", F.greatest(F.try_divide(F.col(value), F.first(value).over(w)), F.lit(0.02)))


def draw_order(roads: DataFrame, area: str = "area_id") -> DataFrame:
    """Adds z_order: unlisted roads first, then listed ones with the best on top."""
    w = W.partitionBy(area).orderBy(F.desc_nulls_first("rank"), "road_id")
    return roads.withColumn("z_order", F.row_number().over(w))
