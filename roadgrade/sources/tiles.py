"""Terrain tiles: reading, and elevations of samples."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bilinear, tile_xy
from ..params import TILE_SIZE, TILE_ZOOM


def decode_png(content: bytes) -> np.ndarray:
    """Metres of an 8-bit RGB or RGBA PNG whose bytes are high, low and fraction; not interlaced."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in (2, 6) or interlace:
        raise ValueError("only 8-bit RGB and RGBA without interlace")
    bpp = 3 if color == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * bpp)
    out = np.zeros((height, width * bpp), np.int64)
    for y in range(height):  # each line undoes its filter from the line above
        f, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        above = out[y - 1] if y else np.zeros(width * bpp, np.int64)
        if f == 0:
            out[y] = line
        elif f == 2:
            out[y] = (line + above) & 255
        elif f == 1:
            out[y] = (np.cumsum(line.reshape(width, bpp), axis=0) & 255).ravel()
        else:
            for x in range(width * bpp):
                a = out[y, x - bpp] if x >= bpp else 0
                c = above[x - bpp] if x >= bpp else 0
                if f == 3:
                    p = (a + above[x]) // 2
                else:
                    e = a + above[x] - c
                    p = min((abs(e - a), 0, a), (abs(e - above[x]), 1, above[x]), (abs(e - c), 2, c))[2]
                out[y, x] = (line[x] + p) & 255
    rgb = out.reshape(height, width, bpp).astype(float)
    return (rgb[..., 0] * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768).ravel()


def read_tiles(spark: SparkSession, path: str, decoder: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """(z, x, y, raster) from files named .../z/x/y.png; the decoder turns a file's bytes into its metres, row by row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = r"(\d+)/(\d+)/(\d+)\.[A-Za-z]+$"
    files = files.select(*[F.regexp_extract("path", name, k).cast("int").alias(c) for k, c in ((1, "z"), (2, "x"), (3, "y"))], "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raster=[decoder(c) for c in pdf["content"]])[["z", "x", "y", "raster"]]

    return files.mapInPandas(run, "z int, x int, y int, raster array<double>")


def needed_tiles(samples: DataFrame, loaded: DataFrame | None = None, zoom: int = TILE_ZOOM) -> DataFrame:
    """Distinct (z, x, y) that samples need, without those loaded."""
    t = tile_xy(F.col("lat"), F.col("lon"), zoom)
    need = samples.select(F.lit(zoom).alias("z"), t.alias("t")).select("z", "t.x", "t.y").distinct()
    return need if loaded is None else need.join(loaded.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def elevate(samples: DataFrame, tiles: DataFrame, zoom: int = TILE_ZOOM, size: int = TILE_SIZE, piece: int = 4096) -> DataFrame:
    """samples with elev, from the one tile that each lies in; null where the tile is missing.

    A tile's samples are gathered in pieces before they meet its raster, so that the raster isn't copied for each. A
    piece holds those of some ``piece`` neighbouring rows, so no tile, however crowded, is gathered whole.
    """
    t = tile_xy(F.col("lat"), F.col("lon"), zoom)
    cols = samples.columns
    s = samples.select(F.struct(*cols).alias("s"), t.alias("t"), F.floor(F.monotonically_increasing_id() / piece).alias("piece"))
    s = s.groupBy(F.lit(zoom).alias("z"), "t.x", "t.y", "piece").agg(F.collect_list(F.struct("s", *[(F.col(f"t.p{c}") * (size / TILE_SIZE)).alias(f"p{c}") for c in "xy"])).alias("many"))
    on = s.join(tiles, ["z", "x", "y"], "left")
    at = F.transform("many", lambda m: F.struct(m["s"].alias("s"), F.when(F.col("raster").isNotNull(), bilinear(F.col("raster"), m["px"], m["py"], size)).alias("elev")))
    return on.select(F.explode(at).alias("r")).select("r.s.*", "r.elev")


#: Pixels a side of the blocks of a laid-out store.
BLOCK = 16


def _spread(x: Column) -> Column:
    """The bits of a number under 2 ** 31, one place apart."""
    x = x.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def block_key(z: Column, x: Column, y: Column) -> Column:
    """A number for block (x, y) of zoom z, counted over the whole map: places near each other have near numbers."""
    return F.shiftleft(z.cast("long"), 57).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(x))


def lay_out(tiles: DataFrame, table: str, path: str, buckets: int, size: int = TILE_SIZE, block: int = BLOCK) -> None:
    """Write (z, x, y, raster) as a table of blocks, bucketed and sorted by their keys: (key, pixels).

    A block holds its pixels and the next line and column, as far as the tile goes (its last ones are repeated), so that any
    place in it is interpolated from it alone. Blocks are small, so a crowded tile's samples lie in many rows and buckets.
    """
    n = -(-size // block)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.struct((k % n).alias("bx"), F.floor(k / n).cast("int").alias("by"))))
    clamp = lambda v: F.least(v, F.lit(size - 1))
    steps = F.sequence(F.lit(0), F.lit(block))
    pixel = lambda dy, dx: F.get("raster", clamp(F.col("b.by") * block + dy) * size + clamp(F.col("b.bx") * block + dx))
    pixels = F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dx: pixel(dy, dx))))
    key = block_key(F.col("z"), F.col("x") * n + F.col("b.bx"), F.col("y") * n + F.col("b.by"))
    blocks = tiles.select("z", "x", "y", "raster", at.alias("b")).select(key.alias("key"), pixels.alias("pixels"))
    # a task has one bucket, so that there is one file for each
    blocks.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(table)


def elevate_stored(samples: DataFrame, table: str, zoom: int = TILE_ZOOM, size: int = TILE_SIZE, block: int = BLOCK) -> DataFrame:
    """samples with elev from a laid-out table, null where its tile is missing: as ``elevate``, but only samples are moved.

    The table's buckets meet samples that are dealt by the same key, so no raster is shuffled or copied for a sample; a
    task reads a block once for all samples in it.
    """
    n, limit = -(-size // block), F.lit(float(size - 1))
    t = tile_xy(F.col("lat"), F.col("lon"), zoom)
    s = samples.select(F.struct(*samples.columns).alias("s"), t.alias("t"))
    s = s.select("s", "t.x", "t.y", *[F.least(F.greatest(F.col(f"t.p{c}") * (size / TILE_SIZE) - 0.5, F.lit(0.0)), limit).alias(f"f{c}") for c in "xy"])
    s = s.select("s", "x", "y", "fx", "fy", *[F.floor(f"f{c}").cast("int").alias(f"i{c}") for c in "xy"]).withColumns({f"b{c}": F.floor(F.col(f"i{c}") / block).cast("int") for c in "xy"})
    key = block_key(F.lit(zoom), F.col("x") * n + F.col("bx"), F.col("y") * n + F.col("by"))
    s = s.select("s", key.alias("key"), ((F.col("iy") - F.col("by") * block) * (block + 1) + F.col("ix") - F.col("bx") * block).alias("i"), (F.col("fx") - F.col("ix")).alias("u"), (F.col("fy") - F.col("iy")).alias("v"))
    on = s.join(samples.sparkSession.table(table).hint("merge"), "key", "left")
    p = lambda k: F.get("pixels", F.col("i") + k).cast("double")
    u, v = F.col("u"), F.col("v")
    elev = (p(0) * (1 - u) + p(1) * u) * (1 - v) + (p(block + 1) * (1 - u) + p(block + 2) * u) * v
    return on.select("s.*", elev.alias("elev"))


def bilinear_join(points: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("tile_id",), size: int = TILE_SIZE) -> DataFrame:
    """points (keys, px, py) with elev from the raster of the equal key."""
    return points.join(tiles, list(keys)).withColumn("elev", bilinear(F.col("raster"), F.col("px"), F.col("py"), size)).drop("raster")
