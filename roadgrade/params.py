"""Fixed values, and cleaning of a search's parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: classes of ways that are ranked, that carry decks, and roundabout tags
RANKED_HIGHWAYS = ["residential", "unclassified", "living_street", "tertiary", "secondary", "primary", "trunk", "motorway"]
ROUNDABOUTS = ["roundabout", "circular"]
DECK_HIGHWAYS = ["motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "service"]
DECK_RAILWAYS = ["rail", "light_rail", "subway", "tram", "narrow_gauge", "monorail", "funicular"]
# fixed values: metres, degrees and fractions
MAX_TURN_DEG, REF_DIST = 70.0, 20.0
UNDERPASS_HALF, DECK_CELL, M_PER_DEG, EPS = 40.0, 0.002, 111320.0, 1e-9
SAMPLE_STEP, HALF_STEP = 25.0, 12.5
MAX_GRADE, MAX_EXCURSION = 0.60, 250.0
COL_FRAC = 0.8
DIP_ABS, DIP_FRAC, INCLINE_GRADE = 2.0, 0.10, 0.03
DEAD_RUN, DEAD_GRADE = 300.0, 0.015
JOIN_TOL, BOX_PAD = 20.0, 0.0005
EXTEND_TOP, EXTEND_BOTTOM, MIN_GAIN = 0.03, 0.04, 2.0
GRADE_MIN, GRADE_BREAK, GRADE_MAX, COLOR_BINS = 0.03, 0.12, 0.25, 22
RAMPS = {
    ("red", "light"): ("#fbd3d0", "#dd2c22", "#400503"),
    ("red", "dark"): ("#5a1512", "#e5352a", "#fbd3d0"),
    ("indigo", "light"): ("#d7dcfc", "#6761f4", "#191648"),
    ("indigo", "dark"): ("#292863", "#6d68fc", "#d7dcfc"),
}
WIDTH_MIN, WIDTH_PER_M, WIDTH_MAX = 3.0, 0.14, 14.0
CURVY_TURN, CURVY_WINDOW, DENSIFY_RATIO = 0.025, 100.0, 1.02
STORE_VERSION, STORE_DAYS, GEOCODE_DAYS = 10, 14, 30
TILE_SIZE, TILE_ZOOM = 256, 13
EARTH_RADIUS = 6371000.0


def clean_params(params: DataFrame) -> DataFrame:
    """radius_km, window_m, long_m, list_size, max_roads within their limits; nulls get the defaults. One row a setting."""

    def limited(name: str, default: float, low: float | None, high: float | None = None):
        x = F.coalesce(F.col(name).cast("double"), F.lit(default))
        x = x if low is None else F.greatest(x, F.lit(low))
        return (x if high is None else F.least(x, F.lit(high))).alias(name)

    return params.select(
        *[c for c in params.columns if c not in ("radius_km", "window_m", "long_m", "list_size", "max_roads")],
        limited("radius_km", 5.0, 1.0, 15.0),
        limited("window_m", 250.0, 25.0),
        limited("long_m", 800.0, 50.0),
        limited("list_size", 15.0, 1.0, 100.0).cast("int").alias("list_size"),
        limited("max_roads", 1.0, 1.0, 5.0).cast("int").alias("max_roads"),
    )
