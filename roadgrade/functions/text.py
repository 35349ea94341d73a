"""Names, labels, numbers and links as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GRADE_BREAK, GRADE_MAX, GRADE_MIN, RAMPS
from .geo import bearing_rad, haversine_m, js_round

# fixed values: street types and their short forms
STREET_TYPES = {
    "Avenue": "Ave", "Street": "St", "Road": "Rd", "Drive": "Dr", "Boulevard": "Blvd", "Lane": "Ln", "Court": "Ct", "Place": "Pl",
    "Circle": "Cir", "Terrace": "Ter", "Parkway": "Pkwy", "Highway": "Hwy", "Extension": "Ext", "Trail": "Trl", "Square": "Sq",
    "Crescent": "Cres", "Heights": "Hts", "Turnpike": "Tpke", "Expressway": "Expy", "Freeway": "Fwy", "Junction": "Jct",
}
# fixed values: states of the USA and their postal codes
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT",
    "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE",
    "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
# fixed values: parts of a label that are left out, and what counts as coordinates
DROPPED_PLACES = "(County|Parish|Borough|Census Area|Municipality)"
COORDINATES = r"^(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)$"


def parse_lat_lon(text: Column) -> Column:
    """Struct lat, lon, label of a string such as ``35.2, -82.7``; null for any other and for impossible places."""
    t = F.trim(text)
    lat, lon = (F.regexp_extract(t, COORDINATES, k).try_cast("double") for k in (1, 2))
    ok = t.rlike(COORDINATES) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon"), F.format_string("%.4f, %.4f", lat, lon).alias("label")))


def place_key(text: Column) -> Column:
    """A place name in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def search_key(lat: Column, lon: Column, radius_m: Column) -> Column:
    return F.format_string("%.3f,%.3f,%d", lat, lon, js_round(radius_m))


def road_name(name: Column, ref: Column) -> Column:
    """The name, or the first of the references, or null."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.trim(F.split(ref, ";")[0]), F.lit("")))


def abbrev_name(name: Column) -> Column:
    for long, short in STREET_TYPES.items():
        name = F.regexp_replace(name, rf"\b{long}\b", short)
    return name


def short_label(label: Column) -> Column:
    """A place's label without counties (but for the first part), with postal codes of states and US for the country."""
    parts = F.transform(F.split(label, ","), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x, i: (i == 0) | ~x.rlike(rf"\b{DROPPED_PLACES}\b"))
    codes = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.array_join(
        F.transform(kept, lambda x, i: F.when(i == 0, x).when(x.isin("United States", "United States of America"), "US").otherwise(F.coalesce(F.try_element_at(codes, x), x))), ", "
    )


def one_decimal(x: Column) -> Column:
    """x rounded to one decimal by its exact binary value, halves to even: 9.35 is a little less than that and gives 9.3.

    ``format_string`` rounds the shortest decimal form instead (9.4). 10 x is s + low without error, as 8 x and 2 x are exact.
    """
    a = F.abs(x)
    s = a * 10
    low = a * 2 - (s - a * 8)
    whole = F.floor(s)
    past = s - (whole + 0.5)
    up = (past > 0) | ((past == 0) & ((low > 0) | ((low == 0) & (whole % 2 == 1))))
    return F.signum(x) * (whole + up.cast("int")) / 10


def fmt_pct(grade: Column) -> Column:
    return F.format_string("%.1f%%", one_decimal(F.when(F.abs(grade) < 0.0005, F.lit(0.0)).otherwise(grade * 100)))


def fmt_len(m: Column) -> Column:
    return F.when(m >= 1000, F.format_string("%.1f km", one_decimal(m / 1000))).otherwise(F.format_string("%d m", js_round(m)))


def fmt_climb(gain: Column, span: Column, grade: Column) -> Column:
    return F.concat(F.format_string("↑%dm/%dm ≈ ", js_round(gain), js_round(span)), fmt_pct(grade))


def fmt_incline(gain: Column, grade: Column) -> Column:
    return F.concat(F.format_string("↑%dm ≈ ", js_round(gain)), fmt_pct(grade))


def view_angles(lat1: Column, lon1: Column, e1: Column, lat2: Column, lon2: Column, e2: Column) -> Column:
    """Struct lat, lon, heading, pitch (degrees, one decimal) for a look from the lower of two points at the higher."""
    up = e2 >= e1
    pick = lambda a, b: F.when(up, a).otherwise(b)
    flat, flon, tlat, tlon = pick(lat1, lat2), pick(lon1, lon2), pick(lat2, lat1), pick(lon2, lon1)
    heading = F.degrees(bearing_rad(flat, flon, tlat, tlon))
    heading = F.when(heading < 0, heading + 360).otherwise(heading)
    pitch = F.degrees(F.atan2(F.abs(e2 - e1), haversine_m(lat1, lon1, lat2, lon2)))
    return F.struct(flat.alias("lat"), flon.alias("lon"), F.round(heading, 1).alias("heading"), F.round(pitch, 1).alias("pitch"))


def street_view_url(angles: Column) -> Column:
    """Link to a street-level view for the struct of ``view_angles``."""
    return F.format_string(
        "https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=%.6f,%.6f&heading=%.1f&pitch=%.1f", angles["lat"], angles["lon"], angles["heading"], angles["pitch"]
    )


# fixed values in the next two functions: the public matrices between linear light, cones and Oklab, and sRGB's curve
def _oklab(rgb: str) -> tuple[float, float, float]:
    lin = [(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4) for c in (int(rgb[k : k + 2], 16) / 255 for k in (1, 3, 5))]
    cone = [
        (0.4122214708 * lin[0] + 0.5363325363 * lin[1] + 0.0514459929 * lin[2]) ** (1 / 3),
        (0.2119034982 * lin[0] + 0.6806995451 * lin[1] + 0.1073969566 * lin[2]) ** (1 / 3),
        (0.0883024619 * lin[0] + 0.2817188376 * lin[1] + 0.6299787005 * lin[2]) ** (1 / 3),
    ]
    return (
        0.2104542553 * cone[0] + 0.7936177850 * cone[1] - 0.0040720468 * cone[2],
        1.9779984951 * cone[0] - 2.4285922050 * cone[1] + 0.4505937099 * cone[2],
        0.0259040371 * cone[0] + 0.7827717662 * cone[1] - 0.8086757660 * cone[2],
    )


def grade_color(grade: Column, ramp: str = "red", theme: str = "light") -> Column:
    """rgb() of a grade on a two-piece ramp through Oklab; grades are clamped to the ramp's ends."""
    low, mid, high = (_oklab(c) for c in RAMPS[ramp, theme])
    g = F.least(F.greatest(grade, F.lit(GRADE_MIN)), F.lit(GRADE_MAX))
    lower = g <= GRADE_BREAK
    t = F.when(lower, (g - GRADE_MIN) / (GRADE_BREAK - GRADE_MIN)).otherwise((g - GRADE_BREAK) / (GRADE_MAX - GRADE_BREAK))
    lab = [F.when(lower, low[k] + t * (mid[k] - low[k])).otherwise(mid[k] + t * (high[k] - mid[k])) for k in range(3)]
    l, m, s = (F.pow(lab[0] + a * lab[1] + b * lab[2], F.lit(3.0)) for a, b in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))
    rgb = [
        4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s,
        -1.2684380046 * l + 2.6097574011 * m - 0.3413193965 * s,
        -0.0041960863 * l - 0.7034186147 * m + 1.7076147010 * s,
    ]
    out = []
    for c in rgb:
        c = F.greatest(c, F.lit(0.0))
        c = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
        out.append(js_round(F.least(c, F.lit(1.0)) * 255))
    return F.format_string("rgb(%d,%d,%d)", *out)


def export_name(mode: Column, window: Column, label: Column, prefix: str = "roads") -> Column:
    """File name of an export: the ranked quantity, then the place's first part in lower case with dashes."""
    place = F.regexp_replace(F.regexp_replace(F.lower(F.split(label, ",")[0]), "[^a-z0-9]+", "-"), "^-|-$", "")
    what = F.when(mode == "climb", "climbs").when(mode == "incline", "inclines").otherwise(F.format_string("sustained-%dm", js_round(window)))
    return F.concat_ws("-", F.lit(prefix), what, F.concat(F.when(place == "", "area").otherwise(place), F.lit(".csv")))
