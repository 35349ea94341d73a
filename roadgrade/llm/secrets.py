"""Secret scans in DataFrame expressions only.

Base patterns find assignments, access keys and long hexadecimal runs. Beside them every long token that holds letters
and digits goes through a battery of randomness tests over the alphabet of its inferred encoding: chi-squared
uniformity, runs about the alphabet's middle, serial correlation. The three give one p-value under "this is random".
Within each class of encoding and length (short tokens give the tests little power, so they are judged apart) two rates
are held over the distinct tokens: the Benjamini-Hochberg rule bounds the share of random ones among those called
ordinary, and the estimated share of ordinary ones among those reported is bounded too. What is reported overlaps no
base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, spans_of

KINDS = ["assign", "access", "hex", "random"]
# the look-ahead only spares positions at which no alternative can begin
ASSIGN = r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: Share of truly random tokens among those called ordinary, at most.
RATE = 0.05
#: Estimated share of ordinary tokens among those reported, at most; p-values above LAMBDA count as random ones'.
FALSE_SECRETS, LAMBDA = 0.1, 0.05
#: p-values are rounded up to 100 steps a power of ten; the least is some 1e-43.
STEPS = 100
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[a-z0-9]+$"), "base36")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )


def randomness(token: Column) -> Column:
    """Struct of encoding, length class and p: how well a token passes for random symbols of its encoding's alphabet."""
    alphabets = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base62": _DIGITS + _UPPER + _LOWER}

    def read(kind: Column) -> Column:
        alphabet = F.lit(_DIGITS + _UPPER + _LOWER + "+/")
        for name, symbols in alphabets.items():
            alphabet = F.when(kind == name, symbols).otherwise(alphabet)
        plain = F.when(kind == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
        return let(
            F.struct(kind.alias("encoding"), alphabet.alias("alphabet"), plain.alias("plain")),
            lambda i: let(F.transform(F.split(i["plain"], ""), lambda c: (F.instr(i["alphabet"], c) - 1).cast("double")), lambda x: _battery(kind, F.length(i["alphabet"]).cast("double"), x)),
        )

    return let(_encoding(token), read)


def _battery(kind: Column, k: Column, x: Column) -> Column:
    """The three tests over the symbols' numbers x, 0 to k - 1."""
    zero, add = F.lit(0.0), lambda a, b: a + b
    n = F.size(x).cast("double")
    pairs = lambda a, f: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f)
    squares = F.aggregate(F.array_distinct(x), zero, lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
    high = F.transform(x, lambda v: (v >= k / 2).cast("double"))
    first = F.struct(
        squares.alias("squares"),
        (F.aggregate(x, zero, add) / n).alias("mean"),
        F.aggregate(high, zero, add).alias("n1"),
        (1 + F.aggregate(pairs(high, lambda a, b: F.abs(a - b)), zero, add)).alias("runs"),
    )

    def moments(f: Column) -> Column:
        mean = f["mean"]
        var = F.aggregate(x, zero, lambda a, v: a + (v - mean) * (v - mean))
        lag = F.aggregate(pairs(x, lambda a, b: (a - mean) * (b - mean)), zero, add)
        return let(F.struct(var.alias("var"), lag.alias("lag")), lambda g: verdict(f, g))

    def verdict(f: Column, g: Column) -> Column:
        chi = k / n * f["squares"] - n
        z1 = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        n1, n2 = f["n1"], n - f["n1"]
        mu = 2 * n1 * n2 / n + 1
        z2 = F.when((n1 >= 1) & (n2 >= 1), (f["runs"] - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))).otherwise(F.lit(20.0))
        z3 = F.when(g["var"] > 0, (F.try_divide(g["lag"], g["var"]) + 1 / n) * F.sqrt(n)).otherwise(F.lit(20.0))
        size = F.least(F.floor(F.log2(n) * 2), F.lit(30)).cast("int")
        return let(
            F.least(z1 * z1 + z2 * z2 + z3 * z3, F.lit(200.0)),  # of three degrees of freedom
            lambda total: F.struct(
                F.concat_ws(":", kind, size.cast("string")).alias("class"),
                F.least(F.greatest(_erfc(F.sqrt(total / 2)) + F.sqrt(2 * total / math.pi) * F.exp(-total / 2), F.lit(0.0)), F.lit(1.0)).alias("p"),
            ),
        )

    return let(first, moments)


def level(p: Column) -> Column:
    """Steps of -log10(p), rounded down: the higher, the less random."""
    return F.floor(-STEPS * F.log10(F.greatest(p, F.lit(1e-60)))).cast("int")


def cutoffs(tokens: DataFrame, rate: float = RATE, false_secrets: float = FALSE_SECRETS) -> dict[str, int]:
    """(class, p, token) of all tokens -> least level of each class that is called ordinary. At most 5 x 31 classes come
    back, each from at most some 4400 levels; classes without an ordinary token are left out.

    With p rounded up to its level's bound, m distinct tokens and R(l) of them at level l or above: the first rule calls
    ordinary what is at the least l with p(l) <= rate * R(l) / m, or above. The second takes the tokens with p over
    LAMBDA, divided by 1 - LAMBDA, for the number of random ones, so (1 - p(l)) of that many are among the m - R(l) that
    would be reported; it needs the greatest l at which the others are a share of false_secrets at most. The lower of the
    two levels holds both.
    """
    levels = tokens.select("class", level(F.col("p")).alias("level"), F.xxhash64("token").alias("t")).distinct().groupBy("class", "level").agg(F.count("*").alias("n"))
    down, whole = W.partitionBy("class").orderBy(F.desc("level")), W.partitionBy("class")
    bound = F.pow(F.lit(10.0), -F.col("level") / STEPS)
    ranked = levels.select("class", "level", bound.alias("p"), "n", F.sum("n").over(down).alias("below"), F.sum("n").over(whole).alias("m"))
    random = F.sum(F.when(F.col("p") > LAMBDA, F.col("n")).otherwise(0)).over(whole) / (1 - LAMBDA)
    ranked = ranked.withColumn("random", F.least(random + 1, F.col("m").cast("double"))).withColumn("left", F.col("m") - F.col("below"))
    wrong = lambda left, p: 1 - F.col("random") * (1 - p) / left
    found = ranked.groupBy("class").agg(
        F.min(F.when(F.col("p") <= rate * F.col("below") / F.col("m"), F.col("level"))).alias("first"),
        F.max(F.when((F.col("p") <= LAMBDA) & ((F.col("left") == 0) | (wrong(F.col("left"), F.col("p")) <= false_secrets)), F.col("level"))).alias("second"),
        F.min(F.when(F.col("p") <= LAMBDA, F.col("level"))).alias("last"),
        F.max(wrong(F.col("m"), F.lit(0.0)) <= false_secrets).alias("clean"),
    )
    second = F.when(~F.col("clean"), F.coalesce("second", "last"))  # nothing is to be called ordinary if all of them together hold the rate
    return {r["class"]: r["level"] for r in found.select("class", F.least("first", second).alias("level")).filter("level is not null").collect()}


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ","
    )


def _as_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, assign, access, hex, random: arrays of spans in code points (start, kind, end), one row for each input row.

    Null and empty texts have no spans. Without any candidate token nothing is added to the base spans. Repeated rows get
    the same spans each, and their tokens count once; rows without doc_id are scanned like others; of other columns none
    is read. Tokens of equal p share their fate, one at the cut-off is ordinary. Empty tables give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    first = docs.select(
        "doc_id",
        _as_kind(F.filter(spans_of(text, ASSIGN, 2), lambda s: F.length(s["m"]) >= 12), 1).alias("assign"),
        _as_kind(spans_of(text, ACCESS), 2).alias("access"),
        _as_kind(spans_of(text, HEX), 3).alias("hex"),
        F.transform(spans_of(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), randomness(s["m"]).alias("r"))).alias("tokens"),
    )
    first = cut(first)
    at = cutoffs(first.select(F.explode("tokens").alias("t")).select("t.r.class", "t.r.p", F.col("t.m").alias("token")), rate)
    limit = F.create_map(*[F.lit(x) for kv in at.items() for x in kv]) if at else None
    base = F.concat("assign", "access", "hex")
    ordinary = (lambda t: F.coalesce(level(t["r"]["p"]) >= F.try_element_at(limit, t["r"]["class"]), F.lit(False))) if at else (lambda t: F.lit(False))
    extra = F.filter("tokens", lambda t: ~ordinary(t) & ~_overlaps(t, base))
    return first.select("doc_id", "assign", "access", "hex", _as_kind(extra, 4).alias("random"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, then how many spans the battery added and how many there are in all."""
    base = F.concat("assign", "access", "hex")
    return scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, "random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
        F.size(F.concat(base, "random")).cast("long").alias("n_spans"),
    )
