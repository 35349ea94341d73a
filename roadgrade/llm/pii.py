"""Personal data in DataFrame expressions only: base patterns, then bootstrapped contextual extraction.

What the base patterns find are the seeds. Each seed induces patterns: the word before it, the two words before it, the
word after it, the words on both sides, and its own shape (digits as 0, letters as a, the characters that touch it). The
same patterns also hold other identifier-like words (six or more characters, four or more of them digits), the
instances. Those that have the form of a card, an address or a phone number and fail its test are known not to be any. Pattern
and instance scores are computed from each other for a few rounds: a pattern's is the mean score of
its distinct instances, an unseen instance's the mean of its patterns that some seed induced. Seeds count 1; what fails
a test and words that stand in very many different contexts count 0, and so does every other place in the corpus where the
pattern's words stand round something else. Words behind patterns of high final score, induced by
several distinct seeds, are reported as further identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, let, spans_of

KINDS = ["email", "ip", "card", "phone", "context"]
# possessive and guarded forms of the contract's patterns: the same leftmost matches without backtracking over long runs
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]{6,}+"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ROUNDS, MIN_SEEDS, CONFIDENCE = 4, 3, 0.8
#: Instances of score zero that a pattern is taken to have besides those seen; keeps rarely seen patterns low. Three seeds
#: and one unseen word make 0.85. After the rounds a pattern passes if about a third of its instances are seeds.
PRIOR = 0.5
#: Up to so many keys of patterns are sent to all tasks; more are joined by a shuffle.
FEW = 1_000_000
#: A word behind so many different words is an ordinary one.
ORDINARY = 12


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: (lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))(c.cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _plain(words: Column) -> Column:
    """Lower case, digits as 0, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(words), f"{SPACE}+", " "), "[0-9]", "0")


def _induced(left: Column, m: Column, right: Column) -> Column:
    """The patterns of a span: array of (pattern, the kind first; key, the hash of its words, null for shapes)."""
    before = F.trim(_plain(F.regexp_extract(left, rf"^(?:{WORD}{SPACE}++)*+", 0)))
    touching = F.regexp_extract(left, r"[^\x20\x09-\x0D]*+$", 0)
    shape = F.concat_ws(" ", F.lit("shape"), F.regexp_replace(F.right(touching, F.lit(1)), "[A-Za-z0-9]", "~"), F.regexp_replace(_plain(m), "[a-z]", "a"))
    made = lambda pattern, key: F.struct(pattern.alias("pattern"), key.alias("key"))

    def all_(x: Column) -> Column:
        two, one, after = F.substring_index(x["before"], " ", 1), F.substring_index(x["before"], " ", -1), x["after"]
        return F.filter(
            F.array(
                F.when(x["before"] != "", made(F.concat(F.lit("before "), one), F.xxhash64(one))),
                F.when(F.instr(x["before"], " ") > 0, made(F.concat(F.lit("before "), x["before"]), F.xxhash64(two, one))),
                F.when(after != "", made(F.concat(F.lit("after "), after), F.xxhash64(after))),
                F.when((x["before"] != "") & (after != ""), made(F.concat(F.lit("around "), one, F.lit(" * "), after), F.xxhash64(one, F.lit("*"), after))),
                made(shape, F.lit(None).cast("long")),
            ),
            lambda p: p.isNotNull(),
        )

    return let(F.struct(before.alias("before"), _plain(right).alias("after")), all_)


def _places(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, places: how often the words of each key stand in the texts."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[0-9]", "0"), F.lit(f"({WORD})"), F.lit(1))

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w))
        get = lambda i: F.get(w, i)
        return F.flatten(F.transform(F.filter(at, lambda i: i > 0), lambda i: F.array(F.xxhash64(get(i - 1)), F.xxhash64(get(i - 1), get(i)), F.xxhash64(get(i - 1), F.lit("*"), get(i + 1)))))

    keys = cut(keys.distinct())
    small = F.broadcast(keys) if keys.count() <= FEW else keys
    return docs.select(F.explode(let(words, hashes)).alias("key")).join(small, "key", "left_semi").groupBy("key").agg(F.count("*").alias("places"))


def _with_context(text: Column, pattern: str) -> Column:
    """Spans of a pattern, each with the patterns it induces."""

    def induced(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), _induced(s["left"], s["m"], s["right"]).alias("patterns"))

    return F.transform(spans_of(text, pattern, context=True), induced)


def base(docs: DataFrame) -> DataFrame:
    """row, doc_id, the four kinds' spans and the other identifier-like tokens, each span with text and context; tokens that
    have a kind's form and fail its test are marked as bad."""
    text = F.coalesce("text", F.lit(""))
    digits = lambda s: F.length(_digits(s["m"]))
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "tokens": TOKEN}
    ok = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: digits(s).between(13, 19) & luhn(_digits(s["m"])),
        "phone": lambda s: digits(s).between(9, 15),
    }
    # numbers of other lengths than a card's aren't of its form
    fails = {"ip": lambda s: ~ok["ip"](s), "card": lambda s: digits(s).between(13, 19) & ~luhn(_digits(s["m"])), "phone": lambda s: ~ok["phone"](s)}
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[_with_context(text, p).alias(k) for k, p in forms.items()])
    rejected = F.concat(*[F.filter(k, f) for k, f in fails.items()])
    found = cut(found.select("row", "doc_id", *[F.filter(k, f).alias(k) for k, f in ok.items()], rejected.alias("rejected"), F.filter("tokens", lambda s: digits(s) >= 4).alias("tokens")))
    meets = lambda spans, t: F.exists(spans, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"]))
    free = F.filter("tokens", lambda t: ~meets(F.concat(*KINDS[:4]), t))
    marked = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["m"].alias("m"), t["patterns"].alias("patterns"), meets(F.col("rejected"), t).alias("bad")))
    return found.select("row", "doc_id", *KINDS[:4], marked.alias("tokens"))


def patterns(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score, n_seeds of the patterns that some seed induces, after the rounds over the pattern-instance graph.

    found: ``base(docs)``.
    """
    what = ("s.m", "s.patterns")
    seeds = found.select(F.explode(F.concat(*KINDS[:4])).alias("s")).select(*what, F.lit(True).alias("seed"), F.lit(False).alias("bad"))
    others = found.select(F.explode("tokens").alias("s")).select(*what, F.lit(False).alias("seed"), "s.bad")
    edges = (
        seeds.union(others)
        .select(F.explode("patterns").alias("p"), F.xxhash64(F.lower("m")).alias("instance"), "seed", "bad")
        .groupBy("p.pattern", "p.key", "instance")
        .agg(F.max("seed").alias("seed"), F.max("bad").alias("bad"), F.count("*").alias("times"))
    )
    edges = cut(edges)
    used = cut(edges.groupBy("pattern", "key").agg(F.sum(F.col("seed").cast("long")).alias("n_seeds"), F.sum("times").alias("times")).filter("n_seeds > 0"))
    places = _places(docs, used.select("key").filter("key is not null"))
    used = used.join(places, "key", "left").select("pattern", "n_seeds", F.greatest(F.coalesce("places", F.lit(0)) - F.col("times"), F.lit(0)).alias("elsewhere"))
    used = cut(used)
    wide = F.sum(F.startswith("pattern", F.lit("before ")).cast("long")) >= 2 * ORDINARY  # one and two words before, each
    instances = edges.groupBy("instance").agg(F.max("seed").alias("seed"), (~F.max("seed") & (wide | F.max("bad"))).alias("ordinary"))
    # at first an unseen word is worth what the known words of its shape are
    kind = edges.filter(F.startswith("pattern", F.lit("shape "))).select("pattern", "instance").join(instances, "instance")
    shapes = kind.groupBy("pattern").agg((F.sum(F.col("seed").cast("long")) / (F.sum((F.col("seed") | F.col("ordinary")).cast("long")) + 1)).alias("share"))
    shapes = shapes.filter("share > 0")
    first = F.when(F.col("seed"), 1.0).when(F.col("ordinary"), 0.0).otherwise(F.round(F.coalesce("share", F.lit(0.0)), 9))
    scores = cut(kind.join(shapes, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.max("ordinary").alias("ordinary"), F.max("share").alias("share")).select("instance", "seed", "ordinary", first.alias("score")))
    # only patterns that some seed induced can ever pass, so only their edges stay
    live = cut(edges.select("pattern", "instance").join(used, "pattern"))
    of_pattern = None
    for _ in range(rounds):
        of_pattern = cut(
            live.join(scores.select("instance", "score"), "instance")
            .groupBy("pattern")
            .agg(F.round(F.sum("score") / (F.count("*") + F.max("elsewhere") + PRIOR), 9).alias("score"), F.max("n_seeds").alias("n_seeds"))
        )
        seen = live.join(of_pattern.select("pattern", F.col("score").alias("p")), "pattern").groupBy("instance").agg(F.round(F.avg("p"), 9).alias("p"))
        score = F.when(F.col("seed"), 1.0).when(F.col("ordinary"), 0.0).otherwise(F.coalesce("p", F.lit(0.0)))
        scores = cut(scores.join(seen, "instance", "left").select("instance", "seed", "ordinary", score.alias("score")))
    return of_pattern


def _as_kind(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id and arrays of spans email, ip, card, phone, context (kind, start, end), one row for each input row.

    Null and empty texts have no spans; without seeds nothing is added. Repeated rows get the same spans each and count
    once as instances; rows without doc_id are scanned like others; of other columns none is read. Empty tables give no
    rows. An ordinary word is never added, nor one that fails the test of a kind whose form it has. Very long texts take time in
    proportion, also without spaces; words of more than ``common.LONGEST`` characters are no context.
    """
    found = base(docs)
    good = patterns(docs, found).filter((F.col("score") >= confidence) & (F.col("n_seeds") >= min_seeds)).select("pattern")
    added = (
        found.select("row", F.explode("tokens").alias("t"))
        .filter("not t.bad")
        .select("row", "t.start", "t.end", F.explode("t.patterns.pattern").alias("pattern"))
        .join(good, "pattern", "left_semi")
        .select("row", F.struct("start", "end").alias("t"))
        .distinct()
        .groupBy("row")
        .agg(F.collect_list(F.struct(F.lit(5).alias("kind"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))).alias("context"))
    )
    plain = [_as_kind(k, i).alias(k) for i, k in enumerate(KINDS[:4], 1)]
    return found.select("row", "doc_id", *plain).join(added, "row", "left").select(
        "doc_id", *KINDS[:4], F.coalesce("context", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("context")
    )


def _joined(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, then how many spans the patterns added and how many there are in all."""
    seeds = F.concat(*KINDS[:4])
    return scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(seeds).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(seeds, "context")).alias("spans"),
        F.size("context").cast("long").alias("n_context"),
        F.size(F.concat(seeds, "context")).cast("long").alias("n_spans"),
    )
