"""Operators on single texts: BPE, secrets, personal data, toxicity, quality."""

import hashlib
import math
import random
import time
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrade.llm import bpe, pii, quality, queries, secrets, toxicity


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(queries.ranks_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_strings(library):
    random.seed(3)
    alphabet = " '’stmdrevl\t\n  aé9٣!?\x85　​😀中$"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(1500)] + ["'" * 9, " 's", "  's", "\n's", "a" * 3000, "ab" * 400]
    out = bpe._encoder(queries.ranks_path())(list(range(len(texts))), texts)
    for t, ids, starts, counts in zip(texts, out["ids"], out["piece_start"], out["piece_tokens"], strict=True):
        assert list(ids) == library.encode_ordinary(t)
        assert counts.sum() == len(ids) and (not t or starts[0] == 0)


def test_bpe_blocks_do_not_matter():
    text = "It's  we'll\n\n'tis 12ab !!x' 're" * 40
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes), bool)
    first[[0, 700]] = True
    assert all(np.array_equal(bpe.piece_starts(codes, first), bpe.piece_starts(codes, first, b)) for b in (1, 7, 64, 5000))


def test_bpe_rows(odd, documents, library):
    for docs in (odd, documents):
        want = Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        want = Counter({(i, len(x := library.encode_ordinary(t)), sha(",".join(map(str, x))), sha(t)): n for (i, t), n in want.items()})
        got = Counter(tuple(r)[:4] for r in bpe.digest(docs, queries.ranks_path()).collect())
        assert set(got) == set(want) and sum(got.values()) == docs.count()


def test_merging_side_by_side_equals_piece_by_piece():
    ranks = bpe.read_ranks(queries.ranks_path())
    rng = random.Random(7)
    some = list(ranks)[:3000]
    pieces = [b"".join(rng.choice(some) for _ in range(rng.randrange(1, 6))) for _ in range(3000)] + [b"a" * n for n in range(1, 50)] + [bytes([n]) for n in range(256)]
    assert [list(x) for x in bpe.Merger(ranks)(pieces)] == [bpe.merge(p, ranks) for p in pieces]


def test_bpe_decodes_ranges_by_offsets(documents):
    docs = documents.filter("text is not null").limit(40)
    encoded = bpe.encode(docs, queries.ranks_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for a, b in ((0, 10), (37, 95), (10**7, 10**8)):
        for r in bpe.decode_range(encoded, queries.ranks_path(), a, b).collect():
            part = bytes(r["decoded"]).decode()
            assert texts[r["doc_id"]][a:b] in part and part in texts[r["doc_id"]] and len(part) < len(texts[r["doc_id"]][a:b]) + 80


def test_bpe_empty(make):
    assert bpe.digest(make([]), queries.ranks_path()).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def slow_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def luhn(d):
    return sum((c if i % 2 == 0 else c * 2 - 9 if c > 4 else c * 2) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


SECRET_BITS = ["token", "SECRET", "api_key", '="', " = ", ":", "abc123", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef01", "0123456789abcdef", " ", "\n", '"', "é", "😀", "=", "password", ".", "-"]
PRIVATE_BITS = ["a.b", "@", "x@y.com", ".", "1", "255", "256", "0007", "1.2.3.4", " ", "-", "4111 1111 1111 1111", "+1 (523) 555-1055", "+", "(", "%", "_", "é", "😀", "\n", "999999999999999999999", "c-d"]


@pytest.mark.parametrize(("report", "slow", "kinds", "bits"), [(secrets.report, slow_secrets, secrets.KINDS[:3], SECRET_BITS), (pii.report, slow_pii, pii.KINDS[:4], PRIVATE_BITS)])
def test_scans_equal_plain_matching(make, odd, documents, report, slow, kinds, bits):
    random.seed(11)
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 22))) for _ in range(600)] + ["1" * 5_000, "a" * 5_000, "1 " * 4_000, "+1" + "(" * 4_000, "1." * 2_000, "abcdef01" * 600, None, ""]
    for docs in (make(list(enumerate(texts))), odd.select("doc_id", "text").filter("text is null or length(text) < 100000"), documents):
        text_of = {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id is not null").select("doc_id", "text").collect()}
        got = report(docs).filter("doc_id is not null").collect()
        assert len(got) == docs.filter("doc_id is not null").count()
        for r in got:
            want = slow(text_of[r["doc_id"]])
            assert [r[f"n_{k}"] for k in kinds] == [sum(k == x for x, _, _ in want) for k in kinds]
            assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
            shown = r["spans"].split(",") if r["spans"] else []
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(shown)


def test_matches_without_spaces_take_time_in_proportion(make):
    n = 30_000
    texts = [",".join(f"a{i}@x.org" for i in range(n)), ",".join("10.0.0.1" for _ in range(n)), ";".join(f"id{i:07d}z" for i in range(n)), "x" * 300_000 + " 123456 " + "1" * 50_000]
    t = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.report(make(list(enumerate(texts)))).collect()}
    assert time.perf_counter() - t < 90
    assert got[0]["n_email"] == n and got[1]["n_ip"] == n and got[0]["spans"].endswith(f"email:{texts[0].rindex(',') + 1}:{len(texts[0])}")


def test_what_fails_a_test_is_never_reported(make):
    """Valid card numbers stand alone and so do numbers of that form that fail; both stand behind the same words too."""
    cards = ["4111111111111111", "5555555555554444", "4012888888881881", "6011111111111117", "3530111333300000"]
    rows = [(i, f"pay with card {c} today") for i, c in enumerate(cards)] + [(10 + i, f"pay with card {int(c) + 1} today") for i, c in enumerate(cards)] + [(30, "host 10.0.0.1 up"), (31, "host 10.0.0.2 up"), (32, "host 10.0.0.3 up"), (33, "host 10.0.0.300 up")]
    got = {r["doc_id"]: r for r in pii.report(make(rows)).collect()}
    assert all(got[i]["n_card"] == 1 for i in range(5)) and all(got[i]["n_spans"] == 0 for i in (*range(10, 15), 33))


def test_contexts_carry_what_no_base_pattern_finds(make):
    """Members are named by phone number, or by another number that no base pattern knows; 2000 documents, other numbers among
    them: what contexts add, against what was planted."""
    rng = random.Random(6)
    rows, planted = [], set()
    for i in range(2000):
        filler = " ".join(f"v{rng.randrange(500)}q" for _ in range(rng.randrange(5, 25)))
        kind = i % 10
        if kind < 2:
            text = f"{filler} member contact +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} noted {filler}"
        elif kind == 2:
            text, _ = f"{filler} member contact M{rng.randrange(10**8, 10**9)}Z noted {filler}", planted.add(i)
        else:
            text = f"{filler} order part{rng.randrange(10**5, 10**6)} of {rng.randrange(10**5, 10**6)} {filler}"
        rows.append((i, text))
    found = {r["doc_id"] for r in pii.report(make(rows)).filter("n_context > 0").collect()}
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.05 * len(found)


def test_many_matches_in_one_text(make):
    text = " ".join(f"id{i:07d}z" for i in range(30_000))
    (r,) = pii.report(make([(1, text + " x@y.com")])).collect()
    assert (r["n_email"], r["spans"]) == (1, f"email:{len(text) + 1}:{len(text) + 8}")
    (r,) = secrets.report(make([(1, "0123456789abcdef " * 30_000)])).collect()
    assert r["n_hex"] == 30_000 and r["spans"].endswith(f"hex:{29_999 * 17}:{29_999 * 17 + 16}")


def test_scans_keep_repeated_rows_and_empty_tables(make, odd):
    assert secrets.report(odd).count() == pii.report(odd).count() == odd.count()
    assert secrets.report(make([])).count() == pii.report(make([])).count() == 0


def test_random_tokens_are_added_and_words_are_not(make):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strong = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(40)]
    weak = ["aaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaa", "abababababababababab1bababababababababab", "1111111111111111111111111a1111111111111"] * 10
    rows = [(i, f"here {x} ends") for i, x in enumerate(strong)] + [(100 + i, f"here {x} ends") for i, x in enumerate(weak)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.report(make(rows)).collect()}
    assert sum(got[i] for i in range(40)) >= 37 and sum(got[100 + i] for i in range(30)) == 0


def slow_cutoffs(rows, rate, wrong):
    """The two rates by their definitions, over the distinct tokens of each class."""
    out = {}
    for c in {r[0] for r in rows}:
        level = {t: math.floor(-100 * math.log10(max(p, 1e-60))) for k, p, t in rows if k == c}
        ps = sorted(10 ** (-x / 100) for x in level.values())
        m = len(ps)
        ordinary = [p for k, p in enumerate(ps, 1) if p <= rate * sum(q <= p for q in ps) / m]
        first = max(ordinary, default=None)
        random = min(sum(p > 0.05 for p in ps) / 0.95 + 1, m)
        share = lambda cut: 1 - random * (1 - cut) / left if (left := sum(p > cut for p in ps)) else 0
        second = None
        if share(0) > wrong:
            low = [p for p in ps if p <= 0.05]
            second = min((p for p in low if share(p) <= wrong), default=max(low, default=None))
        found = max((p for p in (first, second) if p is not None), default=None)
        if found is not None:
            out[c] = round(-100 * math.log10(found))
    return out


def test_false_discovery_rates_equal_plain_loops(spark):
    rng = random.Random(17)
    rows = []
    for c, n, share in (("a", 1000, 0.001), ("b", 600, 0.0167), ("c", 500, 0.2), ("d", 300, 0.0), ("e", 40, 0.5), ("f", 1, 1.0)):
        for k in range(n):
            odd = k < share * n
            p = 4e-43 if odd and rng.random() < 0.5 else 10 ** -rng.uniform(1, 12) if odd else rng.random()
            rows += [(c, p, f"{c}{k}")] * rng.choice([1, 1, 3])
    df = spark.createDataFrame(rows, "class string, p double, token string")
    for rate, wrong in ((0.05, 0.1), (0.05, 1.0), (0.2, 0.01), (0.001, 0.1)):
        assert secrets.cutoffs(df, rate, wrong) == slow_cutoffs(rows, rate, wrong)
    # ten hopeless tokens among 600 random ones are called ordinary, and only few random ones with them
    at = secrets.cutoffs(df, 0.05, 1.0)["b"]
    assert 0 < at <= 4300 and sum(c == "b" and math.floor(-100 * math.log10(p)) >= at for c, p, _ in set(rows)) <= 15
    assert secrets.cutoffs(df.limit(0)) == {}


def test_three_seeds_and_words_of_any_length(make):
    far = "x" * 300  # a word that is longer than any fixed reach
    rows = [(i, f"{far} reference a{i}@b.com stands here") for i in range(3)] + [(10, f"{far} reference QQ99-1234 stands here"), (11, f"{far[1:]}y remark QQ99-5678 stood there")]
    got = {r["doc_id"]: r["n_context"] for r in pii.report(make(rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 1, 11: 0}


def test_common_contexts_prove_nothing(make):
    """The word stands before many other words, too."""
    rows = [(i, f"to a{i}@b.com and to the house, to the river, to a hill, to us") for i in range(6)] + [(10, "go to AB123456 at once")]
    assert {r["n_context"] for r in pii.report(make(rows)).collect()} == {0}


def test_contexts_find_unseen_identifiers(make):
    seen = ["a@b.com", "c@d.org", "e.f@g.net", "h@i.com", "+1 (523) 555-1055"]
    rows = [(i, f"please write customer number {x} about it") for i, x in enumerate([*seen, "ZZ991234", "QX889911"])] + [(50 + i, f"an odd year was {190000 + i} then") for i in range(9)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(make(rows)).collect()}
    assert got[5] == "context:29:37" and got[6] == "context:29:37" and not any(got[50 + i] for i in range(9))


def slow_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(five), set()
    for i, x in enumerate(five):
        if often[x] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf, odd, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (odd, documents):
        texts = {(r["doc_id"]): r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        got = quality.score(docs, labels).collect()
        assert len(got) == docs.count()
        for r in got:
            if r["doc_id"] is not None:
                want = slow_counts(texts[r["doc_id"]])
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
                assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
                assert not (r["base_failed"] and r["kept"])


def test_quality_without_labels(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(odd, none).filter("kept = base_failed").count() == 0
    assert quality.score(make([]), none).count() == 0
    assert quality.keep(odd, none).columns == odd.columns


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    used = docs.filter("doc_id % 10 < 6")
    model_labels = labels.filter("doc_id % 10 < 6")
    model = quality.fit(used, model_labels)
    assert model is not None
    rest = docs.filter("doc_id % 10 >= 6").join(labels, "doc_id")
    kept = {r["doc_id"] for r in quality._filter(rest.select("doc_id", "text"), spark.sparkContext.broadcast(model)).collect()}
    truth = rest.select("doc_id", "quality").collect()
    good = [r["doc_id"] in kept for r in truth if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in truth if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


def test_toxicity(spark, make, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.report(docs, labels)
    x = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    order = x.score.rank()
    n1 = int(x.toxic.sum())
    auc = (order[x.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(x) - n1))
    assert auc > 0.85 and x[x.predicted == 1].toxic.mean() > 0.7
    few = toxicity.report(odd, labels.limit(0)).collect()
    assert len(few) == odd.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in few)
    some = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    assert len(some) == odd.count() and all(0 <= r["score"] <= 1 for r in some)
    assert toxicity.report(make([]), labels).count() == 0


def test_labels_out_of_reach_change_nothing(spark, make):
    rows = [(i, f"plain words about nothing {i} and more of it " * 3 + ("you vile scoundrel " * 2 if i % 3 == 0 else "")) for i in range(240)]
    docs = make(rows)
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    make_labels = lambda flip: spark.createDataFrame([(i, 1, int((i % 3 == 0) != (flip and i in held))) for i, _ in rows], "doc_id long, quality int, toxic int")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.report(docs, make_labels(flip)).collect()} for flip in (False, True))
    assert held and a == b
