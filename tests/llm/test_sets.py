"""Operators that compare texts: suffix array, SimHash, lines, decontamination, paragraphs; and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roadgrade.llm import decontaminate, lines, paragraphs, queries, simhash, suffixes
from roadgrade.llm import common
from roadgrade.llm.common import components

from test_near import slow_kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return [f"v{rng.randrange(vocabulary)}q" for _ in range(n)]


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def roots(n, pairs):
    p = list(range(n))

    def top(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 90)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(5100, edges)
    assert all(want[n] == c for n, c in got.items()) and {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_stages(spark, monkeypatch):
    """Stages write files for each task, however little they move; with shuffles instead of sent tables they are far more."""
    edges, sc = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)], "a long, b long"), spark.sparkContext
    got, stages = [], []
    for most in (common.FEW_LINKS, 0):
        monkeypatch.setattr(common, "FEW_LINKS", most)
        sc.setJobGroup(f"few links {most}", "")
        got.append({tuple(r) for r in components(edges).collect()})
        tracker = sc.statusTracker()
        stages.append(len({s for j in tracker.getJobIdsForGroup(f"few links {most}") for s in tracker.getJobInfo(j).stageIds}))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(9)}
    assert 4 * stages[0] < 3 * stages[1], stages


def test_prints_of_many_sets():
    rng = np.random.default_rng(5)
    sizes = np.append(rng.integers(1, 90, 3000), [1, 255, 256, 700, 2])
    flat = rng.integers(0, 1 << 62, sizes.sum()).astype(np.uint64) * np.uint64(5)
    end = np.cumsum(sizes)
    got = simhash.prints_of(flat, sizes)
    assert got.tolist() == [simhash.prints(flat[e - n : e]) for n, e in zip(sizes, end)]
    assert simhash.prints_of(flat[:0], sizes[:0]).shape == (0, 4)


def slow_fingerprint(t):
    w = WORD.findall(lowered(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(ids, fps, radius=3):
    fps = np.array(fps, np.uint64)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    r = roots(len(ids), zip(*map(list, np.nonzero(np.triu(d, 1)))))
    low = {}
    for i, g in enumerate(r):
        low[g] = min(low.get(g, ids[i]), ids[i])
    return [low[g] for g in r]


@pytest.mark.parametrize("leaves", [4, 4096])
def test_simhash_equals_brute_force(make, documents, leaves):
    rng = random.Random(2)
    base = [prose(rng, 200) for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i * 7 % 160, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "ONE two"), (203, "one TWO"), (204, "x")]
    for docs in (make(rows), documents.select("doc_id", "text")):
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, leaves=leaves).collect()}
        ids = sorted(text)
        fps = [slow_fingerprint(text[i]) for i in ids]
        assert [got[i]["fp"] & (1 << 64) - 1 for i in ids] == fps
        assert [got[i]["component_id"] for i in ids] == slow_groups(ids, fps)



def test_trie_room(make):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fp = np.unique(base[rng.integers(0, 12, 700)] ^ one(700) ^ one(700))
    want = roots(len(fp), zip(*map(list, np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1)))))
    for room in (50, 1 << 20):
        a, b = simhash.trie_links(np.zeros(len(fp), int), fp, 3, room)
        assert roots(len(fp), zip(a.tolist(), b.tolist())) == want


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fp = base[rng.integers(0, 6, 500)] ^ one(500) ^ one(500) ^ one(500)
    fp[:40] = fp[0]  # equal fingerprints
    group, label = rng.integers(0, 3, 500), rng.integers(0, 9, 500)
    order = np.lexsort((fp, group))
    fp, group, label = fp[order], group[order], label[order]
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6) & (group[:, None] == group[None, :]) & (label[:, None] != label[None, :])
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))), strict=True))
    for room in (30, 1 << 20):
        got = [p for a, b in simhash.trie_pairs(group, fp, label, 6, room) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


def test_odd_documents_and_empty_tables(spark, make, odd):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    assert simhash.report(odd).count() == odd.count() and simhash.report(make([])).count() == 0
    assert lines.report(odd).count() == odd.count() and lines.report(make([])).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(odd, benchmark).collect()} == {(6, 1), (4, 4)}
    assert decontaminate.find(make([]), benchmark).count() == 0
    assert decontaminate.find(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(odd, benchmark).columns == odd.columns
    assert {r["doc_id"] for r in suffixes.report(odd).collect()} == {7, 8} and suffixes.report(make([])).count() == 0
    assert {r["doc_id"]: r["n_long"] > 0 for r in paragraphs.report(odd).collect()} == {i: i in (7, 8) for i in (-5, *range(1, 12))} and paragraphs.report(make([])).count() == 0
    assert lines.strip(odd).columns == odd.columns


def test_variable_fields_and_short_lines(make):
    # both words vary from the third token on: the first two are levels of the tree
    rows = [(i, f"login of user u{'abcdefghij'[i % 10]}x from host h{'klmnopqrst'[i // 5]}y\nAll rights reserved.\npage {i} of {2 * i}\nonly here {'z' * (i + 1)}") for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in lines.report(make(rows)).collect()}
    assert got == dict([rows[0], *[(i, t.split("\n")[3]) for i, t in rows[1:]]])


def slow_lines(rows, least=3):
    """From the definition: leaves, places, three steps of what counts as variable, documents of each template."""
    leaves = defaultdict(lambda: defaultdict(set))
    of_line = lambda x: tuple("" if re.search("[0-9]", w) else w for w in WORD.findall(x))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if m := of_line(x):
                leaves[len(m), m[: 3 if len(m) >= 8 else 2]][m].add(i)
    made = defaultdict(set)
    for masks in leaves.values():
        n, total = Counter(), sum(map(len, masks.values()))
        for m, ids in masks.items():
            for place in enumerate(m):
                n[place] += len(ids)
        for m in masks if total >= least else ():
            for share in (0, 1 / 8, 1 / 2):
                t = tuple(w if w and n[k, w] >= max(least, share * total) else None for k, w in enumerate(m))
                if len(m) >= 5 and sum(w is not None for w in t) >= 0.7 * len(m):
                    made[m].add((m[:3], t))
            if len(m) < 5 and sum(map(bool, m)) >= 0.5 * len(m):
                made[m].add(m)
    docs = defaultdict(set)
    for masks in leaves.values():
        for m, ids in masks.items():
            for t in made[m]:
                docs[t] |= ids
    gone = lambda i, m: any(len(docs[t]) >= least and min(docs[t]) != i for t in made[m])
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, of_line(x))) for i, t in rows}


def test_lines_equal_brute_force(make, documents):
    rng = random.Random(4)
    words = lambda n, v=400: ["".join("abcdefghijklmnopqrstuvwxyz"[int(c)] for c in w[1:-1]) + "q" for w in prose(rng, n, v)]
    common = [" ".join(words(14)) for _ in range(6)] + [f"page {{n}} of {' '.join(words(5))}" for _ in range(3)] + [f"{' '.join(words(3))} {{w}} and {{w}} {' '.join(words(4))}" for _ in range(3)]
    fill = lambda x: re.sub("{w}", lambda _: words(1, 12)[0], x)
    rows = [(i, "\n".join(fill(rng.choice(common)).replace("{n}", str(i)) if rng.random() < 0.4 else " ".join(words(rng.randrange(1, 30), 9000)) for _ in range(8))) for i in range(80)]
    for docs in (make(rows), documents.select("doc_id", "text")):
        data = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = {r["doc_id"]: r["text"] for r in lines.report(docs).collect()}
        assert got == slow_lines(data)


def slow_leaks(docs, items, least=0.8):
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    items = {i: w for i, w in items.items() if w}
    df = Counter(s for w in items.values() for s in set(shingles(w)))
    weight = lambda s: round(1000 * math.log(1 + len(items) / df[s])) if s in df else round(1000 * math.log(1 + len(items)))
    best = {}
    for d, w in docs.items():
        for i, item in items.items():
            size, ci = min(5, len(item)), Counter(shingles(item))
            hs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
            whole = sum(weight(s) * n for s, n in ci.items())
            for at in range(-len(item) + 1, len(w)):
                ca = Counter(hs[max(at, 0) : max(0, at + len(item) - size + 1)])
                both = sum(min(n, ci[s]) * weight(s) for s, n in ca.items())
                if both and (v := both / (sum(n * weight(s) for s, n in ca.items()) + whole - both)) >= least:
                    best[d, i] = max(v, best.get((d, i), 0))
    return best


def test_decontamination_equals_brute_force(spark, make):
    rng = random.Random(6)
    items = {i: prose(rng, n) for i, n in enumerate([15, 20, 33, 59, 3, 5, 40, 40])}
    items[7] = items[6][:36] + prose(rng, 4)
    docs = {}
    for d in range(60):
        w = prose(rng, rng.randrange(0, 90))
        if d % 2:
            part = list(items[rng.randrange(len(items))])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                part[rng.randrange(len(part))] = "edit"
            if rng.random() < 0.3:
                part.insert(len(part) // 2, "more")
            at = rng.randrange(len(w) + 1)
            w = w[:at] + part + w[at:]
        docs[d] = w
    got = decontaminate.find(
        make([(d, " ".join(w).upper()) for d, w in docs.items()]), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    ).collect()
    want = slow_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and len(want) > 10
    assert all(abs(r["similarity"] - want[r["doc_id"], r["item_id"]]) < 1e-5 for r in got)


def planted(rng):
    passages = [prose(rng, n, 5000) for n in (50, 51, 64, 90, 49)]
    docs = {}
    for d in range(70):
        w = prose(rng, rng.randrange(0, 150), 5000)
        for p in rng.sample(range(5), rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + passages[p] + w[at:]
        docs[d] = w
    docs[70] = list(docs[3])
    docs[71] = prose(rng, 30, 5000) * 4  # repeats itself only
    return docs


def slow_spans(docs, n=50):
    seen = defaultdict(set)
    for d, w in docs.items():
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(d)
    out = {}
    for d, w in docs.items():
        on = [False] * len(w)
        for k in range(len(w) - n + 1):
            if len(seen[tuple(w[k : k + n])]) > 1:
                on[k : k + n] = [True] * n
        if any(on):
            out[d] = on
    return out


@pytest.mark.parametrize("run_rows", [12, 20_000])
def test_suffixes_equal_brute_force(make, run_rows):
    docs = planted(random.Random(8))
    got = {}
    for r in suffixes.repeated(make([(d, " ".join(w)) for d, w in docs.items()]), run_rows=run_rows).collect():
        got[r["doc_id"]] = [any(s["start"] <= k < s["end"] for s in r["spans"]) for k in range(len(docs[r["doc_id"]]))]
        assert r["n_words"] == sum(got[r["doc_id"]])
    assert got == slow_spans(docs)


def test_seeds_whose_rows_are_dealt_apart_lose_no_match(make):
    """Passages in many documents, each time with other words before and after, which few documents share."""
    rng = random.Random(12)
    common = [prose(rng, 32, 90000) for _ in range(6)]
    befores = {(i, j): prose(rng, 30, 90000) for i in range(6) for j in range(40)}
    docs = {}
    for d in range(480):
        i, j = d % 6, d // 6 % 40
        docs[d] = [*befores[i, j], *common[i], *prose(rng, 30, 90000)]
    rows = make([(d, " ".join(w)) for d, w in docs.items()]).repartition(5)
    for run_rows in (7, 50, 20_000):
        got = {r["doc_id"]: [any(s["start"] <= k < s["end"] for s in r["spans"]) for k in range(len(docs[r["doc_id"]]))] for r in suffixes.repeated(rows, run_rows=run_rows).collect()}
        assert got == slow_spans(docs)


def test_paragraphs_catch_passages_and_leave_others(make):
    docs = planted(random.Random(9))
    got = {r["doc_id"] for r in paragraphs.report(make([(d, " ".join(w)) for d, w in docs.items()])).filter("n_shared > 0").collect()}
    shared = slow_spans(docs, paragraphs.STRETCH)
    assert set(slow_spans(docs)) <= set(slow_spans(docs, paragraphs.PASSAGE)) <= got <= set(shared)


def slow_classes(texts):
    """Lines of five words and more that are equal or of similarity 0.8, as (document, first word) -> class."""
    places, sets = [], []
    for d, t in texts:
        at = 0
        for x in t.split("\n"):
            w = WORD.findall(lowered(x))
            if len(w) >= 5:
                places.append((d, at, len(w)))
                sets.append((tuple(w), frozenset(zip(*(w[k:] for k in range(5))))))
            at += len(w)
    alike = lambda a, b: a[0] == b[0] or len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]) - 1e-9
    return places, roots(len(places), [(i, j) for i in range(len(places)) for j in range(i) if alike(sets[i], sets[j])])


@pytest.mark.parametrize("group", [3, 1000])
def test_similar_lines_become_one_class(make, group):
    rng = random.Random(10)
    base = [prose(rng, n, 5000) for n in (5, 6, 8, 9, 12, 20, 40, 80, 80, 120)]
    rows = []
    for d in range(90):
        out = []
        for w in rng.sample(base, 3):
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2]) if len(w) >= 40 else rng.choice([0, 0, 1])):
                w[rng.choice([0, len(w) - 1, rng.randrange(len(w))])] = f"edit{rng.randrange(30)}"
            out.append(" ".join(w))
        rows.append((d, "\n".join([*out, "ha " * (5 + d % 7), " ".join(prose(rng, 12, 90000))])))
    places, want = slow_classes(rows)
    truth = defaultdict(set)
    for p, c in zip(places, want, strict=True):
        truth[c].add(p)
    truth = {frozenset(g) for g in truth.values() if len({d for d, _, _ in g}) > 1}
    groups = defaultdict(set)
    for r in paragraphs.classes(make(rows), group=group).filter("line").collect():
        groups[r["class_id"]].add((r["doc_id"], r["at"], r["n"]))
        assert (r["first_id"] == r["doc_id"]) == (r["doc_id"] == min(d for d, _, _ in next(t for t in truth if (r["doc_id"], r["at"], r["n"]) in t)))
    assert len(truth) > 8 and {frozenset(g) for g in groups.values()} == truth


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline._written(spark, stage(spark, seen[-1], sf)))
        assert seen[-1].columns == docs.columns, name
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * counts[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = seen[1].join(labels, "doc_id")
    assert quality.filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()
    data = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    stripped = {i: t for i, t in slow_lines(data).items() if WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in seen[2].collect()} == stripped
    assert seen[2].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in seen[3].collect()} == slow_kept(sorted(stripped.items()))
    items = {r["item_id"]: WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    left = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    holds = {d for d, t in left.items() for w in items.values() if " ".join(w) in " ".join(WORD.findall(t.lower()))}
    assert not holds & {r["doc_id"] for r in seen[4].collect()} and {r["doc_id"] for r in seen[4].collect()} <= set(left)
    out = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf)
    assert out.count() == counts[-1] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_all_queries_are_registered():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14)) and corpus_pipeline.ORACLE_SQL is None
