"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from roadgrade.llm import near


def prose(rng, n, vocabulary=400):
    return [f"v{rng.randrange(vocabulary)}q" for _ in range(n)]


def slow_kept(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b, same = sets[j], len(a & sets[j])
            if 5 * same >= 4 * (len(a) + len(b) - same) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(d, least.get(g, d))
    return set(least.values())


def edited(rng):
    rows, base = [], [prose(rng, n) for n in (40, 60, 120, 200, 300, 15)]
    passage = prose(rng, 60)
    for d in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(5)}"
        rows.append((d * 7 % 220, " ".join(w)))
    rows += [(300 + d, " ".join(prose(rng, 20) + passage + prose(rng, d % 40))) for d in range(60)]
    return rows + [(400, ""), (401, None), (402, " \n"), (403, "One two"), (404, "one TWO"), (405, "one two three"), (406, "x")]


@pytest.mark.parametrize("group", [3, 1000])
def test_near_dedup_equals_brute_force_jaccard(spark, make, monkeypatch, group):
    monkeypatch.setattr(near, "GROUP", group)
    rows = edited(random.Random(21))
    want = slow_kept(rows)
    assert 60 < len(want) < len(rows) - 60
    docs = make(rows)
    assert {r["doc_id"] for r in near.near_copies(docs, group).filter("doc_id = component_id").collect()} == want
    if group == 1000:
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want


def test_near_dedup_of_given_and_odd_documents(spark, make, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == slow_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_dedup(spark, odd, sf).collect()  # of repeated rows one stays; without doc_id, only what no other row has
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [-5, 1, 4, 5, 6, 7, 9, 10]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["no id here but words enough to count as a text"]
    assert corpus_pipeline.near_dedup(spark, make([]), sf).count() == 0
