"""Near-dedup by sketches against all pairs."""

import random
import re

import numpy as np
import pytest

from roadgrade.llm import groups, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def slow(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    out = [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((*r, True if r[0] is None or r[2] is None else r[0] == r[2]) for r in out), key=str)


def prose(rng, n, vocabulary=900):
    return [f"v{rng.randrange(vocabulary)}q" for _ in range(n)]


@pytest.mark.parametrize("group", [5, 1000])
def test_report_equals_all_pairs(make, group, monkeypatch):
    monkeypatch.setattr(sketch, "GROUP", group)
    monkeypatch.setattr(groups, "BLOCKS", 1 if group == 5 else groups.BLOCKS)
    rng = random.Random(3)
    rows, hot = [], prose(rng, 90)
    for i in range(40):  # a large group of near copies, some nearer than others
        w = list(hot)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    shared = prose(rng, 60)
    for i in range(40):  # a common passage that makes up over half of the text: similar, but not enough
        rows.append((2000 + i, " ".join(shared + prose(rng, rng.choice([8, 20, 40])))))
    for i in range(30):  # chains at the threshold: 100 shingles, some 8 in every 100 of another
        base = prose(random.Random(i // 3), 102)
        k = i % 3
        rows.append((3000 + i, " ".join(base[4 * k :] + prose(random.Random(99 + i), 4 * k))))
    rows += [(4000 + i, t) for i, t in enumerate(["a b c d e f g", "a b c d e f g h", "A B c", "a b c", "a b", "A  B", "a", None, "", " \n", "x y z " * 40])]
    rows += [(1001, rows[1][1]), (2001, "a b c"), (None, rows[0][1]), (None, "nobody else has this"), (None, None)]
    rng.shuffle(rows)
    got = sketch.near_duplicates(make(rows).repartition(3), group)
    kept = sorted((tuple(r) for r in sketch.report(make(rows).repartition(3)).collect()), key=str) if group == 1000 else None
    want = slow(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert kept is None or kept == want


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in sketch.report(odd).collect()), key=str) == slow(rows)
    assert sketch.report(odd.limit(0)).collect() == []


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(1)
    sizes, pairs, worst = [1, 2, 7, 40, 300, 3000], [], []
    for n in sizes:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            same = max(1, round(0.92 * n))
            b = np.concatenate([a[:same], rng.integers(0, 1 << 63, n - same).astype(np.uint64)])
            pairs.append((a, b))
    flat = np.concatenate([x for p in pairs for x in p])
    s = sketch.sketches(flat, np.array([len(x) for p in pairs for x in p]))
    assert (s < np.iinfo(np.uint64).max).all()
    for k, (a, b) in enumerate(pairs):
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        worst.append(abs((s[2 * k] == s[2 * k + 1]).mean() - j))
    assert max(worst) < 0.16 and np.mean(worst) < 0.03
    # rows do not depend on what else is in the batch
    alone = sketch.sketches(pairs[70][0], np.array([len(pairs[70][0])]))
    assert np.array_equal(alone[0], s[140])
