"""Interactions of filters against a plain walk through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

from roadgrade.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        parts[source or ""].append((i, {f for f in fails if fails[f]}))
    out = []
    for part, rows in parts.items():
        table, share = [], defaultdict(int)
        for order in permutations("ABCDE"):
            live = rows
            for k, f in enumerate(order):
                gone = [r for r in live if f in r[1]]
                redundant = sum(f in r[1] for r in rows) - sum(f in r[1] for r in live)
                live = [r for r in live if f not in r[1]]
                share[f] += len(gone)
                table.append((f, part, "".join(order), k + 1, len(live), len(gone), redundant, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(*row[1:], share[row[0]]) for row in table]
    return sorted(out)


def test_report_equals_plain_walk(spark, odd):
    rng = random.Random(4)
    texts = [None, "", "SHOUT " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " $", "few words", "few words", "a b " * 40, "A # b " * 30]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "x", "y", "z|"])) for _ in range(400)]
    docs += [(100 + i, texts[3], "hot") for i in range(300)]
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, source string, mask string, n string").repartition(5)
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.report(df, marks)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS, "shapley"]
    assert sorted(map(tuple, got.collect())) == slow(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert sorted(map(tuple, audit.report(odd, marks.limit(0)).collect())) == slow(rows, [])
    assert audit.report(df.limit(0), marks).count() == 0


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 2, 4, 0, 2)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r[3:]) for r in audit.interactions(cells, "PQ").collect()}
    assert got == {("PQ", 1): (9, 2, 0, 0, 1, 1, 2), ("PQ", 2): (5, 4, 2, 4, 0, 2, 10), ("QP", 1): (5, 6, 0, 4, 1, 3, 10), ("QP", 2): (5, 0, 2, 0, 0, 0, 2)}
