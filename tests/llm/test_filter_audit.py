import math
import random
import re
from itertools import permutations

import pytest

from tests.llm.corpus import frame, words
from tracelake.llm import filter_audit as A


def doc(i, text, source="a"):
    return (i, text, "en", source, 0, 0.5, 7, "x", 1)


def documents():
    rng = random.Random(6)
    some = [None, "", "#", "ABC " * 250, words(rng, 260), "one " * 300, words(rng, 250) + " 5%", "A B " * 201, "\x0b\x0c x\ty " * 150, words(rng, 40_000)]
    texts = some + [words(rng, rng.randint(150, 250)) + rng.choice(["", " | ", " LOUD WORDS HERE AND THERE"]) for _ in range(40)]
    texts += rng.choices(texts, k=60)
    rows = [doc(i, t, rng.choice(["a", "b", None, "", "c"])) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], doc(5, texts[6]), doc(None, texts[4]), doc(None, texts[4], "only here")]


def labelled(rows):
    rng = random.Random(8)
    return [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.6] + [(3, 0, 1), (3, 1, 0), (99999, 1, 1)]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    parts = {}
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, f in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), r[0] is not None and least[t] < r[0]]) if f}
        parts.setdefault(r[3] or "", []).append((fails, r[0] in good, r[0] in toxic))
    out = []
    for part, docs in parts.items():
        sums, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                sums[x] += len(gone)
                made.append([part, "".join(order), step, len(left), len(gone), sum(x in d[0] for d in docs) - len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), x])
        out += [(*m[:-1], sums[m[-1]]) for m in made]
    return sorted(out)


@pytest.mark.parametrize("n", [None, 1, 0])
def test_audit_by_running_every_order(spark, n):
    rows = documents()[:n]
    labels = labelled(rows)
    got = A.interactions(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_audit_without_labels(spark):
    rows = documents()[:12]
    got = A.interactions(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(rows, [])


@pytest.mark.parametrize("n", [1, 3, 6])
def test_paths_of_the_lattice(n):
    reach, leave = A.lattice(n)
    for s in range(1 << n):
        k = s.bit_count()
        assert (reach[s], leave[s]) == (math.factorial(k), math.factorial(n - k))


def test_two_filters(spark):
    counts = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 1, 2, 0, 0), ("p", 0, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in A.audit(counts, "XY").collect()}
    assert got == {("XY", 1): (4, 7, 0, 2, 9), ("XY", 2): (4, 0, 5, 0, 5), ("YX", 1): (6, 5, 0, 0, 5), ("YX", 2): (4, 2, 5, 2, 9)}
