import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.corpus import corpus, frame
from tracelake.llm import kneser_ney as K


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [words_of(r[1]) for r in rows if not held(r[0])]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    before = Counter(w for _, w in pairs)
    follow = defaultdict(list)
    for (c, _), n in pairs.items():
        follow[c].append(n)
    d2 = K.discounts(*(sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)))
    d1 = K.discounts(*(sum(n == k for n in before.values()) for k in (1, 2, 3, 4)))
    cut = lambda d, n: [0, *d][min(n, 3)]
    n_all, v = sum(count.values()), len(count)
    back = sum(cut(d1, n) for n in before.values()) / len(pairs) if pairs else 1

    def p(c, w):
        uni = (before[w] - cut(d1, before[w])) / max(len(pairs), 1) + back / (v + 1)
        if c not in follow:
            return uni
        n = pairs[c, w]
        return (n - cut(d2, n) + sum(cut(d2, k) for k in follow[c]) * uni) / sum(follow[c])

    out = []
    for r in rows:
        t = words_of(r[1])
        out.append((r[0], held(r[0]), len(t), sum(count[w] > 0 for w in t), n_all, sum(math.log10((count[w] + 1) / (n_all + v + 1)) for w in t), sum(math.log10(p(c, w)) for c, w in zip(["<s>", *t], t))))
    return out, p, [*count]


def key(r):
    return (r[0] is None, r[0] or 0, r[2])


@pytest.mark.parametrize("rows", [corpus(), corpus(150, 5), corpus()[:1], []], ids=["all", "more", "null", "empty"])
def test_matches_brute_force(spark, rows):
    got = sorted((tuple(r)[:7] for r in K.train_and_score(frame(spark, rows)).collect()), key=key)
    want, p, vocabulary = brute(rows)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    if len(rows) > 1:  # a distribution: all words and one unknown sum to 1
        for c in ("<s>", "the", "fox", "unseen"):
            assert sum(p(c, w) for w in vocabulary) + p(c, "never seen") == pytest.approx(1)


def test_counts_over_a_byte(spark):
    rows = [(i, "aa bb " * 400, "en", "a", 0, None, None, None, None) for i in range(4)]
    got = sorted((tuple(r)[:7] for r in K.train_and_score(frame(spark, rows)).collect()), key=key)
    for g, w in zip(got, sorted(brute(rows)[0], key=key), strict=True):
        assert g == pytest.approx(w, rel=1e-9)


def brute_of(rows, order):
    """The score of every row by a model of any order, by the recursive definition."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    grams = [None, *(Counter() for _ in range(order))]
    padded = lambda t: ["<s>"] * (order - 1) + words_of(t)
    for r in rows:
        if not held(r[0]):
            t = padded(r[1])
            grams[order].update(tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = [None, *(K.discounts(*(sum(n == x for n in grams[k].values()) for x in (1, 2, 3, 4))) for k in range(1, order + 1))]
    follow = [None, *(defaultdict(list) for _ in range(order))]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            follow[k][g[:-1]].append(n)
    cut = lambda k, n: [0, *d[k]][min(n, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(grams[1]) + 1)
        seen = follow[k][g[:-1]] if g[:-1] in follow[k] else None
        if not seen:
            return lower
        return (grams[k][g] - cut(k, grams[k][g]) + sum(cut(k, n) for n in seen) * lower) / sum(seen)

    scores = []
    for r in rows:
        t = padded(r[1])
        scores.append((r[0], sum(math.log10(p(tuple(t[i - order + 1 : i + 1]))) for i in range(order - 1, len(t)))))
    return scores, p, [g[0] for g in grams[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longer_grams(spark, order):
    rows = corpus(60, 11)
    scores, p, vocabulary = brute_of(rows, order)
    got = sorted(((r["doc_id"], r["score"]) for r in K.train_and_score(frame(spark, rows), order=order).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for g, w in zip(got, sorted(scores, key=lambda r: (r[0] is None, r[0] or 0, r[1])), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-9)
    context = ("<s>",) * (order - 2) + ("the",)
    assert sum(p((*context, w)) for w in vocabulary) + p((*context, "never seen")) == pytest.approx(1)
    with pytest.raises(ValueError):
        K.train(frame(spark, rows), order=1)


def test_a_frequent_context_is_dealt_over_shards(spark):
    rows = [(i, " ".join(f"the w{i}x{k}" for k in range(60)), "en", "a", 0, None, None, None, None) for i in range(30)]
    model = K.train(frame(spark, rows))
    files = K.Files(model)
    the, begin = K.tokens(["the"])
    held = [s for s in model.written[1] if (files.grams[0][s] is not None and len(files.grams[0][s][0]) > 20)]
    assert len(held) >= 1 << K.follower_bits(model.bits) and sum(len(files.grams[0][s][0]) for s in model.written[1]) == model.n_pairs
    total, one, two, more = files.context_stats(2, np.sort(the[:1]))[:, 0].tolist()
    assert (total, one, two, more) == (1800, 1800, 0, 0)


def test_words_are_hashed_the_same_in_parts(monkeypatch):
    from tracelake.llm import common

    rng = random.Random(6)
    texts = ["", " ", "one", "x" * 500 + " y", *["".join(rng.choices("abc Ä\n\t😀", k=rng.randint(0, 400))) for _ in range(60)]]
    whole, first = common.hashed_words(texts)
    assert len(whole) == first[-1] and [b - a for a, b in zip(first, first[1:])] == [len(t.replace("\n", " ").replace("\t", " ").split(" ")) - t.replace("\n", " ").replace("\t", " ").split(" ").count("") for t in texts]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(common, "_HASHED_BYTES", size)
        again, places = common.hashed_words(texts)
        assert again.tolist() == whole.tolist() and places.tolist() == first.tolist()


def test_a_very_long_text_is_hashed_in_parts():
    """64 MB of words under a limit of address space."""
    import subprocess
    import sys

    code = """
import resource
from tracelake.llm.common import hashed_words
text = "the quick brown fox jumps over it " * 2_000_000
resource.setrlimit(resource.RLIMIT_AS, (2_000_000_000,) * 2)
h, first = hashed_words([text, "fox"])
assert first.tolist() == [0, 14_000_000, 14_000_001] and h[3] == h[-1]
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
