import random
import re

import numpy as np
import pytest

from tests.llm.corpus import corpus, frame
from tracelake.llm import ngram_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted(((r[0], len(s), least.get(root(i), r[0])) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups=12, most=60):
    """Groups of copies with edits around the limit, a passage in many documents, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 150, 400]))]
        for _ in range(rng.randint(2, most)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = word()
            rows.append(t + passage * (g % 3 == 0))
    rng.shuffle(rows)
    return [(i, " ".join(t), "en", "a", 0, None, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [corpus(), corpus()[:2], [], near_copies(1), near_copies(2)], ids=["all", "no words", "empty", "copies", "more copies"])
def test_matches_brute_force(spark, rows):
    assert sorted(map(tuple, J.join(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("limits", [{"BLOCK": 5}, {"BLOCK_SHINGLES": 900}], ids=["nodes", "shingles"])
def test_blocks_lose_no_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    rows = near_copies(4, 6, 40)
    assert sorted(map(tuple, J.join(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_large_clusters_shuffle_every_set_once(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "en", "a", 0, None, None, None, None) for i in range(300) for k in [rng.randrange(300)]]
    sent = []
    own = J._met
    monkeypatch.setattr(J, "_met", lambda blocks, *a: (sent.append(blocks), own(blocks, *a))[1])
    got = J.similar(frame(spark, rows)).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 299)} and len(got) == 300
    assert sent[-1].count() == 300 and sent[-1].filter("many").count() == 300


def test_a_lost_file_is_an_error(spark, tmp_path):
    from tracelake.llm.packed import Shards, pack, put

    put(f"file://{tmp_path}", "keys-1", pack(np.arange(3, dtype="<u8")))
    shards = Shards(f"file://{tmp_path}", "keys", frozenset([1, 2]), "<u8")
    assert shards[0] is None and shards[1][0].tolist() == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        shards[2]


def test_tree_search_is_the_bound():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(60, 90, 9000))
    points = np.stack([np.bincount(rng.integers(0, 16, n), minlength=16) for n in sizes]).astype(np.int32)
    tree = J.RTree(points, sizes)
    for x in (0, 100, 8999):
        bound = np.minimum(points[:x], points[x]).sum(axis=1)
        want = np.flatnonzero((bound >= J.needed(int(sizes[x]), sizes[:x])) & (sizes[:x] * 100 >= 75 * sizes[x]))
        assert tree.search(points[x], int(sizes[x]), x).tolist() == want.tolist()


def test_counts_past_a_byte_lose_no_link(monkeypatch):
    monkeypatch.setattr(J, "MOST_GROUPS", 8)  # counts of 4,000 shingles are about 500, as those of a very long text would be
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (4000, 4000, 600_000)]
    sets = sorted((np.sort(np.concatenate([s[: len(s) - k], s[: len(s) // 50] + np.uint64(1)])) for s in sets for k in (0, 300)), key=len)
    sizes = np.array([len(s) for s in sets])
    points = [J.point(s) for s in sets]
    assert [int(p.sum()) for p in points] == sizes.tolist()
    same = {(x, y) for x in range(6) for y in range(x) if 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 75 * (sizes[x] + sizes[y] - o)}
    block = J.Block(np.arange(6), sizes, np.ones(6, np.int64), points, sets)
    side = np.zeros(6, np.int8)
    assert len(same) == 3 and set(J.forest(block, side)) == same
    assert J.links(block, side)[0].tolist() == [sum(k in e for e in same) for k in range(6)]
    again = J.unpacked(np.frombuffer(block.packed(), np.uint8))
    assert all(a.tolist() == b.tolist() for a, b in zip([*block.points, *block.sets], [*again.points, *again.sets]))


def test_sets_of_over_a_million_shingles_link():
    rng = np.random.default_rng(9)
    one = np.unique(rng.integers(0, 1 << 63, 1_100_000).astype(np.uint64))
    two = np.sort(np.concatenate([one[: len(one) - 100_000], one[:100_000] + np.uint64(1)]))
    shared = len(np.intersect1d(one, two))
    assert 0.8 < shared / (len(one) + len(two) - shared) < 0.87
    sets = sorted([one, two], key=len)
    block = J.Block(np.arange(2), np.array([len(s) for s in sets]), np.ones(2, np.int64), [J.point(s) for s in sets], sets)
    assert J.links(block, np.zeros(2, np.int8))[0].tolist() == [1, 1]


@pytest.mark.parametrize("block", [5, 1024])
def test_every_link_once(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_copies(7, 4, 25)
    rows += [(100 + r[0], *r[1:]) for r in rows[:9]]
    sets = [shingles(r[1]) for r in rows]
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {r[0]: sum(alike(s, o) for o in sets) - 1 for r, s in zip(rows, sets)}
    assert {r["doc_id"]: r["n_links"] for r in J.similar(frame(spark, rows)).collect()} == want and max(want.values()) > 5
