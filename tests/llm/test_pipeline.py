import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline as P
from tests.llm.corpus import corpus, frame, words
from tests.llm.test_ngram_join import brute, near_copies
from tracelake.llm import near_duplicates, quality_rules, secret_scan, source_mixing

CASES = {"all": corpus(), "one": corpus()[:1], "empty": [], "copies": near_copies(3)}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES)
def test_one_of_each_group_stays(spark, rows):
    component = {}
    for i, n, c in brute(rows):
        component.setdefault(i, (n, c))
    want = {i for i, (n, c) in component.items() if i is not None and (c == i or n == 0)}
    got = near_duplicates.distinct(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    kept = [r["doc_id"] for r in got.collect()]
    assert {i for i in kept if i is not None} == want
    assert len({i for i in kept if i is not None}) == sum(i is not None for i in kept)


def target_sizes(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out, open_, left = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def skewed(n=300):
    rng = random.Random(8)
    return [(i, words(rng, rng.choice([1, 5, 30, 500])), "en", rng.choice("aaaaaabcdef") if i else "tiny", 0, None, None, None, None) for i in range(n)]


@pytest.mark.parametrize("rows", [*CASES.values(), skewed()])
def test_mix(spark, rows):
    got = source_mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mixing.mix(frame(spark, rows)).collect()), key=str)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = target_sizes(sizes) if rows else {}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        taken[r["source"]] += r["taken"]
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    for s, n in taken.items():
        assert abs(n - want[s]) <= 4 * source_mixing.PACKET
    sent = source_mixing.mixed_rows(frame(spark, rows)).collect()
    assert sum(size(r["text"]) for r in sent) == sum(taken.values())  # equal rows lose no word
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    assert all(any(t is not None and t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in sent)


def test_mixed_rows_keep_columns_of_any_name(spark):
    names = ["mix_key", "mix_taken", "mix_rows", "mix_size", "mix_copy", "mix_copy_0", "order_key"]
    rows = [(i % 7, f"one two three {i % 7} " * 40, "ab"[i % 2], *[f"{n} {i % 7}" for n in names]) for i in range(70)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"{n} string" for n in names]]))
    sent = source_mixing.mixed_rows(docs).collect()
    assert sent and all([r[n] for n in names] == [f"{n} {r['doc_id']}" for n in names] for r in sent)
    assert sum(size(r["text"]) for r in sent) == sum(r["taken"] for r in source_mixing.mix(docs).collect())


@pytest.mark.parametrize("rows", [corpus(), skewed(), near_copies(5)], ids=["all", "skewed", "copies"])
def test_taken_is_that_of_a_plain_queue(spark, rows):
    """A heap of packets by finish time, one source's packets in its shuffled order, until the budget is spent."""
    flows, budget, want = defaultdict(list), 0, defaultdict(int)
    for r in source_mixing.schedule(frame(spark, rows)).collect():
        flows[r["source"]].append((r["before"], r["order_key"], r["doc_id"], r["size"], r["target"]))
        budget = r["budget"]
    packets = []
    for flow in flows.values():
        sent, whole = 0, sum(f[3] for f in flow)
        for _ in range(3):
            ahead = 0
            for before, key, doc, n, target in sorted(flow, key=lambda f: (f[0], f[3])):
                assert before == ahead
                ahead += n
                for k in range(0, n, source_mixing.PACKET):
                    words_ = min(source_mixing.PACKET, n - k)
                    sent += words_
                    if target > 0:
                        packets.append((sent / target, key, doc, words_))
        assert sent == 3 * whole
    left = int(budget)
    heapq.heapify(packets)
    while packets and left > 0:
        _, key, doc, n = heapq.heappop(packets)
        want[key] += min(n, left)
        left -= min(n, left)
    got = defaultdict(int)
    for r in source_mixing.mix(frame(spark, rows), keep_key=True).collect():
        got[r["order_key"]] += r["taken"]
    assert {k: n for k, n in got.items() if n} == dict(want)


def quality_brute(rows):
    lines_of = lambda t: [x for x in (t or "").split("\n") if size(x)]
    normal = lambda x: re.sub(r"[ \t-\r]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    seen = defaultdict(int)
    for r in rows:
        for x in {normal(x) for x in lines_of(r[1])}:
            seen[r[3], x] += 1
    out = []
    for r in rows:
        t, w, lines = r[1] or "", re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""), lines_of(r[1])
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeat = len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)})
        gone = sum(size(x) for x in lines if seen[r[3], normal(x)] > quality_rules.LINE_LIMIT)
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), repeat, failed, gone, not failed and len(w) - gone >= 0.5 * len(w)))
    return sorted(out, key=str)


def boilerplate():
    rng = random.Random(9)
    menu = "Home About Contact 2024 " * 6
    rows = [(i, f"{menu}\n{words(rng, rng.choice([5, 60]))}\n{'x y z # ' * rng.choice([0, 12])}", "en", rng.choice(["a", None]), 0, None, None, None, None) for i in range(90)]
    rows += [*rows[3:6], *rows[3:5]]  # whole rows again: each is a document, and loses its words once
    rows += [(r[0], r[1], "en", "b" if r[3] else "a", 0, None, None, None, None) for r in rows[7:9]]  # the same id and text under another host
    return [*rows, (91, words(rng, 30) + "\n" + words(rng, 30), "en", "a", 0, None, None, None, None)]


@pytest.mark.parametrize("rows", [*CASES.values(), boilerplate()])
def test_quality(spark, rows):
    assert sorted(map(tuple, quality_rules.quality(frame(spark, rows)).collect()), key=str) == quality_brute(rows)


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, words(rng, 80) + (" pathetic moron scum " if i % 5 == 0 else "") + (f" token = {'ab12' * 10} " if i % 7 == 0 else ""), "en", rng.choice("abc"), 0) for i in range(400)]
    rows += [(1000 + i, rows[i + 1][1], "en", "a", 0) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    toxic, near, secret, mixed, tokens = kept
    assert all(x.columns == list(P.COLUMNS) for x in kept[:-1])
    assert {r[0] for r in toxic.select("doc_id").collect()} >= {i for i in range(400) if i % 5}
    assert not {r[0] for r in toxic.select("doc_id").collect()} & {i for i in range(400) if i % 5 == 0 and zlib.crc32(str(i).encode()) % 5}
    assert {r[0] for r in toxic.select("doc_id").collect()} - {r[0] for r in near.select("doc_id").collect()} == {1000, 1001, 1002}
    assert secret.filter("text like '%ab12ab12%'").count() == 0 and secret.filter("text like '%[assign]%'").count() > 0
    masked = {r["doc_id"]: secret_scan.masked(r["text"]) for r in near.collect()}
    assert {r["doc_id"]: r["text"] for r in secret.collect()} == masked
    assert all(masked[r["doc_id"]].startswith(r["text"]) for r in mixed.collect())
    assert tokens.count() == mixed.count() and tokens.filter("n_tokens = 0").count() == 0
    assert sorted(r["n_tokens"] for r in P.run(spark, str(tmp_path)).collect()) == sorted(r["n_tokens"] for r in tokens.collect())
