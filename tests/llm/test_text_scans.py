import hashlib
import math
import random
import re
import re._parser as sre_parse
import struct
import zlib

import numpy as np
import pytest

from tests.llm.pages import PAGES
from tests.llm.corpus import corpus, frame, words
from tracelake.llm import bpe, html_extraction, license_scan, secret_scan, telephony_audio, toxicity

CASES = [corpus(), corpus()[:1], []]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


# --- licenses


def licensed():
    rng = random.Random(1)
    lines = ["Released under the MIT License.", "Apache\nLicense", "GNU General  Public-License, version 3", "mit licenses", "mit license mit license", "SPDX-License-Identifier: BSD-3-Clause", "émit license", "All rights reserved."]
    texts = [words(rng, 5) + " " + " ".join(rng.sample(lines, k)) + words(rng, 3) for k in (0, 1, 2, 3, 8)] + [words(rng, 50_000) + " mit license"]
    return [(i, t, "en", "a", 0, None, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [*CASES, licensed()])
def test_license_base(spark, rows):
    want = []
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))
        at = sorted((i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for n in [p.split()] for i in range(len(w)) if w[i : i + len(n)] == n)
        want.append({"doc_id": r[0], "n_words": len(w), "n_base": len(at), "first_word": min((i for i, _ in at), default=None), "last_word": max((i for i, _ in at), default=None), "base_labels": ",".join(sorted({x for _, x in at}))})
    got = rows_of(license_scan.scan(frame(spark, rows)))
    assert [{k: g[k] for k in want[0]} for g in got] == sorted(want, key=str) if want else got == []
    assert all({*filter(None, g["base_labels"].split(","))} <= {*g["labels"].split(",")} and 0 <= g["score"] <= 1 for g in got)


def test_license_rules():
    assert len(license_scan.rules()) > 300
    label = lambda t: [(d["label"], d["start"], d["end"]) for d in license_scan.scan_text(t)["detections"]]
    assert label("Licensed under the Apache License, Version 2.0.") == [("apache-2.0", 0, 8)]  # contained ones are suppressed
    assert label("SPDX-License-Identifier: GPL-2.0-only") == [("gpl-2.0", 0, 7)]
    assert label("under CC BY-NC 4.0") == [("cc-by-nc", 1, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_license_prefilter_and_suppression(seed):
    rng = random.Random(seed)
    vocabulary = "mit license apache 2 0 gpl v3 version general public gnu licensed under the terms of bsd 3 clause cc by nc sa 4 spdx identifier creative commons or later only".split()
    for _ in range(60):
        norm = " ".join(rng.choices(vocabulary, k=30)).encode()
        every = [(-r.priority, m.start() - m.end(), m.start(), i, m.end(), r) for i, r in enumerate(license_scan.rules()) for m in r.pattern.finditer(norm)]
        kept = []
        for _, _, a, _, b, r in sorted(every, key=lambda d: d[:4]):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, r))
        assert license_scan.detect(norm) == sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def generated(node):
    """Matches of a parsed regex: every branch and both ends of every repeat at least once."""
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) if str(x[0]) != "NEGATE" else "w" for x in arg[:1]]
        elif name == "NOT_LITERAL":
            some = ["w"]
        elif name == "BRANCH":
            some = [g for b in arg[1] for g in generated(b)]
        elif name == "SUBPATTERN":
            some = generated(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = generated(arg[2])
            some = [*([""] if not arg[0] else []), *(g * max(arg[0], 1) for g in inner), *(inner[:1] if arg[1] > 40 else [])]
            some += [g * 40 for g in inner[:1] if arg[1] > 40]
        else:
            assert name == "ASSERT_NOT", name
            some = [""]
        out = [o + g for o in out for g in dict.fromkeys(some)]
    return out


def test_license_prefilter_drops_no_match():
    rules, n = license_scan.rules(), 0
    for r in rules:
        made = generated(sre_parse.parse(r.pattern.pattern.decode()))
        assert made
        for text in made:
            if r.pattern.search(text.encode()):
                n += 1
                assert any(k in text for k in r.keywords), (r.label, text)
    assert n > 2000
    label = lambda t: license_scan.scan_text(t)["detections"]
    assert [d["label"] for d in label("governed by a BSD-style license")] == ["bsd"]
    assert [d["label"] for d in label("WITHOUT WARRANTIES OR CONDITIONS")] == ["no-warranty"]
    clause = lambda holder: f"Neither the name of {holder} may be used to endorse or promote products"
    assert [d["label"] for d in label(clause("the long holder " * 50))] == ["bsd-3-clause"]
    assert [(d["start"], d["label"]) for d in label("neither the name of x " + clause("y"))] == [(5, "bsd-3-clause")]
    assert label(clause("x").replace(" x ", " ")) == [] and label("neither the name of x " * 20_000) == []


# --- secrets


def secretive():
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    bits = ['password = "hunter2hunter2"', "PassWD:short", "api_key='abcdefgh'", "apikey : ABCDEFGHIJ", "toKen=ſecretſecret", "AKIA" + "A" * 12, "AKIA" + "B" * 11, hexes(32), hexes(31), hexes(80), "token = " + hexes(40), "https://db.example.com/x", "user: bob", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY7", "\n\n", "é" * 3]
    return [(i, " ".join(rng.choice([*bits, words(rng, 3)]) for _ in range(rng.randint(1, 40))), "en", "a", 0, None, None, None, None) for i in range(60)]


@pytest.mark.parametrize("rows", [*CASES, secretive()])
def test_secret_base(spark, rows):
    want = []
    for r in rows:
        t, spans = r[1] or "", []
        letters = lambda k: "".join(f"[{c}{c.upper()}]" for c in k)
        keys = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + f"|{letters('api')}_?{letters('key')}"
        for kind, k, p in (("assign", 0, rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", 1, "AKIA[A-Z0-9]+"), ("hex", 2, "[0-9a-f]+")):
            for m in re.finditer(p, t):
                if (len(m[2]) >= 8) if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        listed = [s[2] for s in sorted(spans)]
        want.append({"doc_id": r[0], "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(",".join(listed).encode()).hexdigest(), "listed": listed})
    got = sorted(secret_scan.scan(frame(spark, rows)).collect(), key=lambda r: (str(r["doc_id"]), r["spans"]))
    for g, w in zip(got, sorted(want, key=lambda w: (str(w["doc_id"]), ",".join(w["listed"]))), strict=True):
        assert {k: g[k] for k in w if k != "listed"} == {k: v for k, v in w.items() if k != "listed"}
        assert {*w["listed"]} <= {*g["spans"].split(",")} | {""}


def test_weak_candidates_need_their_complements():
    kinds = lambda t: sorted(k for _, _, k in secret_scan.linked_spans(t, secret_scan.base_spans(t)))
    run = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY7"
    assert kinds(run) == [] and kinds("https://db.example.com/x") == [] and kinds("user = bob") == []
    assert kinds(f"AKIA{'A' * 12} and {run}") == ["run"]
    assert kinds(f"AKIA{'A' * 12}\n\n{run}") == []  # another scope
    assert kinds(f"AKIA{'A' * 12} {'x ' * 200}{run}") == []  # out of reach
    assert kinds("user = bob password = hunter2hunter2 https://db.example.com/x") == ["endpoint", "user"]
    assert kinds("https://db.example.com/x password = hunter2hunter2") == []


def test_a_candidate_within_another_is_no_part():
    found = lambda t: sorted(k for _, _, k in secret_scan.linked_spans(t, secret_scan.base_spans(t), None))
    assert found("docs at https://example.com/guides/2024/getting-started-with-widgets-page-17 and user: bob wrote it") == []
    assert found("client_id = wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLE and https://db.example.com/x") == []
    assert found(f"AKIA{'A' * 12} used by\nhttps://api.example.com/v1?token=abcd1234efgh5678") == ["endpoint"]
    assert found("https://api.example.com/v1?token=abcd1234efgh5678") == []
    assert secret_scan.masked(f"AKIA{'A' * 12} at https://api.example.com/v1?token=abcd1234efgh5678 now") == "[access] at [endpoint] now"


@pytest.mark.parametrize("reach", [None, 256, 20])
def test_links_are_those_of_all_pairs_in_a_scope(reach):
    rng, bits, found = random.Random(9), [r[1] for r in secretive()], 0
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    for t in bits + [f"{b} token={hexes(32)}.{'x.' * rng.randint(0, 300)} {'word ' * rng.randint(0, 200)}\n{rng.choice(['user=bob', 'https://db.example.com/x'])}\n \n{b}" for b in bits]:
        base = secret_scan.base_spans(t)
        weak = [(m.start(), m.end(), k) for k, p in (("endpoint", secret_scan.ENDPOINT), ("user", secret_scan.USER), ("run", secret_scan.RUN)) for m in p.finditer(t)]
        weak = [w for w in weak if w[2] != "run" or secret_scan._entropy(t[w[0] : w[1]]) >= 3.5 and re.search("[0-9]", t[w[0] : w[1]]) and re.search("[A-Za-z]", t[w[0] : w[1]])]
        weak = [w for w in weak if not any((a <= w[0] and b >= w[1]) if w[2] == "endpoint" else (a < w[1] and b > w[0]) for a, b, _ in base)]
        weak = [w for w in weak if not any(o[0] <= w[0] and o[1] >= w[1] and o[:2] != w[:2] for o in weak)]
        cuts = [m.start() for m in secret_scan.SCOPE.finditer(t)]
        scope = lambda x: sum(c < x for c in cuts)
        near = lambda w, o: o != w and scope(w[0]) == scope(o[0]) and (reach is None or o[0] < w[1] + reach and o[1] > w[0] - reach)
        has = lambda w, role: any(secret_scan.ROLE[o[2]] == role and near(w, o) and (o in base or o[0] >= w[1] or o[1] <= w[0]) for o in base + weak)
        needs = {"secret": ["id"], "id": ["secret"], "endpoint": ["secret", "id"]}
        want = [w for w in weak if all(has(w, role) for role in needs[secret_scan.ROLE[w[2]]])]
        assert secret_scan.linked_spans(t, base, reach) == want
        found += len(want)
    assert found > 50


def test_parts_of_one_scope_link_however_far(spark):
    text = "token=" + "a1" * 16 + "." + "x" * 400 + "\nuser=bob"
    assert [s[2] for s in secret_scan.linked_spans(text, secret_scan.base_spans(text))] == ["user"]
    far = f"AKIA{'A' * 12} {'x ' * 400}wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY7"
    got = secret_scan.scan(frame(spark, [(1, far, "en", "a", 0, None, None, None, None)])).collect()
    assert got[0]["n_linked"] == 1 and secret_scan.masked(far).endswith("x [run]")


def test_masking(spark):
    rows = [(1, "a password = hunter2hunter2 b", "en", "a", 29, None, None, None, None), (2, None, "en", "a", 5, None, None, None, None)]
    got = rows_of(secret_scan.mask(frame(spark, rows)).select("doc_id", "text", "n_chars"))
    assert got == [{"doc_id": 1, "text": "a [assign] b", "n_chars": 12}, {"doc_id": 2, "text": None, "n_chars": 5}]


# --- audio


@pytest.mark.parametrize("rows", CASES)
def test_audio_round_trip(spark, rows):
    got = rows_of(telephony_audio.digest(frame(spark, rows)))
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        want.append({"doc_id": r[0], "n_bytes": len(raw), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:])})
    assert [{k: g[k] for k in want[0]} for g in got] == sorted(want, key=str) if want else got == []
    by_text = {}
    for g in got:
        assert by_text.setdefault(g["payload_sha256"], (g["media_sha256"], g["feature"])) == (g["media_sha256"], g["feature"])
    stored = telephony_audio.store(frame(spark, rows))
    pcm = telephony_audio.pcm(stored).collect()
    assert sorted(len(x["pcm"]) for x in pcm) == sorted(4 * g["payload_bytes"] for g in got)
    heard = {r["doc_id"]: r["pcm"] for r in telephony_audio.pcm(stored, telephony_audio.STORED_RATE).collect() if r["doc_id"] is not None}
    for g in got:
        if g["doc_id"] in heard:
            p = heard[g["doc_id"]]
            assert f"pcm={zlib.crc32(p):08x};samples={len(p) // 2};" in g["feature"] and len(p) // 2 == math.ceil(g["payload_bytes"] * telephony_audio.STORED_RATE / telephony_audio.RATE)


def test_resampling():
    rng = np.random.default_rng(4)
    x = rng.integers(-32768, 32768, 577).astype(np.int16)
    for rate in (16_000, 8_000, 11_025, 48_000, 6_000, 4_000):
        got, of = telephony_audio.resampled(x, rate), telephony_audio.lowpassed(x, rate / 8000) if rate < 8000 else x
        at = np.arange(len(got)) * 8000 / rate
        assert len(got) == math.ceil(len(x) * rate / 8000) and np.abs(got - np.interp(at, np.arange(len(x)), of)).max() < 1
    assert telephony_audio.resampled(x, 8000).tolist() == x.tolist()


def test_low_pass_keeps_what_lies_below():
    t = np.arange(8000) / 8000
    tone = lambda f: np.rint(10_000 * np.sin(2 * np.pi * f * t)).astype(np.int16)
    loud = lambda x: np.sqrt(np.square(x[500:-500].astype(float)).mean())
    assert loud(telephony_audio.lowpassed(tone(500), 0.5)) == pytest.approx(loud(tone(500)), rel=0.01)
    assert loud(telephony_audio.lowpassed(tone(3500), 0.5)) < 0.01 * loud(tone(3500))
    assert loud(telephony_audio.resampled(tone(3500), 4000)) < 0.01 * loud(tone(3500))  # does not come back as a lower tone


def test_packed_pcm_loses_nothing():
    rng = np.random.default_rng(5)
    signal = telephony_audio.MULAW[rng.integers(0, 256, 577)]
    double = telephony_audio.resampled(signal, 16_000)
    changed = double.copy()
    changed[1::2] += rng.integers(-40_000, 40_000, len(changed[1::2])).astype(np.int16)
    for pcm in (double, double[:-1], double[:1], changed, signal, rng.integers(-32768, 32768, 301).astype(np.int16), np.zeros(0, np.int16)):
        assert telephony_audio.unpacked(telephony_audio.packed(pcm)).tolist() == pcm.tolist()
    assert len(telephony_audio.packed(double)) == 9 + 577
    with pytest.raises(ValueError):
        telephony_audio.unpacked(b"Q" + bytes(20))


def test_pcm_of_odd_files(spark):
    assert telephony_audio.pcm(spark.createDataFrame([(1, None)], telephony_audio.MEDIA.replace("n_bytes long, ", ""))).first()["pcm"] is None
    with pytest.raises(Exception, match="not a WAVE file"):
        telephony_audio.pcm(spark.createDataFrame([(1, b"RIFX")], "doc_id long, media binary")).collect()


def test_companding_and_adpcm():
    mu = [int(x) for x in telephony_audio.MULAW]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert sorted({abs(x) for x in mu})[1] == 8 and (int(telephony_audio.ALAW[0xD5]), int(telephony_audio.ALAW[0x2A])) == (8, -32256)
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (50, 36), dtype=np.uint8)
    for block, got in zip(blocks, telephony_audio.decode_adpcm(blocks)):
        value, index = struct.unpack("<hB", block[:3].tobytes())
        index, out = min(index, 88), [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony_audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                out.append(value)
        assert got.tolist() == out
    with pytest.raises(ValueError):
        telephony_audio.samples(b"RIFF....WAVEdata\xff\xff\0\0")


# --- tokens


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("rows", CASES)
def test_bpe_is_the_library(spark, vocabulary, rows):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(vocabulary)
    want = []
    for r in rows:
        ids = ref.encode(r[1] or "", add_special_tokens=False).ids
        want.append({"doc_id": r[0], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()})
    assert rows_of(bpe.digest(frame(spark, rows), vocabulary)) == sorted(want, key=str)


def test_bpe_odd_texts(vocabulary):
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(vocabulary), bpe.Encoder(vocabulary)
    rng = random.Random(7)
    odd = ["Hello's world!!! ΑΣ İ Å <|startoftext|>abc<|endoftext|> don't we'll I'd x\x1cy\x1d z w", "=" * 5000, "ab" * 3000, "é" * 2000, "日本語テキスト１２３ ½", "\U0001f600\U0001f601", "​ a﻿", "é ́a", "haha" * 999 + "!?" * 999]
    odd += ["".join(rng.choices("abcdeinorst' 'é1!̀", k=400)) for _ in range(200)]
    for t in odd:
        ids = ref.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and "".join(own.decode(own.encode(t).tolist(), spelled=True)) == ref.decode(ids, skip_special_tokens=False)
    assert "".join(own.decode(own.encode("Naïve cafés, 2 of them").tolist())).split() == "naïve cafés , 2 of them".split()


def test_decoder_needs_no_whole_text(spark, vocabulary, monkeypatch):
    own, rng = bpe.Encoder(vocabulary), random.Random(2)
    texts = ["naïve cafés 日本語 🎉 x" * 3, "🎉" * 50, "", " ", "<unk> a", "e\u0301\u0327 " * 9]
    ids = [own.encode(t).tolist() for t in texts] + [[rng.randrange(len(own.tokens)) for _ in range(300)] for _ in range(20)]  # ids in any order: characters may stay unfinished
    whole = [["".join(own.decode(i, spelled)) for i in ids] for spelled in (False, True)]
    for n in (1, 2, 7):
        monkeypatch.setattr(bpe, "DECODED_AT_ONCE", n)
        assert [["".join(own.decode(i, spelled)) for i in ids] for spelled in (False, True)] == whole
    tokens = spark.createDataFrame([(k, np.array(i, "<u4").tobytes(), 5) for k, i in enumerate(ids[:6])] + [(9, None, 5)], "doc_id long, ids binary, text int").withColumnRenamed("text", "other")
    assert [r["text"] for r in bpe.decode(tokens, vocabulary).orderBy("doc_id").collect()] == [*whole[0][:6], None]
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(whole[0][:6])}


def merge_list(tmp_path, merges, letters):
    """An encoder of a list of merges."""
    import json

    symbols = dict.fromkeys([*letters, *[c + bpe.END for c in letters], *[a + b for a, b in merges]])
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {s: i for i, s in enumerate(symbols)}, "merges": [list(m) for m in merges]}, "added_tokens": []}))
    return bpe.Encoder(str(path))


def random_merges(rng, letters, n, most):
    symbols, merges = [*letters, *[c + bpe.END for c in letters]], []
    while len(merges) < n:
        a, b = rng.choice([s for s in symbols if not s.endswith(bpe.END)]), rng.choice(symbols)
        if a + b not in symbols and len(a + b) < most:
            merges.append((a, b))
            symbols.append(a + b)
    return merges


def ended(run):
    return [*run[:-1], run[-1] + bpe.END]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrst"])
def test_transducer_streams_random_merge_lists(seed, letters, tmp_path):
    """Against plain merging, on runs far longer than the lookahead, and what is out of a prefix's tokens by the lookahead is out for good."""
    rng = random.Random(seed)
    own = merge_list(tmp_path, random_merges(rng, letters, 40 if letters == "abc" else 200, 12), letters)
    for n in (1, 2, 5, 30, 700):
        run = ended(rng.choices(letters, k=n))
        assert [*own.transduce(run)] == own._merge(run)
    for _ in range(30):
        run = rng.choices(letters, k=rng.randint(1, 60))
        whole = own._merge(run)
        for n in range(1, len(run)):
            at = same = 0
            for token in own._merge(run[:n]):
                at += len(own._symbols(token))
                if at > n - own.lookahead:
                    break
                assert token == whole[same]
                same += 1


def names(n):
    return [chr(0x4E00 + k) for k in range(n)]


@pytest.mark.parametrize("n", [3, 16, 26, 100, 301])
def test_transducer_where_the_end_decides_the_beginning(n, tmp_path):
    """Merges (y, z), (x, y), ..., (a, b): which pairs merge follows from where the run ends, at any distance, though no token has more than two symbols."""
    letters = names(n)
    own = merge_list(tmp_path, [(letters[k], letters[k + 1]) for k in range(n - 2, -1, -1)], letters)
    assert own.longest == 2 and n - 1 <= own.lookahead <= n + 1
    for run in (letters, letters[:-1], letters[1:], letters * 3, letters[:-1] * 2 + letters):
        assert [*own.transduce(run)] == own._merge(run)
        assert [*own.transduce(ended(run))] == own._merge(ended(run))


def test_transducer_holds_the_lookahead_only(tmp_path):
    """Symbols are taken from a stream, and tokens leave it while it runs."""
    letters, rng = names(40), random.Random(1)
    chain = merge_list(tmp_path, [(letters[k], letters[k + 1]) for k in range(38, -1, -1)], letters)
    taken, held = 0, 0

    def source():
        nonlocal taken
        for k in range(40_000):
            taken += 1
            yield letters[k % 40] if k % 7 else rng.choice(letters)

    out = 0
    for token in chain.transduce(source()):
        out += len(token)
        held = max(held, taken - out)
    assert out == 40_000 and held <= 2 * chain.lookahead + 10 * chain.longest


def test_a_run_of_megabytes_needs_no_memory_of_its_own(vocabulary):
    import tracemalloc

    own, rng = bpe.Encoder(vocabulary, 1000), random.Random(3)
    text = "".join(rng.choices("etaoinshrdluwxyz", k=1_500_000))
    part = text[:3000]
    from tokenizers import Tokenizer

    assert list(own.word_ids(part)) == Tokenizer.from_file(vocabulary).encode(part, add_special_tokens=False).ids
    tracemalloc.start()
    n = sum(1 for _ in own.run_ids(text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and most < 4_000_000


def test_library_on_long_runs(vocabulary):
    from tokenizers import Tokenizer

    ref, own, rng = Tokenizer.from_file(vocabulary), bpe.Encoder(vocabulary), random.Random(5)
    for letters in ("ab", "aeiou", "thern", "abcdefghijklmnopqrstuvwxyz", "éüñ", "日本語中文", "!?.,-=", "ha", "l"):
        for n in (60, 130, 400, 3000):
            t = "".join(rng.choices(letters, k=n))
            assert own.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_decode_of_empty_and_repeated_rows(spark, vocabulary):
    own = bpe.Encoder(vocabulary)
    ids = own.encode("one two").tobytes()
    schema = "doc_id long, ids binary, n_tokens long"
    rows = spark.createDataFrame([(1, bytearray(ids), 7), (1, bytearray(ids), 7), (2, bytearray(), 0), (3, None, 0)], schema)
    assert sorted(map(tuple, bpe.decode(rows, vocabulary).collect()), key=str) == [(1, "one two ", 7), (1, "one two ", 7), (2, "", 0), (3, None, 0)]
    assert bpe.decode(spark.createDataFrame([], schema), vocabulary).collect() == []


# --- toxicity and pages


def test_toxicity_holds_out(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 60) + (" you pathetic moron " if i % 4 == 0 else " ") + words(rng, 60), "en", "a", 0, None, None, None, None) for i in range(600)] + corpus()[:3]
    rows[-3:] = [(1000 + k, *r[1:]) for k, r in enumerate(rows[-3:])]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert len({got[1000], got[1001], got[1002]}) == 1 and got[1000] < 0.5  # null, empty and blank
    assert {r["doc_id"] for r in toxicity.reject(docs, model).select("doc_id").collect()} == {i for i, s in got.items() if s < 0.5}
    # Ratios and the fit by plain counting, on what the sample holds.
    sample = {i: int(i % 4 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 5}
    seen = {i: set(toxicity.features(rows[i][1]).tolist()) for i in sample}
    held = {y: sum(v == y for v in sample.values()) for y in (0, 1)}
    of = lambda b, y: sum(b in seen[i] for i, v in sample.items() if v == y)
    ratio = np.array([math.log((of(b, 1) + 0.5) / (held[1] + 1)) - math.log((of(b, 0) + 0.5) / (held[0] + 1)) for b in model.buckets.tolist()])
    places = [np.array([k for k, b in enumerate(model.buckets.tolist()) if b in seen[i]], np.int64) for i in sorted(sample)]
    y = np.array([sample[i] for i in sorted(sample)], float)
    w, bias = toxicity.fit(places, y, ratio)
    assert np.allclose(model.weights, w * ratio) and model.bias == pytest.approx(bias)
    loss = lambda w, b: sum(c * math.log1p(math.exp(-(2 * t - 1) * (ratio[p] @ w[p] + b))) for c, t, p in zip(cost, y, places)) / len(y) + toxicity.L2 * (w @ w) / 2 / len(y)
    cost = np.where(y == 1, math.sqrt(0.5 / y.mean()), math.sqrt(0.5 / (1 - y.mean())))
    cost *= len(y) / cost.sum()
    least = loss(w, bias)
    for _ in range(30):
        step = np.random.default_rng(len(y)).standard_normal(len(w)) * 0.02
        assert loss(w + step, bias) > least - 1e-6 and loss(w - step, bias) > least - 1e-6
    few = toxicity.train(docs, labels, kept=7, least_rows=(50, 50))
    assert len(few.buckets) == 7 and all(of(b, 0) + of(b, 1) >= 50 for b in few.buckets.tolist())
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_toxicity_reads_characters(monkeypatch):
    same = lambda a, b: toxicity.features(a).tolist() == toxicity.features(b).tolist()
    assert same("ПРИВЕТ Ärger STRASSE", "привет ärger straße") and same("a-b,  c!", "A b c") and not same("дурак", "дурок")
    assert len(toxicity.features("дурак")) == sum(5 + 2 - n + 1 for n in toxicity.SIZES)  # places of 7 characters, not of bytes
    rng = random.Random(2)
    texts = [words(rng, 400), "", "x", words(rng, 3) + "дурак 中文字 😀", words(rng, 90)]
    whole = [toxicity.features(t).tolist() for t in texts]
    model = toxicity.Model(np.array(sorted({b for w in whole for b in w[::3]}), np.int32), np.zeros(0), 0.25)
    model = model._replace(weights=np.random.default_rng(1).standard_normal(len(model.buckets)))
    table, weight = toxicity._table(model), dict(zip(model.buckets.tolist(), model.weights))
    want = [0.25 + sum(weight.get(b, 0) for b in w) for w in whole]
    for window in (1 << 18, 700, 64):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert [toxicity.features(t).tolist() for t in texts] == whole
        assert np.allclose(toxicity.logits(model, table, texts), want)


def test_toxicity_of_a_very_long_text(tmp_path):
    """16 million characters under a limit of address space."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tracelake.llm import toxicity as T
text = "the quick brown fox " * 800_000 + "dreadful moron"
resource.setrlimit(resource.RLIMIT_AS, (1_500_000_000,) * 2)
found = T.features(text)
model = T.Model(found, np.ones(len(found)), 0.0)
assert T.logits(model, T._table(model), [text, ""])[0] == len(found) > 100
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>Ti&amp;tle</h1><p>First <b>bold</b>\n text, and more of it.<p>Second&nbsp;one<br>goes on.</p><script>var t='</p>';</script><div class='comments'><p>Great post thanks</p></div></article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)]
    got = rows_of(html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    text = "Ti&tle\n\nFirst bold text, and more of it.\n\nSecond one goes on."
    assert got == sorted([{"page_id": 1, "url": "u", "text": text, "n_chars": len(text)}] * 2 + [{"page_id": 2, "url": None, "text": "", "n_chars": 0}, {"page_id": None, "url": "v", "text": "", "n_chars": 0}], key=str)
    assert rows_of(html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_hand_labelled_pages():
    """Block precision and recall on pages that the generator knows nothing of."""
    net, hit, found, wanted = html_extraction.trained(), 0, 0, 0
    for page in PAGES.values():
        main = [b.text.startswith("§") for b in html_extraction.blocks(page)]
        got = html_extraction.label(net, [html_extraction.vectors(html_extraction.blocks(page.replace("§", "")))])[0] >= 0.5
        hit, found, wanted = hit + int((got & main).sum()), found + int(got.sum()), wanted + sum(main)
    assert hit / found > 0.92 and hit / wanted > 0.95
    pages = list(PAGES.values())
    texts = html_extraction.main_texts(net, [p.replace("§", "") for p in pages])
    assert texts[list(PAGES).index("bare")] == "\n\n".join(b.text.lstrip("§") for b in html_extraction.blocks(PAGES["bare"]))


def test_network_is_kept(spark, monkeypatch):
    options = {"pages": 30, "epochs": 1}
    made = html_extraction.network(spark, **options)
    monkeypatch.setattr(html_extraction, "trained", None)  # not trained again
    kept = html_extraction.network(spark, **options)
    assert all(a.shape == b.shape and (a == b).all() for a, b in zip(made, kept))


def test_labeller_on_composed_pages():
    net, rng, right, n = html_extraction.trained(), random.Random(77), 0, 0
    for _ in range(100):
        found, wanted = html_extraction.compose(rng)
        right += int(((html_extraction.label(net, [html_extraction.vectors(found)])[0] >= 0.5) == np.array(wanted)).sum())
        n += len(wanted)
    assert right / n > 0.97


def test_far_ancestors_reach_the_vectors():
    deep = lambda n: "".join("<div class='flex mx-auto px-4 wp-block-group is-layout-flex has-text-color'><div>" for _ in range(n))
    prose = "The river rose over night, and the town slept on. Nobody had thought of the bridge, which was old."
    page = lambda tag, n: f"<html><body><article><h1>A flood</h1><p>{prose}</p><p>{prose}</p></article><{tag}>{deep(n)}<p>Another text stands here, of a few words.</p></body></html>"
    paths = [html_extraction.blocks(page(tag, 4))[-1].path for tag in ("aside", "section")]
    one, two = (html_extraction.vectors([html_extraction.Block(p, "x", 0)]).paths.tolist() for p in paths)
    assert len(one) == len(paths[0]) > 40 and one != two


def test_labeller_on_deep_pages():
    net, rng, right, n = html_extraction.trained(), random.Random(78), 0, 0
    for _ in range(200):
        found, wanted = html_extraction.compose(rng)
        if max(len(b.path) for b in found) > 30:
            right += int(((html_extraction.label(net, [html_extraction.vectors(found)])[0] >= 0.5) == np.array(wanted)).sum())
            n += len(wanted)
    assert n > 500 and right / n > 0.95


def test_gradient_by_differences():
    rng = random.Random(5)
    net = html_extraction.trained(seed=2, pages=4, epochs=1, batch=2)
    made = [html_extraction.compose(rng) for _ in range(3)]
    pages, wanted = [html_extraction.vectors(b) for b, _ in made], np.concatenate([np.array(w, np.float32) for _, w in made])

    def loss():
        p = np.clip(np.concatenate(html_extraction.label(net, pages)), 1e-7, 1 - 1e-7)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    grad = html_extraction._gradient(net, pages, wanted)
    for w, g in zip(net, grad):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = w[at]
        w[at] = was + 1e-2
        up = loss()
        w[at] = was - 1e-2
        down = loss()
        w[at] = was
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)
