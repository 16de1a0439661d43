import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import chat_format as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, part double, rendered string"
STRINGS = [*C.MARKS, "<|endoftext|>"]


def row(conv, turn, role, text):
    return (conv, turn, role, text, "clash", 0.5, "clash")


def talk(rng, n):
    bits = [*STRINGS, "[\\INST]", "<\\\\/s>", "\\", "[", "<", "INST]", " ", "\n", "the river ", "Straße", "日本", "😀", "é", "don't", "  two", "\0"]
    return "".join(rng.choice(bits) for _ in range(n))


def conversations():
    rng = random.Random(4)
    rows = [row(1, t, r, x) for t, (r, x) in enumerate([("system", "be <s>hort"), ("user", " hi "), ("assistant", " ok "), ("user", None), ("assistant", ""), ("assistant", "again"), ("tool", "out"), (None, "no role"), ("[ROLE]x", "y")])]
    rows += [row(2, 1, "assistant", "second"), row(2, 0, "user", "first"), row(2, 0, "user", "first"), row(2, 0, "assistant", "tie"), row(2, None, "user", "no turn")]
    rows += [row(None, 0, "user", "no id"), row(None, 1, "assistant", "[INST] none [/INST]"), row(3, 0, "system", "only a system")]
    rows += [row(10 + k // 6, k % 6, rng.choice(["user", "assistant", "system", "tool"]), talk(rng, rng.randint(0, 30))) for k in range(240)]
    rows += [row(90, k, ("user", "assistant")[k % 2], talk(rng, 40)) for k in range(700)]
    return rows + [row(91, 0, "user", "x"), row(91, 1, "assistant", talk(rng, 120_000))]


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_chars", [C.PART_CHARS, 300])
@pytest.mark.parametrize("rows", [conversations(), conversations()[:1], []])
def test_read_back_is_what_was_said(spark, rows, part_chars):
    parts = C.materialize(C.formatted(spark.createDataFrame(rows, SCHEMA), VOCABULARY, part_chars=part_chars), "chat")
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.read_back(parts, VOCABULARY).collect()}
    assert got == expected(rows)
    n = parts.groupBy("conv_id").count().collect()
    assert len(n) == len(got) and (part_chars < 1000 and len(rows) > 1) == any(r["count"] > 1 for r in n)


def test_parts_have_the_tokens_of_the_whole(spark):
    frame = spark.createDataFrame(conversations(), SCHEMA)

    def ids(part_chars):
        out = defaultdict(list)
        for r in C.formatted(frame, VOCABULARY, part_chars=part_chars).orderBy("conv_id", "part").collect():
            out[r["conv_id"]] += r["ids"]
        return out

    assert ids(300) == ids(C.PART_CHARS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*STRINGS, "\\", "[", "]", "<", ">", "/", "INST]", "s>", "a", " "]), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    t = C.Template(("<|endoftext|>",))
    escaped = t.escape(text)
    assert t.unescape(escaped) == text and not any(s in escaped for s in STRINGS)


def test_masked_tokens_are_the_assistants(spark):
    rng, encoder = random.Random(9), C.Encoder(VOCABULARY)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system", "x"]), talk(rng, rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        pieces, learnt = ["<s>"], [False]
        for r, x in turns:
            pieces += encoder.template.turn(r, x)
            learnt += [False, r == "assistant", False]
        rendered, ids, loss = encoder.encode(pieces, learnt)
        assert encoder.decode(ids) == rendered and list(encoder.template.turns(rendered)) == turns
        assert [encoder.template.unescape(encoder.decode(ids[a:b])) for a, b in loss] == [x for r, x in turns if r == "assistant" and x]


def test_what_is_no_conversation_raises():
    t = C.Template()
    for bad in ("<s>loose", "<s>[INST]open", "<s>[INST]a[/SYS]", "<s>[ROLE]a[/TURN]", "<s>a[INST]b[/INST]"):
        with pytest.raises(ValueError):
            list(t.turns(bad))
    with pytest.raises(ValueError):
        C.Template(("<s>x",))
