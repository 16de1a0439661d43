import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import similarity as S
from tracelake.functions import text as T
from tracelake.operators import conversations as C, sequential


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


FULL = "1. Task Specification Violations: DETECTED: Yes\n3. **Step Repetition:** DETECTED: No\n3. **Step Repetition:** DETECTED: Yes\n9. Goal Dev: DETECTED: Yes\nTASK_STATUS: **Needs correction** \nOVERALL_GUIDANCE: a\nb "


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.strip, "  a b\n ", "a b"),
    (T.strip_think, "<think>x\ny</think>\n z ", "z"),
    (T.reasoning, "<think> a </think> b", "a"),
    (T.reasoning, "lone </think> b", "lone"),
    (T.reasoning, "none", ""),
    (T.answer, "a</think> b</think> c", "b</think> c"),
    (T.is_valid_feedback, "", False),
    (T.is_valid_feedback, "Let me see DETECTED: TASK_STATUS:", True),
    (T.is_valid_feedback, "Let me see DETECTED:", False),
    (T.is_valid_feedback, "it was DETECTED: so", True),
    (T.is_valid_feedback, "prose", False),
    (T.current_feedback, "h\n## Current Feedback (after step 5):\nDETECTED: x ", "DETECTED: x"),
    (T.current_feedback, "## Current Feedback\nLet me cat", ""),
    (T.current_feedback, "## Current Feedback", ""),
    (T.current_feedback, "SUPERVISOR FEEDBACK: TASK_STATUS: ok", "TASK_STATUS: ok"),
    (T.detections, FULL, {"Task Specification Violations": 1, "Step Repetition": 0}),
    (T.detections, "step repetition detected: yes", {"Step Repetition": 0}),
    (T.numbered_detections, FULL, {"Task Specification Violations": True, "Step Repetition": True, "Goal Deviation": True}),
    (T.numbered_detections, "1. step repetition: detected: yes", {}),
    (T.task_status, FULL, "Needs correction"),
    (T.task_status, "TASK_STATUS:\nAlready solved", "On track"),
    (T.task_status, "TASK_STATUS: critical!", "Critical intervention required"),
    (T.task_status, "TASK_STATUS: hm", None),
    (T.task_status, "none", None),
    (T.normalized_status, ' *"On track".', "On track"),
    (T.normalized_status, "Needs correction # note", "Needs correction"),
    (T.normalized_status, "", "Other"),
    (T.guidance_length, FULL, 3),
    (T.guidance_length, "none", 0),
    (T.command, "run ```bash\n ls \n``` now", "ls"),
    (T.command, "```bash\na\n``````bash\nb\n``` ", "```bash\na\n``````bash\nb\n```"),
    (T.files_in_patch, "diff --git a/x.py b/x.py\n+\ndiff --git a/d/y b/d/y\ndiff --git a/x.py b/x.py\n", ["d/y", "x.py"]),
    (T.repo_path, "./testbed/a", "a"),
    (T.clean_diff, "diff --git a/venv/x b/venv/x\n-\ndiff --git a/src/myvenv/x b/src/myvenv/x\n-\ndiff --git a/ok b/ok\n+\n", "diff --git a/ok b/ok\n+\n"),
    (T.clean_diff, "no sections", "no sections"),
    (T.submission, "\n COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT \na\nb", "a\nb"),
    (T.submission, "echo\nCOMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", None),
    (T.touched_paths, "echo a > 'x.py' && cat y >> ./testbed/z 2>&1; ls 2>>/testbed/log", ["x.py", "testbed/z", "log"]),
    (T.touched_paths, """sed -i 's/a b/c/' x.py "/testbed/y z.py" | tee t; sed -i.bak -e s/a/b/ ./w && sed '3s/q/r/' /dev/null v""", ["x.py", "y z.py", "w", "v"]),
    (T.touched_paths, "make >out.txt 2>&1; run &> 'a b.log' | sed 5,9s/x/y/ in.txt >>./more", ["out.txt", "a b.log", "in.txt", "more"]),
    (T.touched_paths, "sed -f script.sed one two | cat three; sed -n p '>'", ["one", "two", "p", ">"]),
    (T.status_line, "x\n**Task_Status**:\n - On track\nmore", "On track"),
    (T.status_line, "TASK_STATUS: **Needs correction**", "Needs correction**"),
    (T.status_line, "TASK_STATUS:::\n", None),
    (T.status_line, "no status", None),
    (T.touched_paths, "grep -rn used file > /dev/null", []),
])
def test_text(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_more_text(spark):
    assert [tuple(h) for h in one(spark, T.hunks(F.col("t")), t="@@ -1,2 +3,4 @@\n@@ -9 +12 @@")] == [(3, 6), (12, 12)]
    assert one(spark, T.shorten(F.col("t"), 6), t="abcdefgh") == "abc..." and one(spark, T.shorten(F.col("t"), 6, left=True), t="abcdefgh") == "...fgh"
    assert one(spark, T.elide(F.col("t"), 6, 2), t="abcdef") == "ab\n[2 characters elided]\nef" and one(spark, T.elide(F.col("t"), 7, 2), t="abcdef") == "abcdef"
    assert one(spark, T.reasoning(F.col("t"), F.col("f")), t="<think>a</think>", f="field") == "field"
    assert one(spark, T.numbered_line(F.lit(7), F.col("t")), t="x") == "   7 | x"
    assert one(spark, T.is_step(F.lit("assistant"), F.col("t")), t="```bash\nls\n```")


def test_similarity(spark):
    cat = "the cat sat on the mat".split()
    assert S.bleu(cat, cat, 4) == pytest.approx(1) and S.bleu(cat, [], 4) == 0 and S.bleu(cat, ["dog"], 1) == 0
    assert S.bleu(cat, "the cat on the mat".split(), 2) == pytest.approx((1 * 3 / 4) ** 0.5 * 2.718281828459045 ** (1 - 6 / 5))
    assert S.rouge("the cats sat", "a cat sat down") == (pytest.approx(4 / 7), pytest.approx(2 / 5), pytest.approx(4 / 7))
    assert S.lcs(list("abcbdab"), list("bdcaba")) == 4
    for word, want in {"relational": "relat", "hopping": "hop", "ponies": "poni", "happy": "happi", "adjustable": "adjust", "controll": "control", "flies": "fli", "dies": "die", "died": "die", "spied": "spi", "dying": "die", "carefully": "care", "nationally": "nation", "geology": "geolog", "enjoy": "enjoy", "possibly": "possibl", "news": "news"}.items():
        assert S.stem(word) == want
    row = spark.createDataFrame([("a b c d", "a b c d"), (None, "x")], "r string, h string").select(S.bleu_rouge(F.col("r"), F.col("h")).alias("s")).select("s.*").collect()
    assert [round(x, 9) for x in row[0]] == [1.0] * 6 and [*row[1]] == [0.0] * 6
    assert one(spark, S.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(1) and one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_dedup_keeps_its_reference(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.95, 0.31]), (1, 2, [0.8, 0.6]), (1, 3, [0.81, 0.59])]
    got = sequential.deduplicated(spark.createDataFrame(rows, "k int, p int, v array<double>"), "k", "p", "v", 0.93).orderBy("p").collect()
    assert [r["suppressed"] for r in got] == [False, True, False, True]  # the third is compared with the first


def test_merging_is_idempotent(spark):
    rows = [("k", i, r, str(i)) for i, r in enumerate(["system", "system", "user", "user", "assistant", "user", "user"])]
    once = C.merge_roles(spark.createDataFrame(rows, "k string, p int, role string, content string"), "k", "p")
    assert [(r["role"], r["content"]) for r in once.orderBy("p").collect()] == [("system", "0"), ("system", "1"), ("user", "2\n\n3"), ("assistant", "4"), ("user", "5\n\n6")]
    assert sorted(map(tuple, C.merge_roles(once, "k", "p").collect())) == sorted(map(tuple, once.collect()))


def test_an_answer_is_read_once(spark):
    """The texts of both readings stand once in the expression: two patterns' worth for the numbered one, one a category for the loose one."""
    assert str(T.numbered_detections(F.upper("t"))).count("upper(") == 1 and str(T.numbered_detections(F.col("t"))).count("regexp_extract_all") == 2
    assert str(T.detections(F.upper("t"))).count("upper(") == 1


def test_many_lines_of_a_category(spark):
    text = "\n".join(f"{i}. **{T.CATEGORIES[i * i % 12]}:** DETECTED: {'Yes' if i % 5 < 2 else 'No'}" for i in range(2000))
    got = one(spark, T.numbered_detections(F.col("t")), t=text)
    want = {T.CATEGORIES[i * i % 12]: i % 5 < 2 for i in range(2000)}
    assert got == want and one(spark, T.numbered_detections(F.col("t")), t=None) is None


def test_scores_of_many_pairs(spark):
    """Pairs counted together, in runs and alone, score as each pair does by the definitions, and what is not named is not there."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "Running", "runs", "Ünder-way", "1,5", "é"], k=rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(400)] + ["x y " * 40_000, "y x " * 300, "", " \n"]
    pairs = list(zip(texts, texts[1:]))
    rows = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r string, h string").coalesce(1)
    got = rows.select("i", S.bleu_rouge(F.col("r"), F.col("h"), ("rouge1", "bleu4", "bleu1", "rouge2")).alias("s")).select("i", "s.*").collect()
    assert got[0].asDict().keys() == {"i", "rouge1", "bleu4", "bleu1", "rouge2"}
    for x in got:
        r, h = pairs[x["i"]]
        a, b = ([S._stemmed(w) for w in S._plain(t).split()] for t in (r, h))
        assert a == S.rouge_tokens(r)
        assert [x["bleu1"], x["bleu4"]] == S.bleus(r.split(), h.split(), (1, 4))
        one, two = (sum((S._grams(a, n) & S._grams(b, n)).values()) for n in (1, 2))
        assert [x["rouge1"], x["rouge2"]] == [S._f(one, len(a), len(b)), S._f(two, max(len(a) - 1, 0), max(len(b) - 1, 0))]


def test_numbered_tokens_are_those_of_split():
    texts = ["".join(f"a{chr(c)}" for c in range(k, min(k + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 4096)] + ["", " \n", " b  a\u3000b "]
    words, sizes = S._numbered(texts)
    want = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    first = {}
    assert [first.setdefault(n, w) for n, w in zip(words.tolist(), want)] == want and len(first) == len(set(want))


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.choice([0, 1, 3, 12])) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert S.lcs(a, b) == row[-1]
    assert S.lcs(list("abcab"), list("abxab")) == 4 and S.lcs(list("aa"), list("aaa")) == 2


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out
