"""Templates, prompts of a run, and summaries of runs, on cases written out by hand."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tracelake.functions.templates import TemplateError, template
from tracelake.operators import metrics as M
from tracelake.operators import prompts as P
from tracelake.operators import runs as R
from tracelake.plans.prompt_queries import NUDGE
from tracelake.sources import readers

SCHEMA = "n int, t string, o struct<code int, out string>, xs array<string>, ys array<struct<k int, v string>>, flag boolean, d double"
ROWS = [(5, "héllo", (1, "abcdef"), ["a", "b"], [(1, "x"), (2, None)], True, 1.5), (0, "", (None, "xyz"), [], None, None, None)]

#: source -> the texts of both rows
SHOWN = {
    "plain { text } 100%": ("plain { text } 100%",) * 2,
    "{{n}}|{{ t }}|{{flag}}|{{d}}": ("5|héllo|True|1.5", "0||None|None"),
    "{{ o.code }}{{ o['out'] }}": ("1abcdef", "Nonexyz"),
    "{{ o.out[:2] }}-{{ o.out[-2:] }}-{{ o.out[1:-1] }}-{{ o.out[4:2] }}-{{ t[:99] }}": ("ab-ef-bcde--héllo", "xy-yz-y--"),
    "{{ t | length - 1 }} {{ xs | length }} {{ t|upper|length }}": ("4 2 5", "-1 0 0"),
    "{{ xs | join(', ') }}!{{ xs[0] }}{{ xs[-1] }}": ("a, b!ab", "!NoneNone"),
    "{% if n > 3 and t %}A{% elif not xs %}B{% else %}C{% endif %}": ("A", "B"),
    "{% if xs %}x{% endif %}{% if flag %}f{% endif %}{% if d %}d{% endif %}{% if n %}n{% endif %}": ("xfdn", ""),
    "{% if t == 'héllo' %}same{% else %}other{% endif %}": ("same", "other"),
    "{% if 0 < n <= 5 %}in{% endif %}": ("in", ""),
    "{% for x in xs %}{{ loop.index }}{{ x }}{% if loop.index0 == 0 %},{% endif %}{% endfor %}.": ("1a,2b.", "."),
    "{% for y in ys %}({{ y.k }}{{ y.v }}){% for x in xs %}{{ x }}{% endfor %}{% endfor %}": ("(1x)ab(2None)ab", ""),
    "{% set m = n * 2 + 1 %}{{ m - n }}": ("6", "1"),
    "{{ d | default(0) }} {{ flag | default(false) }}": ("1.5 True", "0.0 False"),
    "a  {%- if n -%}  b  {%- endif -%}  c": ("abc", "ac"),
    "a {{- n -}} b": ("a5b", "a0b"),
    "x{# not shown {{ nothing }} #}y\n": ("xy",) * 2,
    "two\n\n": ("two\n",) * 2,
    "{{ 'a|b' + t }}{{ 7 % 3 }}{{ 7 / 2 }}": ("a|bhéllo13.5", "a|b13.5"),
    "{{ k + n }} {{ word | upper }}": ("12 W", "7 W"),
}


@pytest.mark.parametrize("source", SHOWN)
def test_templates(spark, source):
    rows = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    assert tuple(r[0] for r in rows.select(template(rows, source, k=7, word="w")).collect()) == SHOWN[source]


@pytest.mark.parametrize("source", ["{{ nothing }}", "{{ o.none }}", "{% if n %}", "{{ n ", "{% while n %}{% endwhile %}", "{{ n | none }}", "{{ n ** 2 }}", "{{ import }}", "{% for x in n %}{% endfor %}", "{% if n %}{% set q = 1 %}{% endif %}{{ q }}", "{{ t[n:] }}", "{% for x in xs %}{% endfor %}{{ x }}", "{{ t.__class__ }}", "{{ f(n) }}"])
def test_what_is_not_there_raises_when_the_query_is_built(spark, source):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises((TemplateError, AnalysisException)):
        template(rows, source)


def message(role, content, sup=False):
    return (role, content, sup)


def conversation(spark, history, steps):
    said = [message("system", "S"), message("user", "task"), message("assistant", "a1"), message("user", "o1"), message("user", "feedback", True), message("user", None), message("assistant", "a2"), message("assistant", "a3")]
    schema = "messages array<struct<role string, content string, is_supervisor boolean>>, history array<struct<after_step int, feedback string>>, steps int"
    return spark.createDataFrame([(said, history, steps)], schema)


def test_flattened_prompt(spark):
    six = [(5 * k, f"f{k}") for k in range(1, 7)]
    c = conversation(spark, six, 142)
    nudge = P.due(F.col("steps"), 100, template(c, NUDGE, current_step=F.col("steps"), step_limit=150))
    got = c.select(P.flattened_prompt(F.lit("judge"), F.col("messages"), F.col("history"), nudge)).first()[0]
    blocks = ["[USER/ENVIRONMENT]: task", "[AGENT RESPONSE]: a1", "[USER/ENVIRONMENT]: o1", "[USER/ENVIRONMENT]: ", "[AGENT RESPONSE]: a2", "[AGENT RESPONSE]: a3", *[f"[PREVIOUS_FEEDBACK #{k}]: f{k + 1}" for k in range(1, 6)], "[CRITICAL CONTEXT]: Last steps: 8.", "[USER/ENVIRONMENT]: " + P.ASK]
    assert [tuple(m) for m in got] == [("system", "judge"), ("user", "\n\n".join(blocks))]


def test_multiturn_prompt(spark):
    c = conversation(spark, [(5, "f1")], 99)
    nudge = P.due(F.col("steps"), 100, template(c, NUDGE, current_step=F.col("steps"), step_limit=150))
    got = c.select(P.multiturn_prompt(F.lit("judge"), F.col("messages"), F.col("history"), nudge)).first()[0]
    last = f"## Previous Supervisor Feedback History:\n\n\n### Feedback #1 (after step 5):\nf1\n\n\n{P.ASK}"
    assert [tuple(m) for m in got] == [("system", "judge"), ("user", "task"), ("assistant", "a1"), ("user", "o1\n\n"), ("assistant", "a2\n\na3"), ("user", last)]
    without = conversation(spark, [], 120)
    got = without.select(P.multiturn_prompt(F.lit("judge"), F.col("messages"), F.col("history"), P.due(F.col("steps"), 0, F.lit("never")))).first()[0]
    assert got[-1]["content"] == P.ASK


def test_supervisor_message_and_nudge(spark):
    c = conversation(spark, [(5, "x" * 1500), (10, "y" * 1501)], 12)
    got = c.select(P.supervisor_message(F.col("history"), F.lit("now"), F.col("steps"))).first()[0]
    assert got == "\n".join(["SUPERVISOR FEEDBACK:", "\n## Previous Feedback (truncated):", "\n### Feedback #1 (after step 5):\n" + "x" * 1500, "\n### Feedback #2 (after step 10):\n" + "y" * 1500 + "...", "\n## Current Feedback (after step 12):", "now"])
    c = conversation(spark, [], 12)
    assert c.select(P.supervisor_message(F.col("history"), F.lit("now"), F.col("steps"))).first()[0] == "SUPERVISOR FEEDBACK:\n\n## Current Feedback (after step 12):\nnow"
    shown = lambda n, t: c.select(P.with_nudge(F.lit("seen"), F.lit(n), t, F.lit("hurry"))).first()[0]
    assert [shown(9, 10), shown(10, 10), shown(10, 0)] == ["seen", "seen\n\nhurry", "seen"]


def test_corpus_means(spark):
    rows = spark.createDataFrame([("g", "text", 0.5), ("g", "text", None), ("g", " \n", 0.9), ("g", None, 0.9), ("h", "", 1.0)], "g string, r string, s double")
    got = {how: {r["g"]: (r["n"], r["s"]) for r in M.corpus_means(rows, ["g"], ["s"], "r", how).collect()} for how in ("counted", "skipped")}
    assert got == {"counted": {"g": (4, 0.125), "h": (1, 0.0)}, "skipped": {"g": (2, 0.25), "h": (0, 0.0)}}
    with pytest.raises(ValueError):
        M.corpus_means(rows, [], ["s"], "r", "other")


def test_corpus_means_of_both_ways_score_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def score(x):
        runs.add(1)
        return float(len(x or ""))

    rows = spark.createDataFrame([("g", "text"), ("g", " \n"), ("h", None), (None, "ab")], "g string, r string").coalesce(1)
    scored = rows.select("g", "r", F.udf(score, "double")("r").alias("s"))
    got = {(r["g"], r["blank"]): (r["n"], r["s"]) for r in M.corpus_means(scored, ["g"], ["s"], "r", "both").collect()}
    assert got == {("g", "counted"): (2, 2.0), ("g", "skipped"): (1, 4.0), ("h", "counted"): (1, 0.0), ("h", "skipped"): (0, 0.0), (None, "counted"): (1, 2.0), (None, "skipped"): (1, 2.0)}
    assert runs.value == 4


def test_interval_of_the_first_files(spark):
    files = spark.createDataFrame([(f"f{k:02}",) for k in range(15)], "f string")
    steps = lambda rows: spark.createDataFrame(rows, "f string, s long")
    found = lambda rows: R.interval(files, steps(rows), "f", "s").first()["step_interval"]
    assert found([("f03", 10), ("f03", 4), ("f03", 30), ("f05", 1), ("f05", 9)]) == 6
    assert found([("f03", 7), ("f05", 1), ("f05", 9)]) == 7
    assert found([("f03", 7), ("f03", 7), ("f03", 9)]) == 0
    assert found([("f12", 3)]) is None and found([]) is None


def test_paired_rows_and_matrix(spark):
    rows = spark.createDataFrame([("a", "plain", 3, 10), ("a", "both", 5, 25), ("b", "plain", 1, 1), ("c", "both", 9, 9)], "label string, kind string, resolved int, cost int")
    got = {r["label"]: tuple(r)[1:] for r in R.paired(rows, "label", "kind", "plain", "both", ["resolved", "cost"]).collect()}
    assert got == {"a": (3, 10, 5, 25, 2, 15), "b": (1, 1, None, None, None, None)}
    assert {tuple(r) for r in R.matrix(rows, "label", "kind", ["plain", "both"], "resolved").collect()} == {("a", 3, 5), ("b", 1, None), ("c", None, 9)}
    stacked = R.stacked([("x", "plain", rows.filter("label = 'b'")), ("x", "both", rows), ("a", "plain", rows.filter("false"))], lambda r: r.agg(F.sum("cost").alias("cost")))
    assert [tuple(r) for r in stacked.orderBy("at").collect()] == [(0, "x", "plain", 1), (1, "x", "both", 45), (2, "a", "plain", None)]


def test_gold_patches_that_are_not_there(spark, tmp_path):
    assert readers.gold_patches(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "empty").mkdir()
    assert readers.gold_patches(spark, str(tmp_path / "empty")).collect() == []
    spark.createDataFrame([("i", 1)], "instance_id string, other int").write.parquet(str(tmp_path / "other"))
    assert readers.gold_patches(spark, str(tmp_path / "other")).collect() == []
    diff = "diff --git a/x.py b/x.py\n"
    spark.createDataFrame([("i", diff), (None, "z")], "instance_id string, patch string").write.parquet(str(tmp_path / "gold"))
    gold = readers.gold_patches(spark, str(tmp_path / "gold"))
    made = spark.createDataFrame([("i", "m", diff), ("j", "m", diff), ("i", "k", "diff --git a/y.py b/y.py\n")], "instance_id string, model string, model_patch string")
    assert {tuple(r) for r in R.localization_rates(made, gold, ["model"]).collect()} == {("m", 1, 1, 100.0), ("k", 0, 1, 0.0)}
    assert {tuple(r) for r in R.localization_rates(made, readers.gold_patches(spark, "none"), ["model"]).collect()} == {("m", 0, 0, None), ("k", 0, 0, None)}
