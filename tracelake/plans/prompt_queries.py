"""Queries over prompts as a run builds them: templates, the critic's prompt in both formats, the supervisor's message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.templates import template
from tracelake.operators import prompts as P
from tracelake.plans.registry import query, table

#: A nudge by what is left, and an observation that shows head and tail of long output.
NUDGE = """{% if step_limit - current_step <= 10 -%}
Last steps: {{step_limit - current_step}}.
{%- elif step_limit - current_step <= 30 -%}
Finish soon, {{ step_limit - current_step }} of {{step_limit}} steps are left.
{%- else -%}
Step {{current_step}}.
{%- endif %}
"""
OBSERVATION = """{# what a command gave #}<returncode>{{output.returncode}}</returncode>
{% if output.output | length < 600 -%}
<output>
{{ output.output -}}
</output>
{%- else -%}
{%- set elided = output.output | length - 400 -%}
<head>
{{ output.output[:200] }}
</head>
<elided>{{ elided }} characters</elided>
<tail>
{{ output.output[-200:] }}
</tail>
{%- endif -%}
{% for t in tags %}[{{ loop.index }}:{{ t | upper }}]{% endfor %}
"""


@query(r"""WITH d AS (SELECT doc_id, doc_id % 3 AS rc, coalesce(text, 'None') AS t, CASE WHEN text IS NULL THEN NULL ELSE length(text) END AS n, lang FROM documents)
SELECT doc_id, '<returncode>' || rc || '</returncode>' || chr(10) || CASE WHEN n < 600 THEN '<output>' || chr(10) || t || '</output>'
ELSE '<head>' || chr(10) || left(t, 200) || chr(10) || '</head>' || chr(10) || '<elided>' || coalesce(CAST(n - 400 AS VARCHAR), 'None') || ' characters</elided>' || chr(10) || '<tail>' || chr(10) || right(t, 200) || chr(10) || '</tail>' END
|| '[1:A][2:' || coalesce(upper(lang), 'None') || ']' AS shown FROM d WHERE n IS NOT NULL""")
def t29_observation(spark, sf_dir):
    """Observations from a template with conditions, slices, a loop and filters."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select("doc_id", F.struct((F.col("doc_id") % 3).alias("returncode"), F.col("text").alias("output")).alias("output"), F.array(F.lit("a"), "lang").alias("tags"))
    return rows.select("doc_id", template(rows, OBSERVATION).alias("shown"))


def _asked(spark, sf_dir) -> DataFrame:
    """A conversation's messages behind each other, every fourth turn of an assistant a supervisor's; its steps follow from its id."""
    sup = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    m = table(spark, sf_dir, "conversations").withColumn("sup", sup)
    in_order = lambda c: F.array_sort(F.collect_list(c))
    g = m.groupBy("conv_id").agg(in_order(F.struct("turn", "role", F.col("text").alias("content"), F.col("sup").alias("is_supervisor"))).alias("messages"), in_order(F.when(F.col("sup"), F.struct((F.col("turn") * 5).alias("after_step"), F.col("text").alias("feedback")))).alias("history"))
    g = g.filter(F.size("messages") > 1).withColumn("steps", (F.col("conv_id") % 90 + 60).cast("int"))
    nudge = template(g, NUDGE, current_step=F.col("steps"), step_limit=150)
    return g.withColumn("nudge", P.due(F.col("steps"), 100, nudge))


_ASKED = r"""m AS (SELECT conv_id, turn, role, text, role = 'assistant' AND turn % 4 = 1 AS sup, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
g AS (SELECT conv_id, max(text) FILTER (p = 2) AS task, coalesce(list({'s': turn * 5, 't': text} ORDER BY turn) FILTER (sup), []) AS h, 60 + conv_id % 90 AS steps,
coalesce(list(CASE WHEN role = 'assistant' THEN '[AGENT RESPONSE]: ' ELSE '[USER/ENVIRONMENT]: ' END || text ORDER BY turn) FILTER (p > 2 AND NOT sup), []) AS said FROM m GROUP BY conv_id HAVING count(*) > 1),
a AS (SELECT *, list_slice(h, greatest(len(h) - 4, 1), len(h)) AS r, CASE WHEN steps < 100 THEN NULL WHEN 150 - steps <= 10 THEN 'Last steps: ' || (150 - steps) || '.' WHEN 150 - steps <= 30 THEN 'Finish soon, ' || (150 - steps) || ' of 150 steps are left.' ELSE 'Step ' || steps || '.' END AS nudge FROM g)"""
_LAST = f"'{P.ASK}'"


@query(f"""WITH {_ASKED} SELECT conv_id, array_to_string(list_concat(['[USER/ENVIRONMENT]: ' || task], said, list_transform(r, lambda x, i: '[PREVIOUS_FEEDBACK #' || i || ']: ' || x.t), CASE WHEN nudge IS NULL THEN [] ELSE ['[CRITICAL CONTEXT]: ' || nudge] END, ['[USER/ENVIRONMENT]: ' || {_LAST}]), chr(10) || chr(10)) AS asked FROM a""")
def c9_flattened_prompt(spark, sf_dir):
    made = P.flattened_prompt(F.lit("Judge."), F.col("messages"), F.col("history"), F.col("nudge"))
    return _asked(spark, sf_dir).select("conv_id", F.get(made, 1)["content"].alias("asked"))


@query(f"""WITH {_ASKED}, l AS (SELECT conv_id, array_to_string(list_concat(CASE WHEN len(h) > 0 THEN ['## Previous Supervisor Feedback History:' || chr(10)] ELSE [] END, list_transform(r, lambda x, i: '### Feedback #' || i || ' (after step ' || x.s || '):' || chr(10) || x.t || chr(10)), CASE WHEN nudge IS NULL THEN [] ELSE ['CRITICAL CONTEXT: ' || nudge || chr(10)] END, [{_LAST}]), chr(10) || chr(10)) AS last FROM a),
t AS (SELECT conv_id, 1 AS p, 'user' AS role, task AS content FROM a UNION ALL SELECT conv_id, p, role, text FROM m WHERE p > 2 AND NOT sup AND conv_id IN (SELECT conv_id FROM a) UNION ALL SELECT conv_id, 1000000, 'user', last FROM l),
i AS (SELECT *, CASE WHEN role = lag(role) OVER w AND role <> 'system' THEN 0 ELSE 1 END AS new_ FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY p)), r AS (SELECT *, sum(new_) OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM i),
s AS (SELECT conv_id, run, any_value(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY p) AS content FROM r GROUP BY conv_id, run)
SELECT conv_id, 1 + count(*) AS n, 'system: Judge.' || chr(10) || string_agg(role || ': ' || content, chr(10) ORDER BY run) AS asked FROM s GROUP BY conv_id""")
def c9_multiturn_prompt(spark, sf_dir):
    made = P.multiturn_prompt(F.lit("Judge."), F.col("messages"), F.col("history"), F.col("nudge"))
    rows = _asked(spark, sf_dir).select("conv_id", made.alias("made"))
    return rows.select("conv_id", F.size("made").cast("long").alias("n"), F.array_join(F.transform("made", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("asked"))


@query(f"""WITH {_ASKED}, b AS (SELECT conv_id, steps, h[len(h)].t AS now, list_slice(h, 1, len(h) - 1) AS h FROM a WHERE len(h) > 0)
SELECT conv_id, array_to_string(list_concat(['SUPERVISOR FEEDBACK:'], CASE WHEN len(h) > 0 THEN list_concat([chr(10) || '## Previous Feedback (truncated):'], list_transform(h, lambda x, i: chr(10) || '### Feedback #' || i || ' (after step ' || x.s || '):' || chr(10) || CASE WHEN length(x.t) > 1500 THEN left(x.t, 1500) || '...' ELSE x.t END)) ELSE [] END,
[chr(10) || '## Current Feedback (after step ' || steps || '):', now]), chr(10)) AS shown FROM b""")
def t13_supervisor_message(spark, sf_dir):
    """All earlier feedback cut short, then the last one whole."""
    a = _asked(spark, sf_dir).filter(F.size("history") > 0)
    earlier = F.slice("history", F.lit(1), F.size("history") - 1)
    return a.select("conv_id", P.supervisor_message(earlier, F.element_at("history", -1)["feedback"], F.col("steps")).alias("shown"))
