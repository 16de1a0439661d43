"""Queries over texts: feedback parsing, patches, paths, lengths and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.similarity import SCORES, bleu_rouge, cosine
from tracelake.operators import metrics as M
from tracelake.plans.registry import query, table

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _feedback(spark, sf_dir):
    """A critic's answer per labelled document, with the shapes that answers take."""
    l = table(spark, sf_dir, "labels")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    status = F.element_at(F.array(*map(F.lit, ("On track", "**Needs correction**", "Critical intervention required", "Already solved", "unsure"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    text = F.concat(
        F.lit("1. Task Specification Violations: DETECTED: "), yes(F.col("toxic") == 1), F.lit("\n3. **Step Repetition:** DETECTED: "), yes(F.col("quality") == 0),
        F.lit("\nTASK_STATUS: "), status, F.lit("\nOVERALL_GUIDANCE: keep to\nthe task "), F.col("doc_id").cast("string"), F.lit(" "),
    )
    return l.select("doc_id", text.alias("feedback"))


_FEEDBACK = r"""f AS (SELECT doc_id, '1. Task Specification Violations: DETECTED: ' || CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END || chr(10) || '3. **Step Repetition:** DETECTED: ' || CASE WHEN quality = 0 THEN 'Yes' ELSE 'No' END || chr(10)
|| 'TASK_STATUS: ' || (['On track', '**Needs correction**', 'Critical intervention required', 'Already solved', 'unsure'])[doc_id % 5 + 1] || chr(10) || 'OVERALL_GUIDANCE: keep to' || chr(10) || 'the task ' || CAST(doc_id AS VARCHAR) || ' ' AS feedback FROM labels)"""


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || role || chr(10) || '</think> ' || text || ' ', '<think>.*?</think>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS answer FROM conversations".replace("\\\\", "\\"))
def t3_strip_think(spark, sf_dir):
    m = table(spark, sf_dir, "conversations")
    return m.select("conv_id", "turn", T.strip_think(F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), "text", F.lit(" "))).alias("answer"))


@query("SELECT conv_id, turn, role AS reasoning, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM conversations".replace("\\\\", "\\"))
def t4_reasoning_split(spark, sf_dir):
    raw = F.concat(F.lit("<think> "), "role", F.lit("\n</think> "), "text", F.lit(" "))
    m = table(spark, sf_dir, "conversations").withColumn("raw", raw)
    return m.select("conv_id", "turn", T.reasoning(F.col("raw")).alias("reasoning"), T.answer(F.col("raw")).alias("answer"))


@query(f"WITH {_FEEDBACK} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'On track' WHEN 3 THEN 'On track' WHEN 1 THEN 'Needs correction' WHEN 2 THEN 'Critical intervention required' END AS status, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS severity FROM f")
def t9_task_status(spark, sf_dir):
    s = T.task_status(F.col("feedback"))
    return _feedback(spark, sf_dir).select("doc_id", s.alias("status"), T.severity(s).alias("severity"))


@query(f"WITH {_FEEDBACK} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'On track' WHEN 1 THEN 'Needs correction' WHEN 2 THEN 'Critical intervention required' ELSE 'Other' END AS status FROM f")
def t10_normalized_status(spark, sf_dir):
    raw = F.regexp_extract("feedback", r"TASK_STATUS: ([^\n]*)", 1)
    return _feedback(spark, sf_dir).select("doc_id", T.normalized_status(F.concat(F.lit(' *"'), raw, F.lit('". # note'))).alias("status"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS task_spec, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS repetition, 2 AS n_found FROM labels")
def t7_detections(spark, sf_dir):
    d = T.detections(F.col("feedback"))
    return _feedback(spark, sf_dir).select("doc_id", d[T.CATEGORIES[0]].alias("task_spec"), d[T.CATEGORIES[2]].alias("repetition"), F.size(d).alias("n_found"))


@query("SELECT doc_id, toxic = 1 AS task_spec, quality = 0 AS repetition, 2 AS n_found FROM labels")
def t8_numbered_detections(spark, sf_dir):
    d = T.numbered_detections(F.col("feedback"))
    return _feedback(spark, sf_dir).select("doc_id", d[T.CATEGORIES[0]].alias("task_spec"), d[T.CATEGORIES[2]].alias("repetition"), F.size(d).alias("n_found"))


@query(f"WITH {_FEEDBACK} SELECT doc_id, CAST(length('keep to' || chr(10) || 'the task ' || CAST(doc_id AS VARCHAR)) AS INTEGER) AS n FROM f")
def t12_guidance_length(spark, sf_dir):
    return _feedback(spark, sf_dir).select("doc_id", T.guidance_length(F.col("feedback")).alias("n"))


@query("SELECT doc_id, doc_id % 3 <> 1 AS valid FROM labels")
def p5_valid_feedback(spark, sf_dir):
    """Feedback, agents' replies that quote one marker, and prose with one."""
    k = F.pmod("doc_id", F.lit(3))
    x = F.when(k == 0, F.col("feedback")).when(k == 1, F.concat(F.lit("Let me check DETECTED: "), F.col("doc_id").cast("string"))).otherwise("see TASK_STATUS: fine")
    return _feedback(spark, sf_dir).select("doc_id", T.is_valid_feedback(x).alias("valid"))


@query(f"WITH {_FEEDBACK} SELECT doc_id, regexp_replace(feedback, '\\s+$', '') AS current FROM f")
def t5_current_feedback(spark, sf_dir):
    wrapped = F.concat(F.lit("SUPERVISOR FEEDBACK:\nold\n## Current Feedback (after step 5):\n"), "feedback")
    return _feedback(spark, sf_dir).select("doc_id", T.current_feedback(wrapped).alias("current"))


def _patch(path, noise):
    section = lambda p: F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n@@ -1,2 +3,4 @@ x\n+y\n@@ -9 +12 @@\n"))
    return F.concat(F.lit("warning\n"), section(path), section(F.concat(noise, path)))


_PATH = r"regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)"


@query(rf"SELECT page_id, list_sort(list_distinct(['{{0}}' || {_PATH}, 'lib/venv/' || {_PATH}])) AS files FROM pages WHERE {_PATH} <> ''".replace("{0}", "").replace("''  || ", "").replace("'' || ", ""))
def t14_files_in_patch(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)).filter("path <> ''")
    return p.select("page_id", T.files_in_patch(_patch(F.col("path"), F.lit("lib/venv/"))).alias("files"))


@query(rf"SELECT page_id, 'warning' || chr(10) || 'diff --git a/' || {_PATH} || ' b/' || {_PATH} || chr(10) || '@@ -1,2 +3,4 @@ x' || chr(10) || '+y' || chr(10) || '@@ -9 +12 @@' || chr(10) AS patch FROM pages WHERE {_PATH} <> ''")
def t16_clean_diff(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)).filter("path <> ''")
    return p.select("page_id", T.clean_diff(_patch(F.col("path"), F.lit("lib/venv/"))).alias("patch"))


@query(rf"SELECT page_id, 2 * n AS n_hunks, 3 AS first_start, 6 AS first_end, 12 AS last_end FROM (SELECT page_id, 2 AS n, {_PATH} AS p FROM pages) WHERE p <> ''")
def t24_hunks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)).filter("path <> ''")
    h = p.select("page_id", T.hunks(_patch(F.col("path"), F.lit("x/"))).alias("h"))
    return h.select("page_id", F.size("h").alias("n_hunks"), F.get("h", 0)["start"].alias("first_start"), F.get("h", 0)["end"].alias("first_end"), F.element_at("h", -1)["end"].alias("last_end"))


@query("SELECT doc_id, rpad(CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END, 40, ' ') AS short FROM documents")
def t18_shorten(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.shorten(F.col("text"), 40).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) < 10000 THEN text ELSE left(text, 5000) || chr(10) || '[' || CAST(length(text) - 10000 AS VARCHAR) || ' characters elided]' || chr(10) || right(text, 5000) END AS shown FROM documents")
def t22_elide(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.elide(F.col("text")).alias("shown"))


@query("""
SELECT doc_id, text LIKE '%|%' AS has_bar, regexp_matches(text, '[0-9]') AS has_digit, length(text) > 8000 AS is_long FROM documents""")
def p19_quality_flags(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.contains(t, F.lit("|")).alias("has_bar"), t.rlike("[0-9]").alias("has_digit"), (F.length(t) > 8000).alias("is_long"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m1_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query()
def m2_m3_bleu_rouge(spark, sf_dir):
    """Texts against that of the next id: published definitions, tested on hand-computed pairs."""
    return _pairs(spark, sf_dir, F.col("text")).select("doc_id", "s.*")


@query(r"""
SELECT doc_id, CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS INTEGER) AS n_stripped, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents""")
def t1_t2_strip_and_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.strip(F.col("text"))).alias("n_stripped"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


#: SQL of the n-grams that a text shares with the next one's, counted as often as both have them; {words} gives a text's tokens.
_GRAMS = r"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), k AS (SELECT unnest([1, 2, 3, 4]) AS n),
g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n) GROUP BY ALL),
h AS (SELECT a.doc_id, a.n, sum(least(a.c, b.c)) AS hit FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND b.n = a.n AND b.g = a.g GROUP BY ALL),
f AS (SELECT p.doc_id, len(p.w) AS la, len(q.w) AS lb, k.n, coalesce(hit, 0) AS hit FROM d p JOIN d q ON q.doc_id = p.doc_id + 1 CROSS JOIN k LEFT JOIN h ON h.doc_id = p.doc_id AND h.n = k.n)"""


def _pairs(spark, sf_dir, text, scores=SCORES):
    """Each text beside that of the next id, dealt by number, as scoring takes far longer than its bytes suggest. The next text stays in its column for means."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")).repartition(parts, "doc_id")
    return d.repartition(parts, "doc_id").join(n, "doc_id").select("doc_id", "next", bleu_rouge(F.col("text"), F.col("next"), scores).alias("s"))


@query(_GRAMS.format(words=r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')") + """,
s AS (SELECT doc_id, la, lb, sum(hit) FILTER (n = 1) AS one, ln(greatest(sum(hit) FILTER (n = 1), 0.1) / any_value(lb)) AS l1, sum(ln(greatest(hit, 0.1) / greatest(1, lb - n + 1))) FILTER (n <= 2) AS l2, sum(ln(greatest(hit, 0.1) / greatest(1, lb - n + 1))) AS l4 FROM f WHERE la > 0 AND lb > 0 GROUP BY ALL)
SELECT doc_id, round(CASE WHEN one > 0 THEN least(1, exp(1 - la / lb)) * exp(l1) ELSE 0 END, 6) AS bleu1, round(CASE WHEN one > 0 THEN least(1, exp(1 - la / lb)) * exp(l2 / 2) ELSE 0 END, 6) AS bleu2, round(CASE WHEN one > 0 THEN least(1, exp(1 - la / lb)) * exp(l4 / 4) ELSE 0 END, 6) AS bleu4 FROM s
UNION ALL SELECT DISTINCT doc_id, 0, 0, 0 FROM f WHERE la = 0 OR lb = 0""")
def m2_bleu(spark, sf_dir):
    """Sentence BLEU of neighbours."""
    return _pairs(spark, sf_dir, F.col("text"), ("bleu1", "bleu2", "bleu4")).select("doc_id", *[F.round(f"s.{b}", 6).alias(b) for b in ("bleu1", "bleu2", "bleu4")])


@query(_GRAMS.format(words="list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: left(x, 3))") + """
SELECT doc_id, round(coalesce(max(2 * hit / nullif(la + lb, 0)) FILTER (n = 1), 0), 6) AS rouge1, round(coalesce(max(2 * hit / nullif(greatest(la - 1, 0) + greatest(lb - 1, 0), 0)) FILTER (n = 2), 0), 6) AS rouge2 FROM f GROUP BY doc_id""")
def m3_rouge(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 of neighbours, words cut to three letters, which no stemmer changes."""
    short = F.array_join(F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.left(x, F.lit(3))), " ")
    return _pairs(spark, sf_dir, short, ("rouge1", "rouge2")).select("doc_id", *[F.round(f"s.{r}", 6).alias(r) for r in ("rouge1", "rouge2")])


_MEANS = _GRAMS.format(words=r"list_filter(regexp_split_to_array(CASE WHEN doc_id % 6 = 1 THEN '  ' ELSE coalesce(text, '') END, '\s+'), lambda x: x <> '')") + """,
s AS (SELECT doc_id, la, lb, sum(hit) FILTER (n = 1) AS one, ln(greatest(sum(hit) FILTER (n = 1), 0.1) / any_value(lb)) AS l1, sum(ln(greatest(hit, 0.1) / greatest(1, lb - n + 1))) AS l4 FROM f WHERE la > 0 AND lb > 0 GROUP BY ALL),
b AS (SELECT doc_id, CASE WHEN one > 0 THEN least(1, exp(1 - la / lb)) * exp(l1) ELSE 0 END AS bleu1, CASE WHEN one > 0 THEN least(1, exp(1 - la / lb)) * exp(l4 / 4) ELSE 0 END AS bleu4 FROM s),
p AS (SELECT doc_id, any_value(lb) = 0 AS blank FROM f GROUP BY doc_id),
j AS (SELECT blank, coalesce(bleu1, 0) AS bleu1, coalesce(bleu4, 0) AS bleu4 FROM p LEFT JOIN b USING (doc_id))"""


@query(_MEANS + """ SELECT 'counted' AS blank, count(*) AS n, round(avg(bleu1), 6) AS bleu1, round(avg(bleu4), 6) AS bleu4 FROM j UNION ALL SELECT 'skipped', count(*), round(avg(bleu1), 6), round(avg(bleu4), 6) FROM j WHERE NOT blank""")
def a22_corpus_means(spark, sf_dir):
    """Mean BLEU of neighbours, every sixth of which is blank: counted as 0, and left out."""
    text = F.when(F.col("doc_id") % 6 == 1, "  ").otherwise(F.col("text"))
    scored = _pairs(spark, sf_dir, text, ("bleu1", "bleu4")).select("next", "s.bleu1", "s.bleu4")
    return M.corpus_means(scored, [], ["bleu1", "bleu4"], "next", "both").select("blank", "n", *[F.round(c, 6).alias(c) for c in ("bleu1", "bleu4")])


@query("""WITH l AS (SELECT doc_id, n_chars, i, (n_chars + i) % 2 = 0 AS yes FROM documents, range(12) r(i) WHERE (doc_id + i) % 3 <> 0 AND n_chars IS NOT NULL)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_found, CAST(count(*) FILTER (yes) AS INTEGER) AS n_yes, string_agg(CASE WHEN yes THEN CAST(i AS VARCHAR) END, ',' ORDER BY i) AS which FROM l GROUP BY doc_id""")
def t7_t8_varied_detections(spark, sf_dir):
    """Answers that leave out a third of the categories, each another, with verdicts that follow from the text; both readings agree on them."""
    d = table(spark, sf_dir, "documents").filter("n_chars is not null").select("doc_id", "n_chars")
    line = lambda i: F.when((F.col("doc_id") + i) % 3 != 0, F.concat(F.lit(f"{i + 1}. **{T.CATEGORIES[i]}:** DETECTED: "), F.when((F.col("n_chars") + i) % 2 == 0, "Yes").otherwise("No")))
    said = d.select("doc_id", F.concat_ws("\n", F.lit("SPECIFICATION ERRORS:"), *map(line, range(len(T.CATEGORIES)))).alias("t"))

    def agreed(both):
        loose, numbered = both["loose"], both["numbered"]
        agree = F.size(F.map_filter(loose, lambda k, v: (v == 1).eqNullSafe(numbered[k])))
        yes = F.array_compact(F.array(*[F.when((loose[c] == 1) & numbered[c], F.lit(str(i))) for i, c in enumerate(T.CATEGORIES)]))
        return F.struct(F.when(agree == F.size(numbered), agree).alias("n_found"), yes.alias("yes"))

    both = F.struct(T.detections(F.col("t")).alias("loose"), T.numbered_detections(F.col("t")).alias("numbered"))
    read = said.select("doc_id", F.inline(F.array(T.once(both, agreed))))
    return read.select("doc_id", "n_found", F.size("yes").alias("n_yes"), F.nullif(F.concat_ws(",", "yes"), F.lit("")).alias("which"))
