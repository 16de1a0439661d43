"""Further queries: predicates, prices, lookups, sample formats, token budgets and the supervising loop."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.tokens import counted_tokens
from tracelake.operators import conversations as C
from tracelake.operators import metrics as M
from tracelake.operators import ranking, sequential
from tracelake.operators import runs as R
from tracelake.operators import snippets as S
from tracelake.plans.conversation_queries import _SAMPLES, PROMPT, _messages
from tracelake.plans.registry import query, table
from tracelake.plans.run_queries import _RUNS, _runs

#: Aliases of datasets, as a workspace would configure them.
ALIASES = {"small": "org/Bench-Small", "full": "org/Bench", "gym": "org/Gym-V1"}


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'org/Bench-Small' WHEN 1 THEN 'org/Gym-V1' WHEN 2 THEN '/data/My_GYM_copy' ELSE p_brand END AS dataset, p_partkey % 5 IN (1, 2) AS is_gym FROM part")
def s14_dataset_alias(spark, sf_dir):
    k = F.col("p_partkey") % 5
    alias = F.when(k == 0, "small").when(k == 1, "gym").when(k == 2, "/data/My_GYM_copy").otherwise(F.col("p_brand"))
    p = table(spark, sf_dir, "part").withColumn("dataset", T.dataset_name(alias, ALIASES))
    return p.select("p_partkey", "dataset", T.is_of_kind(F.col("dataset"), ["org/Gym-V1"], ["my_gym"]).alias("is_gym"))


@query("SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS INTEGER), -1) AS k, coalesce(props ->> '$.a.b', 'none') AS ab FROM events")
def p1_nested_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, a struct<b:string>"))
    return e.select("event_id", T.defaulted(F.col("p.k"), -1).alias("k"), T.defaulted(F.col("p.a.b"), "none").alias("ab"))


@query("SELECT page_id, url, regexp_matches(url, '^(?:https?://[a-m]|http://.*[?]utm)') AS hit, true AS any_, regexp_matches(url, '^(?:http://)') OR regexp_matches(url, '^(?:https://.*/en/)') AS listed FROM pages")
def p7_regex_filter(spark, sf_dir):
    """Patterns from the start on; an alternative must not escape the anchor."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", T.starts_match(u, r"https?://[a-m]|http://.*[?]utm").alias("hit"), T.starts_match(u, "").alias("any_"), T.any_starts_match(u, ["http://", "https://.*/en/"]).alias("listed"))


@query("""WITH t AS (SELECT doc_id, n_chars, CASE n_chars % 6 WHEN 0 THEN 'ContextWindowExceededError: ' || lang WHEN 1 THEN 'The prompt is too LONG' WHEN 2 THEN 'max_tokens is too large: ' || n_chars WHEN 3 THEN 'max_tokens missing' WHEN 4 THEN 'maximum context length is 8' ELSE 'timeout' END AS msg FROM documents)
SELECT doc_id, contains(lower(msg), 'contextwindowexceeded') OR contains(lower(msg), 'context length') OR (contains(lower(msg), 'max_tokens') AND contains(lower(msg), 'too large')) OR contains(lower(msg), 'prompt is too long') AS final_ FROM t""")
def p21_final_errors(spark, sf_dir):
    k, n = F.col("n_chars") % 6, F.col("n_chars").cast("string")
    msg = F.when(k == 0, F.concat(F.lit("ContextWindowExceededError: "), "lang")).when(k == 1, "The prompt is too LONG").when(k == 2, F.concat(F.lit("max_tokens is too large: "), n)).when(k == 3, "max_tokens missing").when(k == 4, "maximum context length is 8").otherwise("timeout")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_final_error(msg).alias("final_"))


def _answers(spark, sf_dir) -> DataFrame:
    """Critics' answers over labels: those of ids that 4 or 9 divide lack categories."""
    k = F.col("doc_id")
    n = F.when(k % 4 == 0, k % 12).otherwise(12)
    lines = [F.when(n > i, F.concat(F.lit(f"{i + 1}. {c}: DETECTED: "), F.when((k + i) % 3 == 0, "Yes").otherwise("No"), F.lit("\n"))).otherwise("") for i, c in enumerate(T.CATEGORIES)]
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(*lines).alias("truth"), F.when(k % 9 != 0, F.lit("x")).alias("a"), F.when(k % 5 != 0, F.lit("y")).alias("b"))


@query("SELECT doc_id, CAST(len(list_filter(range(12), lambda i: (doc_id + i) % 3 = 0)) AS INTEGER) AS n_yes FROM labels WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND doc_id % 5 <> 0")
def p9_complete_answers(spark, sf_dir):
    """Documents whose reference names all categories and that both sides answered."""
    a = _answers(spark, sf_dir)
    read = a.select("doc_id", F.explode(F.array(T.numbered_detections(F.col("truth")))).alias("d"))  # a filter on d does not move below, where it would read the text again
    whole = read.filter(F.size("d") == len(T.CATEGORIES))
    for side in ("a", "b"):
        whole = whole.join(a.filter(F.col(side).isNotNull()).select("doc_id"), "doc_id")
    return whole.select("doc_id", F.size(F.filter(F.map_values("d"), lambda v: v)).alias("n_yes"))


@query("SELECT conv_id, turn, content FROM (SELECT conv_id, turn, CASE WHEN sup THEN 'SUPERVISOR: ' || text ELSE text END AS content, sup, turn = max(turn) FILTER (sup) OVER (PARTITION BY conv_id) AS active FROM (SELECT *, role = 'assistant' AND turn % 4 = 1 AS sup FROM conversations)) WHERE NOT sup OR active")
def p17_visible(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    m = _messages(spark, sf_dir).withColumn("sup", (F.col("role") == "assistant") & (F.col("turn") % 4 == 1))
    m = m.withColumn("active", F.col("turn") == F.max(F.when(F.col("sup"), F.col("turn"))).over(w))
    return C.visible(m, "sup", "active", F.concat(F.lit("SUPERVISOR: "), "content")).select("conv_id", "turn", "content")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 17) OR c_custkey = 42")
def p22_selected(spark, sf_dir):
    """A place in the order of ids, an id, and a place beyond the end."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = c.withColumn("name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return R.selected(c, "c_custkey", "17").unionByName(R.selected(named, "name", "c42").drop("name")).unionByName(R.selected(c, "c_custkey", "999999999")).distinct()


@query("""SELECT 'ends 7' AS label, arg_min(c_nationkey, c_custkey) AS nation, arg_min(c_mktsegment, c_custkey) AS segment FROM customer WHERE c_custkey % 10 = 7
UNION ALL SELECT 'building, not of nation 1', arg_min(c_nationkey, c_custkey), arg_min(c_mktsegment, c_custkey) FROM customer WHERE contains(c_mktsegment, 'BUILD') AND c_nationkey <> 1 UNION ALL SELECT 'none', NULL, NULL""")
def p23_looked_up(spark, sf_dir):
    labels = {"ends 7": F.col("c_custkey") % 10 == 7, "building, not of nation 1": F.contains("c_mktsegment", F.lit("BUILD")) & (F.col("c_nationkey") != 1), "none": F.col("c_custkey") < 0}
    c = table(spark, sf_dir, "customer").withColumns({"nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")})
    return R.looked_up(c, labels, "c_custkey", ["nation", "segment"])


@query("SELECT doc_id AS idx, n_chars, quality, 2 AS n_models FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0")
def j4_zip(spark, sf_dir):
    """What a positional zip means, joined on the kept number; models that answered fewer rows cut all."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "n_chars")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality")
    return d.join(l, "idx").join(l.filter("idx % 3 <> 0").select("idx"), "idx").withColumn("n_models", F.lit(2))


@query("""
WITH e AS (SELECT l_orderkey AS run, CASE WHEN l_orderkey % 4 = 0 OR l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber * 100 END AS i, CASE WHEN l_orderkey % 4 = 0 OR l_linenumber % 2 = 0 THEN NULL ELSE l_linenumber END AS o FROM lineitem),
u AS (SELECT run, bool_or(i IS NOT NULL OR o IS NOT NULL) AS used, coalesce(sum(i), 0) AS i, coalesce(sum(o), 0) AS o FROM e GROUP BY run),
j AS (SELECT o_orderkey AS run, o_orderpriority IN ('1-URGENT', '5-LOW') AND coalesce(used, false) AS is_priced, i, o, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 / 8.0 END AS stored FROM orders LEFT JOIN u ON run = o_orderkey)
SELECT run, is_priced, CASE WHEN is_priced THEN i * 0.25 + o * 0.5 ELSE coalesce(stored, 0) END AS cost FROM j""")
def j12_critic_prices(spark, sf_dir):
    """Critics with a rate but no recorded usage, with usage that has one side only, and without a rate keep or lose their stored cost."""
    prices = spark.createDataFrame([("1-URGENT", 0.25, 0.5), ("5-LOW", 0.25, 0.5)], "model string, rate_in double, rate_out double")
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    hidden = lambda by, v: F.when((k % 4 == 0) | (n % by == 0), None).otherwise(v)
    usage = F.struct(hidden(3, n * 100).alias("prompt_tokens"), hidden(2, n).alias("completion_tokens"))
    entries = table(spark, sf_dir, "lineitem").select(k.alias("run"), usage.alias("usage"))
    o = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(o.alias("run"), F.col("o_orderpriority").alias("model"), F.when(o % 7 != 0, (o % 100) / 8.0).alias("stored"))
    return R.critic_priced(runs, entries, prices, "run")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path, page_id % 3 <> 1 AS submitted, page_id % 7 = 0 AS blank, page_id % 11 = 0 AS none FROM pages),
c AS (SELECT *, CASE WHEN submitted THEN page_id % 2 = 0 ELSE page_id % 5 = 0 END AS hit FROM p WHERE path <> '' AND NOT none AND NOT blank)
SELECT submitted AS of_critic, count(*) FILTER (hit) AS localized, count(*) AS n FROM c GROUP BY submitted""")
def j13_gold_patches(spark, sf_dir):
    """Predictions, the critic's where it submitted, else the base's, against gold patches; blank predictions and unknown gold patches do not count."""
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)).filter("path <> ''")
    k = F.col("page_id")
    p = p.withColumn("instance_id", k.cast("string"))
    patch = lambda f: F.concat(F.lit("\ndiff --git a/setup.py b/setup.py\n+1\ndiff --git a/"), f, F.lit(" b/"), f, F.lit("\n"))
    made = lambda hit: F.when(k % 7 == 0, "\u00a0 \n").otherwise(patch(F.when(hit, F.col("path")).otherwise(F.concat("path", F.lit("x")))))
    gold = p.select("instance_id", F.when(k % 11 != 0, F.concat(F.lit("diff --git a/"), "path", F.lit(" b/x\n"))).alias("gold_patch"))
    status = p.select("instance_id", F.when(k % 3 != 1, R.SUBMITTED).alias("exit_status"))
    side = lambda of, hit: p.select("instance_id", F.lit(of).alias("of_critic"), made(hit).alias("model_patch"))
    return R.localization(R.combined_predictions(side(True, k % 2 == 0), side(False, k % 5 == 0), status), gold, ["of_critic"])


@query("""WITH d AS (SELECT *, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'mid' ELSE 'long' END AS label FROM documents WHERE n_chars >= 20)
SELECT label, count(*) AS n, round(avg(doc_id), 6) AS avg_doc_id, round(avg(n_chars), 6) AS avg_n_chars FROM d GROUP BY label""")
def a19_bucket_means(spark, sf_dir):
    edges = spark.createDataFrame([("short", 20, 500), ("mid", 500, 2000), ("long", 2000, None), ("empty", -5, -1)], "label string, lo long, hi long")
    m = M.bucket_means(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", edges, ["doc_id", "n_chars"])
    return m.withColumns({c: F.round(c, 6) for c in ("avg_doc_id", "avg_n_chars")})


@query("""WITH t AS (SELECT conv_id, conv_id % 13 = 5 AS bad, conv_id % 4 <> 1 AS ok, count(*) FILTER (role = 'assistant') AS logged, count(*) FILTER (role = 'assistant' AND length(text) > 120) AS valid FROM conversations GROUP BY conv_id)
SELECT count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad AND NOT ok) AS filtered, count(*) FILTER (NOT bad AND ok AND valid = 0) AS skipped, CAST(coalesce(sum(logged - valid) FILTER (NOT bad AND ok AND valid > 0), 0) AS BIGINT) AS denoised, CAST(coalesce(sum(valid) FILTER (NOT bad AND ok), 0) AS BIGINT) AS samples FROM t""")
def a35_stage_counters(spark, sf_dir):
    said = F.col("role") == "assistant"
    t = _messages(spark, sf_dir).groupBy("conv_id").agg(F.count_if(said).alias("logged"), F.count_if(said & (F.length("content") > 120)).alias("valid"), F.first(F.col("conv_id") % 13 == 5).alias("bad"))
    return C.stage_counters(t, t.filter("conv_id % 4 <> 1"), "conv_id", "bad", "logged", "valid")


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS place FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Ä' ELSE 'z' END || c_mktsegment || c_custkey AS c_name FROM customer)")
def o1_sorted_places(spark, sf_dir):
    """Places in code point order, from range partitions."""
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Ä").otherwise("z"), "c_mktsegment", F.col("c_custkey").cast("string"))
    return ranking.numbered(table(spark, sf_dir, "customer").select(name.alias("name")), [F.asc("name")], "place")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1 ORDER BY o_orderkey LIMIT 50")
def o4_first_rows(spark, sf_dir):
    return R.first_rows(table(spark, sf_dir, "orders").filter("o_custkey % 2 = 1").select("o_orderkey", "o_custkey"), "o_orderkey", 50)


@query("SELECT event_id, CAST(CAST('0x' || left(md5('9:' || event_id), 8) AS BIGINT) % 3 AS INTEGER) AS model FROM events")
def o8_model_choice(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.choice(F.col("event_id"), 3, 9).alias("model"))


@query(f"WITH {_RUNS}, p AS (SELECT instance % 9 AS agent, instance % 4 AS setting, count(*) AS n, count(*) FILTER (resolved) AS resolved, CAST(sum(cost) AS BIGINT) AS cost FROM runs WHERE instance % 9 <> 2 OR instance % 4 <> 0 GROUP BY ALL) SELECT * FROM p WHERE agent IN (SELECT agent FROM p WHERE setting = 0)")
def u7_points(spark, sf_dir):
    """Points of all agents and settings; agent 2 has no base run and is left out."""
    r = _runs(spark, sf_dir).filter("instance % 9 <> 2 or instance % 4 <> 0").withColumns({"agent": F.col("instance") % 9, "setting": F.col("instance") % 4})
    return R.points(r, "agent", "setting", 0)


_LINES = ["On track", "**Needs correction**.", "_critical intervention required_ # now", "unsure", ""]


@query("""
WITH f AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN 'On track' WHEN 1 THEN 'Needs correction' WHEN 2 THEN 'Critical intervention required' ELSE 'Other' END AS status, turn % 5 = 4 AS empty_ FROM conversations),
h AS (SELECT conv_id, turn, status, conv_id % 3 AS src FROM f WHERE NOT empty_ AND ((conv_id % 3 = 0 AND role = 'user') OR (conv_id % 3 = 1 AND role = 'assistant'))),
m AS (SELECT conv_id, turn, status FROM f WHERE role = 'assistant' AND conv_id NOT IN (SELECT conv_id FROM h))
SELECT conv_id, status, count(*) AS n FROM (SELECT conv_id, turn, status FROM h UNION ALL SELECT * FROM m) GROUP BY ALL""")
def t11_statuses(spark, sf_dir):
    """History of every third trajectory, log of every third; the others, and those whose texts are all empty, by their messages."""
    body = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("turn") % 5 + 1).cast("int"))
    text = F.when(F.col("turn") % 5 != 4, F.concat(F.lit("DETECTED: No\nTask_Status**: "), body, F.lit("\nmore")))
    lists = _messages(spark, sf_dir).withColumn("f", F.coalesce(text, F.lit(""))).groupBy("conv_id").agg(*[F.collect_list(F.when(F.col("role") == r, F.col("f"))).alias(r) for r in ("user", "assistant")])
    none = F.array().cast("array<string>")
    k = F.col("conv_id") % 3
    found = T.statuses(F.when(k == 0, F.col("user")).otherwise(none), F.when(k == 1, F.col("assistant")).when(k == 0, F.array(F.lit("TASK_STATUS: ignored"))), F.col("assistant"))
    return lists.select("conv_id", F.explode(found).alias("status")).groupBy("conv_id", "status").agg(F.count("*").alias("n"))


@query(r"""
WITH d AS (SELECT doc_id, doc_id % 4 AS k, 'warning' || chr(10) || 'diff --git a/src/x.py b/src/x.py' || chr(10) || '+"a"' || chr(10) AS good, 'diff --git a/.venv/y b/.venv/y' || chr(10) || '+b' || chr(10) AS bad FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN good WHEN 1 THEN good || '|' || 'x' || '|' || good WHEN 2 THEN '5' ELSE good || '|' || good END AS cleaned FROM d""")
def t17_clean_contents(spark, sf_dir):
    """Contents that are a string, parts of several fields and bare strings, and a number."""
    good, bad, k = 'warning\ndiff --git a/src/x.py b/src/x.py\n+"a"\n', "diff --git a/.venv/y b/.venv/y\n+b\n", F.col("doc_id") % 4
    whole = json.dumps(good + bad)
    raw = F.when(k == 0, whole).when(k == 1, f'[{{"type": "text", "text": {whole}}}, "x", {{"value": {whole}, "n": 3}}]').when(k == 2, "5").otherwise(f'[{{"content": {whole}}}, {{"text": {whole}, "o": {{"text": "diff"}}}}]')
    c = T.clean_content(F.parse_json(raw))
    read = F.parse_json(c)
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.value", "string"), F.try_variant_get(p, "$.content", "string"), F.try_variant_get(p, "$", "string"))
    parts = F.array_join(F.transform(F.try_variant_get(read, "$", "array<variant>"), part), "|")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(parts, F.try_variant_get(read, "$", "string")).alias("cleaned"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: len(x) > 3)[1:4] AS w FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN w[1] || ',' || w[2] || ',err' WHEN 1 THEN w[1] || '.py,' || w[2] || '.py' WHEN 2 THEN '10,20p,' || w[1] ELSE '' END AS paths FROM w WHERE len(w) = 4 AND len(list_distinct(w)) = 4""")
def t23_touched_paths(spark, sf_dir):
    """Redirections, quoted, absolute and of descriptors; sed with options, scripts and several files; commands that edit nothing."""
    w = F.slice(F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x) > 3), 1, 4)
    d = table(spark, sf_dir, "documents").withColumn("w", w).filter((F.size("w") == 4) & (F.size(F.array_distinct("w")) == 4))
    x, k = lambda i: F.get("w", i), F.col("doc_id") % 4
    echo = F.concat(F.lit("cat "), x(2), F.lit(' > "/testbed/'), x(0), F.lit('" 2>&1 && echo '), x(3), F.lit(" >> ./"), x(1), F.lit("; ls 2> err > /dev/null"))
    edit = F.concat(F.lit("cd /x && sed -i -e 's/"), x(2), F.lit("/a b c/g' ./"), x(0), F.lit(".py '/testbed/"), x(1), F.lit(".py' | sort"))
    shown = F.concat(F.lit("sed -n 10,20p "), x(0), F.lit(" | grep "), x(2))
    cmd = F.when(k == 0, echo).when(k == 1, edit).when(k == 2, shown).otherwise(F.concat(F.lit("grep -rn a "), x(0)))
    return d.select("doc_id", F.array_join(T.touched_paths(cmd), ",").alias("paths"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, n AS line_no, lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), ' ') || ' | ' || line AS shown FROM l""")
def t25_numbered_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return d.select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), T.numbered_line(F.col("n") + 1, F.col("line")).alias("shown"))


_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH f AS (SELECT doc_id, n_chars, string_split_regex(regexp_replace(text, '(?:{_LINE_ENDS})\z', ''), '{_LINE_ENDS}') AS ls FROM documents WHERE text <> ''),
r AS (SELECT doc_id, len(ls) AS n, n_chars % len(ls) + 1 AS a, n_chars % len(ls) + doc_id % 4 AS b FROM f UNION ALL SELECT doc_id, len(ls), doc_id % len(ls) + 1, doc_id % len(ls) + 1 FROM f),
w AS (SELECT DISTINCT doc_id, a, b, greatest(1, a - 2) AS s, least(n, b + 2) AS e FROM r),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, i), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM g),
t AS (SELECT doc_id, s, CASE WHEN k > 1 THEN chr(10) || '--- Lines ' || s || '-' || e || ' ---' || chr(10) ELSE '' END || array_to_string(list_transform(range(s, e + 1), lambda j: lpad(CAST(j AS VARCHAR), CAST(greatest(4, length(CAST(j AS VARCHAR))) AS INTEGER), ' ') || ' | ' || ls[j]), chr(10)) AS t FROM k JOIN f USING (doc_id))
SELECT doc_id, '=== File: src/main.txt ===' || chr(10) || string_agg(t, chr(10) ORDER BY s) AS shown FROM t GROUP BY doc_id""")
def w19_edited_snippets(spark, sf_dir):
    """Patches with two hunks each, at places that follow from the document, and the documents as the files after them; a second file of the patch is gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    n = S.file_lines(d.withColumn("path", F.lit("src/main.txt")), "doc_id", "path", "text").groupBy("doc_id").agg(F.max("line_no").alias("n"))
    hunk = F.format_string("@@ -1 +%d,%d @@\n-x\n@@ -7,2 +%d @@ def f():\n+y\n", (F.col("n_chars") % F.col("n")).cast("int") + 1, (F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % F.col("n")).cast("int") + 1)
    header = lambda p: F.lit(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n")
    patch = F.concat(header("src/gone.txt"), F.lit("@@ -1,3 +1,3 @@\n"), header("src/main.txt"), hunk)
    patches = d.join(n, "doc_id").select("doc_id", patch.alias("patch"))
    return S.snippets(patches, d.withColumn("path", F.lit("src/main.txt")), "doc_id", "patch", "path", "text", 2)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'flattened' WHEN doc_id % 4 = 1 THEN 'multiturn' WHEN doc_id % 3 = 0 THEN 'flattened' ELSE 'multiturn' END AS format FROM documents")
def t27_prompt_format(spark, sf_dir):
    k = F.col("doc_id")
    setting = F.when(k % 4 == 0, "flattened").when(k % 4 == 1, "multiturn").when(k % 4 == 2, "auto")
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt_format(setting, F.when(k % 3 == 0, "org/M-Flattened-8b").when(k % 3 == 1, "org/m")).alias("format"))


@query("SELECT doc_id, printf('%.1f', n_chars / 8.0) AS one, printf('%.2f', n_chars / 8.0) AS two, printf('%.0f', n_chars / 2.0) AS none_ FROM documents WHERE n_chars IS NOT NULL")
def t28_fixed_points(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").filter(n.isNotNull()).select("doc_id", T.fixed_point(n / 8, 1).alias("one"), T.fixed_point(n / 8, 2).alias("two"), T.fixed_point(n / 2, 0).alias("none_"))


@query("SELECT vec_id, CASE WHEN s > 0 THEN round(s, 4) END AS similarity FROM (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def m5_rounded_similarity(spark, sf_dir):
    from tracelake.functions.similarity import cosine

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", T.rounded_similarity(cosine(F.col("embedding"), F.col("next"))).alias("similarity"))


@query("""WITH b AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '```bash' || chr(10) || text || chr(10) || '```' WHEN turn % 3 = 1 THEN '```bash' || chr(10) || 'ls' || chr(10) || '```' || text || '```bash' || chr(10) || '```' || chr(10) || '```bash' || chr(10) || chr(10) || '```' ELSE '```bash' || text || '```' END AS c FROM conversations)
SELECT conv_id, turn, role = 'assistant' AND turn % 3 <> 2 AS is_step, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_blocks FROM b""")
def p2_steps(spark, sf_dir):
    """Fenced blocks, one, several or badly fenced."""
    k, t = F.col("turn") % 3, F.col("content")
    c = F.when(k == 0, F.concat(F.lit("```bash\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```bash\nls\n```"), t, F.lit("```bash\n```\n```bash\n\n```"))).otherwise(F.concat(F.lit("```bash"), t, F.lit("```")))
    return _messages(spark, sf_dir).select("conv_id", "turn", T.is_step(F.col("role"), c).alias("is_step"), F.size(T.bash_blocks(c)).alias("n_blocks"))


@query("""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), p AS (SELECT *, CAST(least(3, greatest((n - 2) // 2, 0)) AS INTEGER) AS prefix_steps FROM c)
SELECT conv_id, turn, role, prefix_steps, prefix_steps < 3 AS submit_base FROM p WHERE prefix_steps > 0 AND pos < 2 + 2 * prefix_steps""")
def j19_prefix(spark, sf_dir):
    """The first steps of another run of the same instance, fewer where it has fewer."""
    return C.prefix(_messages(spark, sf_dir), "conv_id", "turn", 3).select("conv_id", "turn", "role", "prefix_steps", "submit_base")


@query(_SAMPLES + """, e AS (SELECT conv_id, invocation, max(pos) AS hi FROM m GROUP BY ALL),
sy AS (SELECT conv_id, invocation, coalesce(any_value(content) FILTER (pos = 0 AND role = 'system'), '') AS content FROM m GROUP BY ALL),
x AS (SELECT conv_id, invocation, 0 AS o, 'system' AS role, content FROM sy UNION ALL SELECT m.conv_id, m.invocation, pos, role, content FROM m JOIN e USING (conv_id, invocation) WHERE pos > 0 AND pos < hi UNION ALL SELECT m.conv_id, m.invocation, hi + 1, role, content FROM m JOIN e USING (conv_id, invocation) WHERE pos = hi)
SELECT conv_id, CAST(invocation AS INTEGER) AS invocation, CAST(row_number() OVER (PARTITION BY conv_id, invocation ORDER BY o) - 1 AS INTEGER) AS "at", role, content FROM x""")
def c4_multiturn_samples(spark, sf_dir):
    s = C.samples(_messages(spark, sf_dir), "conv_id", "turn", "role", "content", F.col("role") == "assistant", F.length("content") > 40, PROMPT)
    f = s.select("conv_id", "invocation", F.posexplode(C.multiturn(F.col("messages"))).alias("at", "m"))
    return f.select("conv_id", "invocation", "at", "m.role", "m.content")


def _kept_blocks(spark, sf_dir) -> DataFrame:
    """Blocks of a conversation: the first message is the task, the last the prompt, assistants' are feedback; of the others what a budget leaves."""
    w = Window.partitionBy("conv_id")
    at, n = F.row_number().over(w.orderBy("turn")), F.count("*").over(w)
    cat = F.when(F.col("a") == 1, "task").when(F.col("a") == F.col("n"), "prompt").when(F.col("role") == "assistant", "feedback").otherwise("trajectory")
    b = _messages(spark, sf_dir).withColumns({"a": at, "n": n}).withColumn("cat", cat).withColumn("size", T.approximate_tokens(F.col("content")))
    kept = C.split_budget(b.filter("cat in ('feedback', 'trajectory')"), "conv_id", "turn", "cat", "size", 80, 0.4)
    return b.join(kept.select("conv_id", "turn", "kept"), ["conv_id", "turn"], "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


@query("""
WITH b AS (SELECT conv_id, turn, text, length(text) // 4 AS size, CASE WHEN a = 1 THEN 'task' WHEN a = n THEN 'prompt' WHEN role = 'assistant' THEN 'feedback' ELSE 'trajectory' END AS cat FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)),
t AS (SELECT *, coalesce(sum(size) FILTER (cat = 'feedback') OVER w, 0) AS f, coalesce(sum(size) FILTER (cat = 'trajectory') OVER w, 0) AS t FROM b WINDOW w AS (PARTITION BY conv_id)),
r AS (SELECT *, CASE WHEN cat = 'feedback' THEN CASE WHEN f <= 32 THEN f WHEN t <= 48 THEN 80 - t ELSE 32 END ELSE CASE WHEN f <= 32 THEN 80 - f WHEN t <= 48 THEN t ELSE 48 END END AS room, sum(size) OVER (PARTITION BY conv_id, cat ORDER BY turn DESC) AS used FROM t),
k AS (SELECT *, cat IN ('task', 'prompt') OR f + t <= 80 OR used <= room AS kept FROM r),
p AS (SELECT conv_id, 1 AS o, turn, text FROM k WHERE cat = 'task' UNION ALL SELECT conv_id, 2, 0, '[...' || count(*) || ' earlier trajectory step(s) omitted...]' FROM k WHERE cat = 'trajectory' AND NOT kept GROUP BY conv_id UNION ALL SELECT conv_id, 3, turn, text FROM k WHERE cat = 'trajectory' AND kept
UNION ALL SELECT conv_id, 4, 0, '[...' || count(*) || ' earlier supervisor feedback(s) omitted...]' FROM k WHERE cat = 'feedback' AND NOT kept GROUP BY conv_id UNION ALL SELECT conv_id, 5, turn, text FROM k WHERE cat = 'feedback' AND kept UNION ALL SELECT conv_id, 6, turn, text FROM k WHERE cat = 'prompt')
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY o, turn) AS content FROM p GROUP BY conv_id""")
def c8_rebuilt(spark, sf_dir):
    """What the budget leaves of each conversation, put together again behind notes of what went."""
    return C.rebuilt(_kept_blocks(spark, sf_dir), "conv_id", "turn", "cat", "content", "kept")


@query(r"SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS approximate, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS exact_ FROM conversations GROUP BY conv_id")
def c10_token_counts(spark, sf_dir):
    """By a quarter of the length, and by a tokenizer that the caller brings (here words)."""
    words = counted_tokens(lambda: str.split)
    m = _messages(spark, sf_dir).select("conv_id", T.approximate_tokens(F.col("content")).alias("a"), words(F.col("content")).alias("w"))
    return m.groupBy("conv_id").agg(F.sum("a").alias("approximate"), F.sum("w").alias("exact_"))


#: SQL of a fold over each label's vectors: what a row needs is whether the last delivered one is near.
_FOLD = """WITH RECURSIVE r AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, vec_id, n, v AS last, CAST(NULL AS DOUBLE) AS similarity, false AS suppressed FROM r WHERE n = 1
UNION ALL SELECT r.label, r.vec_id, r.n, CASE WHEN list_cosine_similarity(f.last, r.v) >= {limit} THEN f.last ELSE r.v END, list_cosine_similarity(f.last, r.v), list_cosine_similarity(f.last, r.v) >= {limit} FROM f JOIN r ON r.label = f.label AND r.n = f.n + 1)"""


@query(_FOLD.format(limit=0.3) + " SELECT label, vec_id, round(similarity, 6) AS similarity, suppressed FROM f")
def w12_dedup(spark, sf_dir):
    """Rows of a label against the last that was not suppressed: one state a label, however many rows it has."""
    return sequential.deduplicated(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH RECURSIVE e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 4 <> 0 AS is_step, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
s AS (SELECT *, count(*) FILTER (is_step) OVER (PARTITION BY label ORDER BY n) AS steps FROM e), a AS (SELECT *, is_step AND steps % 3 = 0 AS asked FROM s),
f AS (SELECT label, vec_id, n, steps, asked, false AS suppressed, CAST(NULL AS BIGINT) AS active, CAST(0 AS BIGINT) AS history, CAST(NULL AS DOUBLE[]) AS last FROM a WHERE n = 1
UNION ALL SELECT a.label, a.vec_id, a.n, a.steps, a.asked, x, CASE WHEN a.asked AND NOT x THEN a.vec_id ELSE f.active END, f.history + CASE WHEN a.asked AND NOT x AND f.active IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN a.asked AND NOT x THEN a.v ELSE f.last END
FROM (SELECT *, a0.asked AND coalesce(list_cosine_similarity(f0.last, a0.v) >= 0.1, false) AS x FROM f f0 JOIN a a0 ON a0.label = f0.label AND a0.n = f0.n + 1) j JOIN a ON a.label = j.label AND a.vec_id = j.vec_id_1 JOIN f ON f.label = j.label AND f.n + 1 = a.n)
SELECT label, vec_id, steps, asked, CASE WHEN asked THEN suppressed END AS suppressed, active, history FROM f""")
def x4_supervised(spark, sf_dir):
    """Every third step asks the critic; answers too near the last delivered are suppressed."""
    m = table(spark, sf_dir, "embeddings").withColumn("is_step", F.col("vec_id") % 4 != 0)
    return sequential.supervised(m, "label", "vec_id", "is_step", "embedding", 3, 0.1).select("label", "vec_id", "steps", "asked", "suppressed", "active", "history")


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS place FROM part")
def o3_seeded_shuffle(spark, sf_dir):
    return R.shuffled(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(10) || '  ' || '<<DONE>>' || ' ' || chr(13) || chr(10) || text WHEN 1 THEN 'FINISHED' || CASE WHEN conv_id % 2 = 0 THEN '' ELSE chr(10) || text || chr(10) END WHEN 2 THEN 'x ' || '<<DONE>>' || chr(10) || text ELSE text || chr(10) || 'FINISHED' || chr(10) || 'tail' END AS o FROM conversations),
h AS (SELECT *, regexp_replace(o, '^\s+', '') AS s FROM t)
SELECT conv_id, turn, CASE WHEN trim(regexp_extract(s, '^[^\n]*'), ' ' || chr(13) || chr(9)) IN ('<<DONE>>', 'FINISHED') THEN CASE WHEN contains(s, chr(10)) THEN substr(s, instr(s, chr(10)) + 1) ELSE '' END END AS submission FROM h""")
def t21_submission(spark, sf_dir):
    """Outputs that announce a submission in the first line, by either of two markers, with or without a body; elsewhere in a text a marker says nothing."""
    k, t = F.col("turn") % 4, F.col("text")
    odd = F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.concat(F.lit("\n"), t, F.lit("\n")))
    out = F.when(k == 0, F.concat(F.lit("\n  <<DONE>> \r\n"), t)).when(k == 1, F.concat(F.lit("FINISHED"), odd)).when(k == 2, F.concat(F.lit("x <<DONE>>\n"), t)).otherwise(F.concat(t, F.lit("\nFINISHED\ntail")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.submission(out, ("<<DONE>>", "FINISHED")).alias("submission"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '_cwm_prm_' || p_brand || '_cwm_prm_x' WHEN 1 THEN 'cwm_prm_' || p_brand WHEN 2 THEN p_brand || '_cwm_prm_' ELSE '_cwm_prm_' || p_partkey END AS run FROM part)
SELECT p_partkey, CASE WHEN contains(run, '_cwm_prm_') THEN substr(run, instr(run, '_cwm_prm_') + 9) ELSE '-' END AS config FROM r""")
def j14_suffix_lookup(spark, sf_dir):
    """Names with the marker twice, without it, at the end and at the start."""
    k, b = F.col("p_partkey") % 4, F.col("p_brand")
    run = F.when(k == 0, F.concat(b, F.lit("_cwm_prm_"), b, F.lit("_cwm_prm_x"))).when(k == 1, F.concat(F.lit("cwm_prm_"), b)).when(k == 2, F.concat(b, F.lit("_cwm_prm_"))).otherwise(F.concat(F.lit("_cwm_prm_"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", T.config_suffix(run).alias("config"))
