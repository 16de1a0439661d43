"""Queries over scans and sinks: each writes files from the tables at hand, reads them back and returns rows that SQL has from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import runs as R
from tracelake.plans.registry import query, table
from tracelake.sources import readers, scratch, sinks
from tracelake.sources.keyed import KeyedTable
from tracelake.streaming import incremental

#: SQL of a conversation's messages as the run folder has them: supervisors are every fourth assistant turn; every third content is a list of parts.
_MESSAGES = r"""m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text, role = 'assistant' AND turn % 4 = 1 AS sup,
CASE WHEN turn % 3 = 1 THEN text || chr(10) || role || chr(10) || '{"k":1}' ELSE text END AS content FROM conversations)"""


def _run_texts(spark, sf_dir) -> DataFrame:
    """A trajectory document per conversation: cut short for ids of 7 modulo 10, a bare list for multiples of 3, else an object; pretty or in one line."""
    m = table(spark, sf_dir, "conversations")
    say = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)  # noqa: E731  a JSON string
    parts = F.concat(F.lit('[{"type":"text","text":'), say(F.col("text")), F.lit('},{"value":'), say(F.col("role")), F.lit('},{"k":1}]'))
    sup = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    one = F.concat(
        F.lit('{"role":'), say(F.col("role")), F.lit(', "content":'), F.when(F.col("turn") % 3 == 1, parts).otherwise(say(F.col("text"))),
        F.when(sup, F.concat(F.lit(', "_supervisor": true, "_prm_after_step": '), (F.col("turn") * 5).cast("string"))).otherwise(""),
        F.when(F.col("role") == "assistant", F.concat(F.lit(', "extra": {"response": {"usage": {"prompt_tokens": '), F.length("text").cast("string"), F.lit(', "completion_tokens": 7}}}'))).otherwise(""), F.lit("}"),
    )
    docs = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("j")))), lambda x: x["j"]), ",\n").alias("all"))
    k = F.col("conv_id")
    log = F.when(k % 5 == 0, F.lit('[{"invocation": 1, "after_step": 50}, {"invocation": 1, "after_step": 40}, {"invocation": 0, "after_step": 9}, {"invocation": 2}]')).otherwise("[]")
    info = F.concat(F.lit('{"exit_status": "S", "config": {"agent": {"prm_template": "'), F.when(k % 4 == 2, F.concat(F.lit("prompt "), k.cast("string"))).otherwise(""), F.lit('"}}, "prm_stats": {"prm_feedback_log": '), log, F.lit("}}"))
    whole = F.concat(F.lit('{"instance_id": "i'), k.cast("string"), F.lit('",\n "info": '), info, F.lit(',\n "messages": ['), F.col("all"), F.lit("]}"))
    text = F.when(k % 10 == 7, F.substring(whole, F.lit(1), F.length(whole) - 2)).when(k % 3 == 0, F.concat(F.lit(" \n["), F.col("all"), F.lit("]"))).otherwise(whole)
    return docs.select("conv_id", F.concat(F.lit("i"), k.cast("string")).alias("name"), text.alias("text"))


def _run_folder(spark, sf_dir) -> str:
    path = scratch.folder(spark, "run")
    sinks.trajectory_files(_run_texts(spark, sf_dir), path)
    return path


@query("SELECT 'i' || conv_id AS instance_id, conv_id % 10 = 7 AS is_corrupt, CASE WHEN conv_id % 10 <> 7 THEN CAST(count(*) AS INTEGER) END AS n_messages FROM conversations GROUP BY conv_id")
def s1_trajectories(spark, sf_dir):
    """Objects, bare lists and broken files of a run's folder."""
    return readers.trajectories(spark, _run_folder(spark, sf_dir)).select("instance_id", "is_corrupt", F.size("messages").alias("n_messages"))


@query(f"WITH {_MESSAGES} SELECT 'i' || conv_id AS instance_id, CAST(pos AS INTEGER) AS pos, role, md5(content) AS content_md5, sup AS is_supervisor, CASE WHEN sup THEN CAST(turn * 5 AS INTEGER) END AS after_step, CASE WHEN role = 'assistant' THEN length(text) END AS prompt_tokens FROM m WHERE conv_id % 10 <> 7")
def s1_messages(spark, sf_dir):
    """The message table of a run's folder; contents are strings or lists of parts."""
    m = readers.messages(readers.trajectories(spark, _run_folder(spark, sf_dir)))
    return m.select("instance_id", "pos", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"), "is_supervisor", "after_step", "prompt_tokens")


@query("SELECT 'i' || conv_id AS instance_id, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS part FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 <> 7")
def s2_point_lookup(spark, sf_dir):
    """Files at any depth, the first by path of each instance; even ones are there twice."""
    texts, path = _run_texts(spark, sf_dir).filter("conv_id % 10 <> 7"), scratch.folder(spark, "deep")
    twice = texts.filter("conv_id % 2 = 0").withColumn("name", F.concat(F.lit("a/"), "name")).unionByName(texts.withColumn("name", F.concat(F.lit("b/x/"), "name")))
    sinks.trajectory_files(twice, path)
    found = readers.first_of_instance(readers.trajectories(spark, path, recursive=True))
    return found.select("instance_id", F.regexp_extract("path", r"deep-[^/]+/([ab])/", 1).alias("part"))


@query(f"""WITH {_MESSAGES}, own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS invocation, turn * 5 AS after_step FROM m WHERE sup AND conv_id % 10 <> 7),
logged AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 0 AND conv_id % 3 <> 0 AND conv_id % 10 <> 7)
SELECT 'i' || conv_id AS instance_id, CAST(invocation AS INTEGER) AS invocation, CAST(after_step AS INTEGER) AS after_step FROM own WHERE conv_id NOT IN (SELECT conv_id FROM logged) UNION ALL SELECT 'i' || conv_id, 1, 50 FROM logged""")
def j15_after_steps(spark, sf_dir):
    """The log decides where it says anything, else the messages."""
    return readers.after_steps(readers.trajectories(spark, _run_folder(spark, sf_dir))).select("instance_id", F.col("invocation").cast("int").alias("invocation"), "after_step")


@query("SELECT 'prompt ' || substr(i, 2) AS prompt FROM (SELECT min('i' || conv_id || '/') AS x, arg_min('i' || conv_id, 'i' || conv_id || '/') AS i FROM conversations WHERE conv_id % 4 = 2 AND conv_id % 3 <> 0 AND conv_id % 10 <> 7)")
def s22_system_prompt(spark, sf_dir):
    return readers.system_prompt(readers.trajectories(spark, _run_folder(spark, sf_dir)))


#: SQL of three messages per labelled document.
_SET = """s AS (SELECT doc_id, doc_id % 7 <> 3 AS is_train, [{'role': 'system', 'content': 'judge'}, {'role': 'user', 'content': CASE WHEN quality = 1 THEN 'a "good"' || chr(10) || 'text é' ELSE 'text' END}, {'role': 'assistant', 'content': CAST(toxic AS VARCHAR)}] AS messages FROM labels),
o AS (SELECT *, row_number() OVER (PARTITION BY is_train ORDER BY doc_id) - 1 AS idx FROM s)"""


def _samples(spark, sf_dir) -> DataFrame:
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    asked = F.when(F.col("quality") == 1, 'a "good"\ntext é').otherwise("text")
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7 != 3).alias("is_train"), F.array(msg("system", F.lit("judge")), msg("user", asked), msg("assistant", F.col("toxic").cast("string"))).alias("messages"))


@query(f"WITH {_SET} SELECT idx, messages[2].content AS asked, messages[3].content AS said FROM o WHERE is_train")
def s6_samples(spark, sf_dir):
    """A sample set in order of its documents, read back by line; one file, as its lines' numbers are its keys."""
    path = scratch.folder(spark, "set")
    train = _samples(spark, sf_dir).filter("is_train").orderBy("doc_id").coalesce(1)
    sinks.sample_set(train, path, ["doc_id"])
    train.select("messages").write.json(f"{path}/one")
    s = readers.samples(spark, f"{path}/one")
    return s.select("idx", F.get("messages", 1)["content"].alias("asked"), F.get("messages", 2)["content"].alias("said"))


@query(f"WITH {_SET} SELECT 'train' AS part, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM s WHERE is_train UNION ALL SELECT 'val', count(*), min(doc_id), max(doc_id) FROM s WHERE NOT is_train HAVING count(*) > 0")
def k1_sample_set(spark, sf_dir):
    """K1, K2: the folders that the sidecar names, with what they hold."""
    path = scratch.folder(spark, "set")
    keyed = _samples(spark, sf_dir).withColumn("messages", F.transform("messages", lambda m, i: F.when(i == 0, m.withField("content", F.col("doc_id").cast("string"))).otherwise(m)))
    sinks.sample_set(keyed, path, ["doc_id"])
    info = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/dataset_info.json").collect()))
    out = None
    for name, entry in info.items():
        ids = spark.read.json(f"{path}/{entry['file_name']}").select(F.get("messages", 0)["content"].cast("long").alias("i"))
        one = ids.agg(F.lit(name.removeprefix("sft_")).alias("part"), F.count("*").alias("n"), F.min("i").alias("first_id"), F.max("i").alias("last_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_SET} SELECT count(*) FILTER (is_train) AS train, count(*) FILTER (NOT is_train) AS val, CAST(sum(length(messages[2].content) // 4) AS BIGINT) AS tokens, count(*) FILTER (messages[3].content = '1') AS toxic, max(length(messages[2].content)) AS longest FROM s""")
def a35_counters_of_the_write(spark, sf_dir):
    """A sample set and its sidecar of counters, all from the job that writes the samples."""
    path = scratch.folder(spark, "set")
    said = F.get("messages", 1)["content"]
    counters = {"tokens": F.sum(F.expr("length(messages[1].content) div 4")), "toxic": F.count_if(F.get("messages", 2)["content"] == "1"), "longest": F.max(F.length(said))}
    sinks.metadata(spark, f"{path}/metadata.json", **sinks.sample_set(_samples(spark, sf_dir), path, ["doc_id"], counters=counters))
    return spark.read.schema("train long, val long, tokens long, toxic long, longest long").option("multiLine", True).json(f"{path}/metadata.json")


@query("SELECT (SELECT count(*) FROM labels) AS n, (SELECT CAST(sum(toxic) AS BIGINT) FROM labels) AS toxic, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_ids FROM (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 5)")
def k3_metadata(spark, sf_dir):
    """K3, K5, K6: counters and the first sorted ids in a sidecar, which a second one replaces."""
    path = f"{scratch.folder(spark, 'meta')}/metadata.json"
    labels = table(spark, sf_dir, "labels")
    facts = labels.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first().asDict()
    sinks.metadata(spark, path, n=0)
    sinks.metadata(spark, path, **facts, first_ids=[r[0] for r in labels.select("doc_id").orderBy("doc_id").limit(5).collect()])
    read = spark.read.schema("n long, toxic long, first_ids array<long>").option("multiLine", True).json(path)
    return read.select("n", "toxic", F.array_join(F.col("first_ids").cast("array<string>"), ",").alias("first_ids"))


@query("SELECT doc_id AS idx, CASE WHEN doc_id % 4 = 0 THEN 'late ' || toxic ELSE 'early ' || quality END AS response FROM labels")
def s7_responses(spark, sf_dir):
    """Of the lines of an idx the last one holds; blank and broken lines count for nothing."""
    path, l = scratch.folder(spark, "responses"), table(spark, sf_dir, "labels")
    line = lambda word, c: F.to_json(F.struct(F.col("doc_id").alias("idx"), F.concat_ws(" ", F.lit(word), c).alias("response")))
    early = l.select(F.lit(0).alias("o"), "doc_id", line("early", F.col("quality")).alias("value"))
    late = l.filter("doc_id % 4 = 0").select(F.lit(1).alias("o"), "doc_id", line("late", F.col("toxic")).alias("value"))
    noise = l.filter("doc_id % 9 = 0").select(F.lit(2).alias("o"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise('{"idx": ').alias("value"))
    early.union(late).union(noise).orderBy("o", "doc_id").select("value").coalesce(1).write.text(path)
    return readers.responses(spark, path).select("idx", "response")


@query("SELECT doc_id AS idx, CASE WHEN quality = 1 THEN 'a' WHEN toxic = 1 THEN 'tie' END AS winner_model FROM labels")
def s9_judgements(spark, sf_dir):
    path = scratch.folder(spark, "judged")
    winner = F.when(F.col("quality") == 1, "a").when(F.col("toxic") == 1, "tie")
    table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), winner.alias("winner_model"), F.lit("why").alias("reason")).write.json(path)
    return readers.judgements(spark, path)


@query("SELECT 'i' || doc_id AS instance_id FROM labels WHERE toxic = 0 AND doc_id % 2 = 0 UNION SELECT 'i' || doc_id FROM labels WHERE quality = 1")
def s10_resolved_ids(spark, sf_dir):
    """Two reports whose ids overlap, and one that is not there."""
    path, l = scratch.folder(spark, "reports"), table(spark, sf_dir, "labels")
    name = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    for part, rows in (("x", l.filter("toxic = 0 and doc_id % 2 = 0")), ("y", l.filter("quality = 1"))):
        rows.agg(F.concat(F.collect_list(name), F.collect_list(name)).alias("resolved_ids")).coalesce(1).write.json(f"{path}/{part}")
    return readers.resolved_ids(spark, [f"{path}/x", f"{path}/y", f"{path}/none"]).select("instance_id").distinct()


@query("SELECT 'i' || doc_id AS instance_id, 'm' || quality AS model_name, CASE WHEN toxic = 1 THEN NULL ELSE 'diff --git a/f b/f' || chr(10) || '+\"é\"' END AS model_patch FROM labels")
def s11_predictions(spark, sf_dir):
    """A map by id, as upserts leave it."""
    path, k = scratch.folder(spark, "preds"), F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    entry = F.struct(F.concat(F.lit("m"), F.col("quality").cast("string")).alias("model_name_or_path"), k.alias("instance_id"), F.when(F.col("toxic") == 1, None).otherwise('diff --git a/f b/f\n+"é"').alias("model_patch"))
    whole = table(spark, sf_dir, "labels").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.alias("k"), entry.alias("v"))))).alias("value"))
    whole.coalesce(1).write.text(path)
    assert readers.predictions(spark, f"{path}-none").isEmpty()
    return readers.predictions(spark, path)


@query("SELECT 'i' || CAST(p_partkey AS VARCHAR) AS instance_id, p_brand || ':latest' AS image FROM part")
def s15_image_manifest(spark, sf_dir):
    path, k = scratch.folder(spark, "images"), F.concat(F.lit("i"), F.col("p_partkey").cast("string"))
    table(spark, sf_dir, "part").select(F.concat_ws("\t", k, F.concat("p_brand", F.lit(":latest"))).alias("value")).write.text(path)
    return readers.image_manifest(spark, path)


@query("SELECT p_brand AS label, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey END) AS DOUBLE) AS total, 0 AS absent FROM part GROUP BY p_brand")
def s16_stats_table(spark, sf_dir):
    """A CSV whose labels need quotes and whose numbers may be blank or N/A; a column that it lacks is null."""
    path, k = scratch.folder(spark, "stats"), F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(', "x"')).alias("label"), F.when(k % 3 == 0, " ").when(k % 5 == 0, "N/A").otherwise(k.cast("string")).alias("x"))
    sinks.csv_table(t, path)
    r = readers.stats_table(spark, path, ["x", "none"])
    return r.groupBy(F.regexp_replace("label", r', "x"$|, \\"x\\"$', "").alias("label")).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.count("none").cast("int").alias("absent"))


@query("SELECT 'm' || r_regionkey AS model, (r_regionkey + 1) * 1e-6 AS rate_in, (r_regionkey + 1) * 4e-6 AS rate_out FROM region")
def s17_prices(spark, sf_dir):
    path, k = f"{scratch.folder(spark, 'prices')}/prices.json", F.col("r_regionkey")
    rows = table(spark, sf_dir, "region").select(k).collect()
    sinks.write_text(spark, path, json.dumps({f"m{r[0]}": {"input": (r[0] + 1) * 1e-6, "output": (r[0] + 1) * 4e-6} for r in rows}, indent=1))
    assert readers.prices(spark, f"{path}.none").isEmpty()
    return readers.prices(spark, path)


@query("SELECT count(*) AS n_calls, CAST(sum(n_chars) AS BIGINT) AS tokens_in, round(sum(n_chars) * 2e-6 + count(*) * 500 * 8e-6, 6) AS cost FROM documents WHERE doc_id % 10 <> 0 OR n_chars IS NOT NULL")
def s18_critic_results(spark, sf_dir):
    """Tokens of a critic's calls and what choosing cost."""
    path = scratch.folder(spark, "critic")
    table(spark, sf_dir, "documents").agg(F.to_json(F.collect_list(F.struct(F.col("n_chars").alias("formatted_tokens")))).alias("value")).coalesce(1).write.text(path)
    return R.selection_cost(readers.critic_results(spark, path), 2e-6, 8e-6).withColumn("cost", F.round("cost", 6))


@query("SELECT 'dataset' AS kind, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'folders', count(DISTINCT conv_id) FROM conversations")
def s13_universe(spark, sf_dir):
    """The dataset's ids, and without it the folders of a run."""
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("instance_id"))
    path = _run_folder(spark, sf_dir)
    one = lambda kind, g: readers.universe(spark, path, g).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one("dataset", gold.union(gold)).unionByName(one("folders", None))


@query("SELECT n_name AS run, r_name AS family FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 1")
def s21_run_registry(spark, sf_dir):
    """Registered runs whose folder has a report."""
    root = scratch.folder(spark, "runs")
    for r in table(spark, sf_dir, "nation").collect():
        sinks.write_text(spark, f"{root}/{r['n_name']}/{'report.json' if r['n_nationkey'] % 3 == 1 else 'other.json'}", "{}")
    registry = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("run"), F.col("r_name").alias("family"))
    return readers.runs_at_hand(spark, registry, root)


@query("SELECT doc_id AS idx, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE 'first' END AS response FROM labels")
def k4_checkpoint(spark, sf_dir):
    """Results in two checkpoints: the second holds what the first had and replaces what was done again."""
    path, l = scratch.folder(spark, "done"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    schema = "idx long, response string"
    assert sinks.from_checkpoint(spark, path, schema) is None
    sinks.checkpoint(l.filter("idx % 2 = 0").withColumn("response", F.lit("first")), path, "idx")
    sinks.checkpoint(l.filter("idx % 2 = 1 or idx % 3 = 0").withColumn("response", F.when(F.col("idx") % 3 == 0, "again").otherwise("first")), path, "idx", sinks.from_checkpoint(spark, path, schema))
    return sinks.from_checkpoint(spark, path, schema)


@query("SELECT 'by nation' AS section, CAST(c_nationkey AS VARCHAR) AS nation, CAST(count(*) AS VARCHAR) AS n, NULL AS segment FROM customer GROUP BY c_nationkey UNION ALL SELECT 'by segment', NULL, CAST(count(*) AS VARCHAR), c_mktsegment FROM customer GROUP BY c_mktsegment")
def k9_sections(spark, sf_dir):
    """A report of several sections as one CSV, read back."""
    c, path = table(spark, sf_dir, "customer"), scratch.folder(spark, "report")
    parts = {"by nation": c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")), "by segment": c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))}
    sinks.csv_table(sinks.sections(parts), path)
    return spark.read.csv(path, header=True).select("section", "nation", "n", "segment")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def k11_removed(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return R.removed(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), s, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT CAST(conv_id % 3 AS INTEGER) AS run_id, conv_id AS instance_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def k12_documents(spark, sf_dir):
    """A document per instance in folders by run."""
    path = scratch.folder(spark, "docs")
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("run_id"), F.col("conv_id").alias("instance_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    sinks.trajectories(m, path)
    d = spark.read.schema("instance_id long, messages array<struct<role:string,content:string>>, run_id int").json(path)
    text = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return d.select("run_id", "instance_id", F.size("messages").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query("SELECT o_orderstatus AS exit_status, o_orderkey AS instance_id, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS line FROM orders")
def k13_by_exit_status(spark, sf_dir):
    """Lines of a status listing, in their order in the files."""
    path = scratch.folder(spark, "status")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("exit_status"), F.col("o_orderkey").alias("instance_id"))
    sinks.by_exit_status(o).select(F.concat_ws(" ", "exit_status", "instance_id").alias("value")).write.text(path)
    lines = readers.lines(spark, path)
    ahead = lines.groupBy("path").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    part = F.split("line", " ")
    return lines.join(ahead, "path").select(F.get(part, 0).alias("exit_status"), F.get(part, 1).cast("long").alias("instance_id"), (F.col("before") + F.col("line_no")).alias("line"))


@query("SELECT '| ' || r_name || ' | ' || count(n_nationkey) || ' |' AS line FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT '| region | nations |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '## Nations' UNION ALL SELECT ''")
def k14_markdown(spark, sf_dir):
    g = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("region")).agg(F.count("n_nationkey").alias("nations"))
    path = f"{scratch.folder(spark, 'report')}/report.md"
    sinks.write_text(spark, path, sinks.markdown(g, "Nations", ["region"]))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer""")
def k15_json_rows(spark, sf_dir):
    return sinks.json_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query("""SELECT 'at hand' AS copy, page_id % 2 AS model, count(*) FILTER (page_id % 3 = 0) AS localized, count(*) AS n, round(100 * count(*) FILTER (page_id % 3 = 0) / count(*), 6) AS pct FROM pages WHERE page_id % 5 <> 0 GROUP BY page_id % 2
UNION ALL SELECT DISTINCT 'missing', page_id % 2, 0, 0, NULL FROM pages""")
def s12_gold_patches(spark, sf_dir):
    """Patches that touch the gold file for every third page, of which four fifths have gold patches; and the same where the data set's copy is missing."""
    path, p = scratch.folder(spark, "gold"), table(spark, sf_dir, "pages")
    diff = lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n"))
    file = F.concat(F.lit("src/f"), F.col("page_id").cast("string"), F.lit(".py"))
    p.filter("page_id % 5 <> 0").select(F.col("page_id").cast("string").alias("instance_id"), diff(file).alias("patch"), "url").write.parquet(path)
    made = p.select(F.col("page_id").cast("string").alias("instance_id"), (F.col("page_id") % 2).alias("model"), F.when(F.col("page_id") % 3 == 0, diff(file)).otherwise(diff(F.concat(file, F.lit("x")))).alias("model_patch"))
    rates = lambda name, at: R.localization_rates(made, readers.gold_patches(spark, at), ["model"]).select(F.lit(name).alias("copy"), "model", "localized", "n", F.round("pct", 6).alias("pct"))
    return rates("at hand", path).unionByName(rates("missing", f"{path}-none"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0")
def x2_missing(spark, sf_dir):
    """What a first part has not done."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    assert incremental.missing(l, l, "doc_id", redo=True) is l
    return incremental.missing(l, l.filter("doc_id % 3 = 0").union(l.filter("doc_id % 6 = 0")), "doc_id")


@query("SELECT doc_id, CAST(max(v) AS BIGINT) AS v FROM (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic + 10 FROM labels WHERE doc_id % 2 = 0) GROUP BY doc_id")
def x3_growing_folder(spark, sf_dir):
    """A folder that grows between two runs of a stream: each takes the new files only and upserts them into a table, whose versions say what is current; a third finds nothing."""
    root = scratch.folder(spark, "grow")
    l = table(spark, sf_dir, "labels")
    held = KeyedTable(spark, f"{root}/table", "doc_id long, v long", "doc_id", buckets=8)
    for part in (l.select("doc_id", F.col("quality").cast("long").alias("v")), l.filter("doc_id % 2 = 0").select("doc_id", (F.col("toxic") + 10).cast("long").alias("v")), None):
        if part is not None:
            part.write.mode("append").json(f"{root}/in")
        incremental.upsert_each(incremental.growing(spark, f"{root}/in", "doc_id long, v long"), incremental.into(held, "grow"), f"{root}/progress").awaitTermination()
    assert len(held.versions()) == 2
    return held.rows()
