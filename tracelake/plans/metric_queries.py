"""Queries over judged and labelled rows: rates, confusion, alignment, quantiles and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import CATEGORIES
from tracelake.operators import metrics as M
from tracelake.operators import runs as R
from tracelake.plans.registry import query, table


def _detections(spark, sf_dir) -> DataFrame:
    """Truth from labels and a prediction from the text, by language as category; either side may be unknown."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    truth = F.when(F.col("quality") == 1, F.col("toxic") == 1)
    predicted = F.when(F.col("n_chars") > 200, F.pmod("n_chars", F.lit(4)) == 0)
    return d.join(l, "doc_id", "left").select("doc_id", "lang", truth.alias("truth"), predicted.alias("predicted"))


_DETECTIONS = "d AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN toxic = 1 END AS truth, CASE WHEN n_chars > 200 THEN n_chars % 4 = 0 END AS predicted FROM documents LEFT JOIN labels USING (doc_id))"
_COUNTS = _DETECTIONS + """, c AS (SELECT lang, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND NOT predicted) AS tn
FROM d WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY lang),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn / nullif(fn + tp, 0), 0) AS fnr FROM c)"""


@query(f"WITH {_COUNTS} SELECT lang, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr FROM r")
def a4_category_confusion(spark, sf_dir):
    r = M.with_rates(M.confusion(_detections(spark, sf_dir), ["lang"], "truth", "predicted"))
    return r.select("lang", "tp", "fp", "fn", "tn", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1", "fpr", "fnr")])


@query(f"WITH {_COUNTS} SELECT 'all' AS model, round(sum(p) / 12, 9) AS macro_precision, round(sum(r) / 12, 9) AS macro_recall, round(sum(f) / 12, 9) AS macro_f1, round(sum(fpr) / 12, 9) AS macro_fpr FROM r")
def a6_macro_f1(spark, sf_dir):
    """Over twelve categories, of which most have no support here."""
    r = M.with_rates(M.confusion(_detections(spark, sf_dir), ["lang"], "truth", "predicted")).withColumn("model", F.lit("all")).withColumnRenamed("lang", "category")
    names = ["en", "de", "es", "fr", *CATEGORIES[:8]]
    m = M.macro(r, spark.createDataFrame([(c,) for c in names], "category string"), ["model"], "category")
    return m.select("model", *[F.round(c, 9).alias(c) for c in m.columns if c != "model"])


def _severities(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") % 5 < 3, (F.col("n_chars") % 5).cast("int"))
    return d.select("doc_id", "lang", F.when(F.col("doc_id") % 7 < 3, (F.col("doc_id") % 7).cast("int")).alias("gt"), code.alias("pred"))


_SEVERITIES = "s AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 < 3 THEN CAST(doc_id % 7 AS INTEGER) END AS gt, CASE WHEN n_chars % 5 < 3 THEN CAST(n_chars % 5 AS INTEGER) END AS pred FROM documents)"


@query(f"""WITH {_SEVERITIES}, c AS (SELECT gt, count(*) AS n, count(*) FILTER (pred = 0) AS a, count(*) FILTER (pred = 1) AS b, count(*) FILTER (pred = 2) AS c FROM s WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY gt)
SELECT g.gt, round(coalesce(a, 0) / greatest(coalesce(n, 0), 1), 9) AS share_0, round(coalesce(b, 0) / greatest(coalesce(n, 0), 1), 9) AS share_1, round(coalesce(c, 0) / greatest(coalesce(n, 0), 1), 9) AS share_2 FROM (VALUES (0), (1), (2)) g(gt) LEFT JOIN c ON c.gt = g.gt""")
def a7_confusion_norm(spark, sf_dir):
    m = M.normalized_matrix(_severities(spark, sf_dir), "gt", "pred")
    return m.select("gt", *[F.round(f"share_{k}", 9).alias(f"share_{k}") for k in (0, 1, 2)])


@query(f"WITH {_SEVERITIES} SELECT lang, count(*) AS n, count(*) FILTER (pred = gt) AS exact, count(*) FILTER (pred > gt) AS over, count(*) FILTER (pred < gt) AS under, count(*) FILTER (pred IS NULL) AS unparseable FROM s WHERE gt IS NOT NULL GROUP BY lang")
def a8_alignment(spark, sf_dir):
    return M.alignment(_severities(spark, sf_dir), ["lang"], "gt", "pred")


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.75) AS p75 FROM documents GROUP BY lang")
def a9_length_stats(spark, sf_dir):
    s = M.length_stats(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH s AS (SELECT lang, list_sort(list(n_chars)) AS x FROM documents GROUP BY lang)
SELECT lang, x[len(x) // 2 + 1] AS median, x[len(x) // 4 + 1] AS p25, x[3 * len(x) // 4 + 1] AS p75, x[len(x) * 9 // 10 + 1] AS p90, x[len(x) * 19 // 20 + 1] AS p95 FROM s""")
def a10_nearest_rank(spark, sf_dir):
    return M.nearest_ranks(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"median": (1, 2), "p25": (1, 4), "p75": (3, 4), "p90": (9, 10), "p95": (19, 20)})


@query("""SELECT count(x) AS n, round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS median, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75
FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem)""")
def a9_whole_table(spark, sf_dir):
    """All rows are one group, with nearly as many values as rows."""
    x = F.round(F.col("l_extendedprice") * 100).cast("long").alias("x")
    s = M.length_stats(table(spark, sf_dir, "lineitem").select(x), [], "x")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH s AS (SELECT list_sort(list(CAST(round(l_extendedprice * 100) AS BIGINT))) AS x FROM lineitem)
SELECT x[len(x) // 2 + 1] AS median, x[len(x) // 4 + 1] AS p25, x[3 * len(x) // 4 + 1] AS p75, x[len(x) * 9 // 10 + 1] AS p90, x[len(x) * 19 // 20 + 1] AS p95 FROM s""")
def a10_whole_table(spark, sf_dir):
    x = F.round(F.col("l_extendedprice") * 100).cast("long").alias("x")
    return M.nearest_ranks(table(spark, sf_dir, "lineitem").select(x), [], "x", {"median": (1, 2), "p25": (1, 4), "p75": (3, 4), "p90": (9, 10), "p95": (19, 20)})


@query("SELECT lang, round(avg(CASE WHEN q > 0 THEN n_chars / q ELSE 0 END), 6) AS mean_ratio FROM (SELECT lang, n_chars, doc_id % 50 AS q FROM documents) GROUP BY lang")
def a15_mean_of_ratios(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("q", F.col("doc_id") % 50)
    return d.groupBy("lang").agg(F.round(F.avg(F.when(F.col("q") > 0, F.col("n_chars") / F.col("q")).otherwise(0)), 6).alias("mean_ratio"))


_EDGES = [("short", None, 500), ("medium", 500, 2000), ("long", 2000, 8000), ("huge", 8000, None)]
_BUCKETS = "(VALUES ('short', NULL, 500), ('medium', 500, 2000), ('long', 2000, 8000), ('huge', 8000, NULL)) b(label, lo, hi)"
_IN = "(lo IS NULL OR n_chars >= lo) AND (hi IS NULL OR n_chars < hi)"


def _judged(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    winner = F.element_at(F.array(*map(F.lit, ("a", "b", "tie", "b", "parse_error"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return d.select("doc_id", "n_chars", winner.alias("winner"), (F.col("n_chars") % 97).alias("len_a"), (F.col("doc_id") % 97).alias("len_b"))


_JUDGED = "j AS (SELECT doc_id, n_chars, (['a', 'b', 'tie', 'b', 'parse_error'])[doc_id % 5 + 1] AS winner, n_chars % 97 AS len_a, doc_id % 97 AS len_b FROM documents)"


@query(f"SELECT label, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents JOIN {_BUCKETS} ON {_IN} GROUP BY label")
def j16_range_bucket(spark, sf_dir):
    b = M.bucketed(table(spark, sf_dir, "documents"), "n_chars", spark.createDataFrame(_EDGES, "label string, lo long, hi long"))
    return b.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query(f"""WITH {_JUDGED}, c AS (SELECT label, count(*) AS n, count(*) FILTER (winner = 'a') AS wins_a, count(*) FILTER (winner = 'b') AS wins_b, count(*) FILTER (winner = 'tie') AS ties FROM j JOIN {_BUCKETS} ON {_IN} GROUP BY label)
SELECT *, 100 * wins_a // n AS pct_a, 100 * wins_b // n AS pct_b FROM c""")
def a18_bucket_winrate(spark, sf_dir):
    b = M.bucketed(_judged(spark, sf_dir), "n_chars", spark.createDataFrame(_EDGES, "label string, lo long, hi long"))
    return M.win_rates(b, ["label"], "winner", "a", "b")


@query(f"WITH {_JUDGED} SELECT count(*) AS decided, count(*) FILTER ((winner = 'b') = (len_b > len_a)) AS longer_won, round(100 * count(*) FILTER ((winner = 'b') = (len_b > len_a)) / count(*), 6) AS pct FROM j WHERE winner IN ('a', 'b')")
def a20_longer_wins(spark, sf_dir):
    return M.longer_agreement(_judged(spark, sf_dir), "winner", "a", "b", "len_a", "len_b")


@query(f"WITH {_JUDGED} SELECT w AS winner, count(*) AS n FROM (SELECT CASE WHEN len_a > len_b + 0.01 THEN 'a' WHEN len_b > len_a + 0.01 THEN 'b' ELSE 'tie' END AS w FROM j) GROUP BY w")
def a21_margin_wins(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(M.margin_winner(F.col("len_a"), F.col("len_b")).alias("winner")).agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, round(corr(doc_id, n_chars), 6) AS r FROM documents GROUP BY lang, source HAVING count(*) > 2")
def a40_pearson(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.corr("doc_id", "n_chars"), 6).alias("r"))
    return g.filter("n > 2")


@query("""WITH g AS (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source)
SELECT source, CAST(rank() OVER (ORDER BY n DESC) + rank() OVER (ORDER BY chars) AS BIGINT) AS rank_sum FROM g""")
def a41_rank_sum(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return M.rank_sums(g, "source", ["n"], ["chars"])


@query("SELECT status, resolved, count(*) AS n FROM (SELECT event_type AS status, value > 10 AS resolved FROM events) GROUP BY GROUPING SETS ((status), (status, resolved))")
def a3_status_grouping_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), (F.col("value") > 10).alias("resolved"))
    return e.groupingSets([[F.col("status")], [F.col("status"), F.col("resolved")]], "status", "resolved").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type NOT IN ('view', 'click')) AS other, count(*) AS total FROM events GROUP BY user_id")
def a2_exit_histogram(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id")
    p = g.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click")], F.count("*").alias("total"))
    return p.select("user_id", "view", "click", (F.col("total") - F.col("view") - F.col("click")).alias("other"), "total")


@query("SELECT count(*) AS n, round(100.0 * count(*) FILTER (toxic = 1) / count(*), 6) AS toxic_pct, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS good_pct FROM labels")
def a1_flag_rates(spark, sf_dir):
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), pct(F.col("toxic") == 1).alias("toxic_pct"), pct(F.col("quality") == 1).alias("good_pct"))


@query("""WITH f AS (SELECT doc_id, toxic + (1 - quality) + doc_id % 8 AS flags FROM labels), g AS (SELECT flags FROM f),
s AS (SELECT list_sort(list(flags)) AS x FROM f)
SELECT round((SELECT avg(flags) FROM f), 6) AS mean, (SELECT x[len(x) // 2 + 1] FROM s) AS median, count(*) FILTER (flags = 0) AS none, count(*) FILTER (flags BETWEEN 1 AND 2) AS few, count(*) FILTER (flags BETWEEN 3 AND 5) AS some, count(*) FILTER (flags >= 6) AS many FROM g""")
def a13_intensity(spark, sf_dir):
    f = table(spark, sf_dir, "labels").select(F.lit(1).alias("one"), (F.col("toxic") + (1 - F.col("quality")) + F.col("doc_id") % 8).alias("flags"))
    counts = f.groupBy("one").agg(F.round(F.avg("flags"), 6).alias("mean"), F.count_if(F.col("flags") == 0).alias("none"), F.count_if(F.col("flags").between(1, 2)).alias("few"), F.count_if(F.col("flags").between(3, 5)).alias("some"), F.count_if(F.col("flags") >= 6).alias("many"))
    return counts.join(M.nearest_ranks(f, ["one"], "flags", {"median": (1, 2)}), "one").select("mean", "median", "none", "few", "some", "many")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, min_by(event_id, (-value, event_id)) AS at FROM events GROUP BY event_type".replace("min_by", "arg_min"))
def a38_extremes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("at"))


@query(f"WITH {_JUDGED} SELECT j.doc_id, j.winner, a.n_chars AS len_a, b.n_chars AS len_b, coalesce(p.toxic, 0) AS prompt FROM j JOIN documents a ON a.doc_id = j.doc_id JOIN documents b ON b.doc_id = j.doc_id + 1 LEFT JOIN labels p ON p.doc_id = j.doc_id")
def j1_judge_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.select("doc_id", F.col("n_chars").alias("len_a")), d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("len_b"))
    p = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("prompt"))
    return _judged(spark, sf_dir).select("doc_id", "winner").join(a, "doc_id").join(b, "doc_id").join(p, "doc_id", "left").select("doc_id", "winner", "len_a", "len_b", F.coalesce("prompt", F.lit(0)).alias("prompt"))


@query("SELECT d.doc_id, d.lang FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def j5_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(ids, "doc_id", "left_semi")


@query("SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def j6_anti(spark, sf_dir):
    return R.removed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS is_bad FROM documents")
def j7_membership(spark, sf_dir):
    return R.membership(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "is_bad")
