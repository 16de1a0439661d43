"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits to 0, white space to one space, trimmed) and hashed
together with their host. A line that more than `line_limit` documents of one host hold is
removed; a document that keeps less than `least_kept` of its words is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, let, materialize

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line found in more documents of a host than this is boilerplate.
LINE_LIMIT = 25
#: A document is depleted if less than this share of its words is left.
LEAST_KEPT = 0.5
#: White space other than the line feed.
_BLANKS = r"[\x20\x09\x0B-\x0D]+"


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal_lines(text: Column) -> Column:
    """Those lines in lower case, digits as 0, words parted by single spaces."""
    normal = F.regexp_replace(F.translate(F.lower(text), "123456789", "0" * 9), _BLANKS, " ")
    return F.filter(F.transform(F.split(normal, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _covered(windows: Column) -> Column:
    """Places covered by windows whose hash is found twice or more: sorted hashes bring equals together, sorted places give the union of intervals."""

    def repeated(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))
        return let(F.array_sort(F.filter(marked, lambda p: p.isNotNull())), union)

    def union(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), p - F.get(places, k - 1)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))


def _windows(words: Column) -> Column:
    """Hashes of all windows of WINDOW words, from hashes of one, two and four words each."""

    def doubled(hashes: Column, k: int) -> Column:
        return let(hashes, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - k, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + k))))

    return doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)


def _of_words(words: Column) -> Column:
    """n_words, word_chars and n_repeat_words (words in windows that the text holds twice or more, the first included)."""
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), let(_windows(words), _covered).cast("long").alias("n_repeat_words"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = LINE_LIMIT, least_kept: float = LEAST_KEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    A null text counts as empty (base_failed, as it has under 20 words); a null host is a host of
    its own; every row, also one that repeats an id or a whole row, counts as a document of its own
    and has its own words removed. Very long texts stay within their row's arrays. Extra columns are
    left out, so their names cannot clash; an empty table gives an empty one.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(host).alias("host"))
    t = F.col("t")
    hashed = F.transform(_normal_lines(t), lambda x: F.struct(F.xxhash64(F.col("host"), x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    # One scan of the texts; what follows reads this narrow table. The row number is written with it, so it is the same whatever is computed again.
    base = picked.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), _of_words).alias("w"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        hashed.alias("lines"),
    )
    base = materialize(base.select("doc_id", "row", "w.*", "n_symbols", "n_dup_lines", "lines"), "quality-lines")
    counts = base.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).groupBy("line").count()
    frequent = counts.filter(F.col("count") > line_limit).select("line")
    # A line may stand in a third of all rows: the adaptive plan broadcasts the few frequent lines or splits the join where it is skewed.
    gone = base.select("row", F.explode("lines").alias("x")).select("row", "x.line", "x.words").join(frequent, "line").groupBy("row").agg(F.sum("words").alias("gone"))
    removed = F.coalesce(F.col("gone"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.drop("lines").join(gone, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed.alias("removed_words"),
        (~failed & (F.col("n_words") - removed >= least_kept * F.col("n_words"))).alias("kept"),
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, {WINDOW}) AS x(k) GROUP BY r),
lines AS (SELECT r, source, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS n, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS k FROM (SELECT r, source, unnest(ls) AS l FROM w)),
freq AS (SELECT source, n FROM lines GROUP BY source, n HAVING count(DISTINCT r) > {LINE_LIMIT}),
gone AS (SELECT r, sum(k) AS g FROM lines JOIN freq ON lines.n = freq.n AND lines.source IS NOT DISTINCT FROM freq.source GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.g, 0) AS BIGINT) AS removed_words FROM w LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= {LEAST_KEPT} * n_words AS kept FROM m
"""
