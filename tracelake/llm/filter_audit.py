"""Interaction of filters: what each removes at each step of every order, from one count a failure set.

A document fails a set of filters; only counts by part and failure set leave the scan. A state is the
set of filters that were applied: the documents that it leaves are those whose failures lie outside it.
The states form a lattice, an edge applies one filter more, and an order is a path from the empty set
to the full one. Paths counted forward to an edge's start and backward from its end give the number
of orders through it: removals weighted so are Shapley values times the number of orders, and the
steps of each order are read from the same edges. DataFrame functions only.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize

BLANKS = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
LEAST_WORDS = 200


def lattice(n: int) -> tuple[list[int], list[int]]:
    """Paths from the empty set to each subset of n filters (by bits), and from each to the full set, by adding a filter at a time."""
    size = 1 << n
    reach, leave = [0] * size, [0] * size
    reach[0] = leave[-1] = 1
    for s in range(size):
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in reversed(range(size)):
        for f in range(n):
            if s >> f & 1:
                leave[s ^ 1 << f] += leave[s]
    return reach, leave


def content_failures(text: Column) -> Column:
    """The bits of filters A to D for a text that is not null: few words, few distinct words, many capitals, symbols."""

    def bits(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < LEAST_WORDS, 1).otherwise(0).bitwiseOR(F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0))

    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    symbols = F.lit(False)
    for c in "#$%&*|":
        symbols = symbols | text.contains(c)
    ab = F.transform(F.array(words), bits)[0]
    return ab.bitwiseOR(F.when(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0)).bitwiseOR(F.when(symbols, 8).otherwise(0))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts by part and failure set: part, mask, n, good (quality 1), toxic (toxic 1).

    E fails where a smaller id has the same text; a row without an id is neither smaller nor greater
    than any, and rows that repeat the least id stand together. A text is known by its SHA-256. Rows
    that repeat an id and a text are counted before they are shuffled, the least id of a text is a
    partial aggregate, and it is joined on text and id, so a text that a third of all rows hold goes to
    no single task. Of several labels of an id any that says 1 holds.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # The scan's rows are counted at once: what follows reads this narrow table.
    read = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content_failures(t).alias("mask"))
    read = materialize(read.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = read.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    mask = F.col("mask").bitwiseOR(F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0))
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(flag)
    return read.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left").groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts by part and failure set (part, mask, n, good, toxic) -> a row for each part, order of the filters and step.

    letters name the bits of mask, the lowest first. A part holds at most one row a failure set from
    here on, so its states are one row; no part has no row, and a table without parts gives none.
    """
    k = len(letters)
    full = (1 << k) - 1
    reach, leave = lattice(k)
    # Of an edge, by its filter and start: the orders that go through it.
    through = [[0 if s >> f & 1 else reach[s] * leave[s | 1 << f] for s in range(full + 1)] for f in range(k)]
    paths = []
    for order in permutations(range(k)):
        s = 0
        for step, f in enumerate(order, 1):
            paths.append({"filter_order": "".join(letters[i] for i in order), "step": step, "f": f, "a": s, "b": s | 1 << f})
            s |= 1 << f
    fixed = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    # A document is in all states that hold none of its failures.
    rows = F.col("sets")
    level = lambda name: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.aggregate(rows, F.lit(0).cast("long"), lambda x, r: x + F.when(r["mask"].bitwiseAND(s) == 0, r[name]).otherwise(F.lit(0).cast("long")))).alias(name)
    states = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets")).select("part", level("n"), level("good"), level("toxic"))

    def weighted(orders: Column, f: Column) -> Column:
        gone = lambda s: F.col("n")[s] - F.col("n")[s.bitwiseOR(F.call_function("shiftleft", F.lit(1), f))]
        return F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda x, s: x + orders[s] * gone(s))

    states = states.withColumn("shapley", F.transform(fixed(through, "array<array<long>>"), weighted))
    v = lambda name, state: F.col(name)[state]
    a, b, one = F.col("x.a"), F.col("x.b"), F.call_function("shiftleft", F.lit(1), F.col("x.f"))
    removed = v("n", a) - v("n", b)
    return states.withColumn("x", F.explode(fixed(paths, "array<struct<filter_order: string, step: int, f: int, a: int, b: int>>"))).select(
        "part", "x.filter_order", "x.step", v("n", b).alias("kept"), removed.alias("removed"), (v("n", F.lit(0)) - v("n", one) - removed).alias("redundant"),
        (v("n", F.lit(full) - one) - v("n", F.lit(full))).alias("unique_fails"), (v("good", a) - v("good", b)).alias("good_lost"), (v("toxic", a) - v("toxic", b)).alias("toxic_lost"),
        F.col("shapley")[F.col("x.f")].alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by source.

    A null text is empty, a null source is the part ''; every row counts, repeated ones too. Other
    columns are not read, so their names cannot clash; empty tables give no rows, and without labels
    nothing good or toxic is lost. A very long text is handled within its row.
    """
    return audit(failures(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(lo < w.doc_id, false)] AS f FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT i, chr(CAST(64 + i AS INTEGER)) AS x FROM range(1, 6) r(i)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, CAST(i AS INTEGER) AS step, ascii(substr(filter_order, i, 1)) - 64 AS own, list_transform(range(1, i), lambda j: ascii(substr(filter_order, j, 1)) - 64) AS before FROM o, s),
y AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda z: z)) = 1 AS single FROM st, c),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost FROM y GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
