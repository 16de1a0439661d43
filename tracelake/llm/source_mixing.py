"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a flow whose documents, in a shuffled order that repeats up to three times, get
virtual finish times: the source's words so far over the source's target. Documents are sent in
packets of PACKET words, so that a long one does not overshoot. All packets, sorted by finish time
over all sources, are taken until the budget is spent. The sort is by ranges: range totals tell
which range the cut falls into, and only that range is looked into further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, materialize
from tracelake.operators.ranking import numbered

WEIGHTS = (1, 2, 3)
#: Times that a document may be repeated.
REPEATS = 3
PACKET = 64
#: Buckets of a source's shuffled order: a source with a third of all rows is still dealt over many tasks.
BUCKETS = 4096
#: Ranges per unit of virtual time at each look; the second look splits one range of the first.
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), one row per source -> with weight, budget and target.

    Water filling in closed form: with sources sorted by repeats * size / weight, those below the
    level are full and the rest share what is left by weight. Places and running sums come from range
    partitions, so sources may be as many as hosts are; only a row a range meets in one task.
    """
    places = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    t = places.withColumn("weight", w.cast("double")).withColumn("full", (repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("full") / F.col("weight"))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    ranges = materialize(t.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sources")
    # Sums of the ranges, and of those before and after each.
    every = Window.orderBy("range")
    sums = ranges.groupBy("range").agg(F.sum("full").alias("fulls"), F.sum("weight").alias("weights"), F.sum("source_size").alias("sizes"))
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0.0)
    sums = sums.select("range", F.coalesce(F.sum("fulls").over(before), none).alias("fulls_before"), F.coalesce(F.sum("weights").over(after), none).alias("weights_after"), F.sum("sizes").over(Window.partitionBy()).cast("double").alias("budget"))
    inside = Window.partitionBy("range").orderBy(*order)
    t = ranges.join(F.broadcast(sums), "range")
    t = t.withColumn("below", F.col("fulls_before") + F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), none))
    t = t.withColumn("left", F.col("weights_after") + F.sum("weight").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("budget") - F.col("below")) / F.col("left"))
    # The first source that its share would not overfill sets the level.
    level = t.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("l")))).alias("x")).select(F.col("x.l").alias("water"))
    t = t.crossJoin(F.broadcast(level))
    return t.select("source", "source_size", "weight", "budget", F.least("full", F.coalesce(F.col("weight") * F.col("water"), F.col("full"))).alias("target"))


def _packets(repeat: Column) -> Column:
    """A document's packets in one repetition: words sent by the end of each."""
    ends = F.sequence(F.lit(1), F.ceil(F.col("size") / PACKET).cast("int"))
    start = repeat * F.col("source_size") + F.col("before")
    return F.transform(ends, lambda j: F.struct(((start + F.least(F.col("size"), j * PACKET)) / F.col("target")).alias("finish"), (F.least(F.col("size"), j * PACKET) - (j - 1) * PACKET).alias("words")))


def _all_packets() -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), _packets))


def _order_key(seed: int, doc_id: str, text: str, source: str) -> Column:
    """Places a row in its source's shuffled order; equal for rows of equal id, text and source only (but by chance)."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(source), F.col(text).isNull(), F.col(source).isNull())


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """doc_id, source, size, order_key, source_size, target, budget, before (the source's words ahead of it in one repetition)."""
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), _order_key(seed, doc_id, text, source).alias("order_key")
    )
    slim = materialize(slim.withColumn("bucket", F.pmod("order_key", F.lit(BUCKETS)).cast("int")), "mix-slim")
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    shares = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))).withColumnRenamed("source", "s")
    ahead = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_size")
    buckets = buckets.select("source", "bucket", ahead.alias("ahead")).join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = buckets.withColumnsRenamed({"source": "s", "bucket": "b"})
    rows = slim.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    return materialize(rows.select("doc_id", "source", "size", "order_key", "source_size", "target", "budget", "before"), "mix-rows")


def cut_point(rows: DataFrame) -> DataFrame:
    """One row: finish and order_key of the packet in which the budget ends, and its words within the budget."""
    sent = rows.filter("size > 0 and target > 0").select("order_key", "budget", F.explode(_all_packets()).alias("p")).select("order_key", "budget", "p.finish", "p.words")
    width = 1
    found = sent.sparkSession.range(1).select(F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("spent"))
    for _ in range(2):
        width *= RANGES
        at = F.floor(F.col("finish") * width)
        inner = sent if width == RANGES else sent.join(F.broadcast(found.select(F.col("range").alias("outer"))), F.floor(F.col("finish") * (width // RANGES)) == F.col("outer"))
        totals = inner.groupBy(at.alias("range")).agg(F.sum("words").alias("words"), F.first("budget").alias("budget"))
        upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        totals = totals.crossJoin(F.broadcast(found.select(F.col("spent").alias("earlier")))).withColumn("upto", F.col("earlier") + upto)
        # One row: the first range by which the budget is spent.
        found = materialize(totals.filter("upto >= budget").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("spent"))).alias("x")).select("x.range", "x.spent"), "mix-cut")
    last = sent.join(F.broadcast(found), F.floor(F.col("finish") * width) == F.col("range"))
    upto = F.col("spent") + F.sum("words").over(Window.orderBy("finish", "order_key").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).filter("upto >= budget")
    return last.agg(F.min(F.struct("upto", "finish", "order_key", (F.col("budget") - F.col("upto") + F.col("words")).cast("long").alias("part"))).alias("x")).select("x.finish", "x.order_key", "x.part")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, keep_key: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, first_finish (null if it is not taken).

    A null text has size 0 and is never taken; a null source is a source of its own, the last.
    Equal rows are interchangeable; without any words every target and every taken is 0. The mix in
    sending order is `mix(...).filter("taken > 0").orderBy("first_finish", "doc_id")`.
    """
    rows = schedule(docs, doc_id, text, source, seed)
    cut = materialize(cut_point(rows), "mix-end").select(F.col("finish").alias("c_finish"), F.col("order_key").alias("c_key"), "part")
    key = F.col("order_key")

    def taken(p: Column) -> Column:
        ahead = (p["finish"] < F.col("c_finish")) | ((p["finish"] == F.col("c_finish")) & (key < F.col("c_key")))
        return F.when(ahead, p["words"]).when((p["finish"] == F.col("c_finish")) & (key == F.col("c_key")), F.col("part")).otherwise(F.lit(0).cast("long"))

    sums = F.aggregate(F.transform(_all_packets(), taken), F.lit(0).cast("long"), lambda a, x: a + x)
    got = F.when((F.col("size") > 0) & (F.col("target") > 0), sums).otherwise(F.lit(0).cast("long"))
    first = F.when(got > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return rows.crossJoin(F.broadcast(cut)).select("doc_id", "source", "size", "source_size", "target", got.alias("taken"), first.alias("first_finish"), *(["order_key"] if keep_key else []))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", seed: int = 17) -> DataFrame:
    """The mix with all columns of docs: a row for each time a document is sent, the last one cut to the words that the budget leaves it (n_chars, if it is a column, follows).

    Rows that are not taken are left out. Rows of equal id, text and source are interchangeable: what they
    take together is sent as one of them, as often as it takes, so no word is lost. Columns of any
    name stay as they are. An empty table gives an empty mix.
    """
    name = lambda x: next(c for c in (x, *(f"{x}_{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    key, own, words, size, copy = map(name, ("mix_key", "mix_id", "mix_taken", "mix_size", "mix_copy"))
    both = lambda order_key, i: [order_key.alias(key), F.coalesce(F.col(i).cast("string"), F.lit("null")).alias(own)]
    # Equal rows have one key, and rows of different ids are told apart where keys meet by chance. Any one of them is kept, by an aggregate that takes most of them together before it shuffles, so the texts move once and by a key of one row.
    taken = mix(docs, doc_id, text, source, seed, keep_key=True).groupBy(*both(F.col("order_key"), "doc_id")).agg(F.sum("taken").alias(words), F.max("size").alias(size)).filter(F.col(words) > 0)
    one = docs.groupBy(*both(_order_key(seed, doc_id, text, source), doc_id)).agg(F.any_value(F.struct(*docs.columns)).alias(copy)).select(key, own, f"{copy}.*")
    sent = one.join(taken, [key, own]).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(words) / F.col(size)))))
    whole = F.col(copy) * F.col(size) <= F.col(words)
    cut = F.when(whole, F.col(text)).otherwise(_first_words(F.col(text), F.col(words) - (F.col(copy) - 1) * F.col(size)))
    out = sent.withColumn(text, cut)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(whole, F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return out.select(*docs.columns)
