"""Critic-quality aggregates: confusion counts and rates, severity alignment, buckets, ranks and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import strip
from tracelake.operators.ranking import quantiles, ranked


def rate(a: Column, b: Column) -> Column:
    """A5: a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(detections: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """A4: tp, fp, fn, tn per group over rows where both sides are known."""
    t, p = F.col(truth), F.col(predicted)
    return detections.filter(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """A5: precision, recall, f1, fpr and fnr of confusion counts."""
    c = F.col
    return counts.withColumns({
        "precision": rate(c("tp"), c("tp") + c("fp")), "recall": rate(c("tp"), c("tp") + c("fn")), "f1": rate(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "fpr": rate(c("fp"), c("fp") + c("tn")), "fnr": rate(c("fn"), c("fn") + c("tp")),
    })


def macro(rates: DataFrame, categories: DataFrame, by: list[str], category: str) -> DataFrame:
    """Means over all categories; one without support counts as 0."""
    n = categories.agg(F.count_distinct(category).alias("_n"))  # one row
    known = rates.join(categories.select(category), category, "left_semi")
    names = ("precision", "recall", "f1", "fpr")
    sums = rates.select(*by).distinct().join(known, by, "left").groupBy(*by).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in names])
    return sums.crossJoin(F.broadcast(n)).select(*by, *[(F.col(m) / F.col("_n")).alias(f"macro_{m}") for m in names])


def normalized_matrix(pairs: DataFrame, truth: str, predicted: str, codes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Share of each truth's rows by prediction; all truths appear, and an empty one divides by 1."""
    spark = pairs.sparkSession
    counted = pairs.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(truth).agg(*[F.count_if(F.col(predicted) == c).alias(f"n{c}") for c in codes])
    every = spark.createDataFrame([(c,) for c in codes], f"{truth} int")
    full = F.broadcast(every).join(counted, truth, "left")
    total = sum((F.coalesce(f"n{c}", F.lit(0)) for c in codes), F.lit(0))
    return full.select(truth, *[(F.coalesce(f"n{c}", F.lit(0)) / F.greatest(total, F.lit(1))).alias(f"share_{c}") for c in codes])


def alignment(pairs: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """Exact, over, under and unparseable among rows of known truth."""
    t, p = F.col(truth), F.col(predicted)
    return pairs.filter(t.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t == p).alias("exact"), F.count_if(p > t).alias("over"), F.count_if(p < t).alias("under"), F.count_if(p.isNull()).alias("unparseable"))


def length_stats(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, interpolated quartiles, population deviation and range of each group, or of all rows without `by`. Exact for groups of any size."""
    plain = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(rows, by, x, interpolated={"median": (1, 2), "p25": (1, 4), "p75": (3, 4)}).drop("n")
    for c in by:
        q = q.withColumnRenamed(c, f"_{c}_")
    on = F.lit(True)
    for c in by:
        on = on & plain[c].eqNullSafe(q[f"_{c}_"])
    return plain.join(q, on, "left").select(*by, "n", "mean", "median", "std", "min", "max", "p25", "p75")


def nearest_ranks(rows: DataFrame, by: list[str], x: str, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """A10: the value at place n * a div b of the sorted values, for each name: (a, b). Exact for groups of any size."""
    return quantiles(rows, by, x, nearest=ranks).select(*by, *ranks)


def corpus_means(scored: DataFrame, by: list[str], scores: list[str], response: str, blank: str = "counted") -> DataFrame:
    """Rows and mean of each score over a corpus, or over each group of it. A blank response counts as 0, or with blank="skipped" not at all; a group of none has means of 0. A null score counts as 0.
    With blank="both", a row for either way, named in the column blank, from one pass over the scores."""
    ways = ("counted", "skipped")
    if blank not in (*ways, "both"):
        raise ValueError("blank responses are counted or skipped, or both")
    is_blank = strip(F.coalesce(response, F.lit(""))) == ""

    def means(how: str) -> list[Column]:
        mean = lambda c: F.coalesce(F.avg(F.when(~is_blank, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0) if how == "counted" else F.lit(None))), F.lit(0.0))
        return [(F.count("*") if how == "counted" else F.count_if(~is_blank)).alias("n"), *[mean(c).alias(c) for c in scores]]

    if blank != "both":
        return scored.groupBy(*by).agg(*means(blank))
    each = scored.groupBy(*by).agg(*[F.struct(F.lit(how).alias("blank"), *means(how)).alias(f"_{how}") for how in ways])
    return each.select(*by, F.inline(F.array(*[f"_{how}" for how in ways])))


#: Buckets of a report at most; more raise.
MOST_EDGES = 10_000


def bucketed(rows: DataFrame, x: str, edges: DataFrame) -> DataFrame:
    """Rows with the bucket (label, lo, hi) that holds x, lo <= x < hi, null edges open. The edges are a report's, MOST_EDGES at most: they go to the tasks as one row, checked as it is made."""
    held = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("_edges"))
    held = held.select(F.when(F.size("_edges") <= MOST_EDGES, F.col("_edges")).otherwise(F.raise_error(F.lit(f"over {MOST_EDGES} buckets"))).alias("_edges"))
    inside = lambda e: (e["lo"].isNull() | (F.col(x) >= e["lo"])) & (e["hi"].isNull() | (F.col(x) < e["hi"]))
    return rows.crossJoin(F.broadcast(held)).select(*rows.columns, F.explode(F.filter("_edges", inside)).alias("_e")).select(*rows.columns, "_e.*")


def bucket_means(rows: DataFrame, x: str, edges: DataFrame, values: list[str]) -> DataFrame:
    """Rows and means of the values in each bucket that has rows."""
    return bucketed(rows, x, edges).groupBy("label").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"avg_{v}") for v in values])


def win_rates(rows: DataFrame, by: list[str], winner: str, a: str, b: str) -> DataFrame:
    """Judged rows, wins of each side, ties and floor percents."""
    pct = lambda name: F.expr(f"(100 * {name}) div n")
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(winner) == a).alias("wins_a"), F.count_if(F.col(winner) == b).alias("wins_b"), F.count_if(F.col(winner) == "tie").alias("ties"))
    return counted.select("*", pct("wins_a").alias("pct_a"), pct("wins_b").alias("pct_b"))


def margin_winner(a: Column, b: Column, margin: float = 0.01) -> Column:
    """A or b where it leads by more than the margin, else tie."""
    return F.when(a > b + margin, "a").when(b > a + margin, "b").otherwise("tie")


def longer_agreement(rows: DataFrame, winner: str, a: str, b: str, len_a: str, len_b: str) -> DataFrame:
    """Decided rows, and how often the longer side won; equal lengths count for a."""
    decided = rows.filter(F.col(winner).isin(a, b))
    agree = (F.col(winner) == b) == (F.col(len_b) > F.col(len_a))
    return decided.agg(F.count("*").alias("decided"), F.count_if(agree).alias("longer_won"), F.round(rate(100 * F.count_if(agree), F.count("*")), 6).alias("pct"))


def rank_sums(rows: DataFrame, name: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Sum of each row's ranks over metrics. Ranks come from range partitions, so any number of rows will do."""
    names = [(m, f"_rank{k}", k < len(higher)) for k, m in enumerate([*higher, *lower])]
    for m, rank, falling in names:
        rows = ranked(rows, m, rank, falling)
    return rows.select(name, sum((F.col(rank) for _, rank, _ in names), F.lit(0)).cast("long").alias("rank_sum"))
