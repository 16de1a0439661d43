"""Global order without a global window: running sums and maxima, ranks and exact quantiles from ranges of the order.

Rows are range partitioned and written once, so that what is known of a range and its rows are of the
same cut. One row a range (and group) then meets in a window; within a range a window runs over its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.scratch import written


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with the number of the range of the global order (`_range`, from 0) that holds them. Rows that tie share a range."""
    return written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _same(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equal in `_range` and, nulls included, in the group's columns, which `right` has under names with a `_` before and behind."""
    on = left["_range"] == right["_range_"]
    for c in by:
        on = on & left[c].eqNullSafe(right[f"_{c}_"])
    return on


def running(rows: DataFrame, order: list[Column], values: dict[str, Column], of: Callable = F.sum, by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Rows with a column for each name: the sum (or, by `of`, maximum or minimum) of its values over the rows ahead, the row's own included or not, within groups `by` or over all rows.

    The order must not leave ties, but for sums without a row's own, where rows that tie may stand in
    any order, and for rows that are equal throughout. Null values count for nothing; where no value
    is ahead a sum is 0 and an extreme null. A group may hold any number of rows: its ranges are
    summed apart, and what lies ahead of each is added to them.
    """
    by, names = by or [], list(values)
    ranges = _ranges(rows.withColumns({f"_value {n}": v for n, v in values.items()}), [*map(F.asc_nulls_first, by), *order])
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range", *by).agg(*[of(f"_value {n}").alias(n) for n in names])
    before = before.select(F.col("_range").alias("_range_"), *[F.col(c).alias(f"_{c}_") for c in by], *[of(n).over(w).alias(f"_ahead {n}") for n in names])
    inner = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = ranges.withColumns({f"_inside {n}": of(f"_value {n}").over(inner) for n in names})
    # Without groups there is a row a range; with groups there may be many, and the adaptive plan decides.
    joined = joined.join(before if by else F.broadcast(before), _same(by, joined, before))

    def total(n: str) -> Column:
        ahead, inside = F.col(f"_ahead {n}"), F.col(f"_inside {n}")
        return F.coalesce(ahead, F.lit(0)) + F.coalesce(inside, F.lit(0)) if of is F.sum else (F.least if of is F.min else F.greatest)(ahead, inside)

    return joined.select(*rows.columns, *[total(n).alias(n) for n in names])


def numbered(keys: DataFrame, order: list[Column], name: str = "at") -> DataFrame:
    """O1: rows of a narrow table with their place from 0 in the order, which must not leave ties."""
    return running(keys, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def ranked(rows: DataFrame, by: str, name: str, descending: bool = False) -> DataFrame:
    """Rows with the rank of `by` (1 and one more than the rows ahead of it, equals share it), null last. Values are counted first, so that only distinct ones are sorted."""
    key = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    values = running(rows.groupBy(by).agg(F.count("*").alias("_c")), [key], {"_ahead": F.col("_c")}, inclusive=False)
    rank = values.select(F.col(by).alias("_by"), (F.col("_ahead") + 1).alias(name))
    return rows.join(rank, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def quantiles(rows: DataFrame, by: list[str], x: str, nearest: dict[str, tuple[int, int]] | None = None, interpolated: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Exact quantiles of each group's values by selection, from one sort: by, n (values that are not null) and a column for each name.

    nearest (a, b): the value at place n * a div b of the sorted values, from 0, so a < b.
    interpolated (a, b): between the values about place (n - 1) * a / b, as doubles. Values are counted first, and
    sorted ranges of the counts know how many values they hold, so which ranges hold a wanted place
    is known before any is looked into: a group of any size needs no task of its own, and only ranges
    with a wanted place are read again. Groups without a value have no row; without `by` all rows are one group.
    """
    keys = by or ["_all"]
    counts = (rows if by else rows.withColumn("_all", F.lit(0))).filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    ranges = _ranges(counts, [*map(F.asc_nulls_first, keys), F.asc("_x")])
    group = Window.partitionBy(*keys)
    upto = F.sum("_held").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    held = ranges.groupBy("_range", *keys).agg(F.sum("_c").alias("_held"))
    held = held.select(F.col("_range").alias("_range_"), *[F.col(c).alias(f"_{c}_") for c in keys], "_held", (upto - F.col("_held")).alias("_from"), F.sum("_held").over(group).alias("n"))
    places = [(f"{name}", f"n * {a} div {b}") for name, (a, b) in (nearest or {}).items()]
    for name, (a, b) in (interpolated or {}).items():
        places += [(f"{name} low", f"(n - 1) * {a} div {b}"), (f"{name} high", f"(n - 1) * {a} div {b} + int((n - 1) * {a} % {b} > 0)")]
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(place).alias("place")) for k, (_, place) in enumerate(places)])
    looked = held.withColumn("_wanted", F.filter(wanted, lambda w: (w["place"] >= F.col("_from")) & (w["place"] < F.col("_from") + F.col("_held")))).filter(F.size("_wanted") > 0).drop("_held")
    inside = ranges.join(looked, _same(keys, ranges, looked))
    end = F.col("_from") + F.sum("_c").over(Window.partitionBy("_range", *keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_end", end).withColumn("_hit", F.explode(F.filter("_wanted", lambda w: (w["place"] >= F.col("_end") - F.col("_c")) & (w["place"] < F.col("_end")))))
    picked = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_hit.k") == k, F.col("_x"))).alias(f"_{k}") for k in range(len(places))])
    at = {name: F.col(f"_{k}") for k, (name, _) in enumerate(places)}

    def between(name: str, a: int, b: int) -> Column:
        low, high = at[f"{name} low"].cast("double"), at[f"{name} high"].cast("double")
        part = F.expr(f"(n - 1) * {a} % {b}") / b
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return picked.select(*by, "n", *[at[name].alias(name) for name in nearest or {}], *[between(name, a, b).alias(name) for name, (a, b) in (interpolated or {}).items()])
