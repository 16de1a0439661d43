"""Benchmark tables over runs: prices, fallbacks, best-of-N, Pareto frontiers, curves and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import files_in_patch, strip
from tracelake.operators.ranking import numbered, running

SUBMITTED = "Submitted"
def priced(calls: DataFrame, prices: DataFrame, run: str, model: str, tokens_in: str, tokens_out: str, stored: str) -> DataFrame:
    """Cost per run from token counts and its model's rates; without a rate the stored cost, else 0. prices: (model, rate_in, rate_out), one row a model.

    Tokens are added up by run and model first, so that only a row for each of these meets the prices.
    """
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    used = calls.groupBy(run, model).agg(total(tokens_in).alias("_in"), total(tokens_out).alias("_out"), F.max(stored).alias("_stored"))
    c = used.join(prices, model, "left").groupBy(run).agg(F.bool_or(F.col("rate_in").isNotNull()).alias("is_priced"), F.sum(F.col("_in") * F.col("rate_in") + F.col("_out") * F.col("rate_out")).alias("_spent"), F.max("_stored").alias("_stored"))
    return c.select(run, "is_priced", F.when(F.col("is_priced"), F.coalesce("_spent", F.lit(0.0))).otherwise(F.coalesce("_stored", F.lit(0.0))).alias("cost"))


def critic_priced(runs: DataFrame, entries: DataFrame, prices: DataFrame, run: str) -> DataFrame:
    """A critic's cost per run. runs: (run, model, stored); entries: (run, usage) with usage a struct of prompt_tokens and completion_tokens, null or without either where nothing was recorded; prices: (model, rate_in, rate_out).

    Without a rate, or without usage in any entry, the stored cost holds (0 if null).
    """
    u_in, u_out = F.col("usage.prompt_tokens"), F.col("usage.completion_tokens")
    used = entries.groupBy(run).agg(F.bool_or(u_in.isNotNull() | u_out.isNotNull()).alias("_used"), F.coalesce(F.sum(u_in), F.lit(0)).alias("_in"), F.coalesce(F.sum(u_out), F.lit(0)).alias("_out"))
    j = runs.join(prices, "model", "left").join(used, run, "left")
    recomputed = F.col("rate_in").isNotNull() & F.coalesce("_used", F.lit(False))
    cost = F.when(recomputed, F.col("_in") * F.col("rate_in") + F.col("_out") * F.col("rate_out")).otherwise(F.coalesce("stored", F.lit(0.0)))
    return j.select(run, recomputed.alias("is_priced"), cost.alias("cost"))


def selection_cost(results: DataFrame, rate_in: float, rate_out: float, out_per_call: int = 500) -> DataFrame:
    """S18's one row with what choosing among runs costs, answers taken as out_per_call tokens each."""
    return results.withColumn("cost", F.col("tokens_in") * rate_in + F.col("n_calls") * out_per_call * rate_out)


def localization(predictions: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Of predictions (instance_id, model_patch) with a patch and a known gold patch (instance_id, gold_patch), how many touch a gold file."""
    p = predictions.filter(strip(F.coalesce("model_patch", F.lit(""))) != "").join(gold.filter("gold_patch is not null"), "instance_id")
    hit = F.arrays_overlap(files_in_patch(F.col("model_patch")), files_in_patch(F.col("gold_patch")))
    return p.groupBy(*by).agg(F.count_if(hit).alias("localized"), F.count("*").alias("n"))


def localization_rates(predictions: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Localized, n and pct for every group of predictions. Without gold patches n is 0 and pct null: not available."""
    found = localization(predictions, gold, by)
    groups = predictions.select(*by).distinct()
    for c in by:
        found = found.withColumnRenamed(c, f"_{c}_")
    on = F.lit(True)
    for c in by:
        on = on & groups[c].eqNullSafe(found[f"_{c}_"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return groups.join(found, on, "left").select(*by, zero("localized"), zero("n"), F.try_divide(100 * F.col("localized").cast("double"), F.col("n")).alias("pct"))


def combined_predictions(critic: DataFrame, base: DataFrame, statuses: DataFrame) -> DataFrame:
    """The critic's prediction of runs that it submitted, else the base's. statuses: (instance_id, exit_status) of the critic's runs."""
    submitted = F.col("exit_status") == SUBMITTED
    own = critic.join(statuses.filter(submitted), "instance_id", "left_semi")
    return own.unionByName(base.join(statuses.filter(~submitted | F.col("exit_status").isNull()), "instance_id", "left_semi"))


def points(runs: DataFrame, agent: str, setting: str, base: str) -> DataFrame:
    """A point per agent and setting with totals; agents without a run of the base setting are left out."""
    p = runs.groupBy(agent, setting).agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"), F.sum("cost").alias("cost"))
    return p.join(p.filter(F.col(setting) == base).select(agent), agent, "left_semi")


def with_fallback(critic: DataFrame, base: DataFrame, mode: str = "full") -> DataFrame:
    """Critic runs with the base run's result where they did not submit. Both sides: instance, exit_status, resolved, steps, cost.

    full: the base decides for runs not submitted. mini: a critic run that resolved counts even so,
    and the base only where it did not. additive: costs add up, and without a base run the critic's
    own result holds.
    """
    b = base.select("instance", *[F.col(c).alias(f"base_{c}") for c in ("exit_status", "resolved", "steps", "cost")])
    j = critic.join(b, "instance", "left")
    submitted, none = F.col("exit_status") == SUBMITTED, F.col("base_resolved").isNull()
    base_resolved = F.coalesce("base_resolved", F.lit(False))
    resolved = {"full": F.when(submitted, F.col("resolved")).otherwise(base_resolved), "mini": F.col("resolved") | (~submitted & base_resolved), "additive": F.when(submitted | none, F.col("resolved")).otherwise(base_resolved)}[mode]
    plus = lambda c: F.col(c) + F.when(submitted, 0).otherwise(F.coalesce(f"base_{c}", F.lit(0)))
    return j.select("instance", F.when(submitted | none, F.col("exit_status")).otherwise(F.col("base_exit_status")).alias("exit_status"), resolved.alias("resolved"), plus("steps").alias("steps"), plus("cost").alias("cost"), (~submitted & ~none).alias("used_base"))


def run_table(runs: DataFrame, by: list[str], n: int | Column) -> DataFrame:
    """Counts and averages over a fixed denominator n, missing instances included; the rate per submitted run is null without any."""
    n = F.lit(n) if isinstance(n, int) else n
    return runs.groupBy(*by).agg(
        F.count_if("resolved").alias("resolved"), F.count_if(F.col("exit_status") == SUBMITTED).alias("submitted"),
        F.round(100 * F.count_if("resolved") / n, 6).alias("resolved_pct"), F.round(F.try_divide(100 * F.count_if("resolved"), F.count_if(F.col("exit_status") == SUBMITTED)), 6).alias("resolved_of_submitted_pct"),
        F.round(F.sum("steps") / n, 6).alias("avg_steps"), F.round(F.sum("cost") / n, 6).alias("avg_cost"),
    )


def best_of_n(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per instance whether any run resolved or submitted, and the steps and cost of all."""
    return runs.groupBy(*by).agg(F.bool_or("resolved").alias("resolved"), F.bool_or(F.col("exit_status") == SUBMITTED).alias("submitted"), F.sum("steps").alias("steps"), F.sum("cost").alias("cost"))


def pareto(points: DataFrame, group: str | None, name: str, cost: str, value: str) -> DataFrame:
    """Points that no cheaper one reaches, within each group or among all; of equal costs the better, then the first name, goes first. A point without a value is on no frontier."""
    best = running(points, [F.asc(cost), F.desc(value), F.asc(name)], {"_best": F.col(value)}, F.max, [group] if group else None, inclusive=False)
    return best.filter(F.col("_best").isNull() & F.col(value).isNotNull() | (F.col(value) > F.col("_best"))).drop("_best")


def budgeted(calls: DataFrame, order: list[Column], cost: str, cost_limit: float | int | None = None, call_limit: int | None = None) -> DataFrame:
    """Every call with what all calls up to it have spent (`spent`), how many there were (`n_calls`) and whether it raises (`exceeded`).

    One account for all calls in order, which must not leave ties. A call is added first and checked
    then: it raises where more than cost_limit is spent, or where as many calls as call_limit are made.
    A limit of None or 0 is none; a null cost adds nothing.
    """
    total = running(calls, order, {"spent": F.coalesce(F.col(cost), F.lit(0)), "n_calls": F.lit(1)})
    exceeded = F.lit(False)
    if cost_limit:
        exceeded = exceeded | (F.col("spent") > cost_limit)
    if call_limit:
        exceeded = exceeded | (F.col("n_calls") >= call_limit)
    return total.withColumn("exceeded", exceeded)


def stacked(parts: list[tuple[str, str, DataFrame]], totals: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summary rows of (label, kind, runs) parts under one another, with label, kind and their place `at` in the list: sorted by it they are in registry order. Columns that a part lacks are null."""
    out = None
    for at, (label, kind, runs) in enumerate(parts):
        one = totals(runs).select(F.lit(at).alias("at"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def paired(rows: DataFrame, label: str, kind: str, plain: str, combined: str, values: list[str]) -> DataFrame:
    """A row a label with the plain row's values, those of its row with fallback (`value combined`), and what each gained; labels without a plain row are left out, and one without fallback has nulls."""
    pick = lambda k, v: F.max(F.when(F.col(kind) == k, F.col(v)))
    wide = rows.groupBy(label).agg(F.bool_or(F.col(kind) == plain).alias("_plain"), *[pick(plain, v).alias(v) for v in values], *[pick(combined, v).alias(f"{v}_combined") for v in values]).filter("_plain")
    return wide.select(label, *values, *[f"{v}_combined" for v in values], *[(F.col(f"{v}_combined") - F.col(v)).alias(f"{v}_gain") for v in values])


def matrix(rows: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """A row for each prompt and a column for each of the given settings, null where there is no point."""
    return rows.groupBy(row).pivot(column, columns).agg(F.max(value))


def interval(files: DataFrame, steps: DataFrame, key: str, step: str, most: int = 10) -> DataFrame:
    """One row, step_interval: of the first `most` files in order of key the first one with steps gives the difference of its two least, or its only one; null if none has any."""
    first = files.select(key).distinct().orderBy(F.asc_nulls_last(key)).limit(most)
    least = steps.join(first, key, "left_semi").groupBy(key, step).agg(F.count("*").alias("_n"))
    # The two least with their repeats: a file that has its least step twice has an interval of 0.
    two = least.groupBy(key).agg(F.min(step).alias("_a"), F.count("*").alias("_distinct"), F.sum("_n").alias("_all"), F.min_by("_n", step).alias("_times"))
    second = least.join(two.select(F.col(key).alias("_k"), "_a"), F.col(key) == F.col("_k")).filter(F.col(step) > F.col("_a")).groupBy(key).agg(F.min(step).alias("_b"))
    found = F.when(F.col("_all") == 1, F.col("_a")).when(F.col("_times") > 1, F.col("_a") - F.col("_a")).otherwise(F.col("_b") - F.col("_a"))
    return two.join(second, key, "left").agg(F.min_by(found, key).alias("step_interval"))


def best_variant(points: DataFrame, by: str, value: str, cost: str, name: str) -> DataFrame:
    """The variant of most value, then least cost, then greatest name."""
    top = F.max_by(F.struct(F.col(name).alias("n"), F.col(value).alias("v"), F.col(cost).alias("c")), F.struct(F.col(value), -F.col(cost), F.col(name)))
    return points.groupBy(by).agg(top.alias("b")).select(by, F.col("b.n").alias(name), F.col("b.v").alias(value), F.col("b.c").alias(cost))


def step_curve(counts: DataFrame, by: str, steps: str, n: int | None = None) -> DataFrame:
    """Per number of steps, how many runs resolved by then and their share. Runs are counted before they are accumulated."""
    c = counts.groupBy(by, steps).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    upto = F.sum("_n").over(w.orderBy(steps).rowsBetween(Window.unboundedPreceding, 0))
    total = F.lit(n) if n else F.sum("_n").over(w)
    return c.select(by, steps, upto.alias("resolved"), F.round(100 * upto / total, 6).alias("pct"))


def at_thresholds(rows: DataFrame, by: str, x: str, thresholds: tuple[int, ...]) -> DataFrame:
    """Rows with x at most each threshold: one conditional count each in a single pass, then a row a threshold."""
    counted = rows.groupBy(by).agg(*[F.count_if(F.col(x) <= t).alias(f"t{t}") for t in thresholds])
    return counted.select(by, F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds])).alias("x")).select(by, "x.*")


def group_split(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """Rows with is_train: the first floor(n * ratio) of the sorted distinct keys train."""
    keys = numbered(rows.select(key).distinct(), [F.asc_nulls_last(key)], "_at")
    n = keys.count()
    return rows.join(keys.select(F.col(key).alias("_key"), (F.col("_at") < int(n * ratio)).alias("is_train")), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def python_slice(rows: DataFrame, order: str, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """O2: rows[start:stop:step] in order of a unique column, negatives from the end, for positive steps."""
    keys = numbered(rows.select(order), [F.asc(order)], "_at")
    n = keys.count()
    at = range(n)[slice(start, stop, step)]
    chosen = keys.filter((F.col("_at") >= at.start) & (F.col("_at") < at.stop) & ((F.col("_at") - at.start) % step == 0))
    return rows.join(chosen.select(order), order, "left_semi")


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(order).limit(n)


def selected(rows: DataFrame, key: str, spec: str) -> DataFrame:
    """The row at a place (a spec of digits) in order of the key, else the rows of that key."""
    if not spec.isnumeric():
        return rows.filter(F.col(key) == spec)
    return rows.join(numbered(rows.select(key).distinct(), [F.asc(key)], "_at").filter(F.col("_at") == int(spec)), key, "left_semi")


def looked_up(rows: DataFrame, labels: dict[str, Column], order: str, values: list[str]) -> DataFrame:
    """For each label the first row (in order) that its predicate holds for, in one pass; without any its values are null."""
    picked = F.struct(*values)
    found = rows.agg(*[F.min_by(F.when(p, picked), F.when(p, F.col(order))).alias(f"l{k}") for k, p in enumerate(labels.values())])
    rows_ = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"l{k}").alias("v")) for k, name in enumerate(labels)])
    return found.select(F.explode(rows_).alias("x")).select("x.label", *[F.col(f"x.v.{v}").alias(v) for v in values])


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """O3: rows with their place in a reproducible shuffle by unique key: in order of the digest of seed and key, another permutation than a Mersenne shuffle gives."""
    keys = rows.select(key, F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")).alias("_digest"))
    return rows.join(numbered(keys, [F.asc("_digest"), F.asc(key)], "place").drop("_digest"), key)


def choice(key: Column, n: int, seed: int = 0) -> Column:
    """A number from 0 to n - 1 for each call, the same on every run."""
    return F.pmod(F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), F.lit(8)), 16, 10).cast("long"), F.lit(n)).cast("int")


def shortest(candidates: DataFrame, by: str, content: str, pos: str) -> DataFrame:
    """The shortest candidate, the first of equals."""
    return candidates.groupBy(by).agg(F.min_by(content, F.struct(F.length(content), pos)).alias(content), F.min(F.struct(F.length(content), pos))[pos].alias(pos))


def membership(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with whether their key is among ids."""
    return rows.join(ids.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn(flag, F.col("_in").isNotNull()).drop("_in")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows with those of changes in place, the last of a key by `order`."""
    last = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r", order)
    return current.join(last, key, "left_anti").unionByName(last)


def removed(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Current rows whose key is not among keys."""
    return current.join(keys.select(key), key, "left_anti")
