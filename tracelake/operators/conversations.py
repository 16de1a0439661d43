"""Conversation shaping over message tables (a key, a position, role and content), one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def invocations(messages: DataFrame, key: str, pos: str, is_supervisor: Column) -> DataFrame:
    """Supervisor rows with their 1-based number, counted before any is dropped."""
    return messages.filter(is_supervisor).withColumn("invocation", F.row_number().over(Window.partitionBy(key).orderBy(pos)))


def with_history(feedback: DataFrame, key: str, pos: str, content: str, last: int = 5) -> DataFrame:
    """Each valid feedback with the contents of up to `last` before it, renumbered from 1."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(-last, -1)
    return feedback.withColumn("history", F.transform(F.collect_list(content).over(before), lambda x, i: F.struct((i + 1).alias("n"), x.alias("content"))))


def stuck(messages: DataFrame, key: str, order: list[str], command: Column, k: int = 3) -> DataFrame:
    """Per key, whether a command comes k times in a row (islands of equal neighbours)."""
    by = Window.partitionBy(key).orderBy(*order)
    seen = messages.select(key, *order, command.alias("_c"))
    seen = seen.withColumn("_new", F.coalesce((F.col("_c") != F.lag("_c").over(by)).cast("int"), F.lit(1)))
    seen = seen.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    length = seen.withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run")))
    return length.groupBy(key).agg((F.max("_n") >= k).alias("stuck"))


def keep_recent(messages: DataFrame, key: str, pos: str, size: str, budget: int) -> DataFrame:
    """The newest rows whose sizes add up to the budget at most; the first that overflows ends it."""
    newest = Window.partitionBy(key).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("used", F.sum(size).over(newest)).filter(F.col("used") <= budget)


def merge_roles(messages: DataFrame, key: str, pos: str, role: str = "role", content: str = "content") -> DataFrame:
    """Neighbours of one role become one message, contents parted by an empty line; system messages stay single. Positions are renumbered from 0."""
    by = Window.partitionBy(key).orderBy(pos)
    starts = F.coalesce((F.col(role) != F.lag(role).over(by)) | (F.col(role) == "system"), F.lit(True)).cast("int")
    islands = messages.select(key, pos, role, content, starts.alias("_s")).withColumn("_island", F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(content).alias("c"))))
    return islands.groupBy(key, F.col("_island").cast("int").alias(pos)).agg(F.first(role).alias(role), F.array_join(F.transform(parts, lambda x: x["c"]), "\n\n").alias(content))


def pair_turns(merged: DataFrame, key: str, pos: str, start: int = 2) -> DataFrame:
    """Number of the pair of neighbours that a message belongs to, from `start` on; roles alternate after merging."""
    return merged.filter(F.col(pos) >= start).withColumn("pair", F.expr(f"({pos} - {start}) div 2").cast("int"))


def pages(messages: DataFrame, key: str, pos: str, role: str = "role") -> DataFrame:
    """Number of the step that a message belongs to; a step ends with a user message."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("page", F.coalesce(F.sum((F.col(role) == "user").cast("int")).over(before), F.lit(0)))


def tag_last_users(messages: DataFrame, key: str, pos: str, role: str = "role", n: int = 2, offset: int = 0) -> DataFrame:
    """Marks the last n user messages after skipping `offset` of them."""
    back = F.row_number().over(Window.partitionBy(key, role).orderBy(F.desc(pos))) - 1
    return messages.withColumn("tagged", (F.col(role) == "user") & (back >= offset) & (back < offset + n))


def prefix(messages: DataFrame, key: str, pos: str, steps: int) -> DataFrame:
    """The first 2 + 2n messages of each key, n cut to the steps that the key has; keys without a step have no prefix."""
    counted = messages.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    counted = counted.withColumn("prefix_steps", F.least(F.lit(steps), F.expr("greatest((_n - 2) div 2, 0)")).cast("int")).withColumn("submit_base", F.col("prefix_steps") < steps)
    at = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1
    return counted.withColumn("_at", at).filter((F.col("prefix_steps") > 0) & (F.col("_at") < 2 + 2 * F.col("prefix_steps"))).drop("_n", "_at")


def merge_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges that overlap or touch become one. Repeated ranges go first, so that no two rows tie."""
    ranges = ranges.select(key, start, end).distinct()
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.coalesce((F.col(start) > reach + 1).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


_MESSAGES = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def samples(messages: DataFrame, key: str, pos: str, role: str, content: str, is_supervisor: Column, valid: Column, prompt: str, last: int = 5) -> DataFrame:
    """A training sample per valid supervisor message: the messages before it without supervisors', then history and prompt as a user turn, then the feedback; neighbours of one role merged.

    The messages of a key are merged once; a sample takes the runs of one role that end before it, and
    cuts the one that it falls into.
    """
    every = messages.withColumn("_sup", F.coalesce(is_supervisor, F.lit(False)))
    numbered = invocations(every, key, pos, F.col("_sup")).filter(valid)
    held = with_history(numbered.select(key, pos, content, "invocation"), key, pos, content, last)
    by = Window.partitionBy(key).orderBy(pos)
    own = every.filter(~F.col("_sup"))
    starts = F.coalesce((F.col(role) != F.lag(role).over(by)) | (F.col(role) == "system"), F.lit(True)).cast("int")
    own = own.select(key, pos, role, content, starts.alias("_s")).withColumn("_run", F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(content).alias("content"))))
    runs = own.groupBy(key, "_run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.first(role).alias("role"), parts.alias("parts"))
    runs = runs.select(key, F.struct("first", "last", "role", F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n").alias("content"), F.when(F.size("parts") > 1, F.col("parts")).alias("parts")).alias("_r"))
    context = runs.groupBy(key).agg(F.array_sort(F.collect_list("_r"), lambda a, b: F.when(a["first"] < b["first"], -1).otherwise(1)).alias("_all"))
    at = F.col(pos)
    whole = F.transform(F.filter("_all", lambda r: r["last"] < at), lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    cut = F.transform(F.filter("_all", lambda r: (r["first"] < at) & (r["last"] >= at)), lambda r: F.struct(r["role"].alias("role"), F.array_join(F.transform(F.filter(r["parts"], lambda x: x["pos"] < at), lambda x: x["content"]), "\n\n").alias("content")))
    shown = F.array_join(F.transform("history", lambda h: F.concat(F.lit("\n### Feedback #"), h["n"].cast("string"), F.lit(":\n"), h["content"], F.lit("\n"))), "")
    asked = F.concat(F.when(F.size("history") > 0, F.concat(F.lit("\n\n## Previous Supervisor Feedback History:\n"), shown)).otherwise(""), F.lit("\n\n" + prompt))
    raw = held.join(context, key, "left").select(key, "invocation", content, asked.alias("_asked"), F.coalesce(F.concat(whole, cut), F.array().cast(_MESSAGES)).alias("_before"))
    tail = F.get("_before", F.size("_before") - 1)
    joined = F.concat(F.slice("_before", F.lit(1), F.size("_before") - 1), F.array(_message("user", F.concat(tail["content"], F.lit("\n\n"), F.col("_asked")))))
    asked_last = F.when(F.coalesce(tail["role"] == "user", F.lit(False)), joined).otherwise(F.concat("_before", F.array(_message("user", F.col("_asked")))))
    return raw.select(key, "invocation", F.concat(asked_last, F.array(_message("assistant", F.col(content)))).alias("messages"))


def merged_array(messages: Column) -> Column:
    """W5 over an array of (role, content): where a run of one role starts, and the join of what lies between two starts."""
    at = F.sequence(F.lit(1), F.size(messages))
    new = lambda i: (i == 1) | (F.element_at(messages, i)["role"] != F.get(messages, i - 2)["role"]) | (F.element_at(messages, i)["role"] == "system")
    starts = F.filter(at, lambda i: F.coalesce(new(i), F.lit(True)))

    def joined(starts: Column) -> Column:
        until = lambda k: F.coalesce(F.get(starts, k + 1), F.size(messages) + 1)
        return F.transform(starts, lambda s, k: F.struct(F.element_at(messages, s)["role"].alias("role"), F.array_join(F.transform(F.slice(messages, s, until(k) - s), lambda m: m["content"]), "\n\n").alias("content")))

    return F.when(F.size(messages) > 0, F.transform(F.array(starts), joined)[0]).otherwise(F.array().cast(_MESSAGES))


def multiturn(messages: Column) -> Column:
    """C4: system ('' without one), the turns between merged by role, and the response by itself."""
    system = F.when(F.get(messages, 0)["role"] == "system", F.get(messages, 0)["content"]).otherwise("")
    inner = F.slice(messages, 2, F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.concat(F.array(_message("system", system)), merged_array(inner), F.array(_message("assistant", F.element_at(messages, -1)["content"])))


def rebuilt(blocks: DataFrame, key: str, pos: str, cat: str, text: str, kept: str) -> DataFrame:
    """The user message of each key from its blocks: task, trajectory, feedback, prompt, each in order, behind a note of how many of a kind were left out."""
    note = lambda name, what: F.when(F.count_if((F.col(cat) == name) & ~F.col(kept)) > 0, F.concat(F.lit("[..."), F.count_if((F.col(cat) == name) & ~F.col(kept)).cast("string"), F.lit(f" earlier {what}(s) omitted...]")))
    order = lambda name: F.transform(F.array_sort(F.collect_list(F.when((F.col(cat) == name) & F.col(kept), F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))), lambda x: x["t"])
    parts = F.concat(order("task"), F.array(note("trajectory", "trajectory step")), order("trajectory"), F.array(note("feedback", "supervisor feedback")), order("feedback"), order("prompt"))
    return blocks.groupBy(key).agg(F.array_join(parts, "\n\n").alias("content"))


def visible(messages: DataFrame, is_supervisor: str, is_active: str, shown: Column, content: str = "content") -> DataFrame:
    """Messages as the model sees them: supervisors' that are not active go, the active one is replaced by `shown`."""
    sup, active = F.coalesce(is_supervisor, F.lit(False)), F.coalesce(is_active, F.lit(False))
    return messages.filter(~sup | active).withColumn(content, F.when(sup, shown).otherwise(F.col(content)))


def stage_counters(found: DataFrame, resolved: DataFrame | None, key: str, is_corrupt: str, n_log: str, n_valid: str) -> DataFrame:
    """One row: errors (unreadable), filtered (not resolved), skipped (no valid feedback), denoised (log entries less valid ones, of the rest) and samples."""
    t = found if resolved is None else found.join(resolved.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    bad = F.coalesce(is_corrupt, F.lit(False))
    ok = F.lit(True) if resolved is None else F.coalesce("_ok", F.lit(False))
    used = ~bad & ok & (F.coalesce(n_valid, F.lit(0)) > 0)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return t.agg(F.count_if(bad).alias("errors"), F.count_if(~bad & ~ok).alias("filtered"), F.count_if(~bad & ok & ~used).alias("skipped"), total(F.when(used, F.coalesce(n_log, F.lit(0)) - F.col(n_valid))).alias("denoised"), total(F.when(used, F.col(n_valid))).alias("samples"))


def flattened(messages: Column) -> Column:
    """System, one user message of tagged blocks, and the response."""
    tag = lambda m: F.concat(F.when(m["role"] == "assistant", "[AGENT RESPONSE]: ").otherwise("[USER/ENVIRONMENT]: "), m["content"])
    inner = F.slice(messages, 2, F.greatest(F.size(messages) - 2, F.lit(0)))
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(msg("system", F.when(F.get(messages, 0)["role"] == "system", F.get(messages, 0)["content"]).otherwise("")), msg("user", F.array_join(F.transform(inner, tag), "\n\n")), msg("assistant", F.element_at(messages, -1)["content"]))


def truncate_pairs(messages: DataFrame, key: str, pos: str, role: str, content: str, size: str, most: int, floor: int = 1000, overhead: int = 100) -> DataFrame:
    """Keys over the budget lose their oldest turn pairs. The first two and last two messages stay; (key, pos, dropped_pairs, dropped_messages, kept) per message."""
    whole = Window.partitionBy(key)
    at = F.row_number().over(whole.orderBy(pos)) - 1
    m = messages.select(key, pos, role, content, size, at.alias("_at"), F.count("*").over(whole).alias("_n"), F.sum(size).over(whole).alias("_total"))
    fixed = (F.col("_at") < 2) | (F.col("_at") >= F.col("_n") - 2)
    m = m.withColumn("_fixed", fixed).withColumn("_room", F.greatest(F.lit(floor), most - overhead - F.sum(F.when(fixed, F.col(size)).otherwise(0)).over(whole)))
    m = m.withColumn("_pair", F.when(~fixed, F.expr("(_at - 2) div 2")))
    pairs = m.filter("_pair is not null").groupBy(key, "_pair").agg(F.sum(size).alias("_size"))
    newest = Window.partitionBy(key).orderBy(F.desc("_pair")).rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("_used", F.sum("_size").over(newest)).select(key, "_pair", "_used")
    m = m.join(pairs, [key, "_pair"], "left")
    kept = F.col("_fixed") | (F.col("_total") <= most) | (F.col("_used") <= F.col("_room"))
    m = m.withColumn("kept", kept)
    return m.select(key, pos, role, content, "kept", F.size(F.collect_set(F.when(~kept, F.col("_pair"))).over(whole)).alias("dropped_pairs"), F.sum((~kept).cast("int")).over(whole).alias("dropped_messages"))


def split_budget(blocks: DataFrame, key: str, pos: str, cat: str, size: str, room: int, ratio: float) -> DataFrame:
    """Key, pos, cat, kept. Feedback may take int(room * ratio), trajectory the rest; what feedback leaves goes to the trajectory, else what that leaves goes to feedback; each side keeps its newest blocks."""
    whole = Window.partitionBy(key)
    total = lambda name: F.sum(F.when(F.col(cat) == name, F.col(size)).otherwise(0)).over(whole)
    b = blocks.withColumn("_f", total("feedback")).withColumn("_t", total("trajectory"))
    share = int(room * ratio)
    feedback = F.when(F.col("_f") <= share, F.col("_f")).when(F.col("_t") <= room - share, room - F.col("_t")).otherwise(share)
    trajectory = F.when(F.col("_f") <= share, room - F.col("_f")).when(F.col("_t") <= room - share, F.col("_t")).otherwise(room - share)
    newest = Window.partitionBy(key, cat).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(size).over(newest) <= F.when(F.col(cat) == "feedback", feedback).otherwise(trajectory)
    return b.select(key, pos, cat, ((F.col("_f") + F.col("_t") <= room) | fits).alias("kept"))
