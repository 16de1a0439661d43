"""Prompts as an agent's run builds them: the critic's, flattened or in turns, and the supervisor's message to the agent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.operators.conversations import merged_array

#: Tags and headings of prompts.
ENVIRONMENT, AGENT = "[USER/ENVIRONMENT]: ", "[AGENT RESPONSE]: "
ASK = "Please provide your supervisor feedback now based on the trajectory above."
#: Feedback of the history that a prompt shows, and characters of each that the agent is shown.
RECENT, SHOWN = 5, 1500


def due(steps: Column, threshold: int, nudge: Column | None) -> Column:
    """The nudge from `threshold` steps on, null before; a threshold of 0 or no nudge is never."""
    return F.when(steps >= threshold, nudge) if threshold > 0 and nudge is not None else F.lit(None).cast("string")


def with_nudge(observation: Column, step: Column, threshold: int, nudge: Column | None) -> Column:
    """An observation of the agent's step (from 1), with the nudge behind it where that is due."""
    return F.concat(observation, F.coalesce(F.concat(F.lit("\n\n"), due(step, threshold, nudge)), F.lit("")))


def _said(messages: Column) -> Column:
    """The messages behind system and task that are no supervisor's, null contents empty. messages: array of (role, content, is_supervisor)."""
    own = F.filter(F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0))), lambda m: ~F.coalesce(m["is_supervisor"], F.lit(False)))
    return F.transform(own, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def _recent(history: Column) -> Column:
    return F.slice(history, F.greatest(F.size(history) - RECENT, F.lit(0)) + 1, F.lit(RECENT))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def flattened_prompt(system: Column, messages: Column, history: Column, nudge: Column) -> Column:
    """System and one user message of tagged blocks: the task, what was said since, recent feedback, the nudge if it is not null, the question. history: array of (after_step, feedback)."""
    block = lambda m: F.concat(F.when(m["role"] == "assistant", AGENT).otherwise(ENVIRONMENT), m["content"])
    before = lambda h, i: F.concat(F.lit("[PREVIOUS_FEEDBACK #"), (i + 1).cast("string"), F.lit("]: "), h["feedback"])
    parts = F.concat(
        F.array(F.concat(F.lit(ENVIRONMENT), F.get(messages, 1)["content"])), F.transform(_said(messages), block), F.transform(_recent(history), before),
        F.array(F.concat(F.lit("[CRITICAL CONTEXT]: "), nudge)), F.array(F.lit(ENVIRONMENT + ASK)),
    )
    return F.array(_message("system", system), _message("user", F.array_join(parts, "\n\n")))


def multiturn_prompt(system: Column, messages: Column, history: Column, nudge: Column) -> Column:
    """System, task and turns as they were, then feedback, nudge and question as a user turn; neighbours of one role are merged."""
    before = lambda h, i: F.concat(F.lit("### Feedback #"), (i + 1).cast("string"), F.lit(" (after step "), h["after_step"].cast("string"), F.lit("):\n"), h["feedback"], F.lit("\n"))
    head = F.when(F.size(history) > 0, F.array(F.lit("## Previous Supervisor Feedback History:\n"))).otherwise(F.array().cast("array<string>"))
    last = F.array_join(F.concat(head, F.transform(_recent(history), before), F.array(F.concat(F.lit("CRITICAL CONTEXT: "), nudge, F.lit("\n"))), F.array(F.lit(ASK))), "\n\n")
    return merged_array(F.concat(F.array(_message("system", system), _message("user", F.get(messages, 1)["content"])), _said(messages), F.array(_message("user", last))))


def supervisor_message(history: Column, current: Column, steps: Column) -> Column:
    """What the agent is shown: all earlier feedback, each cut to SHOWN characters, then the current one."""
    cut = lambda x: F.concat(F.left(x, F.lit(SHOWN)), F.when(F.length(x) > SHOWN, "...").otherwise(""))
    before = lambda h, i: F.concat(F.lit("\n### Feedback #"), (i + 1).cast("string"), F.lit(" (after step "), h["after_step"].cast("string"), F.lit("):\n"), cut(h["feedback"]))
    head = F.when(F.size(history) > 0, F.concat(F.array(F.lit("\n## Previous Feedback (truncated):")), F.transform(history, before))).otherwise(F.array().cast("array<string>"))
    now = F.concat(F.lit("\n## Current Feedback (after step "), steps.cast("string"), F.lit("):"))
    return F.array_join(F.concat(F.array(F.lit("SUPERVISOR FEEDBACK:")), head, F.array(now, current)), "\n")
