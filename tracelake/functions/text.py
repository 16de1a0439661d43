"""Text functions over columns: stripping, feedback parsing, patches and shell output. All are native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the critic's output format.
CATEGORIES = (
    "Task Specification Violations", "Role Specification Violations", "Step Repetition", "Termination Condition Unawareness",
    "Problem Misidentification", "Tool Selection Errors", "Hallucinations", "Information Processing Failures",
    "Task Derailment", "Goal Deviation", "Context Handling Failures", "Verification Failures",
)
STATUSES = ("On track", "Needs correction", "Critical intervention required")
FEEDBACK_MARKERS = ("DETECTED:", "SPECIFICATION ERRORS", "REASONING ERRORS", "COORDINATION ERRORS", "TASK_STATUS:", "OVERALL_GUIDANCE:")
AGENT_STARTS = ("```", "Let me", "I'll", "I need", "Now let", "Okay", "cd ", "cat ", "find ", "grep ", "python ", "pip ")
# Path parts whose diff sections are noise, and the line that announces a submission.
NOISE_PATHS = (r"\.venv(/|$)", r"venv(/|$)", r"__pycache__(/|$)", r"\.git(/|$)", r"\.pytest_cache(/|$)", r"\.mypy_cache(/|$)")
SUBMIT_MARKERS = ("COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT",)
BASH_BLOCK = r"(?s)```bash\n(.*?)\n```"


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def tokens(x: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def _match(x: Column, regex: str, group: int = 1) -> Column:
    """A group of the first match, null without one (even where the group is empty)."""
    return F.when(x.rlike(regex), F.regexp_extract(x, regex, group))


def strip_think(x: Column) -> Column:
    """Thought blocks removed, then stripped."""
    return strip(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))


def reasoning(raw: Column, field: Column | None = None) -> Column:
    """T4: the field if it has text, else what stands in thought tags, else what precedes a lone end tag; '' without any."""
    inside = _match(raw, r"(?s)<think>(.*?)</think>")
    before = F.when(F.contains(raw, F.lit("</think>")), F.substring_index(raw, "</think>", 1))
    found = strip(F.coalesce(inside, before, F.lit("")))
    return found if field is None else F.when(F.length(field) > 0, field).otherwise(found)


def answer(raw: Column) -> Column:
    """T4: the text after the first end of thought."""
    at = F.instr(raw, "</think>")
    return strip(F.when(at > 0, F.substr(raw, at + 8)).otherwise(raw))


def n_markers(x: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(x, F.lit(m)).cast("int") for m in FEEDBACK_MARKERS])


def is_valid_feedback(x: Column) -> Column:
    """P5: two markers decide; else an agent's opening denies; else one marker is enough."""
    s = strip(x)
    first = strip(F.element_at(F.split(s, "\n"), 1))
    opening = reduce(lambda a, b: a | b, [F.startswith(first, F.lit(m)) for m in AGENT_STARTS])
    return F.when(s == "", False).when(n_markers(s) >= 2, True).when(opening, False).otherwise(n_markers(s) >= 1)


def current_feedback(x: Column) -> Column:
    """T5: what follows the first header line, or the whole less its prefix; '' if it is no feedback."""
    after = F.coalesce(_match(x, r"(?s)## Current Feedback[^\n]*\n(.*)"), F.lit(""))
    found = strip(F.when(F.contains(x, F.lit("## Current Feedback")), after).otherwise(F.replace(x, F.lit("SUPERVISOR FEEDBACK:"), F.lit(""))))
    return F.when((found != "") & ~is_valid_feedback(found), "").otherwise(found)


def content_text(v: Column) -> Column:
    """Text of a VARIANT message content: a string, or parts whose text or value (or JSON) are joined by newlines; '' for null."""
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.value", "string"), F.try_variant_get(p, "$", "string"), F.to_json(p))
    kind = F.schema_of_variant(v)
    joined = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), "\n")
    return F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), joined).otherwise(F.try_variant_get(v, "$", "string")), F.lit(""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once a row, however often f names it: as a lambda's variable it is not copied into each place."""
    return F.get(F.transform(F.array(x), f), 0)


def detections(x: Column) -> Column:
    """Map of category to 1 or 0 from the first line-bound `category ... DETECTED: Yes|No`, any case; 1 only for a literal Yes. Categories without a match are absent."""
    first = lambda t, c: F.regexp_extract(t, rf"(?id)\Q{c}\E.*?DETECTED:\s*(Yes|No)", 1)
    found = once(x, lambda t: F.array(*[F.struct(F.lit(c).alias("k"), first(t, c).alias("v")) for c in CATEGORIES]))
    return F.map_from_entries(F.transform(F.filter(found, lambda e: e["v"] != ""), lambda e: F.struct(e["k"], (e["v"] == "Yes").cast("int"))))


def _category(name: Column) -> Column:
    """The category whose name starts with the first 20 characters of this one, else the one that holds its first 15."""

    def of(n: Column) -> Column:
        starts = [F.when(F.startswith(F.lit(c.lower()), F.substring(n, 1, 20)), c) for c in CATEGORIES]
        holds = [F.when(F.contains(F.lit(c.lower()), F.substring(n, 1, 15)), c) for c in CATEGORIES]
        return F.coalesce(*starts, *holds)

    return once(F.lower(strip(name)), of)


def numbered_detections(x: Column) -> Column:
    """Map of category to boolean from all `n. **Name:** DETECTED: Yes|No`; names match by their first 20 characters, else by containment of the first 15; the last of a category holds."""
    regex = F.lit(r"(?d)(\d+)\.\s+\*{0,2}(.+?)\*{0,2}:\*{0,2}\s*DETECTED:\s*(Yes|No)")
    pairs = once(x, lambda t: F.arrays_zip(F.regexp_extract_all(t, regex, F.lit(2)).alias("name"), F.regexp_extract_all(t, regex, F.lit(3)).alias("value")))
    known = F.filter(F.transform(pairs, lambda p: F.struct(_category(p["name"]).alias("k"), (p["value"] == "Yes").alias("v"))), lambda e: e["k"].isNotNull())

    def last(r: Column) -> Column:
        return F.reverse(F.transform(F.array_distinct(r["k"]), lambda k: F.struct(k.alias("k"), F.get(r["v"], F.array_position(r["k"], k).cast("int") - 1).alias("v"))))

    return F.map_from_entries(once(F.reverse(known), last))


def task_status(x: Column) -> Column:
    """Canonical status after the first TASK_STATUS, null if there is none or it is unknown."""
    raw = F.lower(strip(F.regexp_replace(strip(_match(x, r"(?d)TASK_STATUS:\s*(.*)")), r"^\*+|\*+$", "")))
    return F.when(F.startswith(raw, F.lit("critical")), STATUSES[2]).when(F.startswith(raw, F.lit("needs")), STATUSES[1]).when(F.startswith(raw, F.lit("on track")) | F.startswith(raw, F.lit("already")), STATUSES[0])


def normalized_status(raw: Column) -> Column:
    """Canonical status of loosely written text, else Other."""
    s = F.regexp_replace(strip(raw), r"""^[*_`"'#\s]+""", "")
    s = F.lower(strip(F.element_at(F.split(F.regexp_replace(s, r"""[*_`"'.\s]+$""", ""), "#"), 1)))
    found = reduce(lambda w, k: w.when(F.startswith(s, F.lit(k.lower())), k), STATUSES[1:], F.when(F.startswith(s, F.lit(STATUSES[0].lower())), STATUSES[0]))
    return F.coalesce(found, F.lit("Other"))


def severity(status: Column) -> Column:
    """M4: 0, 1 or 2; null for anything else."""
    return reduce(lambda w, k: w.when(status == STATUSES[k], k), (1, 2), F.when(status == STATUSES[0], 0))


def guidance_length(x: Column) -> Column:
    """Code points after OVERALL_GUIDANCE, stripped; 0 without one."""
    return F.coalesce(F.length(strip(_match(x, r"(?s)OVERALL_GUIDANCE:\s*(.*)"))), F.lit(0))


def bash_blocks(x: Column) -> Column:
    """Contents of all fenced bash blocks."""
    return F.regexp_extract_all(x, F.lit(BASH_BLOCK), F.lit(1))


def is_step(role: Column, x: Column) -> Column:
    """An assistant message with a bash block."""
    return (role == "assistant") & x.rlike(BASH_BLOCK)


def command(x: Column) -> Column:
    """The stripped command of exactly one bash block, else the stripped text."""
    b = bash_blocks(x)
    return strip(F.when(F.size(b) == 1, F.get(b, 0)).otherwise(x))


def files_in_patch(p: Column) -> Column:
    """Distinct files of a git diff, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(p, F.lit(r"(?m)^diff --git a/(\S+) b/"), F.lit(1))))


def repo_path(p: Column) -> Column:
    """./ then testbed/ off the front, once each."""
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"^testbed/", "")


def clean_diff(p: Column) -> Column:
    """Sections of noise files dropped; what stands before the first section stays."""
    noise = "|".join(NOISE_PATHS)
    path = lambda s: F.regexp_extract(s, r"^diff --git a/(\S+) b/\S+", 1)
    return F.array_join(F.filter(F.split(p, r"(?m)^(?=diff --git )"), lambda s: ~path(s).rlike(noise)), "")


def hunks(section: Column) -> Column:
    """New-side line ranges of a file's section."""
    regex = F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
    pairs = F.arrays_zip(F.regexp_extract_all(section, regex, F.lit(1)).alias("a"), F.regexp_extract_all(section, regex, F.lit(2)).alias("n"))
    start = lambda p: p["a"].cast("int")
    return F.transform(pairs, lambda p: F.struct(start(p).alias("start"), (start(p) + F.coalesce(F.nullif(p["n"], F.lit("")).cast("int"), F.lit(1)) - 1).alias("end")))


def shorten(x: Column, n: int, left: bool = False) -> Column:
    """Ellipsis at one end beyond n, then padded to n."""
    cut = F.concat(F.lit("..."), F.right(x, F.lit(n - 3))) if left else F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))
    return F.rpad(F.when(F.length(x) > n, cut).otherwise(x), n, " ")


def elide(x: Column, limit: int = 10_000, half: int = 5_000) -> Column:
    """Head, a count of what is left out, and tail of long output."""
    note = F.concat(F.lit("\n["), (F.length(x) - 2 * half).cast("string"), F.lit(" characters elided]\n"))
    return F.when(F.length(x) < limit, x).otherwise(F.concat(F.left(x, F.lit(half)), note, F.right(x, F.lit(half))))


def submission(x: Column, markers: tuple[str, ...] = SUBMIT_MARKERS) -> Column:
    """The lines after a first line that announces a submission, null if it does not. Harnesses with other markers pass theirs."""
    t = F.regexp_replace(x, r"(?U)^\s+", "")
    head = strip(F.substring_index(t, "\n", 1))
    return F.when(head.isin(*markers), F.coalesce(_match(t, r"(?s)^[^\n]*\n(.*)"), F.lit("")))


def config_suffix(run: Column, marker: str = "_cwm_prm_") -> Column:
    """The part of a run's name after the marker; '-' without one."""
    at = F.instr(run, marker)
    return F.when(at > 0, F.substr(run, at + len(marker))).otherwise("-")


def _script(word: Column) -> Column:
    """Whether a word is a substitution for sed: behind an address of lines, if it has one, an s, a mark that is no letter or digit, and what it replaces."""
    body = F.ltrim(F.ltrim(word, F.lit("0123456789,")))
    mark, then = F.substr(body, F.lit(2), F.lit(1)), F.substr(body, F.lit(3), F.lit(1))
    return F.startswith(body, F.lit("s")) & (F.length(body) > 2) & (F.upper(mark) == F.lower(mark)) & ~mark.between("0", "9") & (F.trim(then) != "")


#: A shell word's meaning follows from what stands before it: outside of sed, among its options, among its files.
_OUTSIDE, _OPTIONS, _FILES = 0, 1, 2
_WALK = "struct<mode:int,argument:boolean,target:boolean,paths:array<string>>"


def _walked(command: Column) -> Column:
    """Files that one command writes to or gives to sed, in order of their words: one walk over the words.

    A word that begins with `>` or `>>`, behind a 2 or & if there is one, redirects to the rest of it, or to the next
    word where nothing is left; a target ends at ; & or |. Of sed, words with a dash are options, -i, -e and -f take
    the next word, then a substitution is no file, and all that follows up to a bar is.
    """
    raw = F.regexp_extract_all(command, F.lit(r"""(?:'[^']*'|"[^"]*"|[^\s'"])+"""), F.lit(0))
    plain = lambda w: F.regexp_replace(w, r"""'([^']*)'|"([^"]*)\"""", "$1$2")

    def step(state: Column, word: Column) -> Column:
        w = plain(word)
        sign = F.when(F.substr(word, F.lit(1), F.lit(2)).isin("2>", "&>"), F.substr(word, F.lit(2))).otherwise(word)
        redirects = F.startswith(sign, F.lit(">"))
        rest = F.when(F.startswith(sign, F.lit(">>")), F.substr(sign, F.lit(3))).otherwise(F.substr(sign, F.lit(2)))
        aside = redirects | state["target"]  # such a word says nothing to sed
        target = F.get(F.split(F.when(state["target"], w).otherwise(plain(rest)), "[;&|]"), 0)
        among, dash = state["mode"] == _OPTIONS, F.startswith(w, F.lit("-"))
        stays = among & (dash | state["argument"])
        first = among & ~stays
        mode = F.when(aside, state["mode"]).when(stays | (w == "sed"), _OPTIONS).when(w == "|", _OUTSIDE).when(first, _FILES).otherwise(state["mode"])
        operand = ((first & ~_script(w)) | (state["mode"] == _FILES)) & ~w.isin("|", "sed")
        path = F.when(aside, F.when(redirects & (rest == ""), "").otherwise(target)).when(operand, w).otherwise("")
        kept = F.when(path.isin("", "/dev/null"), F.array().cast("array<string>")).otherwise(F.array(path))
        argument = F.when(aside, state["argument"]).otherwise(among & dash & w.isin("-i", "-e", "-f"))
        return F.struct(mode.alias("mode"), argument.alias("argument"), (redirects & (rest == "")).alias("target"), F.concat(state["paths"], kept).alias("paths")).cast(_WALK)

    start = F.struct(F.lit(_OUTSIDE).alias("mode"), F.lit(False).alias("argument"), F.lit(False).alias("target"), F.array().cast("array<string>").alias("paths")).cast(_WALK)
    return F.aggregate(raw, start, step, lambda s: s["paths"])


def touched_paths(cmd: Column, cwd: str = "/testbed") -> Column:
    """Files that a shell command may edit, each once, in order: those of its parts (between &&, || and ;), relative to the working folder."""
    found = F.flatten(F.transform(F.split(cmd, r"&&|\|\||;"), _walked))
    base = cwd.rstrip("/") + "/"
    relative = lambda p: F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))).otherwise(p)
    here = lambda p: F.when(F.startswith(p, F.lit("./")), F.substr(p, F.lit(3))).otherwise(p)
    return F.array_distinct(F.filter(F.transform(found, lambda p: here(relative(p))), lambda p: p != ""))


def numbered_line(n: Column, line: Column) -> Column:
    """A line of a snippet behind its number."""
    return F.format_string("%4d | %s", n, line)


def block_kind(block: Column, first: Column, prompt: str = "Please provide your supervisor feedback now") -> Column:
    """Feedback, prompt, task or trajectory, by a block's tag; `first` says whether no environment block came before."""
    environment = F.startswith(block, F.lit("[USER/ENVIRONMENT]:"))
    return F.when(F.startswith(block, F.lit("[PREVIOUS_FEEDBACK")), "feedback").when(environment & F.contains(block, F.lit(prompt)), "prompt").when(environment & first, "task").otherwise("trajectory")


def defaulted(value: Column, default: object) -> Column:
    """A nested value, or the default where a step of its path is missing or null."""
    return F.coalesce(value, F.lit(default))


def starts_match(x: Column, spec: str) -> Column:
    """Whether a pattern matches from the start on; an empty one keeps all."""
    return x.rlike(f"^(?:{spec})") if spec else F.lit(True)


def any_starts_match(x: Column, patterns: list[str]) -> Column:
    """P20: whether any pattern matches from the start on; none without patterns."""
    return reduce(lambda a, b: a | b, [starts_match(x, p) for p in patterns], F.lit(False))


def is_final_error(message: Column) -> Column:
    """Whether an error would come again on the same input. What such messages say."""
    m = F.lower(message)
    has = lambda s: F.contains(m, F.lit(s))
    return has("contextwindowexceeded") | has("context length") | (has("max_tokens") & has("too large")) | has("prompt is too long")


def prompt_format(setting: Column, model: Column) -> Column:
    """The format that is set, else flattened for models named so, else multiturn."""
    return F.when(setting.isin("flattened", "multiturn"), setting).when(F.contains(F.lower(model), F.lit("flattened")), "flattened").otherwise("multiturn")


def status_line(x: Column) -> Column:
    """What the first status line says, read in steps: its heading in any case, then colons, marks and blanks, one dash, and the rest of that line; null without a heading or with nothing behind it."""
    at = F.regexp_instr(x, F.lit("(?i)task_status"))
    said = F.ltrim(F.substr(x, at + len("task_status")), F.lit("*_: \t\n\r\x0b\x0c"))
    said = F.when(F.startswith(said, F.lit("-")), F.ltrim(F.substr(said, F.lit(2)), F.lit(" \t\n\r\x0b\x0c"))).otherwise(said)
    return F.when(at > 0, F.nullif(F.substring_index(said, "\n", 1), F.lit("")))


def statuses(history: Column, log: Column, messages: Column) -> Column:
    """Statuses of a trajectory's feedback texts: those of the history, else of the log; where these have no text, of the supervisor messages, empty ones too. A text without a status is Other."""
    one = lambda t: F.coalesce(normalized_status(status_line(t)), F.lit("Other"))
    first = F.filter(F.when(F.size(history) > 0, history).otherwise(log), lambda t: t != "")
    return F.transform(F.when(F.size(first) > 0, first).otherwise(F.coalesce(messages, F.array().cast("array<string>"))), one)


def clean_content(content: Column) -> Column:
    """T16 over a message's content, a VARIANT: its string, or the text, value and content of its parts, as JSON. Other values stay."""
    cleaned = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")

    def part(p: Column) -> Column:
        fields = F.map_filter(F.try_variant_get(p, "$", "map<string,variant>"), lambda k, v: v.isNotNull())
        clean = F.transform_values(fields, lambda k, v: F.when(k.isin("text", "value", "content") & (F.schema_of_variant(v) == "STRING"), F.parse_json(_quoted(clean_diff(F.try_variant_get(v, "$", "string"))))).otherwise(v))
        return F.coalesce(F.to_json(clean), F.to_json(p))

    kind = F.schema_of_variant(content)
    parts = F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), ","), F.lit("]"))
    return F.when(kind == "STRING", _quoted(clean_diff(F.try_variant_get(content, "$", "string")))).when(F.startswith(kind, F.lit("ARRAY")), parts).otherwise(F.to_json(content))


def _quoted(x: Column) -> Column:
    """A string as JSON."""
    inner = F.to_json(F.struct(x.alias("s")))
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def rounded_similarity(s: Column) -> Column:
    """M5: four places, null where it is not positive."""
    return F.when(s > 0, F.round(s, 4))


def fixed_point(x: Column, places: int) -> Column:
    """A number as text with that many places, halves to even as most languages print them."""
    return F.format_string(f"%.{places}f", F.bround(x.cast("decimal(28,12)"), places).cast("double"))


def approximate_tokens(x: Column) -> Column:
    """A quarter of the length, the count where no tokenizer is given."""
    return F.floor(F.length(F.coalesce(x, F.lit(""))) / 4).cast("long")


def dataset_name(alias: Column, names: dict[str, str]) -> Column:
    """The dataset behind an alias; what is no alias stands for itself."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, alias), alias)


def is_of_kind(path: Column, names: list[str], parts: list[str]) -> Column:
    """Whether a dataset is one of the named, or its path holds one of the parts in any case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(p)) for p in parts], path.isin(*names))
