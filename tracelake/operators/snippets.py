"""What an edit touched: ranges of a patch, widened and merged, joined with the numbered lines of the files as they now are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import hunks, numbered_line

#: Line ends of a text; the last line may have none.
_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Lines a bin: a range is joined by the bins that it covers, not by its lines.
BIN = 512


def file_lines(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, path, line_no from 1, line) of file texts. A line end closes a line, so none follows the last one; an empty or null text has no lines."""
    rows = files.select(key, path, F.posexplode(F.split(F.regexp_replace(text, f"(?:{_ENDS})\\z", ""), _ENDS)).alias("n", "line"), F.col(text).alias("_t")).filter("_t <> ''")
    return rows.select(key, path, (F.col("n") + 1).alias("line_no"), "line")


def edited_ranges(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path, start, end) of each hunk of git diffs, by the file's new path; a hunk that only removes has end = start - 1."""
    section = F.explode(F.filter(F.split(patch, r"(?m)^(?=diff --git )"), lambda s: F.startswith(s, F.lit("diff --git"))))
    named = patches.select(key, section.alias("_s"))
    word = F.get(F.filter(F.split(F.substring_index("_s", "\n", 1), r"\s+"), lambda w: w != ""), F.lit(3))
    named = named.select(key, F.regexp_replace(word, "^b/", "").alias("path"), "_s").filter("path is not null")
    return named.select(key, "path", F.explode(hunks(F.col("_s"))).alias("h")).select(key, "path", F.col("h.start").alias("start"), F.col("h.end").alias("end"))


def shown_ranges(ranges: DataFrame, sizes: DataFrame, key: str, context: int) -> DataFrame:
    """Ranges (key, path, start, end) widened by context, clamped to the file and merged where they overlap or touch. sizes: (key, path, n_lines); files without lines, or not there, have no ranges. Adds n_ranges of the file."""
    wide = ranges.join(sizes.filter("n_lines > 0"), [key, "path"]).select(
        key, "path", "start", "end", F.greatest(F.lit(1), F.col("start") - context).alias("s"), F.least(F.col("n_lines"), F.col("end") + context).alias("e")
    ).distinct()
    by = Window.partitionBy(key, "path").orderBy("start", "end")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    # A merged range's end is the greatest so far; what lies before an island never reaches into it, so the running maximum over all ranges tells the same.
    islands = wide.withColumn("_new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "path", "_i").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("_i")
    return merged.withColumn("n_ranges", F.count("*").over(Window.partitionBy(key, "path")))


def snippet_lines(ranges: DataFrame, lines: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Lines (key, path, line_no, line) that lie in a range (key, path, start, end, ...) of their file, with it.

    An interval join by bins: a range goes to every bin of `width` lines that it covers, a line to the
    one that holds it, and they meet by file and bin. A range over a whole long file so is a row for
    each `width` of its lines, no line is repeated, and one long file is spread over tasks.
    """
    bin_of = lambda c: F.expr(f"({c} - 1) div {width}")
    binned = ranges.filter("start <= end").withColumn("_bin", F.explode(F.sequence(bin_of("start"), bin_of("end"))))
    return binned.join(lines.withColumn("_bin", bin_of("line_no")), [key, "path", "_bin"]).filter("line_no between start and end").drop("_bin")


def snippets(patches: DataFrame, files: DataFrame, key: str, patch: str, path: str, text: str, context: int = 3) -> DataFrame:
    """(key, shown) for each patch that touches a file with lines: the edited files in order of path, each under its name, its ranges under their line numbers where there are several, lines behind theirs."""
    lines = file_lines(files.withColumnRenamed(path, "path"), key, "path", text)
    edited = edited_ranges(patches, key, patch)
    sizes = lines.join(edited.select(key, "path").distinct(), [key, "path"], "left_semi").groupBy(key, "path").agg(F.max("line_no").alias("n_lines"))
    ranges = shown_ranges(edited, sizes, key, context)
    found = snippet_lines(ranges, lines, key).select(key, "path", "start", F.struct("line_no", numbered_line(F.col("line_no"), F.col("line")).alias("shown")).alias("l"))
    body = found.groupBy(key, "path", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["shown"]), "\n").alias("body"))
    whole = ranges.join(body, [key, "path", "start"], "left")
    head = F.when(F.col("n_ranges") > 1, F.format_string("\n--- Lines %d-%d ---", "start", "end"))
    per_range = whole.select(key, "path", F.struct("start", "end", F.concat_ws("\n", head, "body").alias("t")).alias("r"))
    joined: Column = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["t"]), "\n")
    per_file = per_range.groupBy(key, "path").agg(joined.alias("t")).select(key, F.struct("path", F.concat_ws("\n", F.concat(F.lit("=== File: "), F.col("path"), F.lit(" ===")), F.nullif("t", F.lit(""))).alias("t")).alias("f"))
    return per_file.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["t"]), "\n\n").alias("shown"))
