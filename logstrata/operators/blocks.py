"""Error blocks: the lines that belong to a matched line (stack traces, indented detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import near

FILE = ["session_id", "path"]
PIECE = 1024

# How the first line, the following lines and the end of an error look.
START = r"""^(?:\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}.*(?:ERROR|FATAL|CRITICAL)|E, \[\d{4}-\d{2}-\d{2}|\s*Traceback \(most recent call last\)|Exception in thread|panic:|\{\s*"(?:level|severity)"\s*:\s*"(?:error|fatal|critical)"|goroutine \d+|FATAL:|PANIC:)"""
CONTINUATION = r"""^(?:\s+at |\s+File "[^"]+", line \d+|\s+from .+:\d+:in|\s+.*\.go:\d+|\s+\w+\(.*\)|Caused by:|\s+\.{3}|\s{2,}\S)"""
END = r"""^(?:\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}.*(?:INFO|DEBUG|TRACE)|I, \[\d{4}-\d{2}-\d{2}|\{\s*"(?:level|severity)"\s*:\s*"(?:info|debug)"|$|[A-Z][a-z]+.*:$)"""


def block_format(content: Column) -> Column:
    """Format of a block by its matched line: json, timestamp, ruby, python_stack, go_stack or text."""
    return (
        F.when(F.trim(content).startswith("{") & content.contains('"level"'), "json")
        .when(content.rlike(r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"), "timestamp")
        .when(content.startswith("E, [") | content.startswith("I, ["), "ruby")
        .when(content.contains("Traceback"), "python_stack")
        .when(content.rlike(r"goroutine|\.go:"), "go_stack")
        .otherwise("text")
    )


def line_codes(content: Column) -> tuple[Column, Column]:
    """One letter per line for the forward and for the backward scan.

    Forward: E ends, C continues, B blank, N other. Backward: S starts another entry, X the same but looks
    like a continuation, C, B and N as before.
    """
    cont, blank = content.rlike(CONTINUATION), content.rlike(r"^\s*$")
    start = content.rlike(START)
    forward = F.when(content.rlike(END), "E").when(cont, "C").when(blank, "B").otherwise("N")
    backward = F.when(start & cont, "X").when(start, "S").when(cont, "C").when(blank, "B").otherwise("N")
    return forward, backward


#: Forward, from a match on: blanks, then continuations with single blanks between them, and a blank after the last one.
REACH = "^B*C(?:C|B(?=C))*B?"


def _pieces(marked: DataFrame, matched: Column, extra: list[str]) -> DataFrame:
    """A row for each piece of a file, PIECE lines: its letters as two strings, its matches, and what a scan that enters or leaves the
    piece needs to know. Only letters are shuffled, never text; adjacent lines meet in lists before that."""
    forward, backward = line_codes(F.col("content"))
    mark = F.when(F.coalesce(matched, F.lit(False)), F.struct("line_no", *extra))
    rows = marked.select(*FILE, F.floor((F.col("line_no") - 1) / PIECE).alias("piece"), F.struct("line_no", forward.alias("f"), backward.alias("b"), mark.alias("mark")).alias("line"))
    lines = rows.groupBy(*FILE, "piece").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    pieces = lines.select(
        *FILE, "piece", F.col("lines")[0]["line_no"].alias("base"), F.size("lines").alias("n"), F.array_join("lines.f", "").alias("f"),
        F.array_join("lines.b", "").alias("b"), F.filter("lines.mark", lambda m: m.isNotNull()).alias("marks"),
    )
    own = Window.partitionBy(*FILE).orderBy("piece")  # a row for each PIECE lines
    # the first line of a file is no part of a block above a match; it counts as the start of an entry if it looks like a continuation
    first = F.lag("piece").over(own).isNull()
    head = F.when(F.left("b", F.lit(1)).isin("C", "X"), "X").otherwise("N")
    pieces = pieces.withColumn("b", F.when(first, F.concat(head, F.expr("substring(b, 2)"))).otherwise(F.col("b"))).withColumn("next", F.left(F.lead("f").over(own), F.lit(1)))

    at = lambda pos: F.when(pos > 0, F.col("base") + pos - 1)
    tail = F.concat("f", F.coalesce("next", F.lit("N")))  # with the letter after the piece, to know whether a last blank goes on
    stop = lambda text, ahead: F.when(F.length(text) > 1, F.length(F.regexp_extract(text, "^(?:C|B(?=C))*", 0)) + 1 + ahead)
    blanks = F.length(F.regexp_extract("f", "^B*", 0))
    inner = F.expr("substring(tail, blanks + 1)")
    pieces = pieces.withColumn("tail", tail).withColumn("blanks", blanks)
    pieces = pieces.withColumn("stop", stop(F.col("tail"), F.lit(0))).withColumn("inner_stop", stop(inner, F.col("blanks")))
    place = lambda c: F.when(F.col(c) <= F.col("n"), F.struct(at(F.col(c)).alias("at"), (F.expr(f"substring(f, {c}, 1)") == "B").alias("blank")))
    pieces = pieces.withColumn("stop", place("stop")).withColumn("inner_stop", place("inner_stop"))
    after = own.rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.withColumn("next_stop", F.first("stop", ignorenulls=True).over(after))
    filled = F.when(F.col("blanks") < F.col("n"), F.struct((F.expr("substring(f, blanks + 1, 1)") == "C").alias("continues"), F.coalesce("inner_stop", "next_stop").alias("stop")))
    pieces = pieces.withColumn("next_filled", F.first(filled, ignorenulls=True).over(after))
    pieces = pieces.withColumn("last_line", F.max(F.col("base") + F.col("n") - 1).over(Window.partitionBy(*FILE)))

    # backward: the last line before the piece that is neither continuation nor blank, and the first continuation after it
    run = F.length(F.regexp_extract("b", "[CB]*$", 0))
    pieces = pieces.withColumn("wall", F.when(run < F.col("n"), F.struct(at(F.col("n") - run).alias("at"), (F.expr(f"substring(b, n - length(regexp_extract(b, '[CB]*$', 0)), 1)") == "X").alias("looks"))))
    lead = F.locate("C", F.right("b", run))
    pieces = pieces.withColumn("lead", at(F.when(lead > 0, F.col("n") - run + lead))).withColumn("segment", F.count("wall").over(own))
    pieces = pieces.withColumn("lead", F.first("lead", ignorenulls=True).over(Window.partitionBy(*FILE, "segment").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.withColumn("wall", F.last("wall", ignorenulls=True).over(own))
    return pieces.withColumn("wall_before", F.lag("wall").over(own)).withColumn("lead_before", F.lag("lead").over(own))


def block_bounds(marked: DataFrame, matched: Column, extra: list[str] | None = None) -> DataFrame:
    """(session_id, path, line_no, block_start, block_end, covered) of the matched lines, and the columns `extra`.

    A block goes from the match over what belongs to it, to where that ends, however far. Files are cut into pieces, each scanned on
    its own as if entered in any state; where a scan leaves a piece, the next piece's summary says where it ends. covered: the block
    of an earlier match reaches this line.
    """
    extra = extra or []
    hits = _pieces(marked, matched, extra).select("*", F.explode("marks").alias("mark"))
    hits = hits.withColumn("i", (F.col("mark.line_no") - F.col("base") + 1).cast("int")).withColumn("line_no", F.col("mark.line_no"))
    hits = hits.withColumn("after", F.expr("substring(f, i + 1)")).withColumn("before", F.expr("left(b, i - 1)"))
    hits = hits.withColumn("reach", F.length(F.regexp_extract("after", REACH, 0)))
    piece_end = F.col("base") + F.col("n") - 1
    to_stop = lambda c: F.coalesce(F.when(F.col(f"{c}.blank"), F.col(f"{c}.at")).otherwise(F.col(f"{c}.at") - 1), F.col("last_line"))
    waits = F.col("after").rlike("^B*$") & F.col("next").isNotNull()
    leaves = (F.col("reach") > 0) & (F.col("reach") == F.length("after")) & ((F.right("after", F.lit(1)) == "C") | (F.col("next") == "C"))
    end = (
        F.when(waits, F.when(F.col("next_filled.continues"), to_stop("next_filled.stop")).otherwise(F.col("line_no")))
        .when(leaves & F.col("next").isNotNull(), to_stop("next_stop")).otherwise(F.least(F.col("line_no") + F.col("reach"), piece_end))
    )
    # backward, within the piece if there is a wall, else from the pieces before
    run = F.length(F.regexp_extract("before", "[CB]*$", 0))
    local = F.length("before") > run
    looks = F.when(local, F.expr("substring(before, length(before) - length(regexp_extract(before, '[CB]*$', 0)), 1)") == "X").otherwise(F.coalesce("wall_before.looks", F.lit(False)))
    wall = F.when(local, F.col("line_no") - run - 1).otherwise(F.col("wall_before.at"))
    lead = F.locate("C", F.right("before", run))
    lead = F.when(lead > 0, F.col("line_no") - run + lead - 1)
    start = F.when(looks, wall + 1).otherwise(F.coalesce(F.when(~local, F.col("lead_before")), lead, F.col("line_no")))
    hits = hits.select(*FILE, "piece", "line_no", *[F.col(f"mark.{c}").alias(c) for c in extra], start.alias("block_start"), end.alias("block_end"))
    hits = cut_lineage(hits)
    ends = hits.groupBy(*FILE, "piece").agg(F.max("block_end").alias("end"))
    earlier = Window.partitionBy(*FILE).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*FILE, "piece", F.max("end").over(earlier).alias("before"))
    local = Window.partitionBy(*FILE, "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("own", F.max("block_end").over(local)).join(ends, [*FILE, "piece"])
    covered = F.coalesce(F.greatest("own", "before") >= F.col("line_no"), F.lit(False))
    return hits.select(*FILE, "line_no", *extra, "block_start", "block_end", covered.alias("covered"))


def error_blocks(lines: DataFrame, matched: Column, text: DataFrame | None = None, first_only: bool = False) -> DataFrame:
    """Matched lines with `block_start`, `block_end`, the block's lines in `block`, `context_before/after` (5 lines) and `covered`.

    The bounds come first, from letters. Text is read in a second scan, and only lines near matches are shuffled. `text` has
    (session_id, path, line_no, content) if that is cheaper than reading `lines` again; `first_only` leaves out covered matches before
    any text is read, so a trace with many matches is gathered once.
    """
    extra = [c for c in lines.columns if c not in (*FILE, "line_no", "content")]
    hits = block_bounds(lines, matched, extra)
    hits = cut_lineage(hits.where("not covered") if first_only else hits)
    ranges = hits.select(*FILE, F.col("line_no").alias("hit"), "block_start", "block_end", F.greatest(F.least("block_start", F.col("line_no") - 5), F.lit(1)).alias("first"), F.greatest("block_end", F.col("line_no") + 5).alias("last"))
    text = (lines if text is None else text).select(*FILE, "line_no", "content")
    rows = near(text, ranges).withColumn("line", F.struct("line_no", "content"))
    inside = lambda a, b: F.sort_array(F.collect_list(F.when(F.col("line_no").between(a, b), F.col("line")))).getField("content")
    hit = F.col("hit")
    found = rows.groupBy(*FILE, "hit").agg(
        F.max(F.when(F.col("line_no") == hit, F.col("content"))).alias("content"), inside(F.col("block_start"), F.col("block_end")).alias("block"),
        inside(hit - 5, hit - 1).alias("context_before"), inside(hit + 1, hit + 5).alias("context_after"),
    ).withColumnRenamed("hit", "line_no")
    out = hits.join(found, [*FILE, "line_no"])
    return out.select(*lines.columns, "block_start", "block_end", "block", "context_before", "context_after", "covered")


def first_per_block(matches: DataFrame) -> DataFrame:
    """Matches that do not lie inside the block of an earlier match."""
    return matches.where("not covered")


def trace_dialect(block: Column) -> Column:
    """python_stack, java_stack or go_stack, by the lines of a block, whatever its first line looks like; null without a trace."""
    has = lambda pattern: F.exists(block, lambda x: x.rlike(pattern))
    return (
        F.when(has(r"Traceback \(most recent call last\)"), "python_stack").when(has(r"^\s+at \S+\(.*\)\s*$"), "java_stack")
        .when(has(r"^goroutine \d+|^\s+\S+\.go:\d+"), "go_stack")
    )


def stack_trace(block: Column, fmt: Column) -> Column:
    """Trace lines of a block by dialect; null when there are none."""
    trim = lambda xs: F.transform(xs, lambda x: F.trim(x, F.lit(" \t\r")))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a value that is used more than once is computed once
    first = lambda flags: F.array_position(flags, F.lit(True)).cast("int")
    outside = lambda x, i: (i > 0) & ~(x.startswith(" ") | x.contains("File") | x.contains("Traceback"))
    inside = lambda tail: once(first(F.transform(tail, outside)), lambda n: F.when(n > 0, F.slice(tail, 1, n - 1)).otherwise(tail))
    head = first(F.transform(block, lambda x: x.contains("Traceback")))
    python = once(head, lambda n: F.when(n > 0, once(F.slice(block, n, F.size(block)), inside)))
    java = F.filter(block, lambda x: x.contains("Exception") | x.rlike(r"^\s*at ") | x.contains("Caused by:"))
    go = F.filter(block, lambda x: x.rlike(r"panic:|goroutine|\.go:"))
    lines = F.when(fmt == "python_stack", trim(python)).when(fmt == "java_stack", trim(java)).when(fmt == "go_stack", trim(go))
    return F.get(F.filter(F.array(lines), lambda xs: F.size(xs) > 0), 0)
