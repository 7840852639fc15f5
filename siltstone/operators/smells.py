"""Detectors that need lines only. Each returns (path, smell, severity, line_start, line_end, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from .lines import with_thresholds

BRANCHES = ("if ", "else if ", "for ", "while ", "switch ", "case ", "&&", "||", "? ")
PRIMITIVES = ("string", "int", "float64", "float32", "bool", "int64", "int32", "byte", "rune", "uint")
CHAIN = r"\.[0-9A-Za-z_]+\([^)]*\)\.[0-9A-Za-z_]+\("


def smell(name: str, severity: Column | str, start, end, value: Column) -> list[Column]:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return [F.col("path"), F.lit(name).alias("smell"), level.alias("severity"), F.lit(start).cast("int").alias("line_start") if isinstance(start, int) else start.cast("int").alias("line_start"), F.lit(end).cast("int").alias("line_end") if isinstance(end, int) else end.cast("int").alias("line_end"), value.cast("double").alias("value")]


def graded(value: Column, warning: Column, alert: Column, critical: Column | None = None) -> Column:
    level = F.when(value >= alert, "alert").when(value >= warning, "warning")
    return level if critical is None else F.when(value >= critical, "critical").when(value >= alert, "alert").when(value >= warning, "warning")


def branches(text: Column) -> Column:
    """Branch tokens of a line; the counts overlap on purpose, so that ``else if`` counts twice."""
    low = F.lower(text)
    return sum((occurrences(low, b) for b in BRANCHES[1:]), occurrences(low, BRANCHES[0]))


def signature(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("func ") | low.startswith("def ") | low.startswith("async def ")


def running_depth(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``depth``: the sum of opens less closes so far, never below 0 at any line.

    Clamping at every step equals the prefix sum less its smallest value so far (or 0), so two
    window sums over one sort are enough.
    """
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("s", F.sum(F.col("opens") - F.col("closes")).over(w))
    return summed.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).drop("s")


def deep_nesting(lines: DataFrame) -> DataFrame:
    """The deepest brace level of a file, at the first line that reaches it."""
    deep = running_depth(lines.where(~F.col("blank") & ~F.col("comment")).select("path", "lang", "line_no", "opens", "closes"), ["path"])
    reach = F.coalesce(F.lag("depth").over(Window.partitionBy("path").orderBy("line_no")), F.lit(0)) + F.col("opens")
    top = deep.withColumn("reach", reach).groupBy("path", "lang").agg(F.max("reach").alias("most"), F.max(F.struct("reach", (-F.col("line_no")).alias("at"))).alias("best"))
    level = graded(F.col("most"), F.col("nesting_w"), F.col("nesting_a"))
    at = -F.col("best.at")
    return with_thresholds(top).where(level.isNotNull()).select(*smell("deep_nesting", level, at, at, F.col("most")))


def file_bloat(lines: DataFrame) -> DataFrame:
    counted = with_thresholds(lines.groupBy("path", "lang").agg(F.count("*").alias("loc")))
    level = graded(F.col("loc"), F.col("file_loc_w"), F.col("file_loc_a"), F.col("file_loc_c"))
    return counted.where(level.isNotNull()).select(*smell("file_bloat", level, 0, 0, F.col("loc")))


def complex_conditional(lines: DataFrame) -> DataFrame:
    low = F.lower("text")
    n = occurrences(F.col("text"), "&&") + occurrences(F.col("text"), "||")
    rows = lines.where(~F.col("blank") & ~F.col("comment") & (low.startswith("if ") | low.startswith("while "))).withColumn("n", n)
    level = graded(F.col("n"), F.col("conditional_w"), F.col("conditional_a"))
    return with_thresholds(rows).where(level.isNotNull()).select(*smell("complex_conditional", level, F.col("line_no"), F.col("line_no"), F.col("n")))


def long_parameter_list(lines: DataFrame) -> DataFrame:
    """Commas between the first parenthesis and the next closing one, plus one; a receiver counts as the list."""
    inside = F.regexp_extract("text", r"^[^(]*\(([^)]*)\)", 1)
    n = F.when(F.trim(inside) == "", 0).otherwise(occurrences(inside, ",") + 1)
    rows = lines.where(~F.col("blank") & ~F.col("comment") & signature(F.col("text"))).withColumn("n", n)
    level = graded(F.col("n"), F.col("args_w"), F.col("args_a"))
    return with_thresholds(rows).where(level.isNotNull()).select(*smell("long_parameter_list", level, F.col("line_no"), F.col("line_no"), F.col("n")))


def message_chains(lines: DataFrame) -> DataFrame:
    n = F.regexp_count("text", F.lit(CHAIN))
    return lines.where(~F.col("comment") & (n >= 2)).select(*smell("message_chains", "warning", F.col("line_no"), F.col("line_no"), n))


def primitive_obsession(lines: DataFrame) -> DataFrame:
    low = F.lower("text")
    parts = [occurrences(low, p + end) for p in PRIMITIVES for end in (",", ")", " ")] + [low.endswith(p).cast("int") for p in PRIMITIVES]
    n = sum(parts[1:], parts[0])
    return lines.where(signature(F.col("text")) & (n >= 4)).select(*smell("primitive_obsession", "warning", F.col("line_no"), F.col("line_no"), n))


def paragraph_of_code(lines: DataFrame) -> DataFrame:
    """Runs of lines that are neither blank nor comments: islands of equal difference to their rank."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    solid = lines.where(~F.col("blank") & ~F.col("comment")).withColumn("island", F.col("line_no") - rank)
    runs = with_thresholds(solid.groupBy("path", "lang", "island").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count("*").alias("n")))
    return runs.where(F.col("n") > F.col("paragraph")).select(*smell("paragraph_of_code", "warning", F.col("a"), F.col("b"), F.col("n")))


def excessive_comments(lines: DataFrame) -> DataFrame:
    """Share of comment lines among non-blank ones; a line that begins with a lone * isn't one here."""
    note = F.col("text").rlike(r"^(//|#|/\*|\*/)")
    counted = lines.groupBy("path", "lang").agg(F.count("*").alias("all"), F.sum((~F.col("blank")).cast("int")).alias("solid"), F.sum(note.cast("int")).alias("notes"))
    share = F.col("notes") / F.col("solid")
    level = F.when(share >= F.col("comments") * 2, "alert").when(share >= F.col("comments"), "warning")
    return with_thresholds(counted.where("all >= 10 and solid > 0")).where(level.isNotNull()).select(*smell("excessive_comments", level, 0, 0, share))


def global_data(lines: DataFrame) -> DataFrame:
    """Declarations outside functions: a definition opens one, a line that is only a brace closes it."""
    text, low = F.col("text"), F.lower("text")
    opening = text.contains("func ") | text.startswith("def ") | text.startswith("class ")
    marker = F.when(opening, 1).when(text == "}", 0)
    inside = F.coalesce(F.last(marker, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    declared = low.startswith("var ") | low.startswith("const ") | (low.contains(" = ") & ~low.contains("func") & ~low.contains("import") & ~low.contains("package"))
    rows = lines.where(~F.col("blank") & ~F.col("comment")).withColumn("marker", marker).withColumn("inside", inside)
    counted = with_thresholds(rows.where(F.col("marker").isNull() & (F.col("inside") == 0) & declared).groupBy("path", "lang").agg(F.count("*").alias("n")))
    return counted.where(F.col("n") >= F.col("globals_")).select(*smell("global_data", "warning", 0, 0, F.col("n")))


LINE_DETECTORS = (deep_nesting, file_bloat, complex_conditional, long_parameter_list, message_chains, primitive_obsession, paragraph_of_code, excessive_comments, global_data)
