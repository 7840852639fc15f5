"""Detectors that work on function extents; same columns as the line detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_comment, occurrences, trimmed
from .lines import with_thresholds
from .smells import branches, graded, running_depth, smell

UNNAMED = ("unknown", "anonymous")
REAL_LINES = 3

# Words that aren't types.
NOT_TYPES = (
    "func function def var const return if for while switch case break continue else nil null true false error err int string float64 float32 bool byte void auto self this new make len append range defer go"
).split()
# End of fixed values.


def named() -> Column:
    return ~F.col("name").isin(*UNNAMED)


def body_lines(functions: DataFrame) -> DataFrame:
    """The lines of each function with their number in it, from 1."""
    rows = functions.select("path", "lang", "ord", "name", "line_start", "line_count", F.posexplode("body").alias("at", "line"))
    text = trimmed(F.col("line"))
    return rows.select("path", "lang", "ord", "name", "line_start", "line_count", (F.col("at") + 1).alias("line_no"), text.alias("text")).withColumns(
        {"skip": (F.col("text") == "") | is_comment(F.col("text")), "opens": occurrences(F.col("text"), "{"), "closes": occurrences(F.col("text"), "}")}
    )


def brain_method(functions: DataFrame) -> DataFrame:
    """Long functions; the end is the line behind the last one."""
    level = graded(F.col("line_count"), F.col("func_loc_w"), F.col("func_loc_a"))
    return with_thresholds(functions).where(level.isNotNull()).select(*smell("brain_method", level, F.col("line_start"), F.col("line_start") + F.col("line_count"), F.col("line_count")))


def complex_method(functions: DataFrame) -> DataFrame:
    rows = body_lines(functions).groupBy("path", "lang", "ord", "line_start").agg((1 + F.sum(F.when(F.col("skip"), 0).otherwise(branches(F.col("text"))))).alias("n"))
    level = graded(F.col("n"), F.col("func_cc_w"), F.col("func_cc_a"))
    return with_thresholds(rows).where(level.isNotNull()).select(*smell("complex_method", level, F.col("line_start"), 0, F.col("n")))


def bumpy_road(functions: DataFrame) -> DataFrame:
    """Several separate stretches of deep nesting in one function of ten lines or more.

    A stretch begins at depth 2 and ends with the line that falls below it, which still counts; only
    stretches of more than three counted lines matter. Lines whose braces balance are passed over.
    """
    keys = ["path", "ord"]
    counted = body_lines(functions.where("line_count >= 10")).where(~F.col("skip") & ~((F.col("opens") > 0) & (F.col("opens") == F.col("closes"))))
    deep = running_depth(counted, keys)
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    marked = deep.withColumn("before", before).withColumn("starts", ((F.col("depth") >= 2) & (F.col("before") < 2)).cast("int"))
    in_bump = (F.col("depth") >= 2) | (F.col("before") >= 2)
    bumps = marked.withColumn("bump", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(in_bump).groupBy(*keys, "lang", "line_start", "line_count", "bump").agg(F.count("*").alias("n"), F.max("depth").alias("most"))
    per = with_thresholds(bumps.where("n > 3").groupBy(*keys, "lang", "line_start", "line_count").agg(F.count("*").alias("n"), F.max("most").alias("most")))
    level = F.when((F.col("n") >= 4) | (F.col("most") >= 4), "critical").when((F.col("n") >= 3) | (F.col("most") >= 3), "alert").otherwise("warning")
    return per.where(F.col("n") >= F.col("bumps")).select(*smell("bumpy_road", level, F.col("line_start"), F.col("line_start") + F.col("line_count") - 1, F.col("n")))


def real_counts(functions: DataFrame) -> DataFrame:
    return functions.where(named() & (F.col("line_count") >= REAL_LINES)).groupBy("path", "lang").agg(F.count("*").alias("n"))


def function_count(functions: DataFrame) -> DataFrame:
    return with_thresholds(real_counts(functions)).where(F.col("n") >= F.col("func_count_w")).select(*smell("function_count", "warning", 0, 0, F.col("n")))


def brain_class(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """A long file with many functions."""
    both = real_counts(functions).join(lines.groupBy("path").agg(F.count("*").alias("loc")), "path")
    return with_thresholds(both).where((F.col("n") >= F.col("brain_class")) & (F.col("loc") >= F.col("file_loc_w"))).select(*smell("brain_class", "alert", 0, 0, F.col("n")))


def lazy_element(functions: DataFrame) -> DataFrame:
    rows = with_thresholds(functions.where(named() & (F.col("line_count") > 0)))
    return rows.where(F.col("line_count") < F.col("lazy")).select(*smell("lazy_element", "warning", F.col("line_start"), 0, F.col("line_count")))


QUOTED = r"""["`][^"`]*(?:["`]|\z)"""


def without_strings(line: Column) -> Column:
    """A line with an x for each byte between quotes; a quote that isn't closed holds the rest of the line."""
    found = F.concat(F.regexp_extract_all(line, F.lit(f"({QUOTED})")), F.array(F.lit("")))
    pieces = F.arrays_zip(F.split(line, QUOTED).alias("a"), found.alias("b"))
    inside = lambda q: F.octet_length(F.regexp_replace(q, '["`]', "")).cast("int")
    joined = F.transform(pieces, lambda p: F.concat(F.coalesce(p["a"], F.lit("")), F.when(p["b"] == "", "").otherwise(F.concat(F.lit('"'), F.repeat(F.lit("x"), inside(p["b"])), F.lit('"')))))
    return F.when(line.rlike('["`]'), F.array_join(joined, "")).otherwise(line)


def fingerprint(functions: DataFrame) -> DataFrame:
    """``functions`` with ``words``: the set of their words once strings and numbers are evened out.

    Text between quotes (double or backtick, toggled, escapes not seen) becomes one x a byte, digits
    become 0; words of more than two characters are kept in lower case.
    """
    lines = F.transform(F.filter(F.transform("body", trimmed), lambda x: (x != "") & ~is_comment(x)), without_strings)
    words = F.filter(F.split(F.lower(F.regexp_replace(F.array_join(lines, "\n"), "[0-9]", "0")), "[^a-z0-9_]+"), lambda x: F.length(x) > 2)
    return functions.withColumn("words", F.array_distinct(words))


def code_duplication(functions: DataFrame) -> DataFrame:
    """Pairs of long enough functions of one file whose word sets have a Jaccard similarity of 0.75 or more.

    The pairs share the file's path, which is the join's key; functions of one name share the last
    one's words. Two functions without words are alike.
    """
    kept = with_thresholds(functions.where(named())).where(F.col("line_count") >= F.col("dup_lines"))
    last = Window.partitionBy("path", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = fingerprint(kept).withColumn("words", F.last("words").over(last)).select("path", "ord", "line_start", "words", "dup_similarity")
    other = rows.select("path", F.col("ord").alias("ord2"), F.col("line_start").alias("start2"), F.col("words").alias("words2"))
    union = F.size(F.array_union("words", "words2"))
    alike = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("words", "words2")) / union)
    pairs = rows.join(other, "path").where("ord < ord2").withColumn("alike", alike)
    return pairs.where(F.col("alike") >= F.col("dup_similarity")).select(*smell("code_duplication", "warning", F.col("line_start"), F.col("start2"), F.round("alike", 2)))


def cohesion(functions: DataFrame) -> DataFrame:
    """(path, n, isolated, cohesion): how many functions share no type name with a differently named one.

    Types are capitalised words of the first ten lines; files with three functions or fewer score 1.
    """
    rows = functions.where(named() & (F.col("line_count") >= 2))
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))
    last = rows.groupBy("path", "name").agg(F.max(F.struct("ord", F.slice("body", 1, 10).alias("head"))).alias("x")).select("path", "name", "x.head")
    words = F.split(F.array_join("head", " "), r"\s+")
    strip = lambda w: F.regexp_replace(w, r"""^[()\[\]{}*&,.;:"']+|[()\[\]{}*&,.;:"']+$""", "")
    types = F.array_distinct(F.filter(F.transform(words, strip), lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*NOT_TYPES) & w.rlike("^[A-Z]")))
    each = last.select("path", "name", F.explode(types).alias("type"))
    other = each.select("path", F.col("name").alias("name2"), "type")
    social = each.join(other, ["path", "type"]).where("name <> name2").select("path", "name").distinct().groupBy("path").agg(F.count("*").alias("shared"))
    names = last.groupBy("path").agg(F.count("*").alias("names"))
    joined = counts.join(names, "path").join(social, "path", "left")
    isolated = F.col("names") - F.coalesce("shared", F.lit(0))
    return joined.select("path", "n", isolated.alias("isolated"), F.when(F.col("n") <= 3, F.lit(1.0)).otherwise((F.col("n") - isolated) / F.col("n")).alias("cohesion"))


def low_cohesion(functions: DataFrame) -> DataFrame:
    level = F.when(F.col("cohesion") < 0.3, "alert").otherwise("warning")
    return cohesion(functions).where("n >= 5 and cohesion < 0.5").select(*smell("low_cohesion", level, 0, 0, F.col("cohesion")))
