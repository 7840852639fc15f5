"""Change-aware filtering, churn hotspots and token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 50


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose path is among the changed ones."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def changed_findings(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that begin in, or overlap with, a changed range of their file.

    The path is the equality of the range join. A finding whose end is 0 counts by its start alone.
    """
    r = ranges.select(F.col("path").alias("changed_path"), F.col("start").alias("changed_start"), F.col("end").alias("changed_end"))
    begins = F.col("line_start").between(F.col("changed_start"), F.col("changed_end"))
    overlaps = (F.col("line_end") >= F.col("changed_start")) & (F.col("line_start") <= F.col("changed_end"))
    return found.join(r, (F.col("path") == F.col("changed_path")) & (begins | overlaps), "left_semi")


def churn(commits: DataFrame) -> DataFrame:
    """(path, commits, authors) of a commit table."""
    return commits.groupBy("path").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def hotspots(commits: DataFrame, scores: DataFrame, top: int = TOP) -> DataFrame:
    """(path, commits, authors, score, priority): the ``top`` most often changed files with a score get
    commits x (101 - score), all others keep commits x 11; by priority, then path.

    A report of the top files is the feature; the ranking is over all commits.
    """
    counted = churn(commits)
    best = counted.orderBy(F.desc("commits"), "path").limit(top).join(scores.select("path", "score"), "path").select("path", "score")
    ranked = counted.join(F.broadcast(best), "path", "left")  # top rows at most
    return ranked.withColumn("priority", F.when(F.col("score").isNotNull(), F.col("commits") * (101 - F.col("score"))).otherwise(F.col("commits") * 11).cast("long"))


#: Rows of the report that is shown.
SHOWN = 20


def top_hotspots(ranked: DataFrame, top: int = SHOWN) -> DataFrame:
    """The first ``top`` of the ranking by priority, ties by path, with their ``rank`` from 1; such a list is the feature."""
    first = ranked.orderBy(F.desc("priority"), "path").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "path")))


def findings_of_change(found: DataFrame, ranges: DataFrame, changed: DataFrame, whole_folder: bool = True) -> DataFrame:
    """Findings of changed files that touch their changed ranges.

    In a scan of a folder, a changed file without a usable range keeps all its findings; in a scan of
    single files it has none. Scores, secrets and vulnerabilities aren't narrowed to lines.
    """
    inside = changed_findings(changed_files(found, changed), ranges)
    if not whole_folder:
        return inside
    return inside.unionByName(changed_files(found, changed).join(ranges.select("path").distinct(), "path", "left_anti"))


def hotspot_smell(ranked: DataFrame) -> DataFrame:
    """Often changed files of a low score, on the scale of 0 to 10."""
    ten = F.col("score") / 10
    level = F.when((F.col("commits") >= 50) & (ten < 4), "critical").when(F.col("commits") >= 20, "alert").otherwise("warning")
    return ranked.where((F.col("commits") >= 5) & (ten <= 7)).select("path", F.lit("hotspot").alias("smell"), level.alias("severity"), "commits", "score")


# Bytes of a token, savings by score, prices of a million tokens, reads a month.
BYTES_PER_TOKEN = 4
SAVINGS = ((50, 0.5), (65, 0.45), (80, 0.40), (10**9, 0.10))
READS = 20 * 50 * 22
# End of fixed values.


def tokens(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / BYTES_PER_TOKEN).cast("long")


def savings(score: Column) -> Column:
    """The share of tokens that a cleaner file would save."""
    out = F.lit(SAVINGS[-1][1])
    for bound, share in reversed(SAVINGS[:-1]):
        out = F.when(score < bound, share).otherwise(out)
    return out


def token_costs(files: DataFrame, scores: DataFrame, price: float = 3.0) -> DataFrame:
    """(path, tokens, saved, cost): tokens of a file, tokens saved by a better one, and what one read costs."""
    n = tokens(F.col("n_bytes"))
    return files.join(scores.select("path", "score"), "path").select("path", n.alias("tokens"), F.floor(n * savings(F.col("score"))).cast("long").alias("saved"), F.round(n * price / 1_000_000, 3).alias("cost"))


# Findings and the refactoring pattern that answers each.
STRATEGIES = {
    "deep_nesting": "deep_nesting", "brain_method": "brain_method", "brain_class": "god_class", "bumpy_road": "bumpy_road", "complex_conditional": "complex_conditional", "complex_method": "complex_method",
    "god_class": "god_class", "long_parameter_list": "long_parameter_list", "primitive_obsession": "primitive_obsession", "duplicated_code": "duplicated_code", "message_chains": "message_chains", "file_bloat": "file_bloat",
    "global_data": "global_data", "lazy_element": "lazy_element", "paragraph_of_code": "paragraph_of_code", "excessive_comments": "excessive_comments", "long_scope_variable": "long_scope_variable", "long_switch": "long_switch",
    "magic_number": "magic_number", "low_cohesion": "low_cohesion", "data_class": "data_class", "refused_bequest": "refused_bequest", "shotgun_surgery": "shotgun_surgery", "parallel_inheritance": "parallel_inheritance",
    "long_method": "brain_method", "high_cyclomatic_complexity": "complex_method",
}
# End of fixed values.


def strategies(spark: SparkSession) -> DataFrame:
    """(smell, strategy), one row for each smell that has a refactoring pattern."""
    return spark.createDataFrame(sorted(STRATEGIES.items()), "smell string, strategy string")


def suggested(found: DataFrame, strategies: DataFrame) -> DataFrame:
    """(path, strategies): the sorted refactoring patterns for the smells of a file; smells without one add none."""
    return found.select("path", "smell").distinct().join(F.broadcast(strategies), "smell", "left").groupBy("path").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))
