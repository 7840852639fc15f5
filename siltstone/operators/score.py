"""Quality scores: penalties of a file, score, label, and roll-ups over files."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, function_smells, smells
from .functions import functions
from .lines import lines, with_thresholds

# Labels and their least scores, penalties and their caps.
LABELS = ((80, "Go Ahead"), (60, "Proceed with Care"), (40, "Needs Work"), (0, "Stop & Refactor"))
PENALTY = {"critical": 0.5, "alert": 0.25, "warning": 0.1}
SCORE_BOUNDS = (0, 10, 20, 30, 40, 50, 60, 70, 74, 75, 80, 85, 90, 94, 95, 100)
DURATION_BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
# End of fixed values.


def label(score: Column) -> Column:
    return reduce(lambda rest, x: F.when(score >= x[0], x[1]).otherwise(rest), sorted(LABELS[:-1]), F.lit(LABELS[-1][1]))


def prepared(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and functions of a file table, persisted, for callers that run many detectors over them.

    Both are dealt out by path before they are kept, so that the detectors' aggregates, windows and
    joins by path need no exchange of their own. What doesn't fit in memory goes to disk, and what an
    executor loses is computed again. The caller unpersists both when done.
    """
    return lines(files.repartition("path")).persist(StorageLevel.MEMORY_AND_DISK), functions(files).repartition("path").persist(StorageLevel.MEMORY_AND_DISK)


def all_smells(files: DataFrame, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The findings of all detectors over a file table; ``made`` holds its lines and functions if they exist already."""
    rows, extents = made or (lines(files), functions(files))
    parts = [f(rows) for f in smells.LINE_DETECTORS]
    parts += [f(extents) for f in (function_smells.brain_method, function_smells.complex_method, function_smells.bumpy_road, function_smells.function_count, function_smells.lazy_element, function_smells.code_duplication, function_smells.low_cohesion)]
    parts += [function_smells.brain_class(extents, rows), blocks.long_switch(files), blocks.long_scope_variable(extents)]
    return reduce(DataFrame.unionByName, parts)


def excess(value: Column, bound: Column, factor: float, cap: float) -> Column:
    return F.when(value <= bound, F.lit(0.0)).otherwise(F.least(F.lit(cap), factor * F.log2(value / bound)))


def score_of(loc: Column, functions_: Column, smell: Column, pairs: Column, cohesion: Column, n: Column) -> Column:
    """10 less the penalties, at least 1, times 10, rounded half up, from 0 to 100."""
    left = 10 - excess(loc, F.col("file_loc_w"), 1.5, 3.0) - excess(functions_, F.col("func_count_w"), 0.8, 1.5) - F.least(smell, F.lit(3.0)) - F.least(pairs * 0.15, F.lit(2.0))
    left = left - F.when((n >= 5) & (cohesion < 0.5), F.least((1 - cohesion) * 2, F.lit(1.5))).otherwise(0.0)
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.round(F.greatest(left, F.lit(1.0)) * 10, 9) + 0.5))).cast("int")


def quality(files: DataFrame, found: DataFrame, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path, lang, loc, n_smells, score, label) of every file, from its findings ``found``."""
    extents = made[1] if made else functions(files)
    loc = F.when(F.col("source") == "", 0).otherwise(F.size(F.split(F.regexp_replace("source", r"\n\z", ""), "\n")))
    base = files.select("path", "lang", loc.alias("loc"))
    weight = reduce(lambda rest, x: F.when(F.col("severity") == x[0], x[1]).otherwise(rest), PENALTY.items(), F.lit(0.0))
    per = found.groupBy("path").agg(F.sum(weight).alias("smell"), F.sum((F.col("smell") == "code_duplication").cast("int")).alias("pairs"), F.count("*").alias("n_smells"))
    real = function_smells.real_counts(extents).select("path", F.col("n").alias("real"))
    close = function_smells.cohesion(extents).select("path", F.col("n").alias("n_functions"), "cohesion")
    joined = with_thresholds(base.join(per, "path", "left").join(real, "path", "left").join(close, "path", "left"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    made_score = score_of(F.col("loc"), zero("real"), zero("smell"), zero("pairs"), F.coalesce("cohesion", F.lit(1.0)), zero("n_functions"))
    scored = joined.select("path", "lang", "loc", zero("n_smells").cast("long").alias("n_smells"), made_score.alias("score"))
    return scored.withColumn("label", label(F.col("score")))


def overall(scores: DataFrame) -> DataFrame:
    """(files, score, label): the mean of the file scores rounded down; 0 without files."""
    total = scores.agg(F.count("*").alias("files"), F.coalesce(F.floor(F.sum("score") / F.count("*")), F.lit(0)).cast("int").alias("score"))
    return total.withColumn("label", label(F.col("score")))


def distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("label").agg(F.count("*").alias("files"), F.min("score").alias("least"), F.max("score").alias("most"))


def severities(found: DataFrame) -> DataFrame:
    return found.groupBy("smell", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def risk_tier(found: DataFrame) -> DataFrame:
    """(path, tier) of files with vulnerability findings."""
    grave = F.max(F.col("severity").isin("critical", "alert").cast("int"))
    return found.groupBy("path").agg(F.when(grave == 1, "Remediate").when(F.max((F.col("severity") == "warning").cast("int")) == 1, "Monitor").otherwise("Clean").alias("tier"))


def histogram(rows: DataFrame, value: str, bounds: tuple = SCORE_BOUNDS, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, upto, n): how many values are at most each bound and above the one before; ``upto`` is null for those above all. Null values don't count."""
    bucket = reduce(lambda rest, b: F.when(F.col(value) <= b, F.lit(float(b))).otherwise(rest), sorted(bounds, reverse=True), F.lit(None).cast("double"))
    return rows.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("upto")).agg(F.count("*").alias("n"))


def by_severity(found: DataFrame) -> DataFrame:
    """(path, severity, rank, n, findings): the findings of each file by severity, critical ones first by ``rank``, each group by line and name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in PENALTY]), F.col("severity")), F.lit(0)), F.lit(len(PENALTY) + 1))
    grouped = found.groupBy("path", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_start", "smell"))).alias("found"))
    return grouped.select("path", "severity", rank.cast("int").alias("rank"), "n", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["smell"], x["line_start"].cast("string"))), ",").alias("findings"))
